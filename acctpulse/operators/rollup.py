"""The account dimension: one row per company with user, event and ticket measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acctpulse.functions.scores import is_open, is_open_critical, or_zero
from acctpulse.functions.times import AsOf, as_of_col
from acctpulse.schemas import STORE_SCHEMAS


def user_activity(events: DataFrame) -> DataFrame:
    """Events folded to one row per (user, type) before anything is joined.

    The sums combine in the map tasks, so what is shuffled grows with users and types, not with events, and
    a user holding a large share of the events is a handful of rows afterwards.
    """
    return events.filter(F.col("user_id").isNotNull()).groupBy("user_id", "event_type").agg(
        F.count("id").alias("events"),
        F.min("occurred_at").alias("first_at"),
        F.max("occurred_at").alias("last_at"),
    )


def event_measures(activity: DataFrame, users: DataFrame, count_users: bool = False) -> DataFrame:
    """Event measures per company from (user, type) rows."""
    owner = users.filter(F.col("company_id").isNotNull()).select(F.col("id").alias("user_id"), "company_id")
    measures = [
        F.sum("events").alias("events"),
        F.min("first_at").alias("first_event_at"),
        F.max("last_at").alias("last_event_at"),
        F.count_distinct("event_type").alias("types"),
    ]
    if count_users:
        measures.append(F.count_distinct("user_id").alias("users_with_events"))
    return activity.join(owner, "user_id").groupBy("company_id").agg(*measures)


def user_measures(users: DataFrame) -> DataFrame:
    return users.filter(F.col("company_id").isNotNull()).groupBy("company_id").agg(
        F.count("id").alias("users"),
        F.count_if(F.col("role") == "admin").alias("admins"),
        F.max("last_login").alias("last_login_at"),
    )


def ticket_measures(tickets: DataFrame) -> DataFrame:
    status, severity = F.col("status"), F.col("severity")
    return tickets.filter(F.col("company_id").isNotNull()).groupBy("company_id").agg(
        F.count("id").alias("tickets"),
        F.count_if(is_open(status)).alias("open"),
        F.count_if(is_open_critical(status, severity)).alias("critical"),
    )


def fanout_rows(events, total_users, users_with_events):
    """Rows of companies LEFT JOIN users LEFT JOIN events: a user without events and a company without users
    still give one row."""
    return F.greatest(events + total_users - users_with_events, F.lit(1))


def account_rollup(
    companies: DataFrame,
    users: DataFrame,
    events: DataFrame,
    tickets: DataFrame,
    as_of: AsOf,
    mode: str = "exact",
    activity: DataFrame | None = None,
) -> DataFrame:
    """Account dimension in one of two modes.

    ``exact`` counts every event and ticket once. ``fanout`` returns what one four-way LEFT JOIN over the
    same tables returns, where each event row meets each ticket row of its company: the inflated counts come
    from the branch totals by multiplication, and the product itself is never built.

    ``activity`` may give the (user, type) rows of :func:`user_activity` from a log, so that the events are
    not scanned again.
    """
    fanout = mode == "fanout"
    if mode not in ("exact", "fanout"):
        raise ValueError(f"unknown mode: {mode}")
    activity = user_activity(events) if activity is None else activity
    joined = (
        companies.withColumnRenamed("id", "company_id")
        .join(user_measures(users), "company_id", "left")
        .join(event_measures(activity, users, count_users=fanout), "company_id", "left")
        .join(ticket_measures(tickets), "company_id", "left")
    )
    n_events, n_tickets = or_zero(F.col("events")), or_zero(F.col("tickets"))
    n_open, n_critical = or_zero(F.col("open")), or_zero(F.col("critical"))
    if fanout:
        rows = fanout_rows(n_events, or_zero(F.col("users")), or_zero(F.col("users_with_events")))
        n_events = n_events * F.greatest(n_tickets, F.lit(1))
        n_open, n_critical = n_open * rows, n_critical * rows
    return joined.select(
        "company_id",
        F.col("name").alias("company_name"),
        "plan",
        "mrr_cents",
        "churned_at",
        or_zero(F.col("users")).alias("total_users"),
        or_zero(F.col("admins")).alias("admin_count"),
        "last_login_at",
        "first_event_at",
        "last_event_at",
        n_events.alias("total_events"),
        or_zero(F.col("types")).alias("distinct_event_types"),
        n_open.alias("open_tickets"),
        n_critical.alias("critical_tickets"),
        as_of_col(as_of).alias("synced_at"),
    ).select(*STORE_SCHEMAS["dim_accounts"].names)
