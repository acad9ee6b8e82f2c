"""Daily activity facts: incremental batches, their fold, and measures over the trailing window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from acctpulse.functions.keyed import latest_k
from acctpulse.functions.scores import or_zero, seat_score
from acctpulse.functions.times import AsOf, as_of_col, trailing_start
from acctpulse.sources.readers import NO_MARK, incremental, trailing

DAILY_KEYS = ["company_id", "event_date", "event_type"]


def user_days(events: DataFrame, *more: Column) -> DataFrame:
    """One row per (user, day, type). Every later distinct count is a plain count of these rows."""
    return events.filter(F.col("user_id").isNotNull()).groupBy(
        "user_id", F.to_date("occurred_at").alias("event_date"), "event_type"
    ).agg(
        F.count("*").alias("events"),
        F.max("id").alias("max_id"),
        F.min("occurred_at").alias("first_at"),
        F.max("occurred_at").alias("last_at"),
        *more,
    )


def fold_user_days(log: DataFrame) -> DataFrame:
    """(user, day, type) rows of any number of batches as if they had been one."""
    return log.groupBy("user_id", "event_date", "event_type").agg(
        F.sum("events").alias("events"),
        F.max("max_id").alias("max_id"),
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
    )


def activity_of(log: DataFrame) -> DataFrame:
    """(user, type) activity for :func:`acctpulse.operators.rollup.account_rollup` from a log of user days."""
    return log.groupBy("user_id", "event_type").agg(
        F.sum("events").alias("events"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at")
    )


def fold_activity(activity: DataFrame) -> DataFrame:
    """(user, type) activity of several parts as one."""
    return activity.groupBy("user_id", "event_type").agg(
        F.sum("events").alias("events"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at")
    )


def events_with_company(user_rows: DataFrame, users: DataFrame) -> DataFrame:
    """Attach the company; rows of unknown users or users without a company drop out."""
    owner = users.filter(F.col("company_id").isNotNull()).select(F.col("id").alias("user_id"), "company_id")
    return user_rows.join(owner, "user_id")


def facts_of(user_rows: DataFrame, users: DataFrame) -> DataFrame:
    """Daily facts from (user, day, type) rows."""
    return events_with_company(user_rows, users).groupBy(*DAILY_KEYS).agg(
        F.sum("events").alias("event_count"),
        F.count("*").alias("unique_users"),
        F.max("max_id").alias("max_id"),
    )


def observed_facts(user_rows: DataFrame, users: DataFrame, counts: Observation) -> DataFrame:
    """Daily facts as :func:`facts_of` gives them; ``counts`` holds ``orphan_events``, those of no company, once the facts
    have been written. They are counted behind the last shuffle, where a repeated task does not count twice."""
    owner = users.filter(F.col("company_id").isNotNull()).select(F.col("id").alias("user_id"), "company_id")
    facts = user_rows.join(owner, "user_id", "left").groupBy(*DAILY_KEYS).agg(
        F.sum("events").alias("event_count"),
        F.count("*").alias("unique_users"),
        F.max("max_id").alias("max_id"),
    )
    orphan = F.sum(F.when(F.col("company_id").isNull(), F.col("event_count")))
    return facts.observe(counts, F.coalesce(orphan, F.lit(0)).alias("orphan_events")).filter("company_id IS NOT NULL")


def events_daily(events: DataFrame, users: DataFrame, hwm: int | Column | None = None) -> DataFrame:
    """New events per company, day and type: event count, distinct users and highest id."""
    fresh = events if hwm is None else incremental(events, hwm)
    return facts_of(user_days(fresh), users)


def fold_daily(log: DataFrame) -> DataFrame:
    """State of the daily facts after any number of batches: counts add up, uniques keep the largest.

    Sum and max do not care about order or grouping, so one aggregation over the batch log equals applying
    the batches one by one, and a late batch for an old day needs no special case.
    """
    return log.groupBy(*DAILY_KEYS).agg(
        F.sum("event_count").alias("event_count"), F.max("unique_users").alias("unique_users")
    )


def refresh_days(events: DataFrame, users: DataFrame, batch: DataFrame) -> DataFrame:
    """Exact facts for the days a batch touched, recomputed from the events of those days only.

    Folding takes the largest per-batch unique count, which is too low when a day is split over batches;
    this gives the true count for the touched days.
    """
    touched = batch.select("event_date").distinct()
    since = batch.agg(F.min("event_date").cast("timestamp_ntz")).scalar()
    candidates = events.filter(F.col("occurred_at") >= since).withColumn("event_date", F.to_date("occurred_at"))
    on_days = candidates.join(touched, "event_date", "left_semi").drop("event_date")
    return events_daily(on_days, users).drop("max_id")


def max_id(batch: DataFrame) -> DataFrame:
    """New high-water mark of a batch (one row; NULL for an empty batch)."""
    return batch.agg(F.max("max_id").alias("last_synced_id"))


def advance_watermark(state: DataFrame, table: str, batch: DataFrame, as_of: AsOf) -> DataFrame:
    """Mark table after a batch: the batch's mark replaces the table's row, an empty batch changes nothing."""
    new = max_id(batch).filter(F.col("last_synced_id").isNotNull()).select(
        F.lit(table).alias("table_name"), "last_synced_id", as_of_col(as_of).alias("last_synced_at")
    )
    both = state.withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)))
    return both.groupBy("table_name").agg(
        F.max_by("last_synced_id", "_turn").alias("last_synced_id"),
        F.max_by("last_synced_at", "_turn").alias("last_synced_at"),
    )


def watermark(state: DataFrame, table: str, default: int = NO_MARK) -> int:
    """Stored mark of a table; ``default`` when it was never synced. One row reaches the driver."""
    row = state.filter(F.col("table_name") == table).agg(F.max("last_synced_id").alias("mark")).first()
    return default if row is None or row["mark"] is None else row["mark"]


def active_users_30d(daily: DataFrame, as_of: AsOf) -> DataFrame:
    """Trailing sum of daily unique users: a person counts once per day and event type."""
    return trailing(daily, "event_date", as_of).groupBy("company_id").agg(
        F.sum("unique_users").alias("active_users_30d")
    )


def active_users_exact(events: DataFrame, users: DataFrame, as_of: AsOf) -> DataFrame:
    """Distinct people with an event in the trailing window."""
    recent = events.filter(F.col("occurred_at") >= trailing_start(as_of).cast("timestamp_ntz"))
    people = recent.select("user_id").filter(F.col("user_id").isNotNull()).distinct()
    return events_with_company(people, users).groupBy("company_id").agg(F.count("*").alias("active_users_30d"))


def with_seats(accounts: DataFrame, active: DataFrame) -> DataFrame:
    """Accounts plus ``active_users_30d`` and ``seat_score``; accounts without activity keep a row."""
    users = or_zero(F.col("active_users_30d"))
    return accounts.join(active, "company_id", "left").withColumns(
        {"active_users_30d": users, "seat_score": seat_score(users, F.col("total_users"))}
    )


def seat_utilization(accounts: DataFrame, daily: DataFrame, as_of: AsOf) -> DataFrame:
    return with_seats(accounts, active_users_30d(daily, as_of)).select(
        "company_id", "total_users", "active_users_30d", "seat_score"
    )


def seat_utilization_exact(accounts: DataFrame, events: DataFrame, users: DataFrame, as_of: AsOf) -> DataFrame:
    return with_seats(accounts, active_users_exact(events, users, as_of)).select(
        "company_id", "total_users", "active_users_30d", "seat_score"
    )


def recent_event_mix(daily: DataFrame, as_of: AsOf, k: int = 5) -> DataFrame:
    """Largest event types of the trailing window per account; equal volumes go by type name."""
    volume = trailing(daily, "event_date", as_of).groupBy("company_id", "event_type").agg(
        F.sum("event_count").alias("cnt")
    )
    return latest_k(volume, "company_id", [F.desc("cnt"), F.asc("event_type")], k)
