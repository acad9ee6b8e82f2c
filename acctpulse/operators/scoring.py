"""Health components, total and score snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acctpulse.functions import scores as rules
from acctpulse.functions.times import AsOf, as_of_col
from acctpulse.schemas import SCORE_RANGE

PARTS = ("login_recency_score", "adoption_score", "ticket_score", "mrr_tier_score", "seat_score")


def health_components(
    accounts: DataFrame, seats: DataFrame | None, as_of: AsOf, keep: Sequence[str] = ()
) -> DataFrame:
    """Five sub-scores per account.

    ``seats`` holds ``seat_score`` per company. Pass ``None`` when ``accounts`` already carries the column
    (:func:`acctpulse.operators.daily.with_seats`), which saves a join. ``keep`` names further account
    columns to carry along.
    """
    if seats is not None:
        accounts = accounts.join(seats.select("company_id", "seat_score"), "company_id", "left")
    col = F.col
    return accounts.select(
        "company_id",
        "company_name",
        "plan",
        "mrr_cents",
        "churned_at",
        rules.login_recency(col("last_login_at"), as_of).alias("login_recency_score"),
        rules.adoption_score(col("distinct_event_types")).alias("adoption_score"),
        rules.ticket_score(col("critical_tickets"), col("open_tickets")).alias("ticket_score"),
        rules.plan_tier(col("plan")).alias("mrr_tier_score"),
        rules.or_zero(col("seat_score")).alias("seat_score"),
        *keep,
    )


def with_total(components: DataFrame) -> DataFrame:
    total = F.col(PARTS[0])
    for part in PARTS[1:]:
        total = total + F.col(part)
    return components.withColumn("total_score", total)


def current_health(components: DataFrame) -> DataFrame:
    return with_total(components).select(
        "company_id", "company_name", "plan", "churned_at", *PARTS, "total_score"
    )


def final_score(total: Column, churned_at: Column) -> Column:
    """Churned accounts score 0 whatever their components say."""
    raw = F.when(rules.is_churned(churned_at), F.lit(0)).otherwise(total)
    return rules.clamp(raw.cast("int"), *SCORE_RANGE)


def score_accounts(health: DataFrame, as_of: AsOf) -> DataFrame:
    """One snapshot per account, not flagged yet. Components keep their values for churned accounts."""
    components = F.struct(
        F.col("login_recency_score").alias("login_recency"),
        F.col("adoption_score").alias("adoption"),
        F.col("ticket_score").alias("ticket_health"),
        F.col("mrr_tier_score").alias("mrr_tier"),
        F.col("seat_score").alias("seat_util"),
    )
    return health.select(
        "company_id",
        final_score(F.col("total_score"), F.col("churned_at")).alias("score"),
        F.lit(False).alias("at_risk"),
        components.alias("components"),
        as_of_col(as_of).alias("scored_at"),
    )


def scoring_summary(scores: DataFrame) -> DataFrame:
    """Counters of one scoring run. The flagged ids are rows of their own, see :func:`at_risk_ids`."""
    return scores.agg(
        F.count("*").alias("companies_scored"), F.count_if(F.col("at_risk")).alias("at_risk_count")
    )


def at_risk_ids(scores: DataFrame) -> DataFrame:
    """Ids flagged by a run, ascending. Kept as rows: the list may be as long as the account table."""
    return scores.filter("at_risk").select("company_id").orderBy("company_id")
