"""Score history: newest against previous snapshot, sharp drops, flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acctpulse.functions.keyed import latest_k, previous_row
from acctpulse.functions.scores import RISK_DAYS, RISK_DROP, is_at_risk


def newest_first() -> list:
    return [F.desc_nulls_last("scored_at")]


def latest_two(scores: DataFrame) -> DataFrame:
    """Newest and previous snapshot of every company in one row.

    Ranking keeps two rows per company before the exchange; the aggregation that puts the two rows side by
    side runs on the same partitioning.
    """
    first, second = F.col("rn") == 1, F.col("rn") == 2
    return latest_k(scores, "company_id", newest_first(), 2).groupBy("company_id").agg(
        F.max(F.when(first, F.col("score"))).alias("current_score"),
        F.max(F.when(second, F.col("score"))).alias("prev_score"),
        F.max(F.when(first, F.col("scored_at"))).alias("scored_at"),
        F.max(F.when(second, F.col("scored_at"))).alias("prev_scored_at"),
    )


def with_drop(pairs: DataFrame, drop: int = RISK_DROP, days: int = RISK_DAYS) -> DataFrame:
    prev, cur = F.col("prev_score"), F.col("current_score")
    flag = is_at_risk(prev, cur, F.col("prev_scored_at"), F.col("scored_at"), drop, days)
    return pairs.withColumns({"score_drop": prev - cur, "at_risk": flag})


def score_trend(scores: DataFrame, drop: int = RISK_DROP, days: int = RISK_DAYS) -> DataFrame:
    """Newest snapshot per company against the one before it: drop, gap and at-risk verdict."""
    return with_drop(latest_two(scores), drop, days).select(
        "company_id", "current_score", "prev_score", "scored_at", "prev_scored_at", "score_drop", "at_risk"
    )


def score_drop_history(scores: DataFrame, drop: int = RISK_DROP, days: int = RISK_DAYS) -> DataFrame:
    """The same comparison at every snapshot of the history."""
    rows = previous_row(scores, "company_id", "scored_at", ["score", "scored_at"])
    return with_drop(rows.withColumnRenamed("score", "current_score"), drop, days).select(
        "company_id", "current_score", "prev_score", "scored_at", "prev_scored_at", "score_drop", "at_risk"
    )


def flag_history(scores: DataFrame) -> DataFrame:
    """History with every snapshot flagged as the scoring run of its time would have flagged it."""
    rows = previous_row(scores, "company_id", "scored_at", ["score", "scored_at"])
    flag = is_at_risk(F.col("prev_score"), F.col("score"), F.col("prev_scored_at"), F.col("scored_at"))
    return rows.withColumn("at_risk", flag).select(*scores.columns)


def latest_score(scores: DataFrame) -> DataFrame:
    """Newest snapshot per company."""
    return latest_k(scores, "company_id", newest_first(), 1).drop("rn")


def flag_latest(scores: DataFrame, flagged: DataFrame) -> DataFrame:
    """History with ``at_risk`` set on the newest snapshot of the companies in ``flagged``.

    ``flagged`` is matched by (company, time), which is unique, so no task gets the whole history of a
    company.
    """
    newest = (
        latest_k(scores.select("company_id", "scored_at"), "company_id", newest_first(), 1)
        .join(flagged.select("company_id"), "company_id", "left_semi")
        .select("company_id", "scored_at", F.lit(True).alias("_hit"))
    )
    hit = F.coalesce(F.col("_hit"), F.col("at_risk"))
    return scores.join(newest, ["company_id", "scored_at"], "left").select(
        *[hit.alias("at_risk") if c == "at_risk" else F.col(c) for c in scores.columns]
    )


def flag_at_risk(scores: DataFrame) -> DataFrame:
    """Flag the newest snapshots whose trend is at risk.

    One ranked pass gives both the verdict and the row it belongs to; that is joined back by (company, time).
    """
    newest = score_trend(scores).filter("at_risk").select("company_id", "scored_at", F.lit(True).alias("_hit"))
    hit = F.coalesce(F.col("_hit"), F.col("at_risk"))
    return scores.join(newest, ["company_id", "scored_at"], "left").select(
        *[hit.alias("at_risk") if c == "at_risk" else F.col(c) for c in scores.columns]
    )


def flag_new(new: DataFrame, state: DataFrame) -> DataFrame:
    """Scoring-run form of the flag: fresh snapshots against the newest stored one per company.

    Gives the rows of :data:`STORE_SCHEMAS["score_state"]`, which also carry the newest flagged snapshot; the history is
    not read.
    """
    before = state.select(
        "company_id", F.col("score").alias("prev_score"), F.col("scored_at").alias("prev_scored_at"),
        "last_flagged_score", "last_flagged_at",
    )
    flag = is_at_risk(F.col("prev_score"), F.col("score"), F.col("prev_scored_at"), F.col("scored_at"))
    return new.join(before, "company_id", "left").withColumn("at_risk", flag).select(
        "company_id", "score", "at_risk", "components", "scored_at", "prev_score", "prev_scored_at",
        F.when(F.col("at_risk"), F.col("score")).otherwise(F.col("last_flagged_score")).alias("last_flagged_score"),
        F.when(F.col("at_risk"), F.col("scored_at")).otherwise(F.col("last_flagged_at")).alias("last_flagged_at"),
    )
