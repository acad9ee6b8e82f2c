"""Counters of a complete run as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acctpulse.operators.alerts import alert_summary
from acctpulse.operators.briefs import brief_summary
from acctpulse.operators.scoring import scoring_summary
from acctpulse.sources.readers import count_rows


def as_rows(step: str, one_row: DataFrame) -> DataFrame:
    """The columns of a one-row summary as ``(step, counter, value)`` rows."""
    items = [F.struct(F.lit(c).alias("counter"), F.col(c).cast("double").alias("value")) for c in one_row.columns]
    return one_row.select(F.lit(step).alias("step"), F.inline(F.array(*items)))


def run_counters(
    accounts: DataFrame,
    daily: DataFrame,
    scores: DataFrame,
    gated: DataFrame,
    briefs: DataFrame,
    at_risk: DataFrame,
    alerts: DataFrame,
    chat: DataFrame,
    digest: DataFrame,
) -> DataFrame:
    """Counters of the four steps: rows written by the sync, scores, briefs and alerts."""
    parts = [
        as_rows("sync", count_rows(accounts, "dim_accounts_upserted")),
        as_rows("sync", count_rows(daily, "fact_events_daily_upserted")),
        as_rows("scoring", scoring_summary(scores)),
        as_rows("briefs", brief_summary(gated, briefs)),
        as_rows("alerts", alert_summary(at_risk, alerts)),
        as_rows("alerts", count_rows(chat, "chat_messages")),
        as_rows("alerts", count_rows(digest, "digest_lines")),
    ]
    return reduce(DataFrame.unionByName, parts)
