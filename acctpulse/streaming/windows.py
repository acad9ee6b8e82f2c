"""Daily facts and the trailing measure as event-time windows: state is kept per day and goes when the watermark has passed.

Both emit a window once, when it is complete: no event may come for it any more. Events later than ``delay`` are dropped.
Distinct users need no distinct count: a first aggregation makes one row per user, day and type, a second one counts rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from acctpulse.functions.times import instant, utc_day
from acctpulse.operators.daily import events_with_company

DELAY = "2 days"
TRAILING_DAYS = 30


def closed_user_days(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """One row per (user, type, day) of a stream of events, once the day is complete."""
    known = events.withColumn("at", instant("occurred_at")).withWatermark("at", delay).filter(F.col("user_id").isNotNull())
    return known.groupBy("user_id", "event_type", F.window("at", "1 day").alias("day")).agg(
        F.count("*").alias("events"), F.max("id").alias("max_id")
    )


def daily_windows(events: DataFrame, users: DataFrame, delay: str = DELAY) -> DataFrame:
    """Daily facts per company, day and type of complete days, as ``events_daily`` gives them."""
    owned = events_with_company(closed_user_days(events, delay), users)
    facts = owned.groupBy("company_id", "event_type", F.window("day", "1 day").alias("day")).agg(
        F.sum("events").alias("event_count"), F.count("*").alias("unique_users"), F.max("max_id").alias("max_id")
    )
    return facts.select("company_id", utc_day("day.start").alias("event_date"), "event_type", "event_count", "unique_users", "max_id")


def trailing_windows(events: DataFrame, users: DataFrame, delay: str = DELAY, n_days: int = TRAILING_DAYS) -> DataFrame:
    """``company_id, as_of_date, active_users_30d`` at the end of every complete day, as ``active_users_30d`` sums them up.

    The trailing window of a day holds it and the ``n_days`` before it.
    """
    owned = events_with_company(closed_user_days(events, delay), users)
    slide = F.window("day", f"{n_days + 1} days", "1 day").alias("span")
    sums = owned.groupBy("company_id", slide).agg(F.count("*").alias("active_users_30d"))
    return sums.select("company_id", F.date_sub(utc_day("span.end"), 1).alias("as_of_date"), "active_users_30d")


def append_to(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what the stream emits to a Parquet folder, each row once, for everything available now."""
    return (
        rows.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
