"""De-duplicated alerts over a stream of flagged score snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from acctpulse.functions.text import alert_message
from acctpulse.functions.times import instant
from acctpulse.operators.alerts import SCORE_DROP, alert_id
from acctpulse.sources.store import Store

ALERTS = "alert-stream"
DELAY = "31 days"


def once_a_day(flagged: DataFrame, alert_type: str = SCORE_DROP, delay: str = DELAY) -> DataFrame:
    """Alert rows, at most one per company and day of a stream of flagged snapshots.

    The stream's state remembers the companies and days it has alerted for, for ``delay`` after the newest snapshot; a
    snapshot that comes later than that is dropped. A delay of a day or more keeps the state of a day as long as any row of
    the day is taken, so no day is alerted twice. Which of several snapshots of one day in one micro-batch makes the alert is
    not fixed.
    """
    rows = flagged.withColumns({"day": F.to_date("scored_at"), "at": instant("scored_at")}).withWatermark("at", delay)
    fresh = rows.dropDuplicatesWithinWatermark(["company_id", "day"])
    alerts = fresh.select(
        "company_id",
        F.lit(alert_type).alias("alert_type"),
        alert_message(F.col("company_name"), F.col("plan"), F.col("score")).alias("message"),
        F.lit(False).alias("acknowledged"),
        F.col("scored_at").alias("created_at"),
    )
    return alerts.select(alert_id(), "*")


def not_logged(alerts: DataFrame, store: Store) -> DataFrame:
    """Alerts whose company, type and day no writer has logged. Opens the log's partitions from the first day on."""
    day = F.to_date("created_at").alias("day")
    first = alerts.agg(F.min(day)).first()[0]
    if first is None:
        return alerts
    logged = store.read("alert_log", first).select("company_id", "alert_type", day).distinct()
    return alerts.withColumn("day", day).join(logged, ["company_id", "alert_type", "day"], "left_anti").drop("day")


def stream_alerts(
    flagged: DataFrame, store: Store, checkpoint: str, alert_type: str = SCORE_DROP, writer: str = ALERTS,
    delay: str = DELAY, shared: bool = False,
) -> StreamingQuery:
    """At most one alert per company, type and day in the stored alert log.

    ``flagged`` streams ``(company_id, company_name, plan, score, scored_at)``. What has been alerted is stream state in the
    checkpoint: the log is not read, and a restart does not alert twice. A replayed epoch changes nothing. Where other
    streams or the daily scan log alerts of the same days, ``shared`` also compares each micro-batch's new alerts with the
    log's partitions of those days.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        if not store.committed("alert_log", epoch, writer):
            store.append("alert_log", not_logged(batch, store) if shared else batch, epoch, writer)

    return (
        once_a_day(flagged, alert_type, delay).writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
