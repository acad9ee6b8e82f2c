"""Incremental daily facts as a stream: new event files become batches of the daily log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from acctpulse.plans.ingest import ingest_stream_batch
from acctpulse.schemas import SOURCE_SCHEMAS
from acctpulse.sources.store import Store

EVENTS = "event-stream"


def event_stream(spark: SparkSession, location: str, files_per_batch: int | None = None) -> DataFrame:
    """Event files under ``location`` as a stream. Files are tracked, not ids: late files are never skipped."""
    reader = spark.readStream.schema(SOURCE_SCHEMAS["events"])
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(location)


def stream_daily(
    events: DataFrame,
    users: Callable[[], DataFrame] | DataFrame,
    store: Store,
    checkpoint: str,
    writer: str = EVENTS,
) -> StreamingQuery:
    """Start a run over everything available and then stop.

    A micro-batch is folded like any batch (an exact distinct count is fine inside a micro-batch); facts, user days and
    mark become visible together under ``(writer, epoch)``. A replayed epoch with the same events changes nothing; other
    events under a used epoch (a new checkpoint under an old writer name) raise. Another stream needs a writer name of its
    own. ``users`` may be a function, to re-read the table per batch.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        ingest_stream_batch(store, batch, users() if callable(users) else users, epoch, writer)

    return (
        events.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
