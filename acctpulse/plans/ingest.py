"""Ingestion of events into a store: one commit holds the facts, the user days, the counters and the mark of a batch.

Runs and streams may feed one store. A run takes the events past the mark, which both kinds advance. A stream takes
every event of its files, late ones too, except those that runs had loaded before its first batch. What a batch held, how
many of its events lay behind the mark and how many belong to no company, is observed while its tables are written: no job
is started to count.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Observation, Row
from pyspark.sql import functions as F

from acctpulse.operators import daily as D
from acctpulse.session import staged
from acctpulse.sources.readers import NO_MARK, incremental
from acctpulse.sources.store import COMPACTION, RUN, Store, batch_name

EVENTS, RUN_EVENTS = "events", "events/run"
FOLD = "fold"
# Rows of the commits that name the batches of user days which the stored activity holds.
FOLDED = "user_days/folded"
TABLES = ["user_days", "daily_log"]


def _state(store: Store, writer: str, sequence: int) -> Row:
    """What the commits say before a batch: the marks, the writer's floor, and whether the batch is stored. One row."""
    own, run = F.col("writer") == writer, F.col("writer") == RUN
    newest = F.col("newest_id")
    row = store.commits().filter(F.col("table_name") == TABLES[0]).filter("visible").agg(
        F.coalesce(F.max(newest), F.lit(NO_MARK)).alias("mark"),
        F.coalesce(F.max(F.when(run, newest)), F.lit(NO_MARK)).alias("run_mark"),
        F.max(F.when(own, F.col("floor_id"))).alias("floor"),
        F.max(F.when(own, F.col("sequence"))).alias("last"),
        F.coalesce(F.max(own & (F.col("sequence") == sequence)), F.lit(False)).alias("stored"),
    ).first()
    if not row["stored"] and row["last"] is not None and sequence < row["last"]:
        raise ValueError(f"batch {sequence} of writer {writer} lies before its newest, {row['last']}")
    return row


def _write(
    store: Store, fresh: DataFrame, users: DataFrame, sequence: int, writer: str, mark: int, floor: int, even_empty: bool = True,
    synced_at: object = None,
) -> None:
    """Stage and commit the tables of one batch. Its newest id, if beyond the mark, is the new mark."""
    read, owned = Observation(), Observation()
    late = F.count_if(F.col("id") <= F.lit(mark)).alias("late")
    # The metrics lie behind the shuffle that spreads the rows over their days, in the stage that writes.
    rows = D.user_days(fresh, late).hint("rebalance", "event_date").observe(
        read, F.coalesce(F.sum("events"), F.lit(0)).alias("events"), F.coalesce(F.sum("late"), F.lit(0)).alias("late_events"),
        F.max("max_id").alias("newest_id"), F.max("last_at").alias("newest_at"),
    )
    rows = store.stage("user_days", rows, sequence, writer)
    seen = read.get
    if not seen["events"] and not even_empty:
        return
    store.stage("daily_log", D.observed_facts(rows, users, owned), sequence, writer)
    if synced_at is not None:
        seen["newest_at"] = datetime.fromisoformat(str(synced_at))
    store.commit(sequence, TABLES, writer, {**seen, **owned.get, "floor_id": floor})


def ingest_log(store: Store) -> DataFrame:
    """What every batch held: ``writer, sequence, events, late_events, orphan_events, newest_id``."""
    kept = store.commits().filter((F.col("table_name") == TABLES[0]) & F.col("visible") & F.col("events").isNotNull())
    return kept.select("writer", "sequence", "events", "late_events", "orphan_events", "newest_id")


def marks(store: Store) -> DataFrame:
    """``table_name, last_synced_id, last_synced_at``: the newest event of all batches, and of those of runs."""
    known = store.commits().filter((F.col("table_name") == TABLES[0]) & F.col("newest_id").isNotNull())
    names = F.filter(F.array(F.lit(EVENTS), F.when(F.col("writer") == RUN, F.lit(RUN_EVENTS))), lambda x: x.isNotNull())
    return known.select(F.explode(names).alias("table_name"), "newest_id", "newest_at").groupBy("table_name").agg(
        F.max("newest_id").alias("last_synced_id"), F.max_by("newest_at", "newest_id").alias("last_synced_at")
    )


def ingest_run_batch(store: Store, sources: dict[str, DataFrame], sequence: int, as_of: object) -> None:
    """Pull the events past the mark. No new events: no batch."""
    state = _state(store, RUN, sequence)
    if not state["stored"]:
        fresh = incremental(sources["events"], state["mark"])
        _write(store, fresh, sources["users"], sequence, RUN, state["mark"], state["mark"], even_empty=False, synced_at=as_of)


def ingest_stream_batch(store: Store, events: DataFrame, users: DataFrame, epoch: int, writer: str) -> None:
    """Store a micro-batch under ``(writer, epoch)``. A replay of the same events changes nothing, other events raise."""
    if writer in (RUN, COMPACTION, FOLD):
        raise ValueError(f"writer name {writer} is reserved")
    state = _state(store, writer, epoch)
    if state["stored"]:
        again = D.user_days(incremental(events, state["floor"]))
        if _content(again) != _content(store.read_batch("user_days", epoch, writer)):
            raise ValueError(f"batch {epoch} of writer {writer} is stored with other content")
        return
    floor = state["run_mark"] if state["floor"] is None else state["floor"]
    _write(store, incremental(events, floor), users, epoch, writer, state["mark"], floor)


def _content(rows: DataFrame) -> tuple:
    """Content of user days as a value that does not depend on row order."""
    names = ["user_id", "event_date", "event_type", "events", "max_id"]
    return tuple(rows.agg(F.count("*"), F.sum(F.xxhash64(*names).cast("decimal(38,0)"))).first())


def user_days_complete(store: Store) -> bool:
    """Whether every batch of daily facts has its user days, so that accounts can be rolled up from these."""
    facts, days = store.visible("daily_log"), store.visible("user_days")
    return facts.join(days, "batch", "left_anti").isEmpty() and days.join(facts, "batch", "left_anti").isEmpty()


def fold_activity(store: Store) -> DataFrame:
    """Activity per user and type over all visible user days, as ``account_rollup`` takes it.

    The stored activity holds what was folded before; only user days of batches that are not in it are read and added, so a
    run's cost follows its new events and the number of users, not the history.
    """
    folded = store.commits().filter(F.col("table_name") == FOLDED)
    pending = staged(store.visible("user_days").join(folded, "batch", "left_anti"), "pending")
    if not pending.isEmpty():
        fresh = D.activity_of(store.read("user_days", batches=pending))
        whole = D.fold_activity(store.read("user_activity").unionByName(fresh))
        sequence = store.next_sequence("user_activity", FOLD)
        store.stage("user_activity", whole, sequence, FOLD)
        names = pending.select(F.lit(FOLDED).alias("table_name"), "batch", F.lit(True).alias("visible"))
        store.commit(sequence, ["user_activity"], FOLD, more=names)
    return store.read("user_activity")


def compact_daily(store: Store) -> None:
    """Fold the batches of the daily log and of the user days into one each, visible with the commit that hides the old ones."""
    shown = [store.visible(t).select(F.lit(t).alias("table_name"), "batch") for t in TABLES]
    old = staged(shown[0].unionByName(shown[1]), "compacted")
    if old.limit(3).count() < 3:
        return
    fold_activity(store)  # the folded batch holds nothing that is not in it
    own = {t: old.filter(F.col("table_name") == t) for t in TABLES}
    sequence = store.next_sequence("daily_log", COMPACTION)
    facts = store.read("daily_log", batches=own["daily_log"]).groupBy(*D.DAILY_KEYS).agg(
        F.sum("event_count").alias("event_count"),
        F.max("unique_users").alias("unique_users"),
        F.max("max_id").alias("max_id"),
    )
    days = D.fold_user_days(store.read("user_days", batches=own["user_days"]))
    store.stage("daily_log", facts.hint("rebalance", "event_date"), sequence, COMPACTION)
    store.stage("user_days", days.hint("rebalance", "event_date"), sequence, COMPACTION)
    name = store.spark.createDataFrame([(FOLDED, batch_name(sequence, COMPACTION), True)], "table_name string, batch string, visible boolean")
    store.commit(sequence, TABLES, COMPACTION, more=old.withColumn("visible", F.lit(False)).unionByName(name))
