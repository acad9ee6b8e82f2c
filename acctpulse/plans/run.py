"""The daily run over a store: sync, scores, briefs, alerts. Every step commits on its own.

Each step writes its result and later steps read it back from the files, so nothing is computed twice, and a
lost executor costs tasks of one step only.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acctpulse.operators import alerts as AL
from acctpulse.operators import briefs as B
from acctpulse.operators import daily as D
from acctpulse.operators.accounts import add_notes, upsert_replace
from acctpulse.operators.rollup import account_rollup
from acctpulse.operators.scoring import current_health, health_components, score_accounts
from acctpulse.operators.trend import flag_new
from acctpulse.plans.counters import run_counters
from acctpulse.plans.ingest import compact_daily, fold_activity, ingest_run_batch, user_days_complete
from acctpulse.session import staged
from acctpulse.sources.drift import schema_drift
from acctpulse.sources.readers import existing
from acctpulse.sources.store import Store

__all__ = ["compact_daily", "run"]

HAND = "hand"
GENERATOR_TASKS = 16
WINDOW_DAYS = 30

log = logging.getLogger(__name__)


def batch_of(as_of: str) -> int:
    """Batch id of a run: its time as a number, so ids grow with time and a re-run gets the same id."""
    return int(datetime.fromisoformat(str(as_of)).strftime("%Y%m%d%H%M%S"))


def run_step(name: str, fn: Callable[[], object]) -> object:
    """One step of a run. A failure is logged and raised; what earlier steps committed stays."""
    try:
        result = fn()
    except Exception:
        log.exception("step %s failed", name)
        raise
    log.info("step %s done", name)
    return result


def daily_facts(store: Store, since: date | None = None) -> DataFrame:
    """Daily facts; ``since`` opens the partitions of later days only."""
    return D.fold_daily(store.read("daily_log", since))


def day_of(as_of: str, days_before: int = 0) -> date:
    return datetime.fromisoformat(str(as_of)).date() - timedelta(days=days_before)


def alert_rows(store: Store) -> DataFrame:
    """Alert log with acknowledgements applied."""
    return AL.acknowledge(store.read("alert_log"), store.read("alert_acks"))[0]


def check_sources(sources: dict[str, DataFrame]) -> None:
    """Warn about columns beyond the known ones. Decided from the schemas; no data is read."""
    for row in schema_drift(sources).collect():  # one row per unknown column
        log.warning("source %s has an unknown column %s", row.table_name, row.column_name)


def sync_accounts(
    sources: dict[str, DataFrame], store: Store, as_of: str, mode: str = "exact", from_log: bool = False
) -> None:
    """Rebuild the account dimension; with ``from_log`` out of the stored activity and the user days since, not all events."""
    batch_id = batch_of(as_of)
    if store.committed("dim_accounts", batch_id):
        return
    if from_log and not user_days_complete(store):
        raise ValueError("the user days of this store lack batches of the daily log; roll accounts up from all events")
    activity = fold_activity(store) if from_log else None
    fresh = account_rollup(**sources, as_of=as_of, mode=mode, activity=activity)
    merged = upsert_replace(store.read("dim_accounts"), fresh, ["company_id"])
    store.stage("dim_accounts", merged, batch_id)
    store.commit(batch_id, ["dim_accounts"])


def sync_daily(sources: dict[str, DataFrame], store: Store, as_of: str) -> None:
    """Pull the events past the mark; facts, user days and new mark become visible together."""
    ingest_run_batch(store, sources, batch_of(as_of), as_of)


def score(store: Store, as_of: str) -> None:
    """Score all accounts. The flag is decided before the snapshot is written, against the newest one stored."""
    batch_id = batch_of(as_of)
    if store.committed("score_state", batch_id):
        return
    active = D.active_users_30d(daily_facts(store, day_of(as_of, WINDOW_DAYS)), as_of)
    seated = D.with_seats(store.read("dim_accounts"), active)
    scored = score_accounts(current_health(health_components(seated, None, as_of)), as_of)
    state = store.stage("score_state", flag_new(scored, store.read("score_state")), batch_id)
    store.stage("fact_health_score", state, batch_id)
    store.commit(batch_id, ["score_state", "fact_health_score"])


def write_briefs(
    store: Store, as_of: str, generator: B.BatchFn, model: str, parallelism: int, ids: DataFrame | None = None
) -> None:
    """Gate all accounts, or those of ``ids``, call the generator for those that pass and store what it returned
    before parsing it."""
    batch_id = batch_of(as_of)
    if store.committed("brief_queue", batch_id):
        return
    pairs = store.read("score_state").select(
        "company_id", F.col("score").alias("latest_score"), F.col("components").alias("latest_components"),
        "at_risk", "prev_score",
    )
    context = B.brief_context(
        store.read("dim_accounts"), store.read("fact_health_score"), daily_facts(store, day_of(as_of, WINDOW_DAYS)), alert_rows(store),
        store.read("crm_notes"), as_of, pairs=pairs,
    )
    if ids is not None:
        context = existing(context, ids.select("company_id").distinct())
    gated = B.brief_gates(context, store.read("ai_summaries"))
    queue = store.stage("brief_queue", B.brief_queue(gated), batch_id)
    answers = store.stage("responses", B.generate(queue, generator, parallelism), batch_id)
    store.stage("ai_summaries", B.to_briefs(answers, model, as_of), batch_id)
    store.commit(batch_id, ["brief_queue", "responses", "ai_summaries"])


def at_risk_now(store: Store) -> DataFrame:
    """Accounts with a flagged snapshot, from the state table: the history is not read."""
    flagged = store.read("score_state").filter(F.col("last_flagged_at").isNotNull()).select(
        "company_id", F.col("last_flagged_score").alias("score"), F.lit(True).alias("at_risk"),
        F.col("last_flagged_at").alias("scored_at"),
    )
    return AL.at_risk_accounts(flagged, store.read("dim_accounts"))


def scan_alerts(store: Store, as_of: str) -> None:
    """Log the new alerts; chat messages for them and the digest, if it is due, become visible with them."""
    batch_id = batch_of(as_of)
    if store.committed("alert_log", batch_id):
        return
    at_risk = staged(at_risk_now(store), "at_risk")
    # Alerts of the day or later: earlier partitions of the log are not opened.
    alerts = store.stage("alert_log", AL.new_alerts(at_risk, store.read("alert_log", day_of(as_of)), as_of), batch_id)
    store.stage("chat_messages", AL.chat_messages(existing(at_risk, alerts), as_of), batch_id)
    store.stage("alert_digests", AL.alert_digest(at_risk, as_of), batch_id)
    store.commit(batch_id, ["alert_log", "chat_messages", "alert_digests"])


def _append_once(store: Store, table: str, df: DataFrame, batch_id: int) -> None:
    """Append hand-written rows. A used batch id, or one below the newest, is an error: skipping would lose them."""
    if not store.append(table, df, batch_id, HAND):
        raise ValueError(f"batch {batch_id} of {table} is already stored; pass another batch_id for further rows")


def take_notes(store: Store, notes: DataFrame, as_of: str, batch_id: int | None = None) -> DataFrame:
    """Store the notes of known accounts; returns the rejected ones."""
    accepted, rejected = add_notes(notes, store.read("dim_accounts"), as_of)
    _append_once(store, "crm_notes", accepted, batch_of(as_of) if batch_id is None else batch_id)
    return rejected


def take_acks(store: Store, ids: DataFrame, as_of: str, batch_id: int | None = None) -> DataFrame:
    """Acknowledge alerts by id; returns the ids that match no alert."""
    unknown = AL.acknowledge(store.read("alert_log"), ids)[1]
    known = ids.select("alert_id").distinct().join(unknown, "alert_id", "left_anti")
    acks = known.withColumn("acknowledged_at", F.lit(str(as_of)).cast("timestamp_ntz"))
    _append_once(store, "alert_acks", acks, batch_of(as_of) if batch_id is None else batch_id)
    return unknown


def run(
    sources: dict[str, DataFrame],
    store: Store,
    as_of: str,
    generator: B.BatchFn,
    model: str = "none",
    mode: str = "exact",
    parallelism: int = GENERATOR_TASKS,
    incremental_accounts: bool = False,
    brief_ids: DataFrame | None = None,
) -> DataFrame:
    """All steps in order; returns ``(step, counter, value)`` rows of this run.

    A run dated before the newest one raises. Accounts are recounted from all events by default.
    ``incremental_accounts`` reads new events only, once, and adds them to the stored activity per user and type, from which
    accounts are rolled up: the cost of a run then follows the new events and the number of users, not the length of the
    history. It relies on ids growing, as the mark of the daily facts does. ``brief_ids`` limits the
    briefs to some accounts.
    """
    run_step("drift", lambda: check_sources(sources))
    steps = [
        ("accounts", lambda: sync_accounts(sources, store, as_of, mode, incremental_accounts)),
        ("daily", lambda: sync_daily(sources, store, as_of)),
    ]
    for name, step in reversed(steps) if incremental_accounts else steps:
        run_step(name, step)
    run_step("scoring", lambda: score(store, as_of))
    run_step("briefs", lambda: write_briefs(store, as_of, generator, model, parallelism, brief_ids))
    run_step("alerts", lambda: scan_alerts(store, as_of))
    return counters(store, as_of)


def counters(store: Store, as_of: str) -> DataFrame:
    """Counters of one run, read from the batches it wrote."""
    batch_id = batch_of(as_of)
    return run_counters(
        accounts=store.read_batch("dim_accounts", batch_id).filter(
            F.col("synced_at") == F.lit(str(as_of)).cast("timestamp_ntz")
        ),
        daily=store.read_batch("daily_log", batch_id),
        scores=store.read_batch("fact_health_score", batch_id),
        gated=store.read_batch("brief_queue", batch_id),
        briefs=store.read_batch("ai_summaries", batch_id),
        at_risk=at_risk_now(store),
        alerts=store.read_batch("alert_log", batch_id),
        chat=store.read_batch("chat_messages", batch_id),
        digest=store.read_batch("alert_digests", batch_id),
    )
