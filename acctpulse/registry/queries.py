"""One named query per operator, over the benchmark tables. Nested results are flattened to plain columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acctpulse.functions import scores as rules
from acctpulse.functions.text import chat_message, components_json
from acctpulse.operators import accounts as AC
from acctpulse.operators import alerts as AL
from acctpulse.operators import briefs as B
from acctpulse.operators import daily as D
from acctpulse.operators import people as P
from acctpulse.operators import quality as Q
from acctpulse.operators import rollup
from acctpulse.operators import scoring as S
from acctpulse.operators import trend as T
from acctpulse.plans.counters import run_counters
from acctpulse.plans.ingest import compact_daily, fold_activity, ingest_log, ingest_run_batch, ingest_stream_batch
from acctpulse.registry.inputs import AS_OF, BATCH_CUTS, DENSE_SNAPSHOTS, MODEL, SCAN_AT, SNAPSHOTS, Inputs
from acctpulse.session import staged, work_path
from acctpulse.sources import adapters
from acctpulse.sources import readers as R
from acctpulse.sources.drift import file_columns, read_drifting, schema_drift
from acctpulse.sources.store import Store
from acctpulse.sources.tables import upsert_buckets, write_clustered
from acctpulse.streaming import windows as W
from acctpulse.streaming.alerts import stream_alerts
from acctpulse.streaming.daily import stream_daily

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[Inputs], DataFrame]):
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
    return fn


def _text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def _flat_components(df: DataFrame, column: str = "components") -> DataFrame:
    return df.withColumn(column, components_json(F.col(column)))


def _lines(items: str | Column, *fields: str) -> Column:
    """A list of structs as text, one line per element."""
    return F.array_join(
        F.transform(items, lambda x: F.concat_ws("|", *[
            _text(x[f]) if f.endswith("_at") else x[f].cast("string") for f in fields
        ])), "\n"
    )


# --- scans ---------------------------------------------------------------------------------------------------


@query
def scan_companies(i):
    return i.companies


@query
def scan_users(i):
    return i.users


@query
def scan_events(i):
    return i.events


@query
def scan_tickets(i):
    return i.tickets


@query
def incremental_events(i):
    mark = i.events.filter(F.col("occurred_at") < F.lit(BATCH_CUTS[0]).cast("timestamp_ntz")).agg(F.max("id"))
    return R.incremental(i.events, mark.scalar())


@query
def target_accounts(i):
    critical = i.tickets.filter(rules.is_open_critical(F.col("status"), F.col("severity"))).select("company_id")
    return R.target_accounts(i.companies.select(F.col("id").alias("company_id")), critical)


@query
def schema_drift_report(i):
    events = i.spark.read.parquet(f"{i.sf_dir}/events.parquet").withColumnsRenamed(
        {"event_id": "id", "ts": "occurred_at"}
    )
    documents = i.spark.read.parquet(f"{i.sf_dir}/documents.parquet")
    return schema_drift({"events": events, "documents": documents})


QUERIES["schema_drift"] = QUERIES.pop("schema_drift_report")


def _drifted(i: Inputs) -> str:
    """The events in files of three schemas: without metadata, as known, and with a narrower id and a surplus column."""
    path = f"{work_path(i.spark, 'drift')}/events"
    part = lambda k: i.events.filter(F.col("id") % 3 == k)
    narrow = part(2).withColumns({"id": F.col("id").cast("int"), "channel": F.lit("web")})
    for rows in (part(0).drop("metadata"), part(1), narrow):
        rows.coalesce(1).write.mode("append").parquet(path)
    return path


@query
def drifting_events(i):
    """Known columns of a source whose files differ."""
    return read_drifting(i.spark, _drifted(i), "events")


@query
def drift_by_file(i):
    """Columns, their types and the number of files that have them."""
    return file_columns(i.spark, _drifted(i)).drop("first_file")


@query
def constraint_report(i):
    # Several rules read each of these.
    i.accounts, i.daily = staged(i.accounts, "accounts"), staged(i.daily, "daily")
    return Q.constraint_report(
        {
            **i.sources,
            "dim_accounts": i.accounts,
            "fact_events_daily": i.daily,
            "fact_health_score": staged(i.scored(), "scored"),
            "crm_notes": i.notes,
            "alert_log": i.alerts,
        }
    )


# --- account dimension and daily facts --------------------------------------------------------------------------


@query
def account_rollup(i):
    return i.accounts


@query
def account_rollup_fanout(i):
    return i.rollup("fanout")


@query
def upsert_accounts(i):
    # The stored dimension knows every other account and as many that are gone from the source.
    old = i.companies.select(
        (F.col("id") * 2).alias("company_id"),
        F.concat(F.lit("old "), F.col("name")).alias("company_name"),
        "plan",
        F.lit(0).cast("bigint").alias("total_users"),
    )
    new = i.accounts.select("company_id", "company_name", "plan", "total_users")
    return AC.upsert_replace(old, new, ["company_id"])


@query
def upsert_accounts_buckets(i):
    """The same upsert into a dimension kept in hash buckets: only the buckets of its last new rows are rewritten."""
    path = f"{work_path(i.spark, 'dimension')}/accounts"
    few = F.col("company_id") % 50 == 7
    old = i.companies.select(
        (F.col("id") * 2).alias("company_id"), F.concat(F.lit("old "), F.col("name")).alias("company_name"), "plan",
        F.lit(0).cast("bigint").alias("total_users"),
    )
    new = staged(i.accounts.select("company_id", "company_name", "plan", "total_users"), "new")
    for rows in (old, new.filter(~few), new.filter(few)):
        upsert_buckets(path, rows, ["company_id"], 16)
    return i.spark.read.parquet(path).select(*new.columns)


@query
def events_after_mark(i):
    """Events past a mark out of files clustered by id: the files before it are not opened."""
    path = f"{work_path(i.spark, 'clustered')}/events"
    write_clustered(i.events, path, 8)
    last = i.events.agg(F.max("id")).first()[0] or 0
    return R.incremental(i.spark.read.schema(i.events.schema).parquet(path), last - last // 10)


@query
def events_daily(i):
    return D.events_daily(i.events, i.users)


@query
def upsert_daily_fold(i):
    log = i.batch(0).unionByName(i.batch(1)).unionByName(i.batch(2))
    return D.fold_daily(log)


@query
def events_daily_stream(i):
    """The daily facts built by the stream: a run over all event files, then the fold of its batches."""
    root = work_path(i.spark, "stream")
    store = Store(i.spark, f"{root}/store")
    stream_daily(adapters.event_stream(i.spark, i.sf_dir), i.users, store, f"{root}/checkpoint").awaitTermination()
    return D.fold_daily(store.read("daily_log"))


def _mixed_store(i: Inputs) -> Store:
    """All events in four batches of two writers, compacted in between: a run, a stream's batch, a run, and late events."""
    store = Store(i.spark, f"{work_path(i.spark, 'mixed')}/store")
    last = i.events.agg(F.max("id")).first()[0] or 0
    low, high = last // 3, 2 * last // 3
    start = {**i.sources, "events": i.events.filter(F.col("id") <= low)}
    ingest_run_batch(store, start, 1, BATCH_CUTS[0])
    # The stream's files hold all events up to its end; those that the run had are left out by the mark.
    late = (F.col("id") % 97 == 5) & F.col("id").between(low + 1, (low + high) // 2)
    ingest_stream_batch(store, i.events.filter((F.col("id") <= high) & ~late), i.users, 0, "event-stream")
    compact_daily(store)
    ingest_run_batch(store, i.sources, 2, BATCH_CUTS[1])
    ingest_stream_batch(store, i.events.filter(late), i.users, 1, "event-stream")
    return store


@query
def ingest_mixed(i):
    """Daily facts from the user days of a store that runs and a stream have fed."""
    return D.facts_of(D.fold_user_days(_mixed_store(i).read("user_days")), i.users)


@query
def ingest_replayed(i):
    """Two runs, each done twice, with rows of an attempt that died in between: as if every step had run once."""
    store = Store(i.spark, f"{work_path(i.spark, 'replayed')}/store")
    last = i.events.agg(F.max("id")).first()[0] or 0
    half = {**i.sources, "events": i.events.filter(F.col("id") <= last // 2)}
    for sources, sequence, at in ((half, 1, BATCH_CUTS[0]), (i.sources, 2, BATCH_CUTS[1])):
        store.stage("user_days", D.user_days(half["events"]), sequence)  # never committed: the run takes its place
        for _ in range(2):
            ingest_run_batch(store, sources, sequence, at)
    return D.facts_of(D.fold_user_days(store.read("user_days")), i.users)


@query
def account_rollup_incremental(i):
    """Accounts rolled up from the user days of such a store instead of all events."""
    return rollup.account_rollup(**i.sources, as_of=AS_OF, activity=fold_activity(_mixed_store(i)))


@query
def ingest_counters(i):
    """What each batch of such a store held: events, those behind the mark, those of no company."""
    return ingest_log(_mixed_store(i))


def _windowed(i: Inputs, rows: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What an event-time stream has emitted after three starts. A third of the events arrive a day late, and so in part
    after younger events."""
    root = work_path(i.spark, "windows")
    arrival = F.col("occurred_at") + F.when(F.col("id") % 3 == 0, F.make_dt_interval(F.lit(1))).otherwise(F.make_dt_interval())
    cuts = [F.lit(c).cast("timestamp_ntz") for c in BATCH_CUTS]
    for wanted in (arrival < cuts[0], (arrival >= cuts[0]) & (arrival < cuts[1]), arrival >= cuts[1]):
        i.events.filter(wanted).write.mode("append").parquet(f"{root}/events")
        emitted = rows(i.spark.readStream.schema(i.events.schema).parquet(f"{root}/events"))
        W.append_to(emitted, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return i.spark.read.schema(emitted.schema).parquet(f"{root}/out")


@query
def events_daily_windows(i):
    """Daily facts of complete days, as an event-time stream emits them."""
    return _windowed(i, lambda events: W.daily_windows(events, i.users))


@query
def seat_usage_windows(i):
    """The trailing measure at the end of every complete day, as an event-time stream emits it."""
    return _windowed(i, lambda events: W.trailing_windows(events, i.users))


@query
def refresh_days(i):
    return D.refresh_days(i.events, i.users, i.batch(2))


@query
def advance_watermark(i):
    first = D.max_id(i.batch(0)).select(F.lit("events").alias("table_name"), "last_synced_id")
    others = i.tickets.agg(F.max("id").alias("last_synced_id")).select(F.lit("tickets").alias("table_name"), "*")
    state = first.unionByName(others).withColumn("last_synced_at", F.lit(BATCH_CUTS[0]).cast("timestamp_ntz"))
    return D.advance_watermark(state, "events", i.batch(1), BATCH_CUTS[1])


@query
def recent_event_mix(i):
    return D.recent_event_mix(i.daily, AS_OF)


# --- scores -----------------------------------------------------------------------------------------------------


@query
def seat_utilization(i):
    return D.seat_utilization(i.accounts, i.daily, AS_OF)


@query
def seat_utilization_exact(i):
    return D.seat_utilization_exact(i.accounts, i.events, i.users, AS_OF)


@query
def seat_utilization_people(i):
    """The exact measure from bitmaps of each day's people; the folded days are staged, the events are not read again."""
    people = staged(P.daily_people(D.user_days(i.events), i.users), "people")
    return P.seat_utilization_people(i.accounts, people, AS_OF)


@query
def login_recency(i):
    points = rules.login_recency(F.col("last_login"), AS_OF)
    return i.users.select(F.col("id").alias("user_id"), "last_login", points.alias("login_recency"))


@query
def plan_tier(i):
    return i.companies.select("id", "plan", rules.plan_tier(F.col("plan")).alias("plan_tier"))


@query
def adoption_score(i):
    types = F.col("distinct_event_types")
    return i.accounts.select("company_id", types, rules.adoption_score(types).alias("adoption_score"))


@query
def ticket_score(i):
    points = rules.ticket_score(F.col("critical_tickets"), F.col("open_tickets"))
    return i.accounts.select("company_id", "critical_tickets", "open_tickets", points.alias("ticket_score"))


@query
def health_components(i):
    return i.components()


@query
def current_health(i):
    return i.health()


@query
def current_health_fanout(i):
    return i.health("fanout")


@query
def score_accounts(i):
    return _flat_components(i.scored())


@query
def stored_scores(i):
    """Score history appended run by run, the last run twice, read from a day on: earlier partitions are not opened."""
    store = Store(i.spark, f"{work_path(i.spark, 'scores')}/store")
    history = staged(i.scores, "history")
    for sequence, at in enumerate([*SNAPSHOTS, SNAPSHOTS[-1]]):
        run = history.filter(F.col("scored_at") == F.lit(at).cast("timestamp_ntz"))
        store.append("fact_health_score", run, min(sequence, len(SNAPSHOTS) - 1))
    return _flat_components(store.read("fact_health_score", SNAPSHOTS[1][:10]))


@query
def score_snapshots(i):
    return _flat_components(i.snapshots())


@query
def score_snapshots_daily_sum(i):
    return _flat_components(i.snapshots(DENSE_SNAPSHOTS, "fanout", "daily_sum"))


@query
def score_trend(i):
    return T.score_trend(i.snapshots())


@query
def score_drop_history(i):
    return T.score_drop_history(staged(i.snapshots(DENSE_SNAPSHOTS), "snapshots"))


@query
def flag_latest_snapshot(i):
    return _flat_components(T.flag_at_risk(staged(i.snapshots(), "snapshots")))


@query
def latest_score(i):
    return _flat_components(T.latest_score(i.scores))


@query
def latest_two_scores(i):
    return T.latest_two(i.scores)


@query
def score_history(i):
    return AC.score_history(i.snapshots(DENSE_SNAPSHOTS)).select("company_id", "score", "scored_at", "rn")


@query
def scoring_run_summary(i):
    return S.scoring_summary(_newest_run(i))


@query
def at_risk_ids(i):
    return S.at_risk_ids(_newest_run(i))


def _newest_run(i: Inputs) -> DataFrame:
    return T.flag_at_risk(staged(i.snapshots(), "snapshots")).filter(F.col("scored_at") == F.lit(AS_OF).cast("timestamp_ntz"))


# --- alerts -----------------------------------------------------------------------------------------------------


@query
def at_risk_accounts(i):
    return i.at_risk


@query
def at_risk_accounts_current(i):
    names = i.companies.selectExpr("id as company_id", "name as company_name", "plan")
    return AL.at_risk_accounts(i.scores, names, current_only=True)


@query
def new_alerts(i):
    return AL.new_alerts(i.at_risk, i.alerts, SCAN_AT)


@query
def stored_alerts(i):
    """Alerts of the scan's day in a store, after two scans of that day: the second finds every account logged."""
    store = Store(i.spark, f"{work_path(i.spark, 'alerts')}/store")
    store.append("alert_log", i.alerts, 0)
    day = SCAN_AT[:10]
    for sequence, at in ((1, SCAN_AT), (2, f"{day} 09:00:00")):
        store.append("alert_log", AL.new_alerts(i.staged_at_risk, store.read("alert_log", day), at), sequence)
    return store.read("alert_log", day)


@query
def chat_alerts(i):
    fresh = i.at_risk.join(AL.alerted_today(i.alerts, SCAN_AT), "company_id", "left_anti")
    return fresh.select(
        "company_id", chat_message(F.col("company_name"), F.col("plan"), F.col("score")).alias("text")
    )


@query
def alert_run_summary(i):
    at_risk = i.staged_at_risk
    return AL.alert_summary(at_risk, AL.new_alerts(at_risk, i.alerts, SCAN_AT))


@query
def alerts_stream(i):
    """Alerts of a stream of flagged snapshots: one per company, type and day."""
    flagged = T.flag_history(staged(i.snapshots(DENSE_SNAPSHOTS), "snapshots")).filter("at_risk")
    names = i.companies.selectExpr("id as company_id", "name as company_name", "plan")
    rows = flagged.join(names, "company_id").select("company_id", "company_name", "plan", "score", "scored_at")
    rows = staged(rows, "flagged_rows")
    root = work_path(i.spark, "alerts")
    store = Store(i.spark, f"{root}/store")
    at = F.col("scored_at") >= F.lit("2024-01-20").cast("timestamp_ntz")
    # The newest days arrive first, and every snapshot arrives twice: the second copy must not alert again.
    for part in (rows.filter(at), rows.filter(~at), rows):
        part.write.mode("append").parquet(f"{root}/flagged")
        source = i.spark.readStream.schema(rows.schema).parquet(f"{root}/flagged")
        stream_alerts(source, store, f"{root}/checkpoint", delay="90 days").awaitTermination()
    return store.read("alert_log")


@query
def alert_digest(i):
    return AL.alert_digest(i.staged_at_risk, SCAN_AT)


def _named(i: Inputs) -> DataFrame:
    return i.companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"))


@query
def alert_feed(i):
    return AL.alert_feed(i.alerts, _named(i), acknowledged=False)


@query
def acknowledge_alerts(i):
    wanted = i.alerts.filter(F.col("alert_type") == AL.SCORE_DROP).select("alert_id")
    return AL.acknowledge(i.alerts, wanted)[0]


# --- accounts ---------------------------------------------------------------------------------------------------


@query
def account_list(i):
    return _flat_components(AC.account_list(i.accounts, i.scores))


@query
def accounts_by_plan(i):
    return _flat_components(AC.account_list(i.accounts, i.scores, plan="pro", order_by="name"))


@query
def accounts_at_risk(i):
    return _flat_components(AC.account_list(i.accounts, i.scores, at_risk_only=True, order_by="score_asc"))


@query
def account_detail(i):
    detail = AC.account_detail(
        i.accounts, i.snapshots(DENSE_SNAPSHOTS), i.plain_briefs, i.notes, i.alerts
    )
    brief = F.col("ai_summary")
    return detail.select(
        "company_id",
        "company_name",
        "total_users",
        F.col("health_score.score").alias("score"),
        F.col("health_score.scored_at").alias("scored_at"),
        components_json(F.col("health_score.components")).alias("components"),
        _lines("score_history", "score", "at_risk", "scored_at").alias("score_history"),
        brief["summary"].alias("brief"),
        brief["generated_at"].alias("generated_at"),
        _lines("cs_notes", "note_id", "author", "note", "created_at").alias("cs_notes"),
        _lines("open_alerts", "alert_id", "alert_type", "message", "acknowledged", "created_at").alias("open_alerts"),
    )


@query
def add_notes(i):
    return AC.add_notes(i.notes, i.companies.select(F.col("id").alias("company_id")))[0]


# --- briefs -----------------------------------------------------------------------------------------------------


@query
def brief_context(i):
    ctx = i.context
    note = F.col("last_cs_note")
    return ctx.select(
        "company_id", "company_name", "plan", "mrr_cents", "total_users", "open_tickets", "critical_tickets",
        "latest_score", "prev_score", "at_risk",
        components_json(F.col("latest_components")).alias("components"),
        _lines("recent_events", "type", "count").alias("recent_events"),
        _lines("open_alerts", "alert_type", "message").alias("open_alerts"),
        note["author"].alias("note_author"),
        note["note"].alias("note"),
        note["date"].alias("note_date"),
    )


@query
def brief_prompt(i):
    return B.brief_prompt(i.context).select("company_id", "prompt")


@query
def brief_hash(i):
    return i.context.select("company_id", "prompt_hash")


@query
def brief_gate_score_change(i):
    latest, prev = F.col("current_score"), F.col("prev_score")
    return T.latest_two(i.scores).select(
        "company_id", latest, prev, rules.score_moved(latest, prev).alias("moved")
    )


@query
def brief_gate_hash(i):
    return B.hash_gate(i.staged_context, i.briefs).select("company_id", "prompt_hash", "stored_hash", "changed")


@query
def brief_gates(i):
    return i.gated.select("company_id", "prompt_hash", "gate")


@query
def brief_gates_subset(i):
    """Gates of chosen accounts: those with an open critical ticket."""
    critical = i.tickets.filter(rules.is_open_critical(F.col("status"), F.col("severity"))).select("company_id")
    chosen = R.target_accounts(i.companies.select(F.col("id").alias("company_id")), critical)
    return B.brief_gates(R.existing(i.staged_context, chosen), i.briefs).select("company_id", "prompt_hash", "gate")


@query
def generated_briefs(i):
    return B.to_briefs(i.answers, MODEL, AS_OF)


@query
def parse_briefs(i):
    return B.parse_briefs(adapters.responses(i.spark, i.sf_dir)).select(
        F.col("company_id").alias("doc_id"), "status", "summary", "recommended_action"
    )


@query
def brief_run_summary(i):
    return B.brief_summary(i.queue, B.to_briefs(i.answers, MODEL, AS_OF))


@query
def run_summary(i):
    i.stage_scores()
    at_risk = i.staged_at_risk
    return run_counters(
        accounts=i.accounts,
        daily=i.daily,
        scores=i.scores.filter(F.col("scored_at") == F.lit(AS_OF).cast("timestamp_ntz")),
        gated=i.queue,
        briefs=B.to_briefs(i.answers, MODEL, AS_OF),
        at_risk=at_risk,
        alerts=(alerts := AL.new_alerts(at_risk, i.alerts, SCAN_AT)),
        chat=AL.chat_messages(R.existing(at_risk, alerts), SCAN_AT),
        digest=AL.alert_digest(at_risk, SCAN_AT),
    )
