"""Store, daily run and views on the small benchmark tables."""

import contextlib
import io
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from acctpulse.operators.briefs import per_prompt
from acctpulse.plans import run as R
from acctpulse.plans import views as V
from acctpulse.sources import adapters
from acctpulse.plans.ingest import marks
from acctpulse.sources.store import COMPACTION, RUN, Store, batch_name

FIRST, SECOND = "2024-01-20 00:30:00", "2024-01-27 00:30:00"


def answer(prompt):
    if "Supplier#000000003" in prompt:
        raise RuntimeError("no answer")
    return '{"summary": "fine", "recommended_action": "wait"}', len(prompt), 7


def until(sources, as_of):
    """The sources as they were at a time."""
    at = F.lit(as_of).cast("timestamp_ntz")
    return {**sources, "events": sources["events"].filter(F.col("occurred_at") <= at)}


def batches(store, table):
    return sorted(r.batch for r in store.visible(table).collect())


def values(counters):
    return {r.counter: r.value for r in counters.collect()}


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    sf_dir = "/root/testdata/sf0.001"
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    sources = adapters.sources(spark, sf_dir)
    notes = adapters.notes(spark, sf_dir)
    first = values(R.run(until(sources, FIRST), store, FIRST, per_prompt(answer), "m"))
    rejected = R.take_notes(store, notes.drop("note_id", "created_at"), FIRST)
    second = values(R.run(until(sources, SECOND), store, SECOND, per_prompt(answer), "m"))
    return store, sources, first, second, rejected


def test_first_run_generates_for_every_account(done):
    _, _, first, _, _ = done
    assert first["companies_scored"] == first["dim_accounts_upserted"] == 10
    assert first["generated"] == 9  # one call failed
    assert first["skipped_no_score_change"] == first["skipped_cached"] == 0
    assert first["at_risk_count"] == 0


def test_second_run_gates_by_score_change(done):
    store, _, _, second, _ = done
    moved = store.read("score_state").filter(F.abs(F.col("score") - F.col("prev_score")) > 5).count()
    assert second["skipped_no_score_change"] == 10 - moved
    assert store.read("brief_queue").filter("gate = 'generate'").count() == 10 + moved


def test_failed_call_is_kept_as_error_row(done):
    store = done[0]
    errors = store.read("responses").filter(F.col("error").isNotNull()).collect()
    assert errors and all(r.company_id == 3 and "no answer" in r.error for r in errors)
    assert store.read("ai_summaries").filter("company_id = 3").isEmpty()


def test_incremental_facts_equal_one_batch(done, spark):
    store, sources, *_ = done
    from acctpulse.operators.daily import events_daily

    once = {
        (r.company_id, r.event_date, r.event_type): r.event_count
        for r in events_daily(until(sources, SECOND)["events"], sources["users"]).collect()
    }
    folded = {(r.company_id, r.event_date, r.event_type): r.event_count for r in R.daily_facts(store).collect()}
    assert folded == once
    newest = until(sources, SECOND)["events"].agg(F.max("id")).first()[0]
    assert sorted(tuple(r)[:2] for r in marks(store).collect()) == [("events", newest), ("events/run", newest)]


def test_history_and_state_agree(done):
    store = done[0]
    from acctpulse.operators.trend import score_trend

    trend = {r.company_id: (r.current_score, r.prev_score, r.at_risk) for r in score_trend(store.read("fact_health_score")).collect()}
    state = {r.company_id: (r.score, r.prev_score, r.at_risk) for r in store.read("score_state").collect()}
    assert trend == state and len(state) == 10


def test_rerun_of_a_batch_changes_nothing(done):
    store, sources, _, second, _ = done
    before = {t: store.read(t).count() for t in ("daily_log", "fact_health_score", "ai_summaries", "alert_log", "dim_accounts")}
    again = values(R.run(until(sources, SECOND), store, SECOND, per_prompt(answer), "m"))
    assert again == second
    assert before == {t: store.read(t).count() for t in before}


def test_compaction_keeps_the_facts(done):
    store = done[0]
    before = sorted(map(tuple, R.daily_facts(store).collect()))
    R.compact_daily(store)
    assert batches(store, "daily_log") == batches(store, "user_days") == [batch_name(0, COMPACTION)]
    assert sorted(map(tuple, R.daily_facts(store).collect())) == before
    assert store.committed("daily_log", R.batch_of(FIRST))


def test_notes_are_checked_against_accounts(done, spark):
    store, _, _, _, rejected = done
    notes = adapters.notes(spark, "/root/testdata/sf0.001")
    known = notes.filter("company_id < 10").count()
    assert store.read("crm_notes").count() == known
    assert rejected.count() == notes.count() - known
    more = notes.filter("company_id = 1").drop("note_id", "created_at")
    with pytest.raises(ValueError):
        R.take_notes(store, more, FIRST)
    R.take_notes(store, more, FIRST, batch_id=R.batch_of(FIRST) + 1)
    assert store.read("crm_notes").count() == known + more.count()


def test_views(done, spark):
    store = done[0]
    listed = V.list_accounts(store).collect()
    assert [r.latest_score for r in listed] == sorted((r.latest_score for r in listed), reverse=True)
    names = [r.company_name for r in V.list_accounts(store, order_by="name").collect()]
    assert names == sorted(names)
    detail = V.get_accounts(store, spark.createDataFrame([(1,), (99,)], "company_id long")).collect()
    assert [r.company_id for r in detail] == [1]
    assert [h.scored_at for h in detail[0].score_history] == [datetime(2024, 1, 27, 0, 30), datetime(2024, 1, 20, 0, 30)]
    assert detail[0].ai_summary.summary == "fine"
    assert detail[0].health_score.components is not None


def test_alerts_once_per_day_and_acknowledge(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    parts = (25, 20, 20, 4, 5)
    at = datetime(2024, 1, 8)
    state = [(1, 60, True, parts, at, 90, datetime(2024, 1, 1), 60, at)]
    store.append("score_state", spark.createDataFrame(state, store.schema("score_state")), 1)
    account = spark.createDataFrame([(1, "One", "pro")], "company_id long, company_name string, plan string")
    for column in store.schema("dim_accounts"):
        if column.name not in account.columns:
            account = account.withColumn(column.name, F.lit(None).cast(column.dataType))
    store.append("dim_accounts", account, 1)
    for at in ("2024-01-08 01:00:00", "2024-01-08 09:00:00", "2024-01-09 01:00:00"):
        R.scan_alerts(store, at)
    log = store.read("alert_log").orderBy("created_at").collect()
    assert [r.created_at for r in log] == [datetime(2024, 1, 8, 1), datetime(2024, 1, 9, 1)]
    assert log[0].message == "One (PRO) health score is 60/100 — flagged at-risk."
    ids = spark.createDataFrame([(log[0].alert_id,), ("nope",)], "alert_id string")
    assert [r.alert_id for r in R.take_acks(store, ids, "2024-01-09 02:00:00").collect()] == ["nope"]
    assert [r.alert_id for r in V.list_alerts(store, acknowledged=False).collect()] == [log[1].alert_id]
    assert [r.alert_id for r in V.list_alerts(store).collect()] == [log[1].alert_id, log[0].alert_id]


def test_uncommitted_batches_are_invisible(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    frame = spark.createDataFrame([("events", 5, None)], store.schema("sync_state"))
    assert store.read("sync_state").isEmpty()
    store.stage("sync_state", frame, 1)
    assert store.read("sync_state").isEmpty()
    store.commit(1, ["sync_state"])
    assert store.read("sync_state").count() == 1
    later = frame.withColumn("last_synced_id", F.lit(9).cast("bigint"))
    store.stage("sync_state", later, 2)
    store.commit(2, ["sync_state"], more=store.visible("sync_state").selectExpr("'sync_state' as table_name", "batch", "false as visible"))
    assert [r.last_synced_id for r in store.read("sync_state").collect()] == [9]
    # A step that died before its commit left rows behind: the next attempt takes their place.
    store.stage("sync_state", frame.unionByName(later), 3)
    store.append("sync_state", later, 3)
    assert [r.last_synced_id for r in store.read("sync_state").collect()] == [9, 9]


def test_state_tables_show_their_newest_batch(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    row = lambda n: spark.createDataFrame([(1, "a", n, None, None)], store.schema("user_activity"))
    for sequence in (9, 10):
        store.append("user_activity", row(sequence), sequence)
    assert [r.events for r in store.read("user_activity").collect()] == [10]
    assert [r.events for r in store.read_batch("user_activity", 9).collect()] == [9]


def test_days_are_partitions(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    parts = (25, 20, 20, 4, 5)
    for n in range(3):
        rows = [(1, 50, False, parts, datetime(2024, 1, 1 + day)) for day in (n, n + 1)] + [(2, 50, False, parts, None)]
        store.append("fact_health_score", spark.createDataFrame(rows, store.schema("fact_health_score")), n)
    assert store.read("fact_health_score").count() == 9
    late = store.read("fact_health_score", "2024-01-03")
    assert sorted(r.scored_at.day for r in late.collect()) == [3, 3, 4]
    with contextlib.redirect_stdout(io.StringIO()) as shown:
        late.explain("formatted")
    filters = [x for x in shown.getvalue().splitlines() if x.startswith("PartitionFilters") and "scored_date" in x]
    assert filters and all(">= 2024-01-03" in x and "dynamicpruning" in x for x in filters)
    opened = spark.read.parquet(f"{tmp_path}/fact_health_score").filter("scored_date >= date'2024-01-03'")
    assert opened.select("_metadata.file_path").distinct().count() == 3


def test_trailing_measure_and_alerts_open_their_days_only(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    sources = adapters.sources(spark, "/root/testdata/sf0.001")
    R.sync_daily(sources, store, SECOND)
    day = R.day_of("2024-02-20 00:00:00", R.WINDOW_DAYS)
    read = R.daily_facts(store, day)
    files = {r.f for r in read.groupBy().count().sparkSession.read.parquet(f"{tmp_path}/daily_log").filter(F.col("event_date") >= F.lit(day)).selectExpr("_metadata.file_path as f").collect()}
    assert all(f.rsplit("event_date=", 1)[1][:10] >= "2024-01-21" for f in files) and files
    whole = R.D.active_users_30d(R.daily_facts(store), "2024-02-20 00:00:00").collect()
    assert sorted(map(tuple, R.D.active_users_30d(read, "2024-02-20 00:00:00").collect())) == sorted(map(tuple, whole))


def test_failing_step_leaves_the_mark(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    sources = adapters.sources(spark, "/root/testdata/sf0.001")
    R.sync_daily(until(sources, FIRST), store, FIRST)
    before = marks(store).collect()

    def broken(*_args, **_kwargs):
        raise RuntimeError("lost")

    monkeypatch.setattr(store, "commit", broken)
    with pytest.raises(RuntimeError):
        R.run_step("daily", lambda: R.sync_daily(until(sources, SECOND), store, SECOND))
    assert marks(store).collect() == before
    assert batches(store, "daily_log") == [batch_name(R.batch_of(FIRST), RUN)]
    monkeypatch.undo()
    R.sync_daily(until(sources, SECOND), store, SECOND)
    assert len(batches(store, "daily_log")) == 2
    R.sync_daily(until(sources, SECOND), store, "2024-01-28 00:00:00")  # nothing new: no batch, same mark
    assert len(batches(store, "daily_log")) == 2


def test_incremental_accounts_equal_a_recount(spark, tmp_path):
    from acctpulse.operators.daily import events_daily, facts_of, fold_user_days

    store = Store(spark, str(tmp_path))
    sources = adapters.sources(spark, "/root/testdata/sf0.001")
    users = sources["users"]
    for at in (FIRST, SECOND):
        R.sync_daily(until(sources, at), store, at)
        R.sync_accounts(until(sources, at), store, at, from_log=True)
    for compacted in (False, True):
        if compacted:
            R.compact_daily(store)
        recount = R.account_rollup(**until(sources, SECOND), as_of=SECOND)
        assert sorted(map(tuple, store.read("dim_accounts").collect())) == sorted(map(tuple, recount.collect()))
        # Days split over the batches are counted exactly from the user days.
        exact = facts_of(fold_user_days(store.read("user_days")), users)
        once = events_daily(until(sources, SECOND)["events"], users)
        assert sorted(map(tuple, exact.collect())) == sorted(map(tuple, once.collect()))
    assert batches(store, "user_days") == [batch_name(0, COMPACTION)]


def exact_facts(store, users):
    from acctpulse.operators.daily import facts_of, fold_user_days

    return sorted(map(tuple, facts_of(fold_user_days(store.read("user_days")), users).collect()))


def test_back_dated_run_raises_and_loses_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    sources = adapters.sources(spark, "/root/testdata/sf0.001")
    R.run(until(sources, SECOND), store, SECOND, per_prompt(answer), "m")
    with pytest.raises(ValueError, match="before its newest"):
        R.run(sources, store, FIRST, per_prompt(answer), "m")
    R.run(sources, store, "2024-02-03 00:30:00", per_prompt(answer), "m")
    assert R.daily_facts(store).agg(F.sum("event_count")).first()[0] == 1000


def test_switching_to_incremental_accounts_equals_a_recount(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    sources = adapters.sources(spark, "/root/testdata/sf0.001")
    R.run(until(sources, FIRST), store, FIRST, per_prompt(answer), "m")
    R.run(sources, store, SECOND, per_prompt(answer), "m", incremental_accounts=True)
    recount = R.account_rollup(**sources, as_of=SECOND)
    assert sorted(map(tuple, store.read("dim_accounts").collect())) == sorted(map(tuple, recount.collect()))
    # A log that lacks user days is refused.
    facts = store.read("daily_log").limit(1)
    store.append("daily_log", facts, 1, writer="other")
    with pytest.raises(ValueError, match="user days"):
        R.sync_accounts(sources, store, "2024-02-03 00:30:00", from_log=True)


def test_chat_and_digest_rows_follow_the_hour(spark, tmp_path):
    for hour, digest in ((0, 3), (3, 0)):
        store = Store(spark, str(tmp_path / str(hour)))
        parts = (25, 20, 20, 4, 5)
        at = datetime(2024, 1, 8)
        state = [(1, 60, True, parts, at, 90, datetime(2024, 1, 1), 60, at)]
        store.append("score_state", spark.createDataFrame(state, store.schema("score_state")), 1)
        account = spark.createDataFrame([(1, "One", "pro")], "company_id long, company_name string, plan string")
        for column in store.schema("dim_accounts"):
            if column.name not in account.columns:
                account = account.withColumn(column.name, F.lit(None).cast(column.dataType))
        store.append("dim_accounts", account, 1)
        R.scan_alerts(store, f"2024-01-08 0{hour}:10:00")
        assert (store.read("alert_log").count(), store.read("chat_messages").count()) == (1, 1)
        assert store.read("alert_digests").count() == digest
        R.scan_alerts(store, f"2024-01-08 0{hour}:40:00")
        assert store.read("alert_log").count() == store.read("chat_messages").count() == 1


def test_briefs_for_chosen_accounts(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    sources = adapters.sources(spark, "/root/testdata/sf0.001")
    ids = spark.createDataFrame([(1,), (2,), (99,)], "company_id long")
    R.run(sources, store, SECOND, per_prompt(answer), "m", brief_ids=ids)
    assert sorted(r.company_id for r in store.read("ai_summaries").collect()) == [1, 2]


def test_activity_reads_new_batches_only(spark, tmp_path):
    from acctpulse.plans.ingest import FOLDED, fold_activity

    store = Store(spark, str(tmp_path))
    sources = adapters.sources(spark, "/root/testdata/sf0.001")
    expected = lambda at: sorted(map(tuple, R.D.activity_of(R.D.user_days(until(sources, at)["events"])).collect()))
    for n, at in enumerate((FIRST, SECOND)):
        R.sync_daily(until(sources, at), store, at)
        assert sorted(map(tuple, fold_activity(store).collect())) == expected(at)
        assert batches(store, "user_activity") == [batch_name(n, "fold")]
    fold_activity(store)  # nothing new: no batch
    assert batches(store, "user_activity") == [batch_name(1, "fold")]
    assert sorted(r.batch for r in store.commits().filter(F.col("table_name") == FOLDED).collect()) == batches(store, "user_days")
    R.compact_daily(store)
    assert sorted(map(tuple, fold_activity(store).collect())) == expected(SECOND)
    assert batches(store, "user_activity") == [batch_name(1, "fold")]
