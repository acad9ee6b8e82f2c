"""Streams against their batch forms."""

from datetime import datetime

from pyspark.sql import functions as F

import pytest
from pyspark.errors import StreamingQueryException

from acctpulse.operators.alerts import new_alerts
from acctpulse.operators.daily import events_daily, facts_of, fold_daily, fold_user_days
from acctpulse.plans.ingest import compact_daily, ingest_run_batch, user_days_complete
from acctpulse.sources import adapters
from acctpulse.sources.store import Store
from acctpulse.streaming.alerts import stream_alerts
from acctpulse.streaming.daily import event_stream, stream_daily

SF_DIR = "/root/testdata/sf0.001"


def write(df, where):
    df.coalesce(1).write.mode("append").parquet(where)


def test_stream_equals_batch_with_late_files(spark, tmp_path):
    events, users = adapters.events(spark, SF_DIR), adapters.users(spark, SF_DIR)
    src, checkpoint = str(tmp_path / "events"), str(tmp_path / "checkpoint")
    store = Store(spark, str(tmp_path / "store"))
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    late = F.col("id") % 7 == 0
    # Whole days per file, so that the fold of unique users is exact; late events come in a file of their own.
    write(events.filter((F.col("occurred_at") < cut) & ~late), src)
    stream_daily(event_stream(spark, src, 1), users, store, checkpoint).awaitTermination()
    write(events.filter((F.col("occurred_at") >= cut) & ~late), src)
    write(events.filter(late), src)
    stream_daily(event_stream(spark, src, 1), lambda: users, store, checkpoint).awaitTermination()
    assert store.visible("daily_log").count() == 3
    count = lambda df: {(r.company_id, r.event_date, r.event_type): r.event_count for r in df.collect()}
    assert count(fold_daily(store.read("daily_log"))) == count(events_daily(events, users))
    # Nothing new: no batch. A fresh checkpoint under the same writer meets other content under its epochs.
    stream_daily(event_stream(spark, src, 1), users, store, checkpoint).awaitTermination()
    assert store.visible("daily_log").count() == 3
    with pytest.raises(StreamingQueryException):
        stream_daily(event_stream(spark, src), users, store, str(tmp_path / "other")).awaitTermination()
    assert count(fold_daily(store.read("daily_log"))) == count(events_daily(events, users))


def exact(store, users):
    return sorted(map(tuple, facts_of(fold_user_days(store.read("user_days")), users).collect()))


def test_stream_run_compaction_and_next_epoch(spark, tmp_path):
    events, users = adapters.events(spark, SF_DIR), adapters.users(spark, SF_DIR)
    src, checkpoint = str(tmp_path / "events"), str(tmp_path / "checkpoint")
    store = Store(spark, str(tmp_path / "store"))
    last = events.agg(F.max("id")).first()[0]
    sources = lambda most: {"events": events.filter(F.col("id") <= most), "users": users}
    write(events.filter(F.col("id") <= last // 4), src)
    stream_daily(event_stream(spark, src), users, store, checkpoint).awaitTermination()
    ingest_run_batch(store, sources(last // 2), 20240101, "2024-01-20")
    compact_daily(store)
    # Events that no run has had: the next epoch of the same stream.
    write(events.filter(F.col("id") > last // 2), src)
    stream_daily(event_stream(spark, src), users, store, checkpoint).awaitTermination()
    assert exact(store, users) == sorted(map(tuple, events_daily(events, users).collect()))
    # A run over the whole source finds nothing that the stream has not loaded.
    ingest_run_batch(store, sources(last), 20240102, "2024-01-30")
    assert exact(store, users) == sorted(map(tuple, events_daily(events, users).collect()))
    assert user_days_complete(store)


def test_second_stream_and_stream_after_run(spark, tmp_path):
    events, users = adapters.events(spark, SF_DIR), adapters.users(spark, SF_DIR)
    store = Store(spark, str(tmp_path / "store"))
    last = events.agg(F.max("id")).first()[0]
    ingest_run_batch(store, {"events": events.filter(F.col("id") <= last // 3), "users": users}, 1, "2024-01-20")
    odd = F.col("id") % 2 == 1
    # The first stream's files also hold what the run had; the second has a checkpoint, a name and new files of its own.
    for name, part in (("one", events.filter(odd)), ("two", events.filter(~odd))):
        write(part, str(tmp_path / name))
        stream_daily(event_stream(spark, str(tmp_path / name)), users, store, str(tmp_path / f"check-{name}"), name).awaitTermination()
    assert exact(store, users) == sorted(map(tuple, events_daily(events, users).collect()))


def test_stream_alerts_once_per_day(spark, tmp_path):
    schema = "company_id long, company_name string, plan string, score int, scored_at timestamp_ntz"
    src = str(tmp_path / "flagged")
    at = lambda d, h: datetime(2024, 1, d, h)
    files = [
        [(1, "A", "pro", 40, at(5, 1)), (1, "A", "pro", 39, at(5, 9)), (2, "B", "trial", 10, at(5, 2))],
        [(1, "A", "pro", 38, at(5, 20)), (1, "A", "pro", 35, at(6, 1))],
        [(2, "B", "trial", 12, at(6, 3)), (1, "A", "pro", 30, at(6, 4))],
    ]
    store = Store(spark, str(tmp_path / "store"))

    def feed(part, checkpoint="checkpoint", writer="alerts"):
        write(spark.createDataFrame(part, schema), f"{src}-{writer}")
        flagged = spark.readStream.schema(schema).parquet(f"{src}-{writer}")
        stream_alerts(flagged, store, str(tmp_path / checkpoint), writer=writer, shared=writer == "other").awaitTermination()

    for part in files:
        feed(part)
    feed([(3, "C", "pro", 5, at(1, 1)), (1, "A", "pro", 30, at(5, 23))])  # a late day, and a late row of a logged day
    feed([(1, "A", "pro", 38, at(5, 20)), (3, "C", "pro", 4, at(2, 1))], "elsewhere", "other")  # another stream
    got = store.read("alert_log").collect()
    assert sorted((r.company_id, r.created_at.day) for r in got) == [(1, 5), (1, 6), (2, 5), (2, 6), (3, 1), (3, 2)]
    assert {(r.company_id, r.created_at.day): r.created_at.hour for r in got}[1, 5] == 1
    assert all("flagged at-risk" in r.message and r.acknowledged is False for r in got)
    # The daily scan of such a day finds it logged.
    names = spark.createDataFrame([(1, "A", "pro", 30, at(6, 4))], schema)
    assert new_alerts(names, store.read("alert_log"), "2024-01-06 01:00:00").isEmpty()


def test_windows_equal_batch_up_to_the_watermark(spark, tmp_path):
    from pyspark.sql import functions as F

    from acctpulse.operators.daily import active_users_30d
    from acctpulse.streaming import windows as W

    users = spark.createDataFrame([(u, u % 3 or None) for u in range(8)], "id long, company_id long")
    at = lambda d, h=0: datetime(2024, 1, d, h)
    schema = "id long, user_id long, event_type string, occurred_at timestamp_ntz"
    # The second file reaches back two days; of the third, one event comes after its day was closed.
    files = [
        [(1, 1, "a", at(1, 5)), (2, 1, "a", at(1, 6)), (3, 2, "b", at(3)), (4, 3, "a", at(4, 1))],
        [(5, 4, "a", at(2, 12)), (6, 1, "a", at(3, 3)), (7, None, "a", at(5)), (8, 99, "a", at(5)), (9, 2, "b", at(9, 1))],
        [(10, 5, "a", at(4, 2)), (11, 5, "a", at(8, 2)), (12, 7, "a", at(20))],
    ]
    for part in files:
        write(spark.createDataFrame(part, schema), str(tmp_path / "src"))
        for name, fn in (("daily", W.daily_windows), ("trailing", lambda e, u: W.trailing_windows(e, u, n_days=2))):
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "src"))
            W.append_to(fn(stream, users), str(tmp_path / name), str(tmp_path / f"{name}-check")).awaitTermination()
    events = spark.createDataFrame([r for part in files for r in part if r[0] != 10], schema)
    facts = events_daily(events, users).filter("event_date < '2024-01-18'")
    got = spark.read.parquet(str(tmp_path / "daily"))
    assert sorted(map(tuple, got.select(facts.columns).collect())) == sorted(map(tuple, facts.collect())) != []
    trailing = spark.read.parquet(str(tmp_path / "trailing")).collect()
    expected = []
    for day in range(1, 18):
        known = facts.filter(F.col("event_date") <= F.lit(f"2024-01-{day:02d}"))
        window = known.filter(F.col("event_date") >= F.date_sub(F.lit(f"2024-01-{day:02d}").cast("date"), 2))
        expected += [(r.company_id, day, r.n) for r in window.groupBy("company_id").agg(F.sum("unique_users").alias("n")).collect()]
    assert sorted((r.company_id, r.as_of_date.day, r.active_users_30d) for r in trailing) == sorted(expected)
    whole = active_users_30d(facts, "2024-01-17 23:00:00").collect()
    assert {r.company_id for r in whole} >= {r.company_id for r in trailing}


def test_alert_state_survives_a_restart_and_is_the_only_memory(spark, tmp_path, monkeypatch):
    schema = "company_id long, company_name string, plan string, score int, scored_at timestamp_ntz"
    store = Store(spark, str(tmp_path / "store"))
    read = []
    plain = store.read
    monkeypatch.setattr(store, "read", lambda table, *a, **k: read.append(table) or plain(table, *a, **k))
    for hour in (1, 5, 9):
        row = [(1, "A", "pro", 40, datetime(2024, 1, 5, hour)), (2, "B", "pro", 40, datetime(2024, 1, 5 + hour, hour))]
        write(spark.createDataFrame(row, schema), str(tmp_path / "src"))
        flagged = spark.readStream.schema(schema).parquet(str(tmp_path / "src"))
        stream_alerts(flagged, store, str(tmp_path / "checkpoint")).awaitTermination()
    assert "alert_log" not in read
    got = sorted((r.company_id, r.created_at.day) for r in plain("alert_log").collect())
    assert got == [(1, 5), (2, 6), (2, 10), (2, 14)]


def test_counters_of_late_and_orphan_events(spark, tmp_path):
    from acctpulse.plans.ingest import ingest_log, ingest_stream_batch

    users = spark.createDataFrame([(1, 10), (2, None)], "id long, company_id long")
    schema = "id long, user_id long, event_type string, occurred_at timestamp_ntz"
    at = datetime(2024, 1, 1)
    batch = lambda ids: spark.createDataFrame([(i, u, "a", at) for i, u in ids], schema)
    store = Store(spark, str(tmp_path / "store"))
    ingest_run_batch(store, {"events": batch([(5, 1), (7, 2), (8, 3)]), "users": users}, 1, "2024-01-02")
    ingest_stream_batch(store, batch([(9, 1), (10, 1)]), users, 0, "s")
    ingest_stream_batch(store, batch([(9, 1)]).limit(0), users, 1, "s")
    ingest_stream_batch(store, batch([(3, 1), (10, 2), (11, None), (12, 1)]), users, 2, "s")
    got = sorted(tuple(r) for r in ingest_log(store).collect())
    assert got == [("run", 1, 3, 0, 2, 8), ("s", 0, 2, 0, 0, 10), ("s", 1, 0, 0, 0, None), ("s", 2, 2, 1, 1, 12)]
