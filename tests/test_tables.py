"""Layouts: what a reader skips and what an upsert leaves alone."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from acctpulse.sources import adapters
from acctpulse.sources.drift import file_columns, read_drifting
from acctpulse.sources.readers import incremental
from acctpulse.sources.tables import upsert_buckets, write_clustered

SF_DIR = "/root/testdata/sf0.001"


def rows_scanned(df):
    """Rows that came out of the file scan of a plan without a shuffle."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().head()
    return plan.metrics().apply("numOutputRows").value()


def test_a_mark_opens_the_tail_only(spark, tmp_path):
    events, path = adapters.events(spark, SF_DIR), str(tmp_path / "events")
    write_clustered(events.filter("id < 800"), path, 4)
    write_clustered(events.filter("id >= 800"), path, 1)
    read = spark.read.schema(events.schema).parquet(path)
    fresh = incremental(read, 949)
    assert fresh.count() == 50 and rows_scanned(fresh.select("id", "user_id")) == 200
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, events.collect()))


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "dim")
    rows = lambda ids, text: spark.createDataFrame([(i, text) for i in ids], "id long, name string")
    upsert_buckets(path, rows(range(1000), "old"), ["id"], 32)
    files = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/bucket=*/*.parquet")}
    before = files()
    for _ in range(2):  # the same upsert again changes nothing
        upsert_buckets(path, rows([5, 2000], "new"), ["id"], 32)
        got = {r.id: r.name for r in spark.read.parquet(path).collect()}
        assert got == {**{i: "old" for i in range(1000)}, 5: "new", 2000: "new"}
        assert spark.read.parquet(path).count() == 1001
    after = files()
    assert 30 <= sum(before.get(f) == t for f, t in after.items()) < 32


def test_files_of_three_schemas(spark, tmp_path):
    path = str(tmp_path / "events")
    events = adapters.events(spark, SF_DIR)
    parts = [
        events.filter("id % 3 = 0").drop("metadata"),
        events.filter("id % 3 = 1"),
        events.filter("id % 3 = 2").withColumns({"id": F.col("id").cast("int"), "extra": F.lit(1)}),
    ]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
    got = read_drifting(spark, path, "events")
    expected = events.withColumn("metadata", F.when(F.col("id") % 3 != 0, F.col("metadata")))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, expected.collect()), key=repr)
    found = {(r.column_name, r.type): r.n_files for r in file_columns(spark, path).collect()}
    assert found["id", "int64"] == 2 and found["id", "int32"] == found["extra", "int32"] == 1 and found["metadata", "string"] == 2
    assert all(r.first_file.startswith("file:") for r in file_columns(spark, path).collect())
    with pytest.raises(ValueError, match="metadata"):
        parts[0].write.parquet(str(tmp_path / "lacking"))
        read_drifting(spark, str(tmp_path / "lacking"), "events")


def test_people_bitmaps_merge_over_batches(spark):
    from acctpulse.operators import daily as D
    from acctpulse.operators import people as P

    events, users = adapters.events(spark, SF_DIR), adapters.users(spark, SF_DIR)
    halves = [P.daily_people(D.user_days(events.filter(F.col("id") % 2 == k)), users) for k in (0, 1)]
    merged = P.merge_people(halves[0].unionByName(halves[1]))
    exact = {r.company_id: r.active_users_30d for r in D.active_users_exact(events, users, "2024-01-31 00:00:00").collect()}
    assert {r.company_id: r.active_users_30d for r in P.active_people(merged, "2024-01-31 00:00:00").collect()} == exact != {}
    assert "event_date" in merged.columns and merged.groupBy("company_id", "event_date", "bucket").count().filter("count > 1").isEmpty()
