"""Constraint report, drift, readers."""

import pytest

from acctpulse.operators.quality import constraint_report
from acctpulse.schemas import SOURCE_SCHEMAS, STORE_SCHEMAS
from acctpulse.sources.drift import schema_drift
from acctpulse.sources.readers import incremental, jdbc_options, read_source, select_renamed


def test_constraint_report(rows):
    tables = {
        "companies": rows([(1, "a", "gold", 0, None, None), (1, None, None, 0, None, None)], SOURCE_SCHEMAS["companies"]),
        "users": rows([(1, "e", 1, "boss", None, None), (2, "e", 7, "admin", None, None), (3, "e", None, "admin", None, None)], SOURCE_SCHEMAS["users"]),
        "events": rows([(i, 9, "x", None, None) for i in range(5)] + [(9, None, None, None, None)], SOURCE_SCHEMAS["events"]),
        "fact_health_score": rows([(1, 101, False, None, None), (1, 0, False, None, None), (1, None, False, None, None)], STORE_SCHEMAS["fact_health_score"]),
        "fact_events_daily": rows([(1, None, "x", 1, 1)] * 3, STORE_SCHEMAS["fact_events_daily"]),
    }
    broken = {r.rule: r.violations for r in constraint_report(tables).collect() if r.violations}
    assert broken == {
        "companies.name not null": 1,
        "companies.plan not null": 1,
        "companies.plan in domain": 1,
        "companies.(id) unique": 1,
        "users.role in domain": 1,
        "users.company_id present": 1,
        "events.user_id present": 1,
        "users.company_id references companies": 1,
        "events.event_type not null": 1,
        "events.user_id references users": 5,
        "fact_health_score.score not null": 1,
        "fact_health_score.score in range": 1,
        "fact_events_daily.event_date not null": 3,
        "fact_events_daily.(company_id, event_date, event_type) unique": 1,
    }


def test_drift_is_reported_and_never_read(spark, rows, tmp_path):
    users = rows([(1, "e", 1, "admin", None, None)], SOURCE_SCHEMAS["users"])
    drifted = users.selectExpr("*", "'x' as nickname", "cast(null as int) as age")
    report = schema_drift({"users": drifted, "teams": rows([(1,)], "id int")})
    assert sorted(map(tuple, report.collect())) == [("teams", "id"), ("users", "age"), ("users", "nickname")]
    assert schema_drift({"users": users}).collect() == []
    drifted.write.parquet(str(tmp_path / "users"))
    assert read_source(spark, str(tmp_path), "users").columns == SOURCE_SCHEMAS["users"].names
    assert read_source(spark, str(tmp_path), "users", known_only=False).columns == drifted.columns


def test_drift_reads_no_data(spark, sf_dir):
    report = schema_drift({"documents": spark.read.parquet(f"{sf_dir}/documents.parquet")})
    assert "Scan parquet" not in report._jdf.queryExecution().executedPlan().toString() and report.count() == 5


def test_missing_column_raises(spark, rows, tmp_path):
    renamed = rows([(1, 2, "x", None, None)], SOURCE_SCHEMAS["events"]).withColumnRenamed("user_id", "user")
    renamed.write.parquet(str(tmp_path / "events"))
    with pytest.raises(ValueError, match="user_id"):
        read_source(spark, str(tmp_path), "events")


def test_jdbc_options_split_by_id():
    options = jdbc_options("jdbc:x", "events", 0, 1000, 8)
    assert (options["partitionColumn"], options["numPartitions"], options["upperBound"]) == ("id", "8", "1000")


def test_incremental_starts_below_zero_and_reaches_the_scan(spark, rows, tmp_path):
    path = str(tmp_path / "events")
    rows([(0, 1, "x", None, None), (1, 1, "x", None, None)], SOURCE_SCHEMAS["events"]).write.parquet(path)
    events = read_source(spark, str(tmp_path), "events")
    assert incremental(events).count() == 2
    fresh = incremental(events, 0)
    assert [r.id for r in fresh.collect()] == [1]
    assert "GreaterThan(id,0)" in fresh._jdf.queryExecution().executedPlan().toString()


def test_select_renamed(rows):
    assert select_renamed(rows([(1, 2)], "a int, b int"), {"b": "x", "a": "y"}).first().asDict() == {"x": 2, "y": 1}
