"""What the physical plans must and must not contain."""

import re
from datetime import date, timedelta

import pytest

from acctpulse.operators import briefs as B
from acctpulse.operators.accounts import account_detail
from acctpulse.operators.alerts import alert_feed
from acctpulse.operators.daily import active_users_30d, events_daily, fold_daily
from acctpulse.operators.rollup import account_rollup
from acctpulse.operators.trend import flag_at_risk, score_trend
from acctpulse.plans.snapshots import score_snapshots
from acctpulse.registry.queries import QUERIES
from acctpulse.schemas import SOURCE_SCHEMAS, STORE_SCHEMAS
from acctpulse.sources import adapters
from acctpulse.sources.readers import read_source

AS_OF = "2024-01-31 00:00:00"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Empty Parquet tables of the store and the source schema; broadcast off, as for large inputs."""
    root = str(tmp_path_factory.mktemp("tables"))
    for name, schema in {**STORE_SCHEMAS, **SOURCE_SCHEMAS}.items():
        spark.createDataFrame([], schema).write.parquet(f"{root}/{name}")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield lambda name: spark.read.schema({**STORE_SCHEMAS, **SOURCE_SCHEMAS}[name]).parquet(f"{root}/{name}")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def exchanges(text: str) -> int:
    return len(re.findall(r"Exchange hashpartitioning", text))


def test_trend_is_one_exchange_of_limited_rows(stored):
    text = plan(score_trend(stored("fact_health_score")))
    assert exchanges(text) == 1 and "WindowGroupLimit" in text
    assert "components" not in text.split("ReadSchema")[1]


def test_daily_facts_read_few_columns_and_push_the_mark(stored):
    text = plan(events_daily(stored("events"), stored("users"), 41))
    assert "GreaterThan(id,41)" in text and "IsNotNull(user_id)" in text
    assert "metadata" not in text and "email" not in text
    assert "count(distinct" not in text  # distinct users are counted as rows


def test_trailing_window_reaches_the_scan_through_the_fold(stored):
    text = plan(active_users_30d(fold_daily(stored("daily_log")), AS_OF))
    assert "GreaterThanOrEqual(event_date,2024-01-01)" in text


def test_rollup_never_fans_out(stored):
    tables = {t: stored(t) for t in SOURCE_SCHEMAS}
    for mode in ("exact", "fanout"):
        text = plan(account_rollup(**tables, as_of=AS_OF, mode=mode))
        assert "NestedLoop" not in text and "Cartesian" not in text
        # Events are aggregated before they meet users.
        scan = text.index("occurred_at", text.index("FileScan parquet", text.index("event_type")))
        assert "SortMergeJoin" not in text[scan:scan + 200]


def test_snapshots_scan_events_once(stored):
    tables = {t: stored(t) for t in SOURCE_SCHEMAS}
    for seats in ("distinct", "daily_sum"):
        text = plan(score_snapshots(**tables, as_ofs=["2024-01-10", "2024-01-20"], seats=seats, login_event="a"))
        assert len(re.findall(r"FileScan parquet \[id#\d+L?,user_id", text)) == 1
        assert "NestedLoop" not in text and "Cartesian" not in text


def test_detail_lists_are_limited_before_the_exchange(stored):
    text = plan(
        account_detail(
            stored("dim_accounts"), stored("fact_health_score"), stored("ai_summaries"), stored("crm_notes"),
            stored("alert_log"),
        )
    )
    assert text.count("WindowGroupLimit") == 8  # partial and final for each of four tables
    assert exchanges(text) == 5  # one per table, the joins add none


def test_feed_is_a_top_k(stored):
    text = plan(alert_feed(stored("alert_log"), stored("dim_accounts")))
    assert "TakeOrderedAndProject" in text and "WindowGroupLimit" in text


def test_generator_runs_behind_the_gate(stored):
    text = plan(B.generate(stored("brief_queue"), B.per_prompt(lambda p: (p, 1, 1)), 2))
    assert "MapInPandas" in text and "EqualTo(gate,generate)" in text


def test_source_scan_reads_known_columns_only(spark, tmp_path):
    empty = spark.createDataFrame([], SOURCE_SCHEMAS["companies"])
    empty.selectExpr("*", "'x' as extra").write.parquet(str(tmp_path / "companies"))
    assert read_source(spark, str(tmp_path), "companies").columns == SOURCE_SCHEMAS["companies"].names


def test_flagging_ranks_the_history_once(stored):
    text = plan(flag_at_risk(stored("fact_health_score")))
    assert text.count("Scan parquet") == 2 and text.count("WindowGroupLimit") == 2  # one rank, partial and final


def test_detail_cuts_before_it_keeps_some_accounts(stored):
    ids = stored("dim_accounts").select("company_id")
    tables = [stored(t) for t in ("dim_accounts", "fact_health_score", "ai_summaries", "crm_notes", "alert_log")]
    logical = account_detail(*tables, ids)._jdf.queryExecution().optimizedPlan().toString()
    lines = logical.splitlines()
    for n, line in enumerate(lines):
        if "LeftSemi" in line and "company_id" in line:
            below = "\n".join(lines[n : n + 12])
            assert "crm_notes" not in below or "Window" in below


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_uses_a_cross_join(spark, sf_dir, name):
    text = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    python = "MapInPandas" in text or "BatchEvalPython" in text or "ArrowEvalPython" in text
    assert not python, "Python belongs behind a staged result"


def test_adapters_use_whole_tables(spark, sf_dir):
    counts = {name: df.count() for name, df in adapters.sources(spark, sf_dir).items()}
    raw = {"companies": "supplier", "users": "customer", "events": "events", "tickets": "orders"}
    assert counts == {k: spark.read.parquet(f"{sf_dir}/{v}.parquet").count() for k, v in raw.items()}


def test_a_year_of_daily_snapshots(spark, sf_dir):
    times = [f"{day:%Y-%m-%d} 00:00:00" for day in (date(2023, 7, 1) + timedelta(days=n) for n in range(365))]
    got = score_snapshots(
        **adapters.sources(spark, sf_dir), as_ofs=times, mode="exact", seats="distinct", login_event=adapters.LOGIN_EVENT
    )
    rows = {(r.company_id, str(r.scored_at)): r.score for r in got.collect()}
    assert len(rows) == 365 * 10
    few = score_snapshots(
        **adapters.sources(spark, sf_dir), as_ofs=times[200::60], mode="exact", seats="distinct", login_event=adapters.LOGIN_EVENT
    ).collect()
    assert all(rows[r.company_id, str(r.scored_at)] == r.score for r in few) and few
