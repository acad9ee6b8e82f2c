"""Every registered query against its SQL counterpart."""

import pytest

import __spark_entry__ as entry_module
import compare

QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


def test_every_query_has_sql():
    assert set(SQL) <= set(QUERIES)
    assert not {name for name in set(QUERIES) - set(SQL) if name != "pipeline" and not name.startswith("op")}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    assert compare.spark_types(df) == compare.sql_types(con, SQL[name])
    assert compare.spark_rows(df) == compare.sql_rows(con, SQL[name])


def test_entry_runs(spark):
    df = entry_module.entry(spark)
    assert df.count() == 10
    assert df.columns == [
        "company_id", "current_score", "prev_score", "scored_at", "prev_scored_at", "score_drop", "at_risk"
    ]
