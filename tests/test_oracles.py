"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks.compare import difference, duckdb_tables

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duckdb_tables(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    ranked = entry.entry(spark)
    scores = [r.final_score for r in ranked.collect()]
    assert len(scores) == 200 and scores == sorted(scores, reverse=True)
    assert "llm_fit_rationale" in ranked.columns
