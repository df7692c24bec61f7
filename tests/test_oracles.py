"""Every registered query with an oracle matches DuckDB on the sf0.001 tables."""

import pytest

import __spark_entry__ as E
from compare import compare, duck

SF = "/root/testdata/sf0.001"
ORACLE_QUERIES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", ORACLE_QUERIES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, SF, con)
    assert r["status"] == "match", r


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "decision" in df.columns
