"""Every registered query equals its DuckDB oracle on the sf0.001 tables."""

import pytest

import __spark_entry__ as E
from conftest import SF001
from oracle_util import compare, duck

QUERIES = E.queries()
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duck(SF001)
    yield c
    c.close()


def test_every_query_has_an_oracle():
    own = {n for n in QUERIES if not n.startswith("op") and n != "pipeline"}
    assert own <= set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF001)
    ok, msg = compare(df, con, ORACLE[name])
    assert ok, f"{name}: {msg}"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "readiness_status" in df.columns
