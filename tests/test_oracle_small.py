"""Every registered query against its DuckDB oracle on sf0.001 (the driver
runs the same check at sf0.01)."""

import pytest

import __spark_entry__ as E
from keyroll.plans.registry import all_queries
from tests.conftest import SF_SMALL
from tests.oracle import compare, duck

# Every query of the reference's operators has an oracle.
NAMES = sorted(all_queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, E.queries()[name], E.oracle_sql().get(name), SF_SMALL, con)
    assert r["status"] == "ok", r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "combatlog_hash" in df.columns
