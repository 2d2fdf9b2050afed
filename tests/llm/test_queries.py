"""Registered training-data queries: DuckDB SQL where it exists, shape and
coverage of every row otherwise."""

import pytest

from keyroll.llm import queries
from tests.conftest import SF_SMALL
from tests.oracle import compare, duck

ALL = queries.queries()


@pytest.mark.parametrize("name", sorted(queries.oracles()))
def test_matches_sql(spark, name):
    r = compare(spark, name, ALL[name], queries.oracles()[name], SF_SMALL, duck(SF_SMALL))
    assert r["status"] == "ok", r


@pytest.mark.parametrize("name", [n for n in ALL if n.startswith(("op1_", "op2_", "op3_", "op4_", "op9_", "op10_"))])
def test_one_row_per_document(spark, name):
    n = spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    got = ALL[name](spark, SF_SMALL)
    assert got.count() == n and got.select("doc_id").distinct().count() == n


def test_entry_lists_them():
    import __spark_entry__ as entry
    assert set(ALL) < set(entry.queries()) and "pipeline" in entry.queries()
    assert set(queries.oracles()) < set(entry.oracle_sql())
