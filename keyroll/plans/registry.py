"""Registry of every query exposed to the driver (``__spark_entry__``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keyroll.plans import log_oracles, log_queries, oracle_sql, relational_queries

Query = Callable[[SparkSession, str], DataFrame]


def _wrap(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from keyroll.session import apply_conf
        apply_conf(spark)
        return fn(spark, sf_dir)
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def all_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    out.update(relational_queries.QUERIES)
    out.update(log_queries.QUERIES)
    return {k: _wrap(v) for k, v in out.items()}


def all_oracles() -> dict[str, str]:
    out = dict(oracle_sql.RELATIONAL)
    out.update(log_oracles.ORACLES)
    return out
