"""Narrow fact model.

The reference stores every fact as (dimensions, measure_name, value). Spark
keeps two wide tables (``run_meta``, ``damage``); these operators convert to
and from the narrow form and write the fact sink.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyroll.operators.relational import BIGINT_MEASURES, VARCHAR_MEASURES

NARROW_COLUMNS = ("run_id", "run_hash", "measure_name", "measure_value_bigint", "measure_value_varchar",
                  "dungeon_name")


def unpivot_meta(meta: DataFrame) -> DataFrame:
    """one row per (run, present measure). Missing measures (NULL) are not
    written, as in the reference; ``dungeon_name`` rides on ``dungeon_id``."""
    entries = [F.struct(F.lit(m).alias("n"), F.col(m).cast("bigint").alias("b"),
                        F.lit(None).cast("string").alias("v")) for m in BIGINT_MEASURES]
    entries += [F.struct(F.lit(m).alias("n"), F.lit(None).cast("bigint").alias("b"),
                         F.col(m).cast("string").alias("v")) for m in VARCHAR_MEASURES]
    extra = [c for c in ("run_id", "ingest_time", "upload_id") if c in meta.columns]
    e = meta.select(*extra, "run_hash", "dungeon_name", F.explode(F.array(*entries)).alias("e"))
    out = e.select(*extra, "run_hash", F.col("e.n").alias("measure_name"),
                   F.col("e.b").alias("measure_value_bigint"), F.col("e.v").alias("measure_value_varchar"),
                   F.when(F.col("e.n") == "dungeon_id", F.col("dungeon_name")).alias("dungeon_name"))
    return out.filter(F.col("measure_value_bigint").isNotNull() | F.col("measure_value_varchar").isNotNull())


def retain(facts: DataFrame, as_of: _dt.datetime, days: int = 365, time_col: str = "ingest_time") -> DataFrame:
    """the store keeps 365 days; older facts are dropped (on a table
    partitioned by ``upload_date`` this is partition pruning)."""
    lo = as_of - _dt.timedelta(days=days)
    return facts.filter(F.col(time_col) >= F.lit(lo))
