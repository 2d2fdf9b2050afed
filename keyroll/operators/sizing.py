"""Skew-safe ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyroll.session import ensure_checkpoint_dir


def _ordered(c: str, descending: bool) -> Column:
    return F.col(c).desc() if descending else F.col(c).asc()


def rank_within(df: DataFrame, part_col: str, order_col: str, descending: bool = True,
                num_partitions: int | None = None, rank_col: str = "rank") -> DataFrame:
    """1-based position of every row in its ``part_col`` group by ``order_col``
    (unique within the group), without a window over a whole group.

    Rows are range-partitioned on (part, order), in as many tasks as adaptive
    execution finds right unless ``num_partitions`` says otherwise, so each task
    holds a contiguous slice; per-(task, part) counts give each slice its offset.
    The tagged rows are checkpointed to the shared checkpoint folder so the
    task ids and row ids are stable when tasks are retried. The offsets table
    has at most ``partitions + groups`` rows.
    """
    ensure_checkpoint_dir(df.sparkSession)
    keys = [F.col(part_col).asc(), _ordered(order_col, descending)]
    ranged = df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)
    tagged = (ranged.sortWithinPartitions(*keys)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_mid", F.monotonically_increasing_id())
                .checkpoint(eager=True))
    stats = tagged.groupBy("_pid", part_col).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    w = Window.partitionBy(part_col).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stats.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    out = tagged.join(offsets, ["_pid", part_col])
    return (out.withColumn(rank_col, (F.col("_off") + F.col("_mid") - F.col("_m0") + 1).cast("bigint"))
               .drop("_pid", "_mid", "_n", "_m0", "_off"))
