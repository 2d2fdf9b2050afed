"""Gold-table sinks and reads.

Writes are idempotent per micro-batch: every batch owns the partition
``batch_id=N`` and rewrites it with dynamic partition overwrite, so a
replayed batch (task or driver retry) produces the same table. Reads apply
latest-wins per (pk, sk) — the document store's put-replaces semantics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def write_batch(df: DataFrame, path: str, batch_id: int, stream: str = "main", lead_partitions=()) -> None:
    """S9 / S10 write: rows of one batch of one stream into the partitions
    ``[lead partitions/]stream=S/batch_id=N`` (dynamic overwrite: a replay
    rewrites exactly the partitions the batch owns)."""
    (df.withColumn("stream", F.lit(stream)).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(*lead_partitions, "stream", "batch_id").parquet(path))


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def read_batch(spark: SparkSession, path: str, batch_id: int, stream: str = "main") -> DataFrame | None:
    """What one batch of a stream has written (a partition filter)."""
    table = read_table(spark, path)
    return None if table is None else table.filter((F.col("stream") == stream) & (F.col("batch_id") == batch_id))


def latest_documents(docs: DataFrame) -> DataFrame:
    """S10 read side: the newest version of each (pk, sk) document. Keys are
    unique per run, so each window group holds the versions of one key."""
    w = Window.partitionBy("pk", "sk").orderBy(F.col("created_at").desc(), F.col("batch_id").desc())
    return docs.withColumn("_v", F.row_number().over(w)).filter(F.col("_v") == 1).drop("_v")


def point_read(docs: DataFrame, pk: str, sk: str) -> DataFrame:
    """Get item by (pk, sk)."""
    return latest_documents(docs.filter((F.col("pk") == pk) & (F.col("sk") == sk)))


def range_read(docs: DataFrame, pk: str, bound: str | None = None, forward: bool = False, limit: int = 11,
               key: str = "pk", sort_key: str = "sk") -> DataFrame:
    """Items of one partition key beyond a sort-key bound, in the given
    direction, limited — a TakeOrderedAndProject."""
    d = docs.filter(F.col(key) == pk)
    if bound is not None:
        d = d.filter(F.col(sort_key) > bound) if forward else d.filter(F.col(sort_key) < bound)
    order = F.col(sort_key).asc() if forward else F.col(sort_key).desc()
    return d.orderBy(order).limit(limit)
