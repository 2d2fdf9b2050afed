"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyroll.session import scratch_path

# White space of the word definition: space and \t \n \x0b \x0c \r. Everything
# else, control characters and non-breaking space included, is part of a word.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

# Bytes of a stored table up to which it is broadcast.
BROADCAST_BYTES = 16 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read
    it back: cuts the lineage, and a lost executor only costs a re-read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Words of a text in order (null text: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def sized(keys: DataFrame) -> DataFrame:
    """``keys`` (read from a stored table of a few short columns) with a broadcast hint if
    its files hold ``BROADCAST_BYTES`` at most; unchanged, for a shuffled join, otherwise."""
    size = keys._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(keys) if int(str(size)) <= BROADCAST_BYTES else keys
