"""Stored document tables.

A table is a folder of Parquet partitions. ``upsert`` rewrites the partitions
that a batch touches and no others: their rows and the batch's are put together,
the newest version per key stays, and the result is range-clustered and sorted
by the sort key, so the row groups of a partition hold disjoint ranges of it and
a bound on the sort key prunes by Parquet statistics.

Beside the rows lies a small index, one row per ``SLOT`` rows of a file: first
and last sort key and how many rows. A page read takes from it a bound behind
which a whole page is sure to lie, and scans that range only.

The rewrite is Spark's dynamic partition overwrite: tasks write to a staging
folder and the partitions are swapped when the job commits, so the old files
can be read until then and a lost executor costs a re-read. A batch that is
replayed gives the same table.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from keyroll.operators.extras import dungeon_sketches
from keyroll.session import scratch_path
from keyroll.sources.sinks import read_table

# Rows of an index entry, and bytes of a row group (a page reads a few of them).
SLOT = 1024
ROW_GROUP = 4 << 20

_WRITING = threading.Lock()  # streams of one driver take turns; a table has one writing driver


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class DocumentTable:
    """Documents (pk, sk, ..., created_at, batch_id) under ``path``, partitioned by the
    columns of ``partitions`` (name: type) and sorted by ``sort`` within them; partition and
    sort key follow from (pk, sk)."""

    def __init__(self, spark: SparkSession, path: str, partitions: dict[str, str], sort: str = "sk",
                 summary: Callable[[DataFrame, list[str]], DataFrame] | None = None):
        """``summary`` makes one row per partition from its documents and the names of the
        partition columns; it is kept beside the table for the partitions that change."""
        self.spark, self.path, self.index_path, self.summary_path = spark, path, f"{path}_index", f"{path}_summary"
        self.partitions, self.sort, self.summary = partitions, sort, summary

    # ------------------------------------------------------------- writing
    def upsert(self, docs: DataFrame) -> None:
        """Put documents; of two versions of a key the one with the higher
        (created_at, batch_id) stays. A document must not move to another partition.
        An empty batch changes nothing."""
        with _WRITING:
            names = list(self.partitions)
            docs = docs.withColumns({c: F.col(c).cast(t) for c, t in self.partitions.items()})
            given = scratch_path(self.spark, "given")
            docs.write.parquet(given)  # made once; read to find the partitions, their ranges and to write
            docs = self.spark.read.schema(docs.schema).parquet(given)
            touched = docs.select(names).distinct().collect()  # boards or hash buckets
            if not touched:
                return
            old = self._table(self.path)
            both = docs if old is None else old.filter(self._in(touched)).unionByName(docs, allowMissingColumns=True)
            self._write(self._latest(both), self.path)
            self._index(touched)
            if self.summary is not None:
                self._write(self.summary(self.read().filter(self._in(touched)), names), self.summary_path)

    def _latest(self, docs: DataFrame) -> DataFrame:
        """The newest version per key, range-clustered and sorted. The versions of a key agree
        in partition and sort key, so one range exchange brings them together and one sort
        serves the choice and the files: documents travel once."""
        place = [*self.partitions, self.sort]
        newest = Window.partitionBy(*place, *[k for k in ("pk", "sk") if k not in place]).orderBy(
            F.col("created_at").desc(), F.col("batch_id").desc())
        ranged = docs.repartitionByRange(*place).withColumn("_v", F.row_number().over(newest))
        return ranged.filter(F.col("_v") == 1).drop("_v").sortWithinPartitions(*place)

    def _write(self, rows: DataFrame, path: str) -> None:
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .option("parquet.block.size", ROW_GROUP).partitionBy(*self.partitions).parquet(path))

    def _index(self, touched: list) -> None:
        # Files are sorted: a slot's first and last row are its ends, the others' keys need not be compared.
        file, row = F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")
        rows = self._table(self.path).filter(self._in(touched)).select(*self.partitions, self.sort, file, row)
        ends = rows.groupBy("_file").agg(F.max("_row").alias("_end"))
        rows = rows.join(F.broadcast(ends), "_file")  # a row per file
        rows = rows.filter((F.col("_row") % SLOT == 0) | (F.col("_row") % SLOT == SLOT - 1) | (F.col("_row") == F.col("_end")))
        slots = rows.groupBy(*self.partitions, "_file", F.floor(F.col("_row") / SLOT).alias("_slot")).agg(
            # Null keys sort first: such a slot begins below every bound.
            F.when(F.count(self.sort) < F.count(F.lit(1)), F.lit("")).otherwise(F.min(self.sort)).alias("first"),
            F.max(self.sort).alias("last"), (F.max("_row") - F.min("_row") + 1).alias("n"))
        self._write(slots.drop("_file", "_slot").sortWithinPartitions(*self.partitions, "first"), self.index_path)

    def _in(self, touched: list) -> Column:
        """A filter on the partition columns only: read from the folder names."""
        return reduce(lambda a, b: a | b, [
            reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(r[c]).cast(t)) for c, t in self.partitions.items()])
            for r in touched])

    # ------------------------------------------------------------- reading
    def _table(self, path: str) -> DataFrame | None:
        if (found := read_table(self.spark, path)) is None:
            return None
        # Folder names are typed by the table, not guessed ('9.1' is no number).
        typed = StructType()
        for f in found.schema:
            own = self.partitions.get(f.name)
            typed = typed.add(f.name, DataType.fromDDL(own) if own else f.dataType, True)
        return self.spark.read.schema(typed).parquet(path)

    def read(self) -> DataFrame | None:
        """All documents; None while nothing has been written."""
        return self._table(self.path)

    def index(self) -> DataFrame | None:
        return self._table(self.index_path)

    def summaries(self) -> DataFrame | None:
        return self._table(self.summary_path)

    def get(self, where: Column, pk: str, sk: str) -> DataFrame:
        """The document of a key in the partition that ``where`` names; empty if none."""
        return self.read().filter(where & (F.col("pk") == pk) & (F.col("sk") == sk))

    def span(self, where: Column, limit: int, below: str | None = None, above: str | None = None) -> DataFrame:
        """Documents of the partitions that ``where`` names, ``below`` or else ``above`` a
        sort key (both exclusive), cut to a range in which the ``limit`` rows next to the
        bound lie: at least ``limit`` of them, or all there are."""
        c = F.col(self.sort)
        slots = self.index().filter(where)
        if below is None and above is not None:
            whole = slots.filter(F.col("first") > above).orderBy("last").limit(limit).collect()
            edge = _edge([(r["last"], r["n"]) for r in whole], limit)
            bounds = (c > above) if edge is None else (c > above) & (c <= edge)
        else:
            whole = (slots if below is None else slots.filter(F.col("last") < below)).orderBy(F.col("first").desc()).limit(limit).collect()
            edge = _edge([(r["first"], r["n"]) for r in whole], limit)
            parts = ([] if below is None else [c < below]) + ([] if edge is None else [c >= edge])
            bounds = reduce(lambda a, b: a & b, parts, F.lit(True))
        return self.read().filter(where & bounds)


def _edge(slots: list[tuple[str, int]], limit: int) -> str | None:
    """The bound of the slot with which ``limit`` rows are together."""
    total = 0
    for edge, n in slots:
        total += n
        if total >= limit:
            return edge
    return None


def leaderboard(spark: SparkSession, path: str) -> DocumentTable:
    """N1 documents, one partition per board: (patch, dungeon), with its sketches."""
    return DocumentTable(spark, path, {"patch": "string", "dungeon_id": "int"},
                         summary=lambda docs, by: dungeon_sketches(docs, *by))


DETAIL_BUCKETS = 64


def run_details(spark: SparkSession, path: str) -> DocumentTable:
    """N6 documents in hash buckets of their key (:func:`with_bucket`), sorted by it."""
    return DocumentTable(spark, path, {"bucket": "int"}, sort="pk")


def with_bucket(docs: DataFrame) -> DataFrame:
    return docs.withColumn("bucket", bucket(F.col("pk"), DETAIL_BUCKETS))


def of_bucket(pk: str) -> Column:
    """The partition filter of a key's bucket."""
    return F.col("bucket") == bucket(F.lit(pk), DETAIL_BUCKETS)
