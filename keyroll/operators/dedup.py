"""Run fingerprints and de-duplication.

The fingerprint of a run is an order-sensitive hash over the bodies (no
timestamps) of its damage and ``COMBATANT_INFO`` lines. Each line is hashed
with its ordinal among the hashed lines of the run and the line hashes are
combined with ``bit_xor`` — an aggregate with a map-side partial, so a run
is never collected into one row. Two independent 64-bit hashes plus the
line count make a collision negligible; only equality matters.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyroll.functions import scoring as S
from keyroll.operators.asof import ordinal_within


def with_body_hashes(lines: DataFrame, body: str = "body") -> DataFrame:
    """Two independent 64-bit hashes of a line's body: what a fingerprint needs
    of the text, so the text itself need not travel."""
    return lines.withColumn("body_h1", F.xxhash64(body)).withColumn("body_h2", F.xxhash64(F.lit("keyroll"), body))


def fingerprint(hashed_lines: DataFrame, run: str = "run_id", pos: str = "pos") -> DataFrame:
    """``run_id -> run_hash`` for runs with at least one hashed line
    (a run without any gets no hash, Q8)."""
    d = ordinal_within(hashed_lines.select(run, pos, "body_h1", "body_h2"), [run], pos, out="_seq")
    h1 = F.xxhash64(F.col("_seq"), F.col("body_h1"))
    h2 = F.xxhash64(F.lit("keyroll-run-hash"), F.col("body_h2"), F.col("_seq"))
    agg = d.groupBy(run).agg(F.count(F.lit(1)).alias("_n"), F.bit_xor(h1).alias("_h1"), F.bit_xor(h2).alias("_h2"))
    run_hash = F.concat_ws("-", F.col("_n").cast("string"), F.lower(F.hex(F.col("_h1"))),
                           F.lower(F.hex(F.col("_h2"))))
    return agg.select(run, run_hash.alias("run_hash"), F.col("_n").alias("hashed_lines"))


def first_of_batch(runs: DataFrame, order_cols=("upload_id", "start_pos")) -> DataFrame:
    """D3: among runs with the same hash in one batch keep the first by
    (upload, start position) — a grouped ``min`` (map-side partial), so a
    hash with very many copies is never one window partition."""
    first = (runs.groupBy("run_hash")
             .agg(F.min(F.struct(*[F.col(c) for c in order_cols], F.col("run_id"))).alias("_first"))
             .select(F.col("_first.run_id").alias("run_id")))
    return runs.join(first, "run_id", "left_semi")


# Ledger tables are partitioned by a hash bucket, so a batch reads only the
# buckets of its own hashes (dynamic partition pruning).
LEDGER_BUCKETS = 256
# Tasks that write a batch's entries: a bucket is in one of them, so a batch adds
# one file per bucket, whatever its size.
LEDGER_WRITERS = 16


def hash_bucket(run_hash) -> F.Column:
    return F.pmod(F.xxhash64(run_hash), F.lit(LEDGER_BUCKETS)).cast("int")


def known_hashes(batch_runs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Ledger rows whose hash occurs in the batch. Neither side is
    broadcast by a hint. When the ledger carries the ``bucket``
    partition column, only the partitions of the batch's buckets are read:
    the bucket set (at most ``LEDGER_BUCKETS`` integers) becomes a partition
    filter on the ledger scan."""
    hashes = batch_runs.select("run_hash").distinct()
    if "bucket" in ledger.columns:
        hashes = hashes.withColumn("bucket", hash_bucket(F.col("run_hash")))
        buckets = [r[0] for r in hashes.select("bucket").distinct().collect()]   # <= LEDGER_BUCKETS values
        pruned = ledger.filter(F.col("bucket").isin(buckets)).select("run_hash", "bucket")
        return pruned.join(hashes, ["run_hash", "bucket"], "left_semi").select("run_hash")
    return ledger.select("run_hash").join(hashes, "run_hash", "left_semi")


def drop_known(batch_runs: DataFrame, ledger) -> DataFrame:
    """Runs whose hash is already in the ledger (a table, or an
    :class:`keyroll.operators.ledger.Ledger`) are skipped."""
    if ledger is None:
        return batch_runs
    known = known_hashes(batch_runs, ledger) if isinstance(ledger, DataFrame) else ledger.known(batch_runs)
    return batch_runs.join(known.distinct(), "run_hash", "left_anti")


def decide(runs: DataFrame, ledger) -> DataFrame:
    """D2 + D3: add ``duplicate`` (bool) to every hashed run of the batch."""
    fresh = first_of_batch(drop_known(runs, ledger)).select("run_id", F.lit(False).alias("duplicate"))
    return runs.join(fresh, "run_id", "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(True)))


def ledger_entries(kept: DataFrame, created_at: _dt.datetime, batch_id: int) -> DataFrame:
    """Ledger rows ``DEDUP#hash`` for the runs kept in this batch, dealt by bucket."""
    rows = kept.select("run_hash", S.dedup_pk(F.col("run_hash")).alias("pk"),
                       F.lit(created_at).alias("created_at"), F.lit(batch_id).cast("bigint").alias("batch_id"),
                       hash_bucket(F.col("run_hash")).alias("bucket"))
    return rows.repartition(LEDGER_WRITERS, "bucket")


def hash_rows(runs: DataFrame) -> DataFrame:
    """Per upload its run hashes, how often each occurs in it, whether all of these
    runs were duplicates, and the upload's date as event time; one row per
    (upload, hash), so an upload of any length is spread."""
    time = F.max(F.col("upload_date").cast("timestamp")) if "upload_date" in runs.columns else F.lit(None).cast("timestamp")
    return runs.groupBy("upload_id", "run_hash").agg(F.count(F.lit(1)).alias("n"), F.min("duplicate").alias("duplicate"),
                                                     time.alias("event_time"))


def hash_lists(runs: DataFrame) -> DataFrame:
    """The numbers of hashes and of duplicate hashes per upload."""
    some = runs.groupBy("upload_id", "run_hash").agg(F.max("duplicate").alias("duplicate"))
    return some.groupBy("upload_id").agg(F.count(F.lit(1)).alias("n_hashes"), F.count_if("duplicate").alias("n_duplicates"))


def delete_from_ledger(ledger: DataFrame, hashes: DataFrame) -> DataFrame:
    """The ledger without the given hashes (re-ingest); the caller writes
    it as a new table version."""
    return ledger.join(hashes.select("run_hash").distinct(), "run_hash", "left_anti")
