"""The compacted ledger: no known run is missed, no new one skipped, versions stay readable."""

import datetime as dt
import glob

from pyspark.sql import functions as F

from keyroll.operators import dedup as D
from keyroll.operators.ledger import BITS_PER_HASH, Ledger, bloom, maybe_known, merge_blooms
from keyroll.sources import sinks as SK


def hashes(spark, values):
    return spark.createDataFrame([(v,) for v in values], "run_hash string")


def append(spark, path, batch, values, stream="text"):
    rows = D.ledger_entries(hashes(spark, values), dt.datetime(2024, 1, 1 + batch), batch)
    SK.write_batch(rows.drop("batch_id"), path, batch, stream, lead_partitions=("bucket",))


def names(frame):
    return sorted(r["run_hash"] for r in frame.distinct().collect())


def test_bloom_filter_says_yes_to_all_it_holds(spark):
    held, other = [f"h{i}" for i in range(5000)], [f"o{i}" for i in range(5000)]
    bits = 1 << (BITS_PER_HASH * 40 - 1).bit_length()  # about 20 hashes a bucket
    parts = merge_blooms(bloom(hashes(spark, held[:3000]), bits), bloom(hashes(spark, held[2000:]), bits))
    whole = bloom(hashes(spark, held), bits)
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.select(*parts.columns).collect()))
    yes = maybe_known(hashes(spark, held + other), whole, bits).collect()
    found = {r["run_hash"] for r in yes}
    assert set(held) <= found and len(found - set(held)) < 250 and len(yes) == len(found)


def test_compaction_and_versions(spark, tmp_path):
    path = str(tmp_path / "ledger")
    ledger = Ledger(spark, path)
    assert ledger.compact() is None and names(ledger.known(hashes(spark, ["a"]))) == []
    append(spark, path, 0, ["a", "b"])
    assert ledger.compact() is None                                  # the latest batch may be replayed
    append(spark, path, 1, ["c"])
    append(spark, path, 2, ["d", "e"])
    append(spark, path, 0, ["p", "q"], "packed")
    one = ledger.compact()
    assert (one["version"], one["hashes"], one["upto"]) == (1, 3, {"text": 1})
    assert names(ledger.hashes(1)) == ["a", "b", "c"] and names(ledger.hashes()) == ["a", "b", "c", "d", "e", "p", "q"]
    asked = hashes(spark, ["a", "c", "d", "p", "x", "y", "a"])
    assert names(ledger.known(asked)) == ["a", "c", "d", "p"]
    assert names(Ledger(spark, path, skip=("text", 2)).known(asked)) == ["a", "c", "p"]
    append(spark, path, 3, ["f"])
    append(spark, path, 1, ["a", "r"], "packed")
    two = ledger.compact()
    assert (two["version"], two["hashes"], two["upto"]) == (2, 7, {"text": 2, "packed": 0})
    assert names(ledger.hashes(1)) == ["a", "b", "c"] and names(ledger.hashes(2)) == ["a", "b", "c", "d", "e", "p", "q"]
    assert names(ledger.known(hashes(spark, ["r", "f", "b", "z"]))) == ["b", "f", "r"]
    assert names(D.drop_known(hashes(spark, ["r", "z", "q"]), ledger)) == ["z"]
    for bucket in glob.glob(f"{path}_base/v2/hashes/bucket=*"):
        assert len(glob.glob(f"{bucket}/*.parquet")) == 1            # small files are merged


def test_a_compaction_without_its_row_does_not_count(spark, tmp_path):
    path = str(tmp_path / "ledger")
    for n in range(3):
        append(spark, path, n, [f"h{n}"])
    ledger = Ledger(spark, path)
    hashes(spark, ["h0", "bad"]).withColumn("bucket", F.lit(1)).write.parquet(f"{path}_base/v1/hashes")
    assert ledger.version() is None and names(ledger.known(hashes(spark, ["h0", "bad"]))) == ["h0"]
    assert ledger.compact()["hashes"] == 2 and names(ledger.hashes()) == ["h0", "h1", "h2"]


def test_a_batch_adds_one_file_per_bucket(spark, tmp_path):
    import datetime as dt
    import glob

    from keyroll.operators import dedup as D
    kept = spark.range(0, 5000, 1, 7).selectExpr("concat('h', id) AS run_hash")
    path = str(tmp_path / "ledger")
    D.ledger_entries(kept, dt.datetime(2024, 1, 1), 1).write.partitionBy("bucket").parquet(path)
    folders = glob.glob(f"{path}/bucket=*")
    assert len(folders) == D.LEDGER_BUCKETS and all(len(glob.glob(f"{f}/*.parquet")) == 1 for f in folders)
    assert spark.read.parquet(path).count() == 5000
