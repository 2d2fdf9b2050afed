"""Fingerprints and their search against plain Python."""

import hashlib
import random
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from keyroll.llm import simhash as sh
from tests.llm.conftest import prose


def spark_hash(*parts):
    seed = 42
    for p in parts:
        data = p.encode() if isinstance(p, str) else struct.pack("<i", p)
        seed = xxhash.xxh64_intdigest(data, seed=seed)
    return seed


def fingerprint(text):
    ws = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
          .replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    value = 0
    for s in (1, 2):
        bits, total = [0] * 64, 0
        for w, after in zip(ws, [*ws[1:], ""]):
            for h, n in ((spark_hash(w, s), sh.WEIGHTS[min(len(w), 8)]), (spark_hash(w, after, s), sh.PAIR_WEIGHT)):
                total += n
                for k in range(64):
                    bits[k] += n * (h >> k & 1)
        value = value << 64 | sum(1 << k for k in range(64) if 2 * bits[k] > total)
    return value


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(spark_hash(r[1] or ""))))
    out = []
    for i, (key, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 4
        edited = text[:len(text) - cut] + after[:cut]
        own, new, nxt = fingerprint(text), fingerprint(edited), fingerprint(after)
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), f"{own:032x}", f"{new:032x}",
                    1 - (own ^ new).bit_count() / 128, 1 - (own ^ nxt).bit_count() / 128))
    return sorted(out, key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    rows = [(rng.randrange(10 ** 12) - 10 ** 11, prose(rng, rng.randint(1, 60)).upper() if i % 7 == 0 else prose(rng, rng.randint(1, 60)))
            for i in range(n)]
    rows += [(5, None), (6, ""), (7, " \n\t"), (8, "a"), (9, "日本語 текст 🎉🎉🎉"), (10, rows[0][1]), (None, "no id here"), (None, None)]
    return rows + [rows[3]] * 3 + [(rows[4][0], "same id, other text")]


@pytest.mark.parametrize("partitions", [1, 8])
def test_equals_brute_force(spark, partitions):
    rows = corpus(2, 80)
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, row int, key int, bucket int")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = sorted((tuple(r) for r in sh.compare(frame.repartition(5)).drop("f1", "f2").collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert got == brute(rows)


def test_one_row_and_none(spark):
    one = [(3, "only one text here")]
    assert [tuple(r) for r in sh.compare(spark.createDataFrame(one, "doc_id long, text string")).drop("f1", "f2").collect()] == brute(one)
    empty = sh.counted(sh.compare(spark.createDataFrame([], "doc_id long, text string")), F.col("doc_id") % 20 == 0)
    assert empty.count() == 0


def test_near_texts_differ_less_than_others(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(40, 200))) for i in range(120)]
    got = sh.compare(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r["near_edited"] > r["near_next"] for r in got) >= 118


def test_search_finds_every_neighbour(spark):
    """All pairs within the radius, each once; no others."""
    rng = random.Random(7)
    base = [rng.getrandbits(128) for _ in range(40)]
    prints = set(base)
    for x in base:
        for _ in range(12):
            for bit in rng.sample(range(128), rng.randint(1, 9)):
                x ^= 1 << bit
            prints.add(x)
    prints = sorted(prints)
    asked = prints[::3]

    def frame(values):
        return spark.createDataFrame([(signed(v >> 64), signed(v & (1 << 64) - 1)) for v in values], "f1 long, f2 long")

    got = sh.neighbours(frame(asked), frame(prints)).collect()
    whole = lambda a, b: (a & (1 << 64) - 1) << 64 | b & (1 << 64) - 1
    pairs = sorted((whole(r["f1"], r["f2"]), whole(r["g1"], r["g2"]), r["distance"]) for r in got)
    assert pairs == sorted((a, b, (a ^ b).bit_count()) for a in asked for b in prints if 0 < (a ^ b).bit_count() <= sh.RADIUS)
    assert len(pairs) > 100


def test_counts_in_the_query(spark):
    rng = random.Random(8)
    text = prose(rng, 400)
    rows = [(i, text if i % 2 else text + f" w{i}") for i in range(0, 60)]
    got = sh.counted(sh.compare(spark.createDataFrame(rows, "doc_id long, text string")), F.col("doc_id") % 20 == 0).collect()
    prints = {int(r["fingerprint"], 16) for r in got}
    for r in got:
        mine = int(r["fingerprint"], 16)
        want = sum(0 < (mine ^ x).bit_count() <= sh.RADIUS for x in prints) if r["doc_id"] % 20 == 0 else None
        assert r["n_near"] == want


def test_no_python_in_the_plan(spark):
    rows = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id long, text string")
    plan = sh.compare(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "Cartesian" not in plan
