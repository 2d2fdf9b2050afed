"""Operator tests against brute force on small fixtures: the block-wise
as-of lookup and ordinals (tiny blocks, so the carry path is exercised),
the skew-safe rank, and keyset paging edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from keyroll.operators.asof import asof_lookup, ordinal_within
from keyroll.operators.serve import keys_page
from keyroll.operators.sizing import rank_within


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("block", [1, 3, 1000])
def test_asof_matches_brute_force(spark, inclusive, block):
    rnd = random.Random(7 + block)
    left = [(f"g{rnd.randint(0, 3)}", rnd.randint(0, 60)) for _ in range(200)]
    right = [(f"g{rnd.randint(0, 3)}", rnd.randint(0, 60), i) for i in range(40)]
    # positions are unique per group on the right, as line positions are
    seen, uniq = set(), []
    for g, p, v in right:
        if (g, p) not in seen:
            seen.add((g, p))
            uniq.append((g, p, v))
    ldf = spark.createDataFrame([(i, g, p) for i, (g, p) in enumerate(left)], "id long, g string, lp long")
    rdf = spark.createDataFrame(uniq, "g string, rp long, v long")
    got = {r.id: (r.a.v if r.a else None) for r in
           asof_lookup(ldf, rdf, ["g"], "lp", "rp", ["v"], inclusive=inclusive, block=block, out="a").collect()}
    for i, (g, p) in enumerate(left):
        cands = [(rp, v) for (rg, rp, v) in uniq if rg == g and (rp <= p if inclusive else rp < p)]
        want = max(cands)[1] if cands else None
        assert got[i] == want, (i, g, p)


@pytest.mark.parametrize("block", [1, 4, 1 << 16])
def test_ordinal_matches_row_number(spark, block):
    rnd = random.Random(block)
    rows = [(f"r{rnd.randint(0, 4)}", p) for p in rnd.sample(range(10_000), 300)]
    df = spark.createDataFrame(rows, "run string, pos long")
    got = {(r.run, r.pos): r.ordinal for r in ordinal_within(df, ["run"], "pos", block=block).collect()}
    for run in {r for r, _ in rows}:
        for i, p in enumerate(sorted(p for r, p in rows if r == run), start=1):
            assert got[(run, p)] == i


def test_rank_within_matches_window(spark):
    rnd = random.Random(3)
    rows = [(f"LOG#KEY#9.0.{rnd.choice([2, 5])}", f"{rnd.randint(2, 20):02d}#{rnd.random() * 150:3.6f}#{i}", str(i))
            for i in range(500)]
    df = spark.createDataFrame(rows, "pk string, sk string, combatlog_hash string")
    got = {r.combatlog_hash: r.rank for r in rank_within(df, "pk", "sk", num_partitions=7).collect()}
    for pk in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == pk), key=lambda r: r[1], reverse=True)
        for i, r in enumerate(ordered, start=1):
            assert got[r[2]] == i


def _board(spark, n):
    rows = [("LOG#KEY#9.0.2", f"10#{100 + i:3.6f}#h{i}", f"h{i}") for i in range(n)]
    rows.append(("LOG#KEY#9.0.5", "99#1.000000#other", "other"))
    return spark.createDataFrame(rows, "pk string, sk string, combatlog_hash string")


def _model(sks, next_sk=None, prev_sk=None):
    """The reference's paging, restated on a Python list."""
    if next_sk:
        read, backward, first = sorted([s for s in sks if s < next_sk], reverse=True)[:11], False, False
    elif prev_sk:
        read, backward, first = sorted([s for s in sks if s > prev_sk])[:11], True, False
    else:
        read, backward, first = sorted(sks, reverse=True)[:11], False, True
    hit = len(read) == 11
    kept = read[:10]
    last = False if backward else not hit
    if backward and not hit:
        first = True
    return sorted(kept, reverse=True), first, last


@pytest.mark.parametrize("n", [0, 1, 10, 11, 12, 21])
@pytest.mark.parametrize("direction", ["first", "next", "prev"])
def test_paging_edge_cases(spark, n, direction):
    docs = _board(spark, n)
    sks = [f"10#{100 + i:3.6f}#h{i}" for i in range(n)]
    cursor = sks[len(sks) // 2] if sks else "10#100.000000#x"
    kw = {"next": {"next_sk": cursor}, "prev": {"prev_sk": cursor}, "first": {}}[direction]
    page = keys_page(docs, "LOG#KEY#9.0.2", columns=("combatlog_hash",), **kw).orderBy("pos").collect()
    kept, first, last = _model(sks, kw.get("next_sk"), kw.get("prev_sk"))
    assert [r.sk for r in page] == kept
    if kept:
        assert page[0].first_page == first and page[0].last_page == last
        assert page[0].first_sk == kept[0] and page[0].last_sk == kept[-1]


def test_next_row_matches_brute_force(spark):
    """The row that follows in a group, over block borders and empty blocks."""
    import random

    from keyroll.operators.asof import next_row
    rng = random.Random(12)
    rows = [(g, p, rng.choice("ab")) for g in ("x", "y", "z") for p in sorted(rng.sample(range(400), 40 if g != "z" else 1))]
    frame = spark.createDataFrame(rows, "g string, p long, v string").repartition(3)
    for block in (1, 7, 64, 1 << 16):
        got = {(r["g"], r["p"]): (r["next"]["v"], r["next"]["_pos"]) if r["next"] is not None else None
               for r in next_row(frame, ["g"], "p", ["v"], block=block).collect()}
        want = {}
        for g in ("x", "y", "z"):
            own = [r for r in rows if r[0] == g]
            for a, b in zip(own, [*own[1:], None]):
                want[a[:2]] = None if b is None else (b[2], b[1])
        assert got == want
