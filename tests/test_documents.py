"""Stored document tables against a dictionary, the player index and the sketches."""

import datetime as dt
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from keyroll.operators import extras as X
from keyroll.operators import serve as K
from keyroll.operators.players import PlayerIndex
from keyroll.sources import documents as DT

SCHEMA = ("pk string, sk string, gsi1pk string, gsi1sk string, player_damage array<struct<damage:bigint,player_name:string,"
          "player_id:string>>, duration_text string, deaths int, affixes string, keylevel int, dungeon_name string, "
          "combatlog_hash string, intime int, percent double, date bigint, patch string, dungeon_id int, created_at timestamp, batch_id long")


def doc(rng, n, patch, dungeon, batch, version=0):
    level, share = 2 + n % 17, 50 + (n * 37 % 1000) / 10
    sk = f"{level:02d}#{share:.6f}#{n}"
    players = [(rng.randint(1, 1000), f"Name{(n + i) % 5}", f"P{(n + i) % 5}") for i in range(2)]
    return (f"LOG#KEY#{patch}", sk, f"LOG#KEY#{patch}#{dungeon}", sk, players, "01:00", 0, "Tyrannical", level, "Plaguefall", str(n),
            1, share, 1000 + n * 7 % 300, patch, dungeon, dt.datetime(2024, 1, 1 + version), batch)


@pytest.fixture
def board(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(DT, "SLOT", 16)
    return DT.leaderboard(spark, str(tmp_path / "board"))


def files(board):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{board.path}/**/*.parquet", recursive=True)}


def batches(rng):
    """Three batches: new documents, newer versions, and an older version that must not count."""
    first = [doc(rng, n, "9.1" if n % 3 else "9.0.2", 2291 + n % 2, 1) for n in range(300)]
    second = [doc(rng, n, "9.1" if n % 3 else "9.0.2", 2291 + n % 2, 2, 1) for n in range(200, 420)]
    third = [doc(rng, n, "9.0.2", 2291, 3) for n in range(0, 30, 6)]
    return first, second, third


def newest(*parts):
    out = {}
    for rows in parts:
        for r in rows:
            old = out.get((r[0], r[1]))
            if old is None or (r[-2], r[-1]) >= (old[-2], old[-1]):
                out[r[0], r[1]] = r
    return out


def test_upserts_equal_a_dictionary(spark, board):
    parts = batches(random.Random(1))
    assert board.read() is None
    board.upsert(spark.createDataFrame([], SCHEMA))
    for i, rows in enumerate(parts):
        before = files(board)
        board.upsert(spark.createDataFrame(rows, SCHEMA).repartition(3))
        want = newest(*parts[:i + 1])
        got = {(r["pk"], r["sk"]): r for r in board.read().collect()}
        assert set(got) == set(want) and board.read().count() == len(want)
        assert all(got[k]["batch_id"] == want[k][-1] and got[k]["combatlog_hash"] == want[k][10] for k in want)
        touched = {(r[14], r[15]) for r in rows}
        for f, t in files(board).items():  # partitions that the batch does not touch keep their files
            if f in before:
                assert t == before[f] and not any(f"patch={p}/dungeon_id={d}/" in f for p, d in touched)
    board.upsert(spark.createDataFrame(parts[-1], SCHEMA))  # a replay
    assert board.read().count() == len(newest(*parts))
    assert dict(board.read().dtypes)["patch"] == "string" and board.index().agg(F.sum("n")).first()[0] == len(newest(*parts))


def test_pages_equal_the_sorted_board(spark, board):
    parts = batches(random.Random(2))
    for rows in parts:
        board.upsert(spark.createDataFrame(rows, SCHEMA))
    rng = random.Random(3)
    everything = newest(*parts).values()
    for patch, dungeon in (("9.1", None), ("9.1", 2291), ("9.0.2", 2292), ("none", None)):
        keys = sorted((r[1] for r in everything if r[14] == patch and dungeon in (None, r[15])), reverse=True)
        cursors = [None, "99#", "00#", *(rng.sample(keys, 3) if keys else [])]
        for c in cursors:
            down = [k for k in keys if c is None or k < c]
            page = K.board_page(board, patch, dungeon, next_sk=c).orderBy("pos").collect()
            sk = "sk" if dungeon is None else "gsi1sk"
            assert [r[sk] for r in page] == down[:10]
            assert all(r["last_page"] == (len(down) <= 10) for r in page)
            if c is not None:
                up = [k for k in keys if k > c]
                page = K.board_page(board, patch, dungeon, prev_sk=c).orderBy("pos").collect()
                assert [r[sk] for r in page] == up[-10:]


def test_a_page_reads_a_range_of_its_partition(spark, board):
    board.upsert(spark.createDataFrame(batches(random.Random(4))[0], SCHEMA))
    plan = K.board_page(board, "9.1", 2291, next_sk="12#")._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan parquet"):]
    assert "(patch#" in scan.split("PartitionFilters: ")[1].split("]")[0] and "2291" in scan.split("PartitionFilters: ")[1].split("], ")[0]
    pushed = scan.split("PushedFilters: ")[1].split("], ")[0]
    assert "LessThan(sk,12#)" in pushed and "GreaterThanOrEqual(sk," in pushed
    rows = board.span((F.col("patch") == "9.1") & (F.col("dungeon_id") == 2291), 11, below="12#").count()
    assert 11 <= rows <= 11 + 2 * 16


def test_run_details_by_key(spark, tmp_path):
    table = DT.run_details(spark, str(tmp_path / "details"))
    rows = [(f"LOG#KEY#{n}#OVERALL_PLAYER_DAMAGE", n, dt.datetime(2024, 1, 1), 1) for n in range(500)]
    docs = spark.createDataFrame(rows, "pk string, v int, created_at timestamp, batch_id long").withColumn("sk", F.col("pk"))
    table.upsert(DT.with_bucket(docs))
    assert [r["v"] for r in K.stored_run_detail(table, "77").collect()] == [77]
    assert K.stored_run_detail(table, "777").count() == 0
    plan = K.stored_run_detail(table, "77")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket#" in plan


def test_player_index(spark, tmp_path):
    parts = batches(random.Random(5))
    index = PlayerIndex(spark, str(tmp_path))
    for rows in parts[:2]:
        index.upsert(spark.createDataFrame(rows, SCHEMA))
    runs = [(p[2], p[1], r) for r in newest(*parts[:2]).values() for p in r[4]]
    mine = [r for i, _, r in runs if i == "P2"]
    got = [r["combatlog_hash"] for r in index.dungeon_runs("P2", "9.1", 2292).collect()]
    want = sorted((r for r in mine if (r[14], r[15]) == ("9.1", 2292)), key=lambda r: r[1], reverse=True)
    assert got == [r[10] for r in want] and len(got) > 10
    best = {r["dungeon_id"]: (r["combatlog_hash"], r["runs"]) for r in index.best_per_dungeon("P2", "9.1").collect()}
    for d in (2291, 2292):
        own = [r for r in mine if (r[14], r[15]) == ("9.1", d)]
        assert best[d] == (max(own, key=lambda r: r[1])[10], len(own))
    recent = [r["combatlog_hash"] for r in index.recent("P2", 7).collect()]
    assert recent == [r[10] for r in sorted(mine, key=lambda r: (-r[13], r[10]))[:7]]
    one = index.by_id("P2").collect()
    assert [(r["player_name"], r["runs"], r["last_date"]) for r in one] == [("Name2", len(mine), max(r[13] for r in mine))]
    assert index.by_id("nobody").count() == 0 and index.dungeon_runs("P", "9.1", 2292).count() == 0
    assert [r["player_id"] for r in index.search("nAME", 3).collect()] == ["P0", "P1", "P2"]
    assert [r["player_id"] for r in index.search("name", 3, after="name2#P2").collect()] == ["P3", "P4"]
    assert index.search("nobody", 3).count() == 0 and index.search("", 9).count() == 5


def test_merged_sketches_are_near_the_exact_ranks(spark):
    rng = random.Random(6)
    values = [(n % 3, n % 7, [(int(rng.paretovariate(1.1) * 1000), "a", "a")], rng.gauss(100, 30)) for n in range(30_000)]
    docs = spark.createDataFrame(values, "dungeon_id int, part int, player_damage array<struct<damage:bigint,player_name:string,player_id:string>>, percent double")
    states = X.dungeon_sketches(docs, "dungeon_id", "part")
    ranks = (0.01, 0.25, 0.5, 0.75, 0.99)
    got = X.percentiles(X.merge_sketches(states, "dungeon_id"), ranks).collect()
    assert len(got) == 3 * len(ranks)
    for r in got:
        own = [v for v in values if v[0] == r["dungeon_id"]]
        assert r["runs"] == len(own)
        for value, exact in ((r["damage"], sorted(v[2][0][0] for v in own)), (r["percent"], sorted(v[3] for v in own))):
            below, upto = sum(x < value for x in exact) / len(exact), sum(x <= value for x in exact) / len(exact)
            assert below - 0.01 <= r["rank"] <= upto + 0.01


def test_the_registered_pages_read_the_stored_board(spark, board, monkeypatch):
    """K1-K4 as they are registered, over a board of the test's own rows."""
    from keyroll.plans import relational_queries as Q
    rows = [doc(random.Random(1), n, Q.PATCH, Q.DUNGEON if n % 2 else 2284, 1) for n in range(60)]
    board.upsert(spark.createDataFrame(rows, SCHEMA))
    monkeypatch.setattr(Q.PB, "leaderboard", lambda *_: board)
    every = sorted((r[1] for r in rows), reverse=True)
    own = sorted((r[1] for r in rows if r[15] == Q.DUNGEON), reverse=True)
    wanted = {"k1_top_keys": every[:10], "k2_top_keys_dungeon": own[:10],
              "k3_next_page": [s for s in every if s < Q.CURSOR][:10], "k4_prev_page": [s for s in every if s > Q.CURSOR][-10:]}
    for name, sks in wanted.items():
        page = Q.QUERIES[name](spark, "unused").orderBy("pos").collect()
        assert [r["gsi1sk" if name.startswith("k2") else "sk"] for r in page] == sks, name


def test_documents_travel_once_in_an_upsert(spark, board):
    rows = spark.createDataFrame(batches(random.Random(1))[0], SCHEMA)
    plan = board._latest(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan
