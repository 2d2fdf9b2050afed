"""Registered queries over the relational bridge (B1 runs, B2 damage).

Each function takes ``(spark, sf_dir)`` and returns a DataFrame whose column
names equal those of the matching oracle in ``oracle_sql``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyroll.functions import scoring as S
from keyroll.operators import facts as FA
from keyroll.operators import gold as G
from keyroll.operators import relational as R
from keyroll.operators import serve as K
from keyroll.plans import boards as PB
from keyroll.sources import bridge as B

# Fixed request parameters of the registered serving queries.
PATCH = S.DEFAULT_PATCH
DUNGEON = 2291
CURSOR = "15#"
DETAIL_RUN = "32"


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return B.damage_b(spark, sf_dir), B.runs_b(spark, sf_dir)


def a6_damage_per_player(spark, sf_dir):
    return R.damage_per_player(B.damage_b(spark, sf_dir))


def a7_damage_per_player_spell(spark, sf_dir):
    return R.damage_per_player_spell(B.damage_b(spark, sf_dir))


def a11_keys_result(spark, sf_dir):
    return R.keys_result(*_inputs(spark, sf_dir))


def a11_keys_result_left(spark, sf_dir):
    return R.keys_result(*_inputs(spark, sf_dir), join_mode="left")


def a12_breakdown_result(spark, sf_dir):
    return R.breakdown_result(*_inputs(spark, sf_dir))


def a10_missing_breakdowns(spark, sf_dir):
    damage, meta = _inputs(spark, sf_dir)
    expected = damage.select("run_hash").distinct()
    return R.missing_results(expected, R.breakdown_result(damage, meta), "empty_breakdown")


def f1_unpivot_meta(spark, sf_dir):
    return FA.unpivot_meta(B.runs_b(spark, sf_dir)).drop("run_id")


def f2_pivot_meta(spark, sf_dir):
    return R.pivot_meta(FA.unpivot_meta(B.runs_b(spark, sf_dir)))


def x_scoring(spark, sf_dir):
    """X1-X11 evaluated for every bridge run."""
    r = B.runs_b(spark, sf_dir)
    pct, intime = S.timed_as_percent(F.col("dungeon_id"), F.col("duration"))
    pct_fixed, intime_fixed = S.timed_as_percent(F.col("dungeon_id"), F.col("duration"), corrected=True)
    mmss = S.duration_mmss(F.col("duration"))
    return r.select(
        "run_hash",
        mmss.alias("duration_text"),
        S.min_sec_to_millis(mmss).alias("mmss_ms"),
        S.dungeon_limit(F.col("dungeon_id"), 0).alias("intime_ms"),
        intime.alias("intime"),
        intime_fixed.alias("intime_corrected"),
        F.round(pct, 6).alias("percent"),
        S.sort_key(F.col("key_level"), pct, F.col("run_hash")).alias("sk"),
        S.leaderboard_pk(F.col("patch")).alias("pk"),
        S.dungeon_pk(F.col("patch"), F.col("dungeon_id")).alias("gsi1pk"),
        S.run_detail_pk(F.col("run_hash")).alias("detail_pk"),
        S.dedup_pk(F.col("run_hash")).alias("dedup_pk"),
        S.affix_names(F.col("two_affix_id"), F.col("four_affix_id"), F.col("seven_affix_id"),
                      F.col("ten_affix_id")).alias("affixes"),
        S.finished_flag(F.col("finished")).alias("finished"),
    )


def _explode_players(docs: DataFrame) -> DataFrame:
    return (docs.select("*", F.posexplode("player_damage").alias("player_pos", "p"))
                .select("pk", "sk", "gsi1pk", "combatlog_hash", "player_pos",
                        F.col("p.damage").alias("damage"), F.col("p.player_name").alias("player_name"),
                        F.col("p.player_id").alias("player_id"), F.col("p.class").alias("class"),
                        F.col("p.specc").alias("specc"), "duration_text", "deaths", "affixes", "keylevel",
                        "dungeon_name", "dungeon_id", "finished", "intime", "date"))


def n1_leaderboard_docs(spark, sf_dir):
    return _explode_players(G.leaderboard_docs(*_inputs(spark, sf_dir)))


def n3_player_totals(spark, sf_dir):
    p = G.player_totals(B.damage_b(spark, sf_dir))
    return p.select("run_hash", "caster_name", "caster_id", "damage",
                    F.size("damage_per_spell").cast("bigint").alias("n_spells"),
                    F.col("damage_per_spell")[0]["spell_id"].alias("top_spell_id"),
                    F.col("damage_per_spell")[0]["damage"].alias("top_spell_damage"))


def n6_breakdown_docs(spark, sf_dir):
    d = G.breakdown_docs(*_inputs(spark, sf_dir))
    p = d.select("pk", "combatlog_hash", "duration_text", "affixes", "keylevel", "dungeon_id", "intime",
                 "finished", F.posexplode("player_damage").alias("player_pos", "p"))
    s = p.select("*", F.posexplode("p.damage_per_spell").alias("spell_pos", "s"))
    return s.select("pk", "combatlog_hash", "duration_text", "affixes", "keylevel", "dungeon_id", "intime",
                    "finished", "player_pos", F.col("p.player_name").alias("player_name"),
                    F.col("p.player_id").alias("player_id"), F.col("p.damage").alias("player_total"),
                    "spell_pos", F.col("s.spell_id").alias("spell_id"), F.col("s.spell_name").alias("spell_name"),
                    F.col("s.damage").alias("spell_damage"))


def s10_board_upsert(spark, sf_dir):
    """The stored board after two upsert batches, one row per document and player,
    with the batch that its newest version came from."""
    docs = PB.leaderboard(spark, sf_dir).read()
    return docs.select("pk", "sk", "gsi1pk", "combatlog_hash", "patch", "dungeon_id", "batch_id", F.explode("player_damage").alias("p")).select(
        "pk", "sk", "gsi1pk", "combatlog_hash", "patch", "dungeon_id", "batch_id", F.col("p.player_id").alias("player_id"),
        F.col("p.damage").alias("damage"))


def _page(spark, sf_dir, **request) -> DataFrame:
    """One page of the stored board, its players written as ``id=damage`` in document order."""
    page = K.board_page(PB.leaderboard(spark, sf_dir), PATCH, **request)
    players = F.transform("player_damage", lambda p: F.concat_ws("=", p["player_id"], p["damage"].cast("string")))
    return page.withColumn("players", F.array_join(players, ";")).drop("player_damage")


def k1_top_keys(spark, sf_dir):
    return _page(spark, sf_dir)


def k2_top_keys_dungeon(spark, sf_dir):
    return _page(spark, sf_dir, dungeon_id=DUNGEON)


def k3_next_page(spark, sf_dir):
    return _page(spark, sf_dir, next_sk=CURSOR)


def k4_prev_page(spark, sf_dir):
    return _page(spark, sf_dir, prev_sk=CURSOR)


def k8_run_detail(spark, sf_dir):
    d = K.stored_run_detail(PB.run_details(spark, sf_dir), DETAIL_RUN)
    return (d.select("pk", "combatlog_hash", F.posexplode("player_damage").alias("player_pos", "p"))
             .select("pk", "combatlog_hash", "player_pos", F.col("p.player_name").alias("player_name"),
                     F.col("p.damage").alias("player_total"),
                     F.size("p.damage_per_spell").cast("bigint").alias("n_spells")))


def k9_page_numbers(spark, sf_dir):
    return K.page_numbers(PB.leaderboard(spark, sf_dir).read())


def k9_page_numbers_dungeon(spark, sf_dir):
    return K.page_numbers(PB.leaderboard(spark, sf_dir).read(), index="gsi1")


QUERIES = {
    "a6_damage_per_player": a6_damage_per_player,
    "a7_damage_per_player_spell": a7_damage_per_player_spell,
    "a11_keys_result": a11_keys_result,
    "a11_keys_result_left": a11_keys_result_left,
    "a12_breakdown_result": a12_breakdown_result,
    "a10_missing_breakdowns": a10_missing_breakdowns,
    "f1_unpivot_meta": f1_unpivot_meta,
    "f2_pivot_meta": f2_pivot_meta,
    "x_scoring": x_scoring,
    "n1_leaderboard_docs": n1_leaderboard_docs,
    "n3_player_totals": n3_player_totals,
    "n6_breakdown_docs": n6_breakdown_docs,
    "s10_board_upsert": s10_board_upsert,
    "k1_top_keys": k1_top_keys,
    "k2_top_keys_dungeon": k2_top_keys_dungeon,
    "k3_next_page": k3_next_page,
    "k4_prev_page": k4_prev_page,
    "k8_run_detail": k8_run_detail,
    "k9_page_numbers": k9_page_numbers,
    "k9_page_numbers_dungeon": k9_page_numbers_dungeon,
}


# ------------------------------------------------------------ optional tier
def _docs(spark, sf_dir):
    return PB.leaderboard(spark, sf_dir).read()


def o3_affix_filter(spark, sf_dir):
    from keyroll.operators import extras as X
    d = X.filter_by_player_class(X.filter_by_affix(_docs(spark, sf_dir), "Prideful"), "unsupported")
    return d.select("combatlog_hash", "sk", "affixes")


def o4_best_run_per_dungeon(spark, sf_dir):
    from keyroll.operators import extras as X
    return X.best_run_per_dungeon(_docs(spark, sf_dir))


def o5_recent_runs(spark, sf_dir):
    from keyroll.operators import extras as X
    return X.recent_runs(_docs(spark, sf_dir), 5)


def o6_merge_spells(spark, sf_dir):
    rows = R.damage_per_player_spell(B.damage_b(spark, sf_dir)).withColumn(
        "spell_name", F.concat(F.lit("spell"), (F.col("spell_id") % 10).cast("string")))
    return G.merge_spells_by_name(rows)


def o7_dungeon_statistics(spark, sf_dir):
    from keyroll.operators import extras as X
    return X.dungeon_statistics(_docs(spark, sf_dir))


# Fixed request parameters of the player reads.
PLAYER, RECENT, PREFIX, FOUND = "Player-1", 10, "NAME", 3
RANKS = (0.1, 0.5, 0.9, 0.99)
# Highest distance of a sketch's value from the rank it was asked for (99 % confidence is below 0.4 %).
RANK_ERROR = 0.01


def o4_player_dungeon_runs(spark, sf_dir):
    found = PB.players(spark, sf_dir).dungeon_runs(PLAYER, PATCH, DUNGEON)
    return found.select("combatlog_hash", F.col("board_sk").alias("sk"), "keylevel", "damage", "date")


def o4_player_best(spark, sf_dir):
    return PB.players(spark, sf_dir).best_per_dungeon(PLAYER, PATCH)


def o5_player_recent(spark, sf_dir):
    return PB.players(spark, sf_dir).recent(PLAYER, RECENT).select("combatlog_hash", "patch", "dungeon_id", "date", "damage")


def o5_player_by_id(spark, sf_dir):
    return PB.players(spark, sf_dir).by_id(PLAYER)


def o5_player_search(spark, sf_dir):
    """The second page of a search whatever the case."""
    index = PB.players(spark, sf_dir)
    last = index.search(PREFIX, FOUND).agg(F.max("sk")).first()[0]
    return index.search(PREFIX, FOUND, after=last)


def o7_dungeon_percentiles(spark, sf_dir):
    """Percentiles per dungeon from the sketches of its boards, merged over patches, and
    whether the rank of each among all runs is within the bound."""
    from keyroll.operators import extras as X
    board = PB.leaderboard(spark, sf_dir)
    found = X.percentiles(X.merge_sketches(board.summaries(), "dungeon_id"), RANKS)
    total = F.aggregate("player_damage", F.lit(0).cast("bigint"), lambda acc, p: acc + p["damage"])
    rows = board.read().select("dungeon_id", total.alias("total"), F.col("percent").alias("share"))
    checked = rows.join(F.broadcast(found), "dungeon_id").groupBy("dungeon_id", "rank", "runs").agg(*[
        F.avg((F.col(a) < F.col(b)).cast("double")).alias(f"below_{b}") for a, b in (("total", "damage"), ("share", "percent"))], *[
        F.avg((F.col(a) <= F.col(b)).cast("double")).alias(f"upto_{b}") for a, b in (("total", "damage"), ("share", "percent"))])
    near = [(F.col(f"below_{b}") <= F.col("rank") + RANK_ERROR) & (F.col(f"upto_{b}") >= F.col("rank") - RANK_ERROR)
            for b in ("damage", "percent")]
    return checked.select("dungeon_id", "rank", "runs", near[0].alias("damage_near"), near[1].alias("percent_near"))


QUERIES.update({
    "o4_player_dungeon_runs": o4_player_dungeon_runs,
    "o4_player_best": o4_player_best,
    "o5_player_recent": o5_player_recent,
    "o5_player_by_id": o5_player_by_id,
    "o5_player_search": o5_player_search,
    "o7_dungeon_percentiles": o7_dungeon_percentiles,
    "o3_affix_filter": o3_affix_filter,
    "o4_best_run_per_dungeon": o4_best_run_per_dungeon,
    "o5_recent_runs": o5_recent_runs,
    "o6_merge_spells": o6_merge_spells,
    "o7_dungeon_statistics": o7_dungeon_statistics,
})


# ------------------------------------------------------------ A1 / A2
FRESH_AS_OF = "1995-06-17 00:01:00"


def a1_filter_runs(spark, sf_dir):
    """A1: damage per player of a set of runs given as a DataFrame of hashes
    (finished runs of patch 9.0.5) — a semi join, not a driver-side list."""
    runs = B.runs_b(spark, sf_dir).filter((F.col("patch") == "9.0.5") & (F.col("finished") != 0))
    return R.damage_per_player(R.filter_runs(B.damage_b(spark, sf_dir), runs.select("run_hash")))


def a2_fresh_damage(spark, sf_dir):
    """A2: only facts whose ingest time lies in the three minutes before
    ``as_of`` (ingest time of a bridge fact := its line's ship date)."""
    import datetime as dt
    facts = B.damage_b(spark, sf_dir, with_ingest_time=True)
    return R.damage_per_player(R.filter_fresh(facts, dt.datetime.fromisoformat(FRESH_AS_OF)))


QUERIES.update({"a1_filter_runs": a1_filter_runs, "a2_fresh_damage": a2_fresh_damage})
