"""Documented-but-unbuilt reads of the reference.

The player reads are in :mod:`keyroll.operators.players`.
All are expressed on the gold documents; grouped results use aggregates
with map-side partials (``max`` of a struct instead of a window), and the
top-k per player is a ``row_number() <= k`` filter that Spark turns into a
partial ``WindowGroupLimit`` before the shuffle, so a very active player
never sends all of their runs to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def filter_by_affix(docs: DataFrame, affix: str) -> DataFrame:
    """O3: leaderboard rows whose affix list names ``affix``."""
    return docs.filter(F.array_contains(F.split("affixes", ", "), affix))


def filter_by_player_class(docs: DataFrame, cls: str, specc: str | None = None) -> DataFrame:
    """O3: runs with at least one player of the class (and spec)."""
    cond = (lambda p: (p["class"] == cls) & (p["specc"] == specc)) if specc else (lambda p: p["class"] == cls)
    return docs.filter(F.exists("player_damage", cond))


def player_runs(docs: DataFrame) -> DataFrame:
    """One row per (run, player) of the leaderboard documents."""
    return docs.select("combatlog_hash", "sk", "dungeon_id", "keylevel", "date",
                       F.explode("player_damage").alias("p")) \
        .select("combatlog_hash", "sk", "dungeon_id", "keylevel", "date", F.col("p.player_id").alias("player_id"),
                F.col("p.player_name").alias("player_name"), F.col("p.damage").alias("damage"))


def best_run_per_dungeon(docs: DataFrame) -> DataFrame:
    """A player's best run (largest sort key) in every dungeon."""
    best = F.max(F.struct(F.col("sk"), F.col("combatlog_hash"), F.col("keylevel")))
    return (player_runs(docs).groupBy("player_id", "dungeon_id").agg(best.alias("b"), F.count(F.lit(1)).alias("runs"))
            .select("player_id", "dungeon_id", F.col("b.combatlog_hash").alias("combatlog_hash"),
                    F.col("b.sk").alias("sk"), F.col("b.keylevel").alias("keylevel"), "runs"))


def recent_runs(docs: DataFrame, k: int = 5) -> DataFrame:
    """Each player's ``k`` most recent runs (date desc, hash asc)."""
    w = Window.partitionBy("player_id").orderBy(F.col("date").desc(), F.col("combatlog_hash").asc())
    return (player_runs(docs).withColumn("recent", F.row_number().over(w)).filter(F.col("recent") <= k)
            .select("player_id", "recent", "combatlog_hash", "date"))


def dungeon_statistics(docs: DataFrame) -> DataFrame:
    """Per dungeon — runs, in-time runs, mean / min / max duration share
    and mean group damage (algebraic aggregates only)."""
    total = F.aggregate("player_damage", F.lit(0).cast("bigint"), lambda acc, p: acc + p["damage"])
    return (docs.withColumn("total_damage", total)
            .groupBy("dungeon_id").agg(
                F.count(F.lit(1)).alias("runs"),
                F.sum((F.col("intime") > 0).cast("bigint")).alias("intime_runs"),
                F.round(F.avg("percent"), 6).alias("avg_percent"),
                F.round(F.min("percent"), 6).alias("min_percent"),
                F.round(F.max("percent"), 6).alias("max_percent"),
                F.round(F.avg("total_damage"), 3).alias("avg_damage")))


# Relative rank error of a quantile sketch grows as 1 / SKETCH_K.
SKETCH_K = 800


def dungeon_sketches(docs: DataFrame, *by: str) -> DataFrame:
    """Mergeable state per ``by``: number of runs and quantile sketches of the group
    damage and of the share of the timer. A few kilobytes a row, whatever the runs."""
    total = F.aggregate("player_damage", F.lit(0).cast("bigint"), lambda acc, p: acc + p["damage"])
    rows = docs.select(*by, total.cast("double").alias("total"), F.col("percent").cast("double").alias("percent"))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"),
                                 F.kll_sketch_agg_double("total", F.lit(SKETCH_K)).alias("damage_sketch"),
                                 F.kll_sketch_agg_double("percent", F.lit(SKETCH_K)).alias("percent_sketch"))


def merge_sketches(states: DataFrame, *by: str) -> DataFrame:
    """States of parts (partitions, batches, patches) to one state per ``by``."""
    return states.groupBy(*by).agg(F.sum("runs").alias("runs"), *[
        F.kll_merge_agg_double(c, F.lit(SKETCH_K)).alias(c) for c in ("damage_sketch", "percent_sketch")])


def percentiles(states: DataFrame, ranks: tuple[float, ...]) -> DataFrame:
    """One row per state and rank: the values of the two sketches there."""
    at = F.array(*[F.lit(r) for r in ranks])
    keys = [c for c in states.columns if not c.endswith("_sketch")]
    values = {"damage": F.kll_sketch_get_quantile_double("damage_sketch", at), "percent": F.kll_sketch_get_quantile_double("percent_sketch", at)}
    rows = states.select(*keys, at.alias("rank"), *[v.alias(n) for n, v in values.items()])
    return rows.select(*keys, F.inline(F.arrays_zip("rank", *values)))
