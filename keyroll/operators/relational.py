"""The two per-run queries of the write path.

The reference pivots its narrow fact table with ten self-joins on the run
hash. Here run meta is one row per run: either read from the wide
``run_meta`` table or pivoted from the narrow facts in *one* scan by
conditional aggregation (:func:`pivot_meta`). Damage is aggregated before
the join (partial + final hash aggregate), so the join sees one row per
(run, player[, spell]) instead of one per hit.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyroll.functions import scoring as S

# --- Fixed values that must equal the reference's: measure names, their value
# type in the narrow model, and the measures each query requires.
BIGINT_MEASURES = ("dungeon_id", "key_level", "date", "two_affix_id", "four_affix_id",
                   "seven_affix_id", "ten_affix_id", "duration", "finished")
VARCHAR_MEASURES = ("patch",)
META_COLUMNS = ("dungeon_name",) + BIGINT_MEASURES + VARCHAR_MEASURES

# (an inner join on a missing measure drops the run)
KEYS_MEASURES = ("dungeon_id", "key_level", "duration", "finished", "two_affix_id", "four_affix_id",
                 "seven_affix_id", "ten_affix_id", "patch", "date")
BREAKDOWN_MEASURES = ("dungeon_id", "key_level", "duration", "finished", "two_affix_id", "four_affix_id",
                      "seven_affix_id", "ten_affix_id", "date")


# ------------------------------------------------------------------ A1, A2
def filter_runs(df: DataFrame, run_hashes: DataFrame | list[str] | None) -> DataFrame:
    """A1: keep facts of the given runs. A list becomes an IN filter (pushed to
    the scan); a DataFrame of hashes becomes a semi join (Spark may broadcast
    it when its statistics are small)."""
    if run_hashes is None:
        return df
    if isinstance(run_hashes, DataFrame):
        return df.join(run_hashes.select("run_hash").distinct(), "run_hash", "left_semi")
    return df.filter(F.col("run_hash").isin(list(run_hashes)))


def filter_fresh(df: DataFrame, as_of: _dt.datetime | None, minutes: int = S.FRESHNESS_MINUTES,
                 time_col: str = "ingest_time") -> DataFrame:
    """A2: ``time BETWEEN as_of - 3 min AND as_of``; ``as_of`` is explicit so
    reruns give the same answer."""
    if as_of is None:
        return df
    lo = as_of - _dt.timedelta(minutes=minutes)
    return df.filter(F.col(time_col).between(F.lit(lo), F.lit(as_of)))


# ------------------------------------------------------------------ F2 / F4
def pivot_meta(narrow: DataFrame) -> DataFrame:
    """F2 + F4: narrow run-meta facts -> one row per run hash, in one pass.

    ``narrow`` has ``run_hash, measure_name, measure_value_bigint,
    measure_value_varchar`` and the ``dungeon_name`` dimension. A measure
    written twice keeps its largest value (one row per run; the reference's
    join would multiply rows instead).
    """
    m = F.col("measure_name")
    aggs = [F.max(F.when(m == "dungeon_id", F.col("dungeon_name"))).alias("dungeon_name")]
    aggs += [F.max(F.when(m == name, F.col("measure_value_bigint"))).cast("bigint").alias(name)
             for name in BIGINT_MEASURES]
    aggs += [F.max(F.when(m == name, F.col("measure_value_varchar"))).alias(name) for name in VARCHAR_MEASURES]
    return (narrow.filter(m.isin(*(BIGINT_MEASURES + VARCHAR_MEASURES)))
                  .groupBy("run_hash").agg(*aggs))


def require_measures(meta: DataFrame, measures, join_mode: str = "inner") -> DataFrame:
    """Q10: with the reference's inner joins a run lacking any measure has no
    result row; ``join_mode='left'`` keeps it with NULLs."""
    if join_mode == "inner":
        cond = None
        for c in measures:
            term = F.col(c).isNotNull()
            cond = term if cond is None else cond & term
        meta = meta.filter(cond)
    elif join_mode != "left":
        raise ValueError("join_mode must be 'inner' or 'left'")
    return meta


# ------------------------------------------------------------------ A5 - A7
def player_damage(damage: DataFrame) -> DataFrame:
    """A5: player casters only, and never the null GUID; measure must be damage
    when the narrow fact table is given (Q19)."""
    cond = S.is_player_flag(F.col("caster_type")) & (F.col("caster_id") != F.lit(S.NULL_GUID))
    if "measure_name" in damage.columns:
        cond = cond & (F.col("measure_name") == "damage")
    return damage.filter(cond)


def damage_per_player(damage: DataFrame) -> DataFrame:
    """SUM(damage) by (run, caster name, caster id)."""
    d = damage if "damage" in damage.columns else damage.withColumnRenamed("measure_value_bigint", "damage")
    return (player_damage(d).groupBy("run_hash", "caster_name", "caster_id")
            .agg(F.sum("damage").cast("bigint").alias("damage")))


def damage_per_player_spell(damage: DataFrame) -> DataFrame:
    """SUM(damage) by (run, caster name, caster id, spell id, spell name)."""
    d = damage if "damage" in damage.columns else damage.withColumnRenamed("measure_value_bigint", "damage")
    return (player_damage(d).groupBy("run_hash", "caster_name", "caster_id", "spell_id", "spell_name")
            .agg(F.sum("damage").cast("bigint").alias("damage")))


# ------------------------------------------------------------------ A8, A11, A12
def fanout_factor(meta: DataFrame) -> DataFrame:
    """Q11: how many rows the reference's measure joins produce per run — the
    product of the number of facts written per measure (``*_facts``
    columns; a missing count is 1)."""
    cols = [c for c in meta.columns if c.endswith("_facts")]
    factor = F.lit(1).cast("bigint")
    for c in cols:
        factor = factor * F.coalesce(F.col(c), F.lit(1)).cast("bigint")
    return meta.withColumn("_fanout", factor)


def keys_result(damage: DataFrame, meta: DataFrame, join_mode: str = "inner", fanout: bool = False) -> DataFrame:
    """A4 + A8 + A11: damage per player joined to run meta of *finished* runs.

    Output columns follow the reference's select list (``combatlog_hash`` is
    the run hash). ``fanout=True`` repeats each row as often as the
    reference's joins would (Q11, parity); the default is one row per
    (run, player)."""
    m = require_measures(meta, KEYS_MEASURES, join_mode)
    j = damage_per_player(damage).join(m, "run_hash", "inner" if join_mode == "inner" else "left")
    # A4 applies to the joined row: a run known to be unfinished has no result in
    # either mode; in left mode a run without the measure stays.
    finished = F.col("finished") != 0
    j = j.filter(finished if join_mode == "inner" else finished | F.col("finished").isNull())
    if fanout:
        j = fanout_factor(j).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_fanout"))))
    return j.select("damage", "caster_name", "caster_id", F.col("run_hash").alias("combatlog_hash"),
                    "dungeon_name", "dungeon_id", "key_level", "duration", "finished", "two_affix_id",
                    "four_affix_id", "seven_affix_id", "ten_affix_id", "patch", "date")


def breakdown_result(damage: DataFrame, meta: DataFrame, join_mode: str = "inner") -> DataFrame:
    """A7 + A8 + A12: damage per player and spell joined to run meta."""
    m = require_measures(meta, BREAKDOWN_MEASURES, join_mode)
    agg = damage_per_player_spell(damage)
    j = agg.join(m, "run_hash", "inner" if join_mode == "inner" else "left")
    return j.select("damage", "caster_name", "caster_id", F.col("run_hash").alias("combatlog_hash"),
                    "dungeon_name", "dungeon_id", "key_level", "duration", "finished", "two_affix_id",
                    "four_affix_id", "seven_affix_id", "ten_affix_id", "spell_id", "spell_name", "date")


def sort_by_damage(df: DataFrame) -> DataFrame:
    """Damage descending; ties broken by caster id (deterministic)."""
    keys = [F.col("damage").desc(), F.col("caster_id").asc()]
    if "spell_id" in df.columns:
        keys.append(F.col("spell_id").asc())
    return df.orderBy(*keys)


def missing_results(expected: DataFrame, result: DataFrame, reason: str) -> DataFrame:
    """A10: run hashes that were expected but produced no row ->
    ``rejects``-shaped rows (the keys query skips them, the breakdown query
    reports them)."""
    got = result.select(F.col("combatlog_hash").alias("run_hash")).distinct()
    return (expected.select("run_hash").distinct().join(got, "run_hash", "left_anti")
            .withColumn("reason", F.lit(reason)))
