"""Nested gold documents.

* ``top_keys``            one row per finished run: players array + scores
* ``player_damage_done``  one row per run: players, each with a spells array

Players are aggregated per run *before* the join with run meta, so the join
is one-to-one per run. The arrays hold every player (and every spell) of a
run — the document is the feature; there is no cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyroll.functions import scoring as S
from keyroll.operators import relational as R


def _doc_meta(df: DataFrame, corrected: bool = False) -> list:
    pct, intime = S.timed_as_percent(F.col("dungeon_id"), F.col("duration"), corrected)
    return [
        S.duration_mmss(F.col("duration")).alias("duration_text"),
        F.lit(S.DEATHS).alias("deaths"),
        S.affix_names(F.col("two_affix_id"), F.col("four_affix_id"), F.col("seven_affix_id"),
                      F.col("ten_affix_id")).alias("affixes"),
        F.col("key_level").cast("int").alias("keylevel"),
        "dungeon_name",
        F.col("dungeon_id").cast("int").alias("dungeon_id"),
        F.col("run_hash").alias("combatlog_hash"),
        S.finished_flag(F.col("finished")).alias("finished"),
        intime.alias("intime"),
        pct.alias("percent"),
        "date",
    ]


def _player_struct(damage: str = "damage"):
    return F.struct(F.col(damage).alias("damage"), F.col("caster_name").alias("player_name"),
                    F.col("caster_id").alias("player_id"), F.lit(S.UNSUPPORTED).alias("class"),
                    F.lit(S.UNSUPPORTED).alias("specc"))


def _by_damage_desc(item: Column, tie: str) -> Column:
    """Aggregate structs into an array by damage desc, then ``tie`` asc: the sort
    keys go first into the collected struct, so the plain array sort applies."""
    keyed = F.struct((-item["damage"]).alias("_d"), item[tie].alias("_t"), item.alias("item"))
    return F.transform(F.sort_array(F.collect_list(keyed)), lambda x: x["item"])


def leaderboard_docs(damage: DataFrame, meta: DataFrame, join_mode: str = "inner",
                     corrected: bool = False, order: str = "sk", fanout: bool = False) -> DataFrame:
    """The leaderboard document of every finished run.

    ``order='sk'`` builds the sort key exactly as the reference (text order,
    Q12); ``order='numeric'`` zero-pads the percentage so text order equals
    numeric order. ``fanout=True`` lists each player as often as the
    reference's joins return it (Q11)."""
    per_player = R.damage_per_player(damage)
    if fanout:
        factor = R.fanout_factor(meta).select("run_hash", "_fanout")
        per_player = (per_player.join(factor, "run_hash", "left")
                      .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"),
                                                                F.coalesce(F.col("_fanout"), F.lit(1).cast("bigint"))))))
    players = (per_player.groupBy("run_hash")
               .agg(_by_damage_desc(_player_struct(), "player_id").alias("player_damage")))
    m = R.require_measures(meta.filter(F.col("finished") != 0), R.KEYS_MEASURES, join_mode)
    j = players.join(m, "run_hash", "inner")
    pct, _ = S.timed_as_percent(F.col("dungeon_id"), F.col("duration"), corrected)
    if order == "numeric":
        sk = F.format_string("%02d#%011.6f#%s", F.col("key_level").cast("int"), pct, F.col("run_hash"))
    else:
        sk = S.sort_key(F.col("key_level"), pct, F.col("run_hash"))
    return j.select(
        S.leaderboard_pk(F.col("patch")).alias("pk"),
        sk.alias("sk"),
        S.dungeon_pk(F.col("patch"), F.col("dungeon_id")).alias("gsi1pk"),
        sk.alias("gsi1sk"),
        "player_damage",
        *_doc_meta(j, corrected),
        "patch",
    )


def player_totals(damage: DataFrame) -> DataFrame:
    """N2 + N3 + N5: per (run, player name): total damage, the id of the
    largest row (Q16) and the spells sorted by damage desc, spell id asc."""
    # One exchange by run serves both document levels and the join with run meta.
    rows = R.damage_per_player_spell(damage).repartition("run_hash")
    spell = F.struct(F.col("spell_id"), F.col("spell_name"), F.col("damage"))
    return (rows.groupBy("run_hash", "caster_name")
            .agg(F.sum("damage").cast("bigint").alias("damage"),
                 F.min(F.struct((-F.col("damage")).alias("nd"), F.col("caster_id").alias("id")))["id"]
                 .alias("caster_id"),
                 _by_damage_desc(spell, "spell_id").alias("damage_per_spell")))


def breakdown_docs(damage: DataFrame, meta: DataFrame, join_mode: str = "inner",
                   corrected: bool = False) -> DataFrame:
    """N4 + N6: the per-run breakdown document (players desc by total damage,
    tie by name)."""
    p = player_totals(damage)
    player = F.struct(F.col("damage"), F.col("damage_per_spell"), F.col("caster_name").alias("player_name"),
                      F.col("caster_id").alias("player_id"), F.lit(S.UNSUPPORTED).alias("class"),
                      F.lit(S.UNSUPPORTED).alias("specc"))
    players = (p.groupBy("run_hash")
               .agg(_by_damage_desc(player, "player_name").alias("player_damage")))
    m = R.require_measures(meta, R.BREAKDOWN_MEASURES, join_mode)
    j = players.join(m, "run_hash", "inner")
    key = S.run_detail_pk(F.col("run_hash"))
    return j.select(key.alias("pk"), key.alias("sk"), "player_damage", *_doc_meta(j, corrected))


def healing_docs(heals: DataFrame, meta: DataFrame, corrected: bool = False) -> DataFrame:
    """O2: the healing document of every run, built as the damage one: players by healing,
    tie by name, each with the spells."""
    docs = breakdown_docs(heals.withColumnRenamed("heal", "damage"), meta, corrected=corrected)
    spell = lambda s: F.struct(s["spell_id"].alias("spell_id"), s["spell_name"].alias("spell_name"), s["damage"].alias("healing"))
    player = F.transform("player_damage", lambda p: F.struct(
        p["damage"].alias("healing"), F.transform(p["damage_per_spell"], spell).alias("healing_per_spell"),
        p["player_name"].alias("player_name"), p["player_id"].alias("player_id"), p["class"].alias("class"), p["specc"].alias("specc")))
    key = S.run_healing_pk(F.col("combatlog_hash"))
    return docs.withColumn("player_healing", player).drop("player_damage").withColumns({"pk": key, "sk": key})


def merge_spells_by_name(docs_rows: DataFrame) -> DataFrame:
    """Merge a player's spells that share a name, keeping the smallest id."""
    return (docs_rows.groupBy("run_hash", "caster_name", "spell_name")
            .agg(F.sum("damage").cast("bigint").alias("damage"), F.min("spell_id").alias("spell_id")))
