"""Bridge views: combat-log shaped inputs derived from the provided tables.

The test data hold no combat log, so every query reads one of these views,
computed by Spark from the whole input tables (their work grows with them):

* B1 ``runs_b``    run meta, one row per ``orders`` row
* B2 ``damage_b``  damage facts, one row per ``lineitem`` row
* B3 ``lines_b``   ordered event lines, one upload per ``events.user_id``
* B4 ``log_lines`` B3 rendered as real combat-log text lines
* B5 duplicate uploads: a copy of every third upload under another id

The rules below are the bridge *specification*; the DuckDB oracles in
``keyroll.plans.oracle_sql`` restate them independently in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyroll.operators.asof import DEFAULT_BLOCK, ordinal_within
from keyroll.session import scratch_path

# --- Fixed values that must equal the reference's -------------------------
# Dungeon names of the timer table's ids (used to label bridge runs).
DUNGEON_NAMES = {
    2291: "De Other Side", 2289: "Plaguefall", 2284: "Sanguine Depths",
    2287: "Halls of Atonement", 2290: "Mists of Tirna Scithe",
    2285: "Spires of Ascension", 2286: "Necrotic Wake", 2293: "Theater of Pain",
}
# --------------------------------------------------------------------------
# Order in which ``key % 8`` picks a dungeon in the bridge views.
DUNGEON_CYCLE = [2291, 2289, 2284, 2287, 2290, 2285, 2286, 2293]
FOUR_CYCLE = [123, 7, 11, 8, 6, 122]
SEVEN_CYCLE = [13, 4, 3, 124, 14, 12]
# What the upload id of a B5 copy ends with.
COPY_SUFFIX = "-copy"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _cycle(key: Column, values: list[int]) -> Column:
    idx = key % len(values)
    expr = None
    for i, v in enumerate(values):
        expr = F.when(idx == i, F.lit(v)) if expr is None else expr.when(idx == i, F.lit(v))
    return expr.cast("bigint")


def dungeon_name(dungeon_id: Column) -> Column:
    m = F.create_map(*[x for k, v in DUNGEON_NAMES.items() for x in (F.lit(k).cast("bigint"), F.lit(v))])
    return F.element_at(m, dungeon_id.cast("bigint"))


# ---------------------------------------------------------------- B1 / B2
def runs_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: run meta (one row per order). ``run_hash`` is the order key as text."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    k = F.col("o_orderkey")
    dungeon = _cycle(k, DUNGEON_CYCLE)
    unfinished = (k % 10) == 0
    return o.select(
        k.alias("run_id"),
        k.cast("string").alias("run_hash"),
        dungeon.alias("dungeon_id"),
        dungeon_name(dungeon).alias("dungeon_name"),
        (F.lit(2) + k % 19).cast("bigint").alias("key_level"),
        F.when(unfinished, F.lit(0)).otherwise(F.lit(900000) + (k * 7919) % 2100000).cast("bigint").alias("duration"),
        F.when(unfinished, F.lit(0)).otherwise(F.lit(1)).cast("bigint").alias("finished"),
        (F.lit(9) + k % 2).cast("bigint").alias("two_affix_id"),
        _cycle(k, FOUR_CYCLE).alias("four_affix_id"),
        _cycle(k, SEVEN_CYCLE).alias("seven_affix_id"),
        F.when(k % 19 >= 8, F.lit(121)).cast("bigint").alias("ten_affix_id"),
        F.when(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"), F.lit("9.0.2"))
         .otherwise(F.lit("9.0.5")).alias("patch"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("date"),
    )


def damage_b(spark: SparkSession, sf_dir: str, with_ingest_time: bool = False) -> DataFrame:
    """B2: damage facts (a bag: equal rows stay separate); optionally with an
    ``ingest_time`` (the line's ship date)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                                  "l_extendedprice", "l_shipdate")
    s5 = (F.col("l_suppkey") % 5).cast("string")
    spell = (F.col("l_partkey") % 40).cast("bigint")
    return li.select(
        F.col("l_orderkey").alias("run_id"),
        F.col("l_orderkey").cast("string").alias("run_hash"),
        F.concat(F.lit("Player-"), s5).alias("caster_id"),
        F.concat(F.lit("name"), s5).alias("caster_name"),
        F.when(F.col("l_linenumber") % 4 == 3, F.lit("0xa48"))
         .when(F.col("l_suppkey") % 5 == 0, F.lit("0x511")).otherwise(F.lit("0x512")).alias("caster_type"),
        spell.alias("spell_id"),
        F.concat(F.lit("spell"), spell.cast("string")).alias("spell_name"),
        F.floor(F.col("l_extendedprice")).cast("bigint").alias("damage"),
        *([F.col("l_shipdate").cast("timestamp").alias("ingest_time")] if with_ingest_time else []),
    )


# ---------------------------------------------------------------- B3
KIND_OF_EVENT = {"signup": "START", "purchase": "END", "error": "SUMMON", "click": "PET_HIT"}


def lines_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One upload per user; ``pos`` (event time in µs, unique) orders the
    lines of an upload, so no window over an upload is needed."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    kind = F.coalesce(F.element_at(F.create_map(*[x for k, v in KIND_OF_EVENT.items()
                                                  for x in (F.lit(k), F.lit(v))]), F.col("event_type")),
                      F.lit("HIT"))
    return ev.select(
        F.col("user_id").cast("string").alias("upload_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("pos"),
        "event_id", "ts",
        kind.alias("kind"),
        (F.col("event_id") % 7).alias("guid"),
        F.floor(F.col("value")).cast("bigint").alias("amount"),
    )


# ---------------------------------------------------------------- B4
def _zeros(n: int) -> list[Column]:
    return [F.lit("0")] * n


def _join(parts: list[Column]) -> Column:
    return F.concat_ws(",", *parts)


def render_body(e: Column, kind: Column, amount: Column) -> Column:
    """Combat-log body text for one B3 event (the B4 rendering rules).

    view   -> e%25=7: COMBAT_LOG_VERSION (patch 9.0.2 / 9.0.5 by e%2)
              e%50=17: COMBATANT_INFO
              e%25=13: SPELL_HEAL (amount, overheal e%100, absorbed 0)
              e%50=29 / 39: ENCOUNTER_START / ENCOUNTER_END (boss 2400+e%4,
              kill flag e%2)
              else a player damage line (swing when e%4=1, else spell
              damage; caster flag 0xa48 when e%9=4, 0x511 when e%5=0,
              else 0x512; target flag 0x512 (friendly fire) when e%13=6;
              amount text 'bad' when e%1000=999)
    click  -> pet damage by Pet-0-<e%7> (swing when e%2=0, else spell 54049)
    error  -> SPELL_SUMMON of Pet-0-<e%7> by Player-<e%5> (flag 0xa48 when e%6=5)
    signup -> CHALLENGE_MODE_START, 9 tokens when e%19>=8 else 8; the
              challenge-mode token (3) carries the event id
    purchase -> CHALLENGE_MODE_END, unfinished when e%10=0
    """
    p5 = (e % 5).cast("string")
    player = F.concat(F.lit("Player-"), p5)
    pname = F.concat(F.lit('"name'), p5, F.lit('-Realm"'))
    target = F.concat(F.lit("Creature-0-1-2-3-"), e.cast("string"))
    target_name = F.lit('"Enemy, the Big"')
    target_flag = F.when(e % 13 == 6, F.lit("0x512")).otherwise(F.lit("0x10a48"))
    amt = F.when(e % 1000 == 999, F.lit("bad")).otherwise(amount.cast("string"))
    flag = F.when(e % 9 == 4, F.lit("0xa48")).when(e % 5 == 0, F.lit("0x511")).otherwise(F.lit("0x512"))
    spell = (F.lit(100) + e % 17).cast("string")
    spell_event = F.when(e % 3 == 0, F.lit("SPELL_DAMAGE")).when(e % 3 == 1, F.lit("SPELL_PERIODIC_DAMAGE")) \
        .otherwise(F.lit("RANGE_DAMAGE"))

    def swing(ev, caster, cname, cflag):
        return _join([ev, caster, cname, cflag, F.lit("0x0"), target, target_name, target_flag, F.lit("0x0")]
                     + _zeros(17) + [amt] + _zeros(9))

    def spell_line(ev, caster, cname, cflag, sid, sname):
        return _join([ev, caster, cname, cflag, F.lit("0x0"), target, target_name, target_flag, F.lit("0x0"),
                      sid, sname, F.lit("0x20")] + _zeros(17) + [amt] + _zeros(9))

    hit = F.when(e % 4 == 1, swing(F.lit("SWING_DAMAGE"), player, pname, flag)) \
        .otherwise(spell_line(spell_event, player, pname, flag, spell, F.concat(F.lit('"Spell '), spell, F.lit('"'))))
    version = _join([F.lit("COMBAT_LOG_VERSION"), F.lit("20"), F.lit("ADVANCED_LOG_ENABLED"), F.lit("1"),
                     F.lit("BUILD_VERSION"), F.when(e % 2 == 0, F.lit("9.0.2")).otherwise(F.lit("9.0.5")),
                     F.lit("PROJECT_ID"), F.lit("1")])
    info = _join([F.lit("COMBATANT_INFO"), player, e.cast("string"), F.lit("0"), F.lit("[(1,2),(3,4)]")])
    heal_spell = (F.lit(2000) + e % 7).cast("string")
    heal = _join([F.lit("SPELL_HEAL"), player, pname, F.lit("0x512"), F.lit("0x0"),
                  F.concat(F.lit("Player-"), ((e + 1) % 5).cast("string")),
                  F.concat(F.lit('"name'), ((e + 1) % 5).cast("string"), F.lit('-Realm"')), F.lit("0x512"),
                  F.lit("0x0"), heal_spell, F.concat(F.lit('"Heal '), heal_spell, F.lit('"')), F.lit("0x8")]
                 + _zeros(16) + [amt, (e % 100).cast("string"), F.lit("0"), F.lit("nil")])
    boss = (F.lit(2400) + e % 4).cast("string")
    boss_name = F.concat(F.lit('"Boss '), boss, F.lit(', the Big"'))
    enc_start = _join([F.lit("ENCOUNTER_START"), boss, boss_name, F.lit("8"), F.lit("5"),
                       _cycle(e, DUNGEON_CYCLE).cast("string")])
    enc_end = _join([F.lit("ENCOUNTER_END"), boss, boss_name, F.lit("8"), F.lit("5"), (e % 2).cast("string")])
    view = (F.when(e % 25 == 7, version).when(e % 50 == 17, info).when(e % 25 == 13, heal)
             .when(e % 50 == 29, enc_start).when(e % 50 == 39, enc_end).otherwise(hit))

    guid = F.concat(F.lit("Pet-0-"), (e % 7).cast("string"))
    pet_name = F.concat(F.lit('"Pet'), (e % 7).cast("string"), F.lit('"'))
    pet_hit = F.when(e % 2 == 0, swing(F.lit("SWING_DAMAGE"), guid, pet_name, F.lit("0x1112"))) \
        .otherwise(spell_line(F.lit("SPELL_DAMAGE"), guid, pet_name, F.lit("0x1112"), F.lit("54049"),
                              F.lit('"Shadow Bite"')))
    sspell = (F.lit(30000) + e % 3).cast("string")
    summon = _join([F.lit("SPELL_SUMMON"), player, pname,
                    F.when(e % 6 == 5, F.lit("0xa48")).otherwise(F.lit("0x512")), F.lit("0x0"),
                    guid, pet_name, F.lit("0xa28"), F.lit("0x0"), sspell,
                    F.concat(F.lit('"Summon '), sspell, F.lit('"')), F.lit("0x20")])

    dungeon = _cycle(e, DUNGEON_CYCLE)
    level = (F.lit(2) + e % 19).cast("string")
    affixes = F.concat(F.lit("["), (F.lit(9) + e % 2).cast("string"), F.lit(","),
                       _cycle(e, FOUR_CYCLE).cast("string"), F.lit(","), _cycle(e, SEVEN_CYCLE).cast("string"),
                       F.when(e % 19 >= 8, F.lit(",121")).otherwise(F.lit("")), F.lit("]"))
    start = _join([F.lit("CHALLENGE_MODE_START"), F.concat(F.lit('"'), dungeon_name(dungeon), F.lit('"')),
                   dungeon.cast("string"), e.cast("string"), level, affixes])
    fin = e % 10 != 0
    end = _join([F.lit("CHALLENGE_MODE_END"), dungeon.cast("string"),
                 F.when(fin, F.lit("1")).otherwise(F.lit("0")), level,
                 F.when(fin, (F.lit(900000) + (e * 7919) % 2100000).cast("string")).otherwise(F.lit("0"))])

    return (F.when(kind == "START", start).when(kind == "END", end).when(kind == "SUMMON", summon)
             .when(kind == "PET_HIT", pet_hit).otherwise(view))


_RENDERED: dict[tuple[str, str, bool], str] = {}


def log_lines(spark: SparkSession, sf_dir: str, with_copies: bool = False) -> DataFrame:
    """``(upload_id, pos, event_id, ts, value)`` — one rendered log line
    per event; with ``with_copies`` the B5 duplicate uploads are added.
    ``pos`` orders the lines of an upload and is dense (see below).

    The rendered lines are written once per session as a Parquet table in
    the shared checkpoint folder and read back: they play the part of stored
    input text, and the long rendering expression is never inlined into the
    parser's expressions."""
    key = (spark.sparkContext.applicationId, sf_dir, with_copies)
    path = _RENDERED.get(key)
    if path is None:
        b3 = lines_b(spark, sf_dir)
        if with_copies:
            b3 = b3.unionByName(copies(b3))
        header = F.date_format(F.col("ts").cast("timestamp"), "M/d HH:mm:ss.SSS")
        value = F.concat(header, F.lit("  "), render_body(F.col("event_id"), F.col("kind"), F.col("amount")))
        path = scratch_path(spark, "b4-lines")
        # Stored with explicit line numbers, whatever the files' sizes.
        # An upload's events are spread over time: blocks are as wide as lets the longest
        # upload have about DEFAULT_BLOCK lines in each.
        most, span = b3.groupBy("upload_id").agg(F.count(F.lit(1)).alias("n"), (F.max("pos") - F.min("pos")).alias("span")).agg(
            F.max("n"), F.max("span")).first()
        block = (span or 0) // -(-(most or 1) // DEFAULT_BLOCK) + 1
        numbered = ordinal_within(b3.select("upload_id", "pos", "event_id", "ts", value.alias("value")), ["upload_id"], "pos",
                                  block=block, out="line")
        numbered.select("upload_id", F.col("line").alias("pos"), "event_id", "ts", "value").write.parquet(path)
        _RENDERED[key] = path
    return spark.read.parquet(path)


def copies(b3: DataFrame) -> DataFrame:
    """A byte-identical copy of every upload whose id is divisible by 3."""
    return (b3.filter(F.col("upload_id").cast("bigint") % 3 == 0)
              .withColumn("upload_id", F.concat("upload_id", F.lit(COPY_SUFFIX))))
