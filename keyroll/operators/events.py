"""Event dispatch and typed projections.

Lines are filtered by their event name *before* tokenising (most lines of a
real log are events nobody reads), then split once; every typed projection
reads the same token array ``p``. Parse problems never stop the job: they
become an ``error`` reason on the row, which the plans route to ``rejects``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyroll.functions import scoring as S
from keyroll.functions import tokens as T

# --- Fixed values that must equal the reference's -------------------------
# Event names the engine reads.
VERSION = "COMBAT_LOG_VERSION"
START = "CHALLENGE_MODE_START"
END = "CHALLENGE_MODE_END"
DAMAGE_EVENTS = ("SPELL_DAMAGE", "SPELL_PERIODIC_DAMAGE", "RANGE_DAMAGE", "SWING_DAMAGE")
SWING = "SWING_DAMAGE"
SUMMON = "SPELL_SUMMON"
COMBATANT_INFO = "COMBATANT_INFO"
ENCOUNTER_START = "ENCOUNTER_START"
ENCOUNTER_END = "ENCOUNTER_END"
HEAL_EVENTS = ("SPELL_HEAL", "SPELL_PERIODIC_HEAL")
READ_EVENTS = (VERSION, START, END, *DAMAGE_EVENTS, SUMMON, COMBATANT_INFO)
OPTIONAL_EVENTS = (ENCOUNTER_START, ENCOUNTER_END, *HEAL_EVENTS)

# Token counts (arity) and token positions, 0-based.
VERSION_ARITY, END_ARITY, SUMMON_ARITY, ENCOUNTER_ARITY = 8, 5, 12, 6
SPELL_DAMAGE_ARITY, SWING_DAMAGE_ARITY = 39, 36
SPELL_AMOUNT_AT, SWING_AMOUNT_AT, HEAL_ABSORBED_AT = 29, 26, 30
# --------------------------------------------------------------------------


def tok(i: int) -> Column:
    """Token ``i`` of ``p`` (NULL when the line is shorter)."""
    return F.get(F.col("p"), i)


def tokenize(lines: DataFrame, parity: bool = False, events=READ_EVENTS, value: str = "value") -> DataFrame:
    """P1 + P2 + P7: split header/body, keep lines whose event is in
    ``events`` (or that have no separator, which are rejected), tokenise.

    Adds ``ts_text, body, event, p`` and ``error`` ('no_separator')."""
    ts_text, body = T.split_header(F.col(value), parity)
    d = lines.withColumn("ts_text", ts_text).withColumn("body", body)
    event = F.substring_index(F.col("body"), ",", 1)
    d = d.withColumn("event", event).filter(F.col("body").isNull() | F.col("event").isin(*events))
    return (d.withColumn("p", F.when(F.col("body").isNotNull(), T.split_tokens(F.col("body"))))
             .withColumn("error", F.when(F.col("body").isNull(), F.lit("no_separator"))))


def line_text() -> Column:
    """A tokenised line's text: its header, the separator and its tokens."""
    return F.concat(F.col("ts_text"), F.lit(T.SEPARATOR), F.array_join("p", ","))


def _first_error(*checks: tuple[Column, str]) -> Column:
    expr = None
    for cond, reason in checks:
        expr = F.when(cond, F.lit(reason)) if expr is None else expr.when(cond, F.lit(reason))
    return expr


def version_fields(d: DataFrame) -> DataFrame:
    """``patch`` = token 5 of an 8-token version line."""
    ok = F.size("p") == VERSION_ARITY
    return d.withColumn("patch", F.when(ok, tok(5))) \
            .withColumn("error", F.coalesce(F.col("error"), F.when(~ok, F.lit("arity"))))


def start_fields(d: DataFrame, log_year: Column) -> DataFrame:
    """P9 + P6: run-start meta. Affixes by token count: 2nd level when >= 6
    tokens, 4th >= 7, 7th >= 8, 10th only when exactly 9."""
    n = F.size("p")
    dungeon_id = T.parse_int64(tok(2))
    key_level = T.parse_int64(tok(4))
    two_txt = T.trim_all(T.trim_all(tok(5), "["), "]")
    two = F.when(n >= 6, T.parse_int64(two_txt))
    four = F.when(n >= 7, T.parse_int64(T.trim_all(tok(6), "]")))
    seven = F.when(n >= 8, T.parse_int64(T.trim_all(tok(7), "]")))
    ten = F.when(n == 9, T.parse_int64(T.trim_all(tok(8), "]")))
    date = T.log_time_millis(F.col("ts_text"), log_year)
    d = d.select("*", T.trim_all(tok(1), '"').alias("dungeon_name"), dungeon_id.alias("dungeon_id"),
                 T.parse_int64(tok(3)).alias("challenge_mode_id"), key_level.alias("key_level"),
                 date.alias("date"), two.alias("two_affix_id"), four.alias("four_affix_id"),
                 seven.alias("seven_affix_id"), ten.alias("ten_affix_id"))
    bad = _first_error(
        (n < 5, "arity"),
        (F.col("dungeon_id").isNull() | F.col("key_level").isNull(), "bad_int"),
        ((n >= 6) & F.col("two_affix_id").isNull(), "bad_int"),
        ((n >= 7) & F.col("four_affix_id").isNull(), "bad_int"),
        ((n >= 8) & F.col("seven_affix_id").isNull(), "bad_int"),
        ((n == 9) & F.col("ten_affix_id").isNull(), "bad_int"),
        (F.col("date").isNull(), "bad_time"),
    )
    return d.withColumn("error", F.coalesce(F.col("error"), bad))


def end_fields(d: DataFrame) -> DataFrame:
    """P10: ``finished`` (token 2) and ``duration`` ms (token 4); 5 tokens."""
    ok = F.size("p") == END_ARITY
    d = d.withColumn("finished", F.when(ok, T.parse_int64(tok(2)))) \
         .withColumn("duration", F.when(ok, T.parse_int64(tok(4))))
    bad = _first_error((~ok, "arity"), (F.col("finished").isNull() | F.col("duration").isNull(), "bad_int"))
    return d.withColumn("error", F.coalesce(F.col("error"), bad))


def summon_fields(d: DataFrame) -> DataFrame:
    """Pet registrations by player casters (12 tokens). Non-player
    summoners are ignored (``keep`` false), as in the reference."""
    n = F.size("p")
    player = S.is_player_flag(T.trim_one_quote(tok(3)))
    spell_id = T.parse_int64(tok(9))
    d = d.select("*", tok(5).alias("pet_guid"), tok(1).alias("owner_id"),
                 T.trim_one_quote(tok(2)).alias("owner_name"), T.trim_one_quote(tok(10)).alias("pet_name"),
                 spell_id.alias("pet_spell_id"))
    bad = _first_error((n < 4, "arity"), (~player, None), (n != SUMMON_ARITY, "arity"),
                       (F.col("pet_spell_id").isNull(), "bad_int"))
    return (d.withColumn("keep", (n >= 4) & player)
             .withColumn("error", F.coalesce(F.col("error"), F.when(F.col("keep") | (n < 4), bad))))


def damage_fields(d: DataFrame, owner: str = "owner") -> DataFrame:
    """P11 + P13 + P14 + R4 + R5 + R6 on in-run damage lines.

    ``owner`` is the as-of struct of the pet's last summon (or NULL). Sets
    ``keep`` (the hit is booked) and ``error``; booked rows get
    ``caster_id, caster_name, caster_type, spell_id, spell_name, damage``.
    """
    n = F.size("p")
    swing = F.col("event") == SWING
    target_player = S.is_player_flag(tok(7))                    # R5, checked first (Q5)
    is_pet = F.col(owner).isNotNull()
    own_type = T.trim_one_quote(tok(3))
    amount_txt = F.when(swing, tok(SWING_AMOUNT_AT)).otherwise(tok(SPELL_AMOUNT_AT))
    amount = T.parse_int64(amount_txt)
    own_spell = F.when(swing, F.lit(S.AUTO_ATTACK_SPELL_ID).cast("bigint")).otherwise(T.parse_int64(tok(9)))
    own_spell_name = F.when(swing, F.lit(S.AUTO_ATTACK_SPELL_NAME)).otherwise(T.trim_one_quote(tok(10)))
    d = d.select(
        "*",
        F.when(is_pet, F.col(f"{owner}.owner_id")).otherwise(tok(1)).alias("caster_id"),
        F.when(is_pet, F.col(f"{owner}.owner_name")).otherwise(T.trim_one_quote(tok(2))).alias("caster_name"),
        F.when(is_pet, F.lit(S.PET_OWNER_FLAG)).otherwise(own_type).alias("caster_type"),
        F.when(is_pet, F.col(f"{owner}.pet_spell_id")).otherwise(own_spell).alias("spell_id"),
        F.when(is_pet, F.col(f"{owner}.pet_name")).otherwise(own_spell_name).alias("spell_name"),
        amount.alias("damage"),
    )
    friendly = (n >= 8) & target_player
    not_player = ~is_pet & ~S.is_player_flag(F.col("caster_type"))
    arity_bad = F.when(swing, n != SWING_DAMAGE_ARITY).otherwise(n != SPELL_DAMAGE_ARITY)
    amount_missing = F.when(swing, n <= SWING_AMOUNT_AT).otherwise(n <= SPELL_AMOUNT_AT)
    bad = _first_error(
        (n < 8, "arity"),
        (friendly | not_player, None),
        (~is_pet & arity_bad, "arity"),
        (is_pet & amount_missing, "arity"),
        (F.col("damage").isNull(), "bad_int"),
        (F.col("spell_id").isNull(), "bad_int"),
    )
    d = d.withColumn("error", F.coalesce(F.col("error"), bad))
    return d.withColumn("keep", F.col("error").isNull() & ~friendly & ~not_player)


def heal_fields(d: DataFrame) -> DataFrame:
    """O2: heal events — spell id 9, amount 28, overhealing 29, absorbed 30. ``keep``: a
    player's heal; ``error``: a line that is too short, or a player's without numbers."""
    d = d.select("*", tok(1).alias("caster_id"), T.trim_one_quote(tok(2)).alias("caster_name"),
                 T.trim_one_quote(tok(3)).alias("caster_type"), T.parse_int64(tok(9)).alias("spell_id"),
                 T.trim_one_quote(tok(10)).alias("spell_name"), T.parse_int64(tok(28)).alias("heal"),
                 T.parse_int64(tok(29)).alias("overheal"), T.parse_int64(tok(30)).alias("absorbed"))
    player = S.is_player_flag(F.col("caster_type"))
    numbers = [F.col(c).isNull() for c in ("spell_id", "heal", "overheal", "absorbed")]
    bad = _first_error((F.size("p") <= HEAL_ABSORBED_AT, "arity"), (~player, None),
                       (numbers[0] | numbers[1] | numbers[2] | numbers[3], "bad_int"))
    d = d.withColumn("error", F.coalesce(F.col("error"), bad))
    return d.withColumn("keep", F.col("error").isNull() & player)


def encounter_fields(d: DataFrame) -> DataFrame:
    """O1: encounter id (1), name (2), difficulty (3), group size (4);
    token 5 is the instance id on ``ENCOUNTER_START`` and the kill flag on
    ``ENCOUNTER_END`` (6 tokens)."""
    is_end = F.col("event") == ENCOUNTER_END
    d = d.select("*", T.parse_int64(tok(1)).alias("encounter_id"), T.trim_one_quote(tok(2)).alias("encounter_name"),
                 T.parse_int64(tok(3)).alias("difficulty"), T.parse_int64(tok(4)).alias("group_size"),
                 F.when(~is_end, T.parse_int64(tok(5))).alias("instance_id"),
                 F.when(is_end, T.parse_int64(tok(5))).alias("kill"))
    bad = _first_error((F.size("p") != ENCOUNTER_ARITY, "arity"),
                       (F.col("encounter_id").isNull() | F.get(F.col("p"), 5).isNull(), "bad_int"))
    return d.withColumn("error", F.coalesce(F.col("error"), bad))
