"""Scalar scoring and formatting expressions.

All of these are plain Column expressions: they stay inside whole-stage
codegen and need no Python at run time. The dungeon timers and affix names
are tiny fixed dimensions; they are inlined as literal CASE / map
expressions, so no join (and no broadcast) is needed for them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values that must equal the reference's -------------------------
# Dungeon timers as "mm:ss" text: dungeon id -> (in time, two chest, three chest).
# Dungeon 2284 has no third limit in the reference (parsed but never assigned,
# so it stays 0); the intended value was "24:36".
DUNGEON_TIMERS = {
    2291: ("43:00", "34:25", "25:49"),   # De Other Side
    2289: ("38:00", "30:24", "22:48"),   # Plaguefall
    2284: ("41:00", "32:48", None),      # Sanguine Depths
    2287: ("31:00", "24:48", "18:36"),   # Halls of Atonement
    2290: ("30:00", "24:00", "18:00"),   # Mists of Tirna Scithe
    2285: ("39:00", "31:12", "23:24"),   # Spires of Ascension
    2286: ("36:00", "28:48", "21:36"),   # Necrotic Wake
    2293: ("37:00", "29:36", "22:12"),   # Theater of Pain
}
SANGUINE_DEPTHS_THREE_CHEST_INTENDED = "24:36"

# Affix names by key level at which they apply.
LEVEL_TWO_AFFIXES = {9: "Tyrannical", 10: "Fortified"}
LEVEL_FOUR_AFFIXES = {123: "Spiteful", 7: "Bolstering", 11: "Bursting",
                      8: "Sanguine", 6: "Raging", 122: "Inspiring"}
LEVEL_SEVEN_AFFIXES = {13: "Explosive", 4: "Necrotic", 3: "Volcanic",
                       124: "Storming", 14: "Quaking", 12: "Grievous"}
LEVEL_TEN_AFFIXES = {121: "Prideful"}

# Combat-log flag words that mark a player (caster or target).
PLAYER_FLAGS = ("0x511", "0x512")
# The flag booked for pet damage moved under its owner.
PET_OWNER_FLAG = "0x512"
# GUID written when the caster is unknown.
NULL_GUID = "0000000000000000"
# Synthetic spell for melee swings.
AUTO_ATTACK_SPELL_ID = 42013370310
AUTO_ATTACK_SPELL_NAME = "Auto Attack"
# Placeholders the documents carry for not-yet-tracked fields.
UNSUPPORTED = "unsupported"
DEATHS = 0
# Paging: ten rows shown, one read ahead.
PAGE_SIZE = 10
# Query-side freshness window (minutes) and the default leaderboard patch.
FRESHNESS_MINUTES = 3
DEFAULT_PATCH = "9.0.2"
# --------------------------------------------------------------------------


def min_sec_to_millis_py(text: str) -> int:
    """Driver-side twin of :func:`min_sec_to_millis` (used to fold constants)."""
    mm, ss = text.split(":")
    if len(mm) != 2 or len(ss) != 2 or not (mm + ss).isdigit():
        raise ValueError(f"bad mm:ss value {text!r}")
    m, s = int(mm), int(ss)
    if m > 59 or s > 59:
        raise ValueError(f"bad mm:ss value {text!r}")
    return (m * 60 + s) * 1000


def min_sec_to_millis(col: Column | str) -> Column:
    """``"43:00"`` -> 2580000; two-digit minute and second, each <= 59;
    anything else yields NULL (the caller turns NULL into a reject)."""
    c = F.col(col) if isinstance(col, str) else col
    ok = c.rlike(r"^[0-5][0-9]:[0-5][0-9]$")
    mins = F.substring(c, 1, 2).cast("bigint")
    secs = F.substring(c, 4, 2).cast("bigint")
    return F.when(ok, (mins * 60 + secs) * 1000)


def _timer_ms(corrected: bool) -> dict[int, tuple[int, int, int]]:
    out = {}
    for dungeon, (t_in, t_two, t_three) in DUNGEON_TIMERS.items():
        if t_three is None and corrected:
            t_three = SANGUINE_DEPTHS_THREE_CHEST_INTENDED
        out[dungeon] = (min_sec_to_millis_py(t_in), min_sec_to_millis_py(t_two),
                        min_sec_to_millis_py(t_three) if t_three else 0)
    return out


def dungeon_limit(dungeon_id: Column, which: int, corrected: bool = False) -> Column:
    """One limit (0 in time, 1 two chest, 2 three chest) in ms; 0 when unknown."""
    expr = None
    for dungeon, limits in _timer_ms(corrected).items():
        cond = dungeon_id == F.lit(dungeon)
        expr = F.when(cond, F.lit(limits[which])) if expr is None else expr.when(cond, F.lit(limits[which]))
    return expr.otherwise(F.lit(0)).cast("bigint")


def timed(duration: Column, t_in: Column, t_two: Column, t_three: Column) -> Column:
    """3 = three chest, 2 = two chest, 1 = in time, 0 = depleted."""
    d = duration.cast("double")
    return (F.when(d <= t_three, 3).when(d <= t_two, 2).when(d <= t_in, 1).otherwise(0)).cast("int")


def duration_as_percent(t_in: Column, duration: Column) -> Column:
    """In-time limit over duration, as a percentage (double)."""
    return (t_in.cast("double") / duration.cast("double")) * F.lit(100.0)


def timed_as_percent(dungeon_id: Column, duration: Column, corrected: bool = False) -> tuple[Column, Column]:
    """(percent, intime). Duration 0 gives (1000, 0); unknown dungeons have
    all limits 0, hence percent 0 and intime 0."""
    t_in = dungeon_limit(dungeon_id, 0, corrected)
    t_two = dungeon_limit(dungeon_id, 1, corrected)
    t_three = dungeon_limit(dungeon_id, 2, corrected)
    zero = duration == 0
    pct = F.when(zero, F.lit(1000.0)).otherwise(duration_as_percent(t_in, duration))
    intime = F.when(zero, F.lit(0)).otherwise(timed(duration, t_in, t_two, t_three)).cast("int")
    return pct, intime


def _name_of(mapping: dict[int, str], id_col: Column) -> Column:
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k).cast("bigint"), F.lit(v))])
    return F.coalesce(F.element_at(m, id_col.cast("bigint")), F.lit(""))


def affix_names(two: Column, four: Column, seven: Column, ten: Column) -> Column:
    """``"Fortified, Spiteful, Volcanic, Prideful"``. The list stops at the
    first zero (or missing) id after the level-two affix; unknown ids are ""."""
    z4 = F.coalesce(four, F.lit(0)) == 0
    z7 = F.coalesce(seven, F.lit(0)) == 0
    z10 = F.coalesce(ten, F.lit(0)) == 0
    n2 = _name_of(LEVEL_TWO_AFFIXES, two)
    n4 = _name_of(LEVEL_FOUR_AFFIXES, four)
    n7 = _name_of(LEVEL_SEVEN_AFFIXES, seven)
    n10 = _name_of(LEVEL_TEN_AFFIXES, ten)
    return (F.when(z4, n2)
             .when(z7, F.concat_ws(", ", n2, n4))
             .when(z10, F.concat_ws(", ", n2, n4, n7))
             .otherwise(F.concat_ws(", ", n2, n4, n7, n10)))


def duration_mmss(duration_ms: Column) -> Column:
    """Minute-of-hour and second, so 61:05 prints as ``01:05`` (UTC)."""
    return F.date_format(F.timestamp_millis(duration_ms.cast("bigint")), "mm:ss")


def sort_key(key_level: Column, percent: Column, run_hash: Column) -> Column:
    """``%02d#%3.6f#%s`` — compared as text, exactly like the reference."""
    return F.format_string("%02d#%3.6f#%s", key_level.cast("int"), percent, run_hash)


def leaderboard_pk(patch: Column) -> Column:
    """Partition key of the overall leaderboard."""
    return F.concat(F.lit("LOG#KEY#"), patch)


def dungeon_pk(patch: Column, dungeon_id: Column) -> Column:
    """Partition key of the per-dungeon leaderboard (secondary index)."""
    return F.concat(F.lit("LOG#KEY#"), patch, F.lit("#"), dungeon_id.cast("string"))


def run_detail_pk(run_hash: Column) -> Column:
    """Key of the per-run breakdown document."""
    return F.concat(F.lit("LOG#KEY#"), run_hash, F.lit("#OVERALL_PLAYER_DAMAGE"))


def run_healing_pk(run_hash: Column) -> Column:
    """O2: key of the per-run healing document."""
    return F.concat(F.lit("LOG#KEY#"), run_hash, F.lit("#OVERALL_PLAYER_HEALING"))


def dedup_pk(run_hash: Column) -> Column:
    """Key of a ledger entry."""
    return F.concat(F.lit("DEDUP#"), run_hash)


def is_player_flag(flag: Column) -> Column:
    """X10 applied to the player flag words."""
    return flag.isin(*PLAYER_FLAGS)


def finished_flag(finished: Column) -> Column:
    """X11."""
    return finished != 0


def to_json_body(*cols: Column | str) -> Column:
    """Serialise a row (or selected columns) to a JSON text."""
    return F.to_json(F.struct(*cols))
