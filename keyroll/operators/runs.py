"""Run segmentation, run assignment and pet attribution.

A run is a START..END interval of one upload. The marker behind each marker and
the run of every other line are found block by block
(:mod:`keyroll.operators.asof`), so no task ever holds a whole upload.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyroll.operators import events as E
from keyroll.operators.asof import asof_lookup, next_row

# Upper bound used for a run left open until the end of its upload.
OPEN_END = (1 << 62)


def segment_runs(markers: DataFrame, upload: str = "upload_id", pos: str = "pos", keep=()) -> DataFrame:
    """START opens a run, the next END closes it; a START while a run is
    open closes that run just before itself (``closed`` false, Q3); an END
    with no open run is ignored. ``markers`` holds START/END lines only.

    Returns ``upload_id, run_id, start_pos, end_pos, closed`` and the columns ``keep``
    of the START line, with ``run_id = upload_id:start_pos`` (deterministic under
    task retries)."""
    m = next_row(markers.select(upload, pos, "event", *keep), [upload], pos, ["event"])
    starts = m.filter(F.col("event") == E.START)
    after = F.col("next.event")
    end_pos = (F.when(after == E.END, F.col("next._pos"))
                .when(after == E.START, F.col("next._pos") - 1)
                .otherwise(F.lit(OPEN_END)))
    return starts.select(
        upload,
        F.concat(F.col(upload), F.lit(":"), F.col(pos).cast("string")).alias("run_id"),
        F.col(pos).alias("start_pos"),
        end_pos.cast("bigint").alias("end_pos"),
        F.coalesce(after == E.END, F.lit(False)).alias("closed"),
        *keep,
    )


def assign_runs(lines: DataFrame, runs: DataFrame, upload: str = "upload_id", pos: str = "pos") -> DataFrame:
    """R2: attach ``run_id, start_pos`` to lines inside a run (start <= pos <=
    end); lines outside every run are dropped."""
    j = asof_lookup(lines, runs, [upload], pos, "start_pos", ["run_id", "end_pos"], inclusive=True,
                    out="_run")
    inside = F.col("_run").isNotNull() & (F.col(pos) <= F.col("_run.end_pos"))
    j = j.withColumn("run_id", F.when(inside, F.col("_run.run_id"))) \
         .withColumn("start_pos", F.when(inside, F.col("_run._pos"))).drop("_run")
    return j.filter(F.col("run_id").isNotNull())


def attach_pet_owners(damage_lines: DataFrame, summons: DataFrame, upload: str = "upload_id",
                      pos: str = "pos") -> DataFrame:
    """The owner of a pet is taken from its last registration earlier in
    the *upload* (not reset per run, Q4). ``summons`` are in-run, player-cast
    ``SPELL_SUMMON`` lines with ``pet_guid, owner_id, owner_name, pet_name,
    pet_spell_id``. Partitioned by (upload, pet GUID, block)."""
    left = damage_lines.withColumn("_guid", F.get(F.col("p"), 1))
    right = summons.select(upload, F.col("pet_guid").alias("_guid"), pos, "owner_id", "owner_name", "pet_name",
                           "pet_spell_id")
    j = asof_lookup(left, right, [upload, "_guid"], pos, pos,
                    ["owner_id", "owner_name", "pet_name", "pet_spell_id"], inclusive=False, out="owner")
    return j.drop("_guid")


def encounter_segments(encounters: DataFrame, pos: str = "pos") -> DataFrame:
    """O1: boss encounters inside a run. An ``ENCOUNTER_START`` is closed by
    the next encounter marker if that is an ``ENCOUNTER_END`` (its kill flag
    is kept); otherwise it stays open. ``encounters`` holds the in-run
    encounter lines with ``run_id``, ``event``, ``kill`` and ``time_ms``."""
    m = next_row(encounters.select("run_id", pos, "event", "encounter_id", "encounter_name", "kill", "time_ms"),
                 ["run_id"], pos, ["event", "kill", "time_ms"])
    closed = F.coalesce(F.col("next.event") == E.ENCOUNTER_END, F.lit(False))
    return (m.filter(F.col("event") == E.ENCOUNTER_START)
             .select("run_id", "encounter_id", "encounter_name", F.col(pos).alias("start_pos"), closed.alias("closed"),
                     F.when(closed, F.col("next.kill")).alias("kill"),
                     F.when(closed, F.col("next.time_ms") - F.col("time_ms")).alias("duration_ms")))
