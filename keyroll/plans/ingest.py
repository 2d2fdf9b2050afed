"""Upload lines -> run meta, damage facts, fingerprints, rejects.

This is the reference's normalise + dedup + fact-write path as one Spark
plan. The text is tokenised once into a stored table. Shuffles: the as-of run assignment (by upload, block), the pet
as-of (by upload, pet, block), the fingerprint aggregate (by run) and the
small per-run joins. The per-upload window touches marker lines only.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyroll.operators import dedup as D
from keyroll.operators import events as E
from keyroll.operators import runs as R
from keyroll.operators.asof import asof_lookup
from keyroll.session import scratch_path

META_FIELDS = ("dungeon_name", "dungeon_id", "challenge_mode_id", "key_level", "date", "two_affix_id",
               "four_affix_id", "seven_affix_id", "ten_affix_id")


# What a run takes from its upload, where the lines have it.
UPLOAD_COLUMNS = ("upload_date",)


class Ingested:
    """The outputs of :func:`ingest`. ``runs`` and ``in_run`` are stored
    when the plan is built; the per-run dedup decisions and run meta are
    computed (and stored) on first use, so a caller that needs only runs or
    rejects never pays for fingerprints."""

    def __init__(self, runs: DataFrame, in_run: DataFrame, meta: DataFrame, hits: DataFrame,
                 line_rejects: DataFrame, fingerprints: DataFrame, mode: str, ledger: DataFrame | None,
                 materialize: bool, refused: DataFrame | None = None, heals: DataFrame | None = None,
                 encounters: DataFrame | None = None) -> None:
        self.runs = runs              # every run: upload_id, run_id, start_pos, end_pos, closed
        self.in_run = in_run          # tokenised lines inside a run (+ run_id, start_pos)
        self._meta = meta
        self._hits = hits
        self._line_rejects = line_rejects
        self._fingerprints = fingerprints
        self._mode = mode
        self._ledger = ledger
        self._materialize = materialize
        self._refused = refused
        self._heals = heals
        self.encounters = None if encounters is None else encounters.filter(F.col("error").isNull())

    @cached_property
    def fingerprints(self) -> DataFrame:
        """run_id, run_hash, hashed_lines — one row per hashed run (stored)."""
        return _stored(self._fingerprints, "fingerprints", self._materialize)

    @cached_property
    def hashes(self) -> DataFrame:
        """run_id, upload_id, start_pos, run_hash, hashed_lines, duplicate, cut (its file
        broke off inside it: what it holds is stored, but the ledger must not know it)."""
        hashed_runs = self.runs.join(self.fingerprints, "run_id", "inner")
        broken = self._line_rejects.filter(F.col("path").isNotNull()).select("upload_id", F.lit(True).alias("_broken")).distinct()
        open_end = ~F.col("closed") & (F.col("end_pos") == R.OPEN_END)
        hashed_runs = (hashed_runs.join(broken, "upload_id", "left")
                       .withColumn("cut", F.coalesce(open_end & F.col("_broken"), F.lit(False))).drop("_broken"))
        if self._mode == "failfast":
            failed = self._line_rejects.select("upload_id").distinct()
            hashed_runs = hashed_runs.join(failed, "upload_id", "left_anti")
        return _stored(D.decide(hashed_runs, self._ledger), "decided", self._materialize)

    @cached_property
    def _tags(self) -> DataFrame:
        return self.hashes.select("run_id", "run_hash", "duplicate", *[c for c in UPLOAD_COLUMNS if c in self.hashes.columns])

    @cached_property
    def run_meta(self) -> DataFrame:
        """One row per hashed run (+ run_hash, duplicate); stored on first use
        (small, and read by several consumers)."""
        return _stored(self._meta.drop(*UPLOAD_COLUMNS).join(self._tags, "run_id", "inner"), "run-meta", self._materialize)

    @property
    def damage(self) -> DataFrame:
        """Booked hits of every hashed run (+ run_hash, duplicate)."""
        return (self._hits.filter(F.col("keep"))
                .select("upload_id", "run_id", "pos", "caster_id", "caster_name", "caster_type", "spell_id",
                        "spell_name", "damage")
                .join(self._tags, "run_id", "inner"))

    @property
    def all_heals(self) -> DataFrame:
        """O2: the heals of players in every run, hashed or not."""
        return self._heals.filter(F.col("keep")).select(
            "upload_id", "run_id", "pos", "caster_id", "caster_name", "caster_type", "spell_id", "spell_name",
            "heal", "overheal", "absorbed")

    @property
    def heals(self) -> DataFrame:
        """O2: the heals of players in every hashed run (+ run_hash, duplicate)."""
        return self.all_heals.join(self._tags, "run_id", "inner")

    @property
    def rejects(self) -> DataFrame:
        """upload_id, pos, event, reason, path, line — rejected lines with their text,
        runs without a hashed line (Q8, reason ``no_hash``), archives that could not be
        read on from ``pos``, and refused files; only the last two have the path."""
        no_hash = (self.runs.join(self.fingerprints, "run_id", "left_anti")
                   .select("upload_id", F.col("start_pos").alias("pos"), F.lit(E.START).alias("event"),
                           F.lit("no_hash").alias("reason")))
        out = self._line_rejects.unionByName(no_hash, allowMissingColumns=True)
        return out if self._refused is None else out.unionByName(self._refused, allowMissingColumns=True)

    def kept_meta(self) -> DataFrame:
        return self.run_meta.filter(~F.col("duplicate"))

    def kept_damage(self) -> DataFrame:
        return self.damage.filter(~F.col("duplicate"))


def _year(lines: DataFrame, log_year: int | None) -> Column:
    if log_year is not None:
        return F.lit(log_year)
    if "upload_date" in lines.columns:
        return F.year("upload_date")
    return F.year(F.current_date())


def _stored(df: DataFrame, name: str, materialize: bool) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it
    back (a lineage cut that survives executor loss); no-op when off."""
    if not materialize:
        return df
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def ingest(lines: DataFrame, log_year: int | None = None, parity: bool = False, mode: str = "quarantine",
           ledger: DataFrame | None = None, events=E.READ_EVENTS, patch_fallback: str | None = None,
           materialize: bool = True, refused: DataFrame | None = None) -> Ingested:
    """``lines``: ``upload_id, pos, value`` (+ optional ``upload_date``);
    ``pos`` orders the lines of an upload. ``mode='failfast'`` drops every
    run of an upload that has a rejected line (the reference fails the
    whole upload, Q9); ``'quarantine'`` keeps the rest. As in the reference
    a run's patch comes from a version line inside it (Q2);
    ``patch_fallback='file'`` falls back to the last version line before
    the run's start in the same upload. A row with a ``fault`` (optional column)
    is no line but says why its file could not be read on: it is rejected with
    its ``path``. ``refused`` (``path, reason``) are files that were not read;
    they are added to the rejects."""
    t = E.tokenize(lines.withColumn("log_year", _year(lines, log_year)), parity=parity, events=events)
    fault_path = F.lit(None).cast("string")
    if "fault" in lines.columns:
        t = t.withColumn("error", F.coalesce("fault", "error"))
        fault_path = F.when(F.col("fault").isNotNull(), F.col("path"))
    # The text is read and split once; later steps need the tokens and, for the
    # fingerprint, two hashes of the body, not the text itself.
    t = t.withColumn("line", F.when(F.col("error").isNotNull(), F.col("value")))
    t = _stored(D.with_body_hashes(t).drop("value", "body"), "tokens", materialize)
    bad_lines = t.filter(F.col("error").isNotNull()).select("upload_id", "pos", "event", F.col("error").alias("reason"),
                                                            fault_path.alias("path"), "line")
    t = t.filter(F.col("error").isNull()).drop("line")
    if "fault" in lines.columns:
        t = t.drop("fault")

    runs = _stored(R.segment_runs(t.filter(F.col("event").isin(E.START, E.END)),
                                  keep=[c for c in UPLOAD_COLUMNS if c in t.columns]), "runs", materialize)
    # Seven consumers read the in-run lines; they are written once as a
    # Parquet table in the shared checkpoint folder instead of recomputing two
    # shuffles per consumer (this also cuts the lineage a lost executor would
    # replay, and gives every consumer a columnar scan).
    in_run = _stored(R.assign_runs(t, runs), "in-run", materialize)

    starts = E.start_fields(in_run.filter(F.col("event") == E.START), F.col("log_year"))
    ends = E.end_fields(in_run.filter(F.col("event") == E.END))
    versions = E.version_fields(in_run.filter(F.col("event") == E.VERSION))
    summons = E.summon_fields(in_run.filter(F.col("event") == E.SUMMON))
    hits = R.attach_pet_owners(in_run.filter(F.col("event").isin(*E.DAMAGE_EVENTS)),
                               summons.filter(F.col("keep") & F.col("error").isNull()))
    hits = E.damage_fields(hits)

    start_meta = starts.filter(F.col("error").isNull()).select("run_id", *META_FIELDS)
    end_meta = (ends.filter(F.col("error").isNull()).groupBy("run_id")
                .agg(F.max("finished").alias("finished"), F.max("duration").alias("duration")))
    # A run's patch; ``patch_facts`` counts its version lines (the reference
    # writes one patch fact per line, which its joins multiply: Q11).
    patch = (versions.filter(F.col("error").isNull()).groupBy("run_id")
             .agg(F.max("patch").alias("patch"), F.count(F.lit(1)).alias("patch_facts")))
    meta = runs.join(start_meta, "run_id", "left").join(end_meta, "run_id", "left").join(patch, "run_id", "left")
    if patch_fallback == "file":
        all_versions = E.version_fields(t.filter(F.col("event") == E.VERSION)).filter(F.col("error").isNull())
        before = asof_lookup(runs.select("run_id", "upload_id", "start_pos"), all_versions, ["upload_id"],
                             "start_pos", "pos", ["patch"], inclusive=False, out="_v")
        meta = (meta.join(before.select("run_id", F.col("_v.patch").alias("_file_patch")), "run_id", "left")
                    .withColumn("patch", F.coalesce("patch", "_file_patch")).drop("_file_patch"))
    elif patch_fallback is not None:
        raise ValueError("patch_fallback must be None or 'file'")

    hashed = in_run.filter(F.col("event").isin(*E.DAMAGE_EVENTS, E.COMBATANT_INFO))
    fp = D.fingerprint(hashed)

    def errors(df: DataFrame) -> DataFrame:
        return df.filter(F.col("error").isNotNull()).select("upload_id", "pos", "event",
                                                            F.col("error").alias("reason"),
                                                            F.lit(None).cast("string").alias("path"),
                                                            E.line_text().alias("line"))

    heals = E.heal_fields(in_run.filter(F.col("event").isin(*E.HEAL_EVENTS)))
    encounters = E.encounter_fields(in_run.filter(F.col("event").isin(E.ENCOUNTER_START, E.ENCOUNTER_END)))
    rejects = (bad_lines.unionByName(errors(starts)).unionByName(errors(ends)).unionByName(errors(versions))
               .unionByName(errors(summons)).unionByName(errors(hits)))
    # Only where they are read: other plans stay as small as they are.
    if set(events) & set(E.HEAL_EVENTS):
        rejects = rejects.unionByName(errors(heals))
    if set(events) & {E.ENCOUNTER_START, E.ENCOUNTER_END}:
        rejects = rejects.unionByName(errors(encounters))
    if mode not in ("quarantine", "failfast"):
        raise ValueError("mode must be 'quarantine' or 'failfast'")
    return Ingested(runs=runs, in_run=in_run, meta=meta, hits=hits, line_rejects=rejects, fingerprints=fp,
                    mode=mode, ledger=ledger, materialize=materialize, refused=refused, heals=heals, encounters=encounters)
