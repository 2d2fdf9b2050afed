"""Registered queries over the text path: B4 lines (B3 rendered as combat-log
text, plus the B5 copies where dedup is exercised) -> tokenise -> runs ->
facts -> fingerprints -> results.

Runs are reported by ``(upload_id, start_event)``, the event id the bridge
writes into the challenge-mode token of the run's START line, because run
ids and hashes are positions / fingerprints the oracle cannot know.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyroll.functions import tokens as T
from keyroll.operators import events as E
from keyroll.operators import relational as R
from keyroll.plans.ingest import Ingested, ingest
from keyroll.sources import bridge as B

LOG_YEAR = 2024


def _ingest(spark: SparkSession, sf_dir: str, with_copies: bool = False, **kw) -> Ingested:
    return ingest(B.log_lines(spark, sf_dir, with_copies=with_copies), log_year=LOG_YEAR, **kw)


def _start_events(res: Ingested) -> DataFrame:
    """run_id -> the event id the bridge wrote into the START line (the
    challenge-mode token, parsed into run meta)."""
    return res.run_meta.select("run_id", F.col("challenge_mode_id").alias("start_event"))


def _all_start_events(res: Ingested) -> DataFrame:
    """As :func:`_start_events` for every run (hashed or not)."""
    return (res.in_run.filter(F.col("event") == E.START)
            .select("run_id", T.parse_int64(F.get(F.col("p"), 3)).alias("start_event")))


def p2_tokenize(spark, sf_dir):
    """P1 + P2 + P3 + P7: header/body split and the quote-aware token split."""
    t = E.tokenize(B.log_lines(spark, sf_dir))
    return t.select("upload_id", "event", F.size("p").cast("bigint").alias("n_tokens"),
                    F.get(F.col("p"), 1).alias("t1"), T.trim_one_quote(F.get(F.col("p"), 2)).alias("t2"),
                    F.get(F.col("p"), 6).alias("t6"))


def r1_run_segments(spark, sf_dir):
    """R1 + R2: runs with their line counts."""
    res = _ingest(spark, sf_dir)
    per_run = res.in_run.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.col("event").isin(*E.DAMAGE_EVENTS).cast("bigint")).alias("n_damage_lines"))
    return (res.runs.join(per_run, "run_id").join(_all_start_events(res), "run_id")
            .select("upload_id", "start_event", "closed", "n_lines", "n_damage_lines"))


def p9_run_meta(spark, sf_dir):
    """P6 + P8 + P9 + P10: typed run meta of every hashed run."""
    res = _ingest(spark, sf_dir)
    return (res.run_meta.withColumnRenamed("challenge_mode_id", "start_event")
            .select("upload_id", "start_event", "dungeon_name", "dungeon_id", "key_level", "date",
                    "two_affix_id", "four_affix_id", "seven_affix_id", "ten_affix_id", "finished", "duration",
                    "patch"))


def r4_damage_attribution(spark, sf_dir):
    """P11 + P14 + R3 - R6: booked damage per run, caster and spell (pet hits
    moved to their owner under the summon spell)."""
    res = _ingest(spark, sf_dir)
    return (res.damage.join(_start_events(res), "run_id")
            .groupBy("upload_id", "start_event", "caster_id", "caster_name", "caster_type", "spell_id", "spell_name")
            .agg(F.sum("damage").cast("bigint").alias("damage"), F.count(F.lit(1)).alias("hits")))


def p13_rejects(spark, sf_dir):
    """P13 + Q8: rejected lines / runs, counted by upload, event and reason."""
    res = _ingest(spark, sf_dir)
    return res.rejects.groupBy("upload_id", "event", "reason").agg(F.count(F.lit(1)).alias("n"))


def d1_duplicate_groups(spark, sf_dir):
    """Runs sharing a fingerprint (B4 + B5 copies)."""
    res = _ingest(spark, sf_dir, with_copies=True)
    h = res.hashes.join(_start_events(res), "run_id")
    sizes = h.groupBy("run_hash").agg(F.count(F.lit(1)).alias("copies"))
    return h.join(sizes, "run_hash").select("upload_id", "start_event", "hashed_lines", "copies")


def d3_kept_runs(spark, sf_dir):
    """D2 + D3: the duplicate decision of every hashed run (B4 + B5)."""
    res = _ingest(spark, sf_dir, with_copies=True)
    return res.hashes.join(_start_events(res), "run_id").select("upload_id", "start_event", "duplicate")


def _two_batches(spark, sf_dir):
    """The uploads in two batches: originals with an even number first, then all
    others (copies included) against the ledger the first batch wrote."""
    from keyroll.operators import dedup as D
    from keyroll.session import scratch_path
    lines = B.log_lines(spark, sf_dir, with_copies=True)
    early = ~F.col("upload_id").endswith(B.COPY_SUFFIX) & (F.try_to_number(F.col("upload_id"), F.lit("999999999999999999")) % 2 == 0)
    path, batches = scratch_path(spark, "ledger"), []
    for n, part in enumerate((lines.filter(early), lines.filter(~early)), start=1):
        ledger = spark.read.parquet(path) if batches else None
        res = ingest(part, log_year=LOG_YEAR, ledger=ledger)
        entries = D.ledger_entries(res.hashes.filter(~F.col("duplicate")), dt.datetime(2024, 2, n), n)
        entries.write.mode("append").partitionBy("bucket").parquet(path)
        batches.append(res)
    return batches, spark.read.parquet(path)


def d2_ledger_skips(spark, sf_dir):
    """D2 + D3: duplicate decisions of the second batch, which skips the runs the
    ledger knows from the first one."""
    batches, _ = _two_batches(spark, sf_dir)
    return batches[1].hashes.join(_start_events(batches[1]), "run_id").select("upload_id", "start_event", "duplicate")


def d4_compacted_ledger(spark, sf_dir):
    """D2 + D4: the decisions of ``d2_ledger_skips`` from a ledger that was compacted after its
    first batches: even uploads whose number is divisible by 4, then the other even
    ones, a compaction, then all others, by the Bloom filter, the base and the batch behind it."""
    from keyroll.operators import dedup as D
    from keyroll.operators.ledger import Ledger
    from keyroll.session import scratch_path
    from keyroll.sources import sinks as SK
    lines = B.log_lines(spark, sf_dir, with_copies=True)
    number = F.try_to_number(F.col("upload_id"), F.lit("999999999999999999"))
    early = ~F.col("upload_id").endswith(B.COPY_SUFFIX) & (number % 2 == 0)
    path, res = scratch_path(spark, "ledger"), None
    parts = (early & (number % 4 == 0), early & (number % 4 != 0), ~early)
    for n, part in enumerate(parts):
        ledger = Ledger(spark, path, skip=("main", n))
        if n == 2:
            ledger.compact()
        res = ingest(lines.filter(part), log_year=LOG_YEAR, ledger=ledger)
        entries = D.ledger_entries(res.hashes.filter(~F.col("duplicate")), dt.datetime(2024, 2, n + 1), n)
        SK.write_batch(entries.drop("batch_id"), path, n, lead_partitions=("bucket",))
    return res.hashes.join(_start_events(res), "run_id").select("upload_id", "start_event", "duplicate")


def d6_ledger_delete(spark, sf_dir):
    """D4 + D6: the ledger after both batches, less the runs of the uploads whose
    number is divisible by 5; one row per run it still holds."""
    from keyroll.operators.dedup import delete_from_ledger
    batches, ledger = _two_batches(spark, sf_dir)
    runs = None
    for res in batches:
        part = res.hashes.filter(~F.col("duplicate")).join(_start_events(res), "run_id").select("run_hash", "upload_id", "start_event")
        runs = part if runs is None else runs.unionByName(part)
    number = F.regexp_extract("upload_id", "^[0-9]+", 0).cast("bigint")
    left = delete_from_ledger(ledger, runs.filter(number % 5 == 0))
    return left.join(runs, "run_hash").select("upload_id", "start_event", "batch_id", (F.col("pk") == F.concat(
        F.lit("DEDUP#"), "run_hash")).alias("keyed"))


def d5_hash_lists(spark, sf_dir):
    """How many hashes an upload has, and how many of them are duplicates."""
    from keyroll.operators.dedup import hash_lists
    res = _ingest(spark, sf_dir, with_copies=True)
    return hash_lists(res.hashes)


def e2e_keys_result(spark, sf_dir):
    """Text -> facts -> dedup -> the keys query (A11) over kept runs."""
    res = _ingest(spark, sf_dir, with_copies=True, patch_fallback="file")
    meta = res.kept_meta()
    keys = R.keys_result(res.kept_damage(), meta)
    ident = meta.select(F.col("run_hash").alias("combatlog_hash"), "upload_id",
                        F.col("challenge_mode_id").alias("start_event"))
    return keys.join(ident, "combatlog_hash").drop("combatlog_hash")


QUERIES = {
    "p2_tokenize": p2_tokenize,
    "r1_run_segments": r1_run_segments,
    "p9_run_meta": p9_run_meta,
    "r4_damage_attribution": r4_damage_attribution,
    "p13_rejects": p13_rejects,
    "d1_duplicate_groups": d1_duplicate_groups,
    "d3_kept_runs": d3_kept_runs,
    "d2_ledger_skips": d2_ledger_skips,
    "d4_compacted_ledger": d4_compacted_ledger,
    "d6_ledger_delete": d6_ledger_delete,
    "d5_hash_lists": d5_hash_lists,
    "e2e_keys_result": e2e_keys_result,
}


# ------------------------------------------------------------ file sources
def _file_ingest(spark, sf_dir):
    from keyroll.sources.fixtures import write_upload_files
    from keyroll.sources.logfiles import list_uploads, read_uploads, refused_files
    root = write_upload_files(spark, sf_dir)
    return ingest(read_uploads(spark, root, faults=True), log_year=LOG_YEAR,
                  refused=refused_files(list_uploads(spark, root)))


def s1_file_runs(spark, sf_dir):
    """S1 + S3 + S4 + S5 + S6: the B4 lines written as .txt / .txt.gz / .zip
    uploads, read back through the file sources; runs as in r1."""
    res = _file_ingest(spark, sf_dir)
    per_run = res.in_run.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.col("event").isin(*E.DAMAGE_EVENTS).cast("bigint")).alias("n_damage_lines"))
    return (res.runs.join(per_run, "run_id").join(_all_start_events(res), "run_id")
            .select("upload_id", "start_event", "closed", "n_lines", "n_damage_lines"))


def s2_line_numbers(spark, sf_dir):
    """Dense line numbers per file equal the event order per upload."""
    from keyroll.sources.fixtures import write_upload_files
    from keyroll.sources.logfiles import read_uploads
    root = write_upload_files(spark, sf_dir)
    lines = read_uploads(spark, root, dense_line_no=True)
    _, body = T.split_header(F.col("value"))
    return lines.select("upload_id", F.col("line_no").cast("bigint").alias("line_no"),
                        F.substring_index(body, ",", 1).alias("event"))


def s7_upload_keys(spark, sf_dir):
    """S5 + S6 + S7: key parsing and gates of every written upload file."""
    from keyroll.sources.fixtures import write_upload_files
    from keyroll.sources.logfiles import list_uploads
    root = write_upload_files(spark, sf_dir)
    return list_uploads(spark, root).select("upload_id", "upload_date", "upload_hour", "file_type", "accepted")


QUERIES.update({
    "s1_file_runs": s1_file_runs,
    "s2_line_numbers": s2_line_numbers,
    "s7_upload_keys": s7_upload_keys,
})


# ------------------------------------------------------------ streaming
# Table files per micro-batch of the stream over run hashes, the same at every size. The
# upload streams bound their batches by bytes.
STREAM_FILES_PER_TRIGGER = 64


_STREAMED: dict[tuple[str, str], str] = {}


def _stream_tables(spark, sf_dir: str) -> str:
    """The tables of the file streams over the B4 + B5 uploads (``availableNow``, whole
    files per micro-batch, ledger shared across batches); run once per session."""
    from keyroll.session import scratch_path
    from keyroll.sources.fixtures import write_upload_files
    from keyroll.streaming.uploads import start_upload_streams
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STREAMED:
        landing = write_upload_files(spark, sf_dir, with_copies=True)
        out_root = scratch_path(spark, "stream-out")
        start_upload_streams(spark, landing, out_root, scratch_path(spark, "stream-ckpt"),
                             max_files_per_trigger=None, log_year=LOG_YEAR,
                             patch_fallback="file", sequential=True)
        _STREAMED[key] = out_root
    return _STREAMED[key]


def t1_stream_keys_result(spark, sf_dir):
    """S8 + T1 + D4 + S9: the B4 + B5 uploads as files, ingested by the text and the
    packed file stream, facts read back and queried. Which copy of a duplicate
    survives depends on batch order, so the upload id is left out; everything
    else equals the batch result."""
    from keyroll.streaming.uploads import gold_table
    out_root = _stream_tables(spark, sf_dir)
    meta = gold_table(spark, out_root, "run_meta")
    damage = gold_table(spark, out_root, "damage")
    keys = R.keys_result(damage, meta)
    ident = meta.select(F.col("run_hash").alias("combatlog_hash"), F.col("challenge_mode_id").alias("start_event"))
    return keys.join(ident, "combatlog_hash").drop("combatlog_hash")


def t2_stream_documents(spark, sf_dir):
    """T2 + S10: the players of the board that the streams keep by upserts; the board equals
    a rebuild from all facts."""
    from keyroll.sources import documents as DT
    from keyroll.streaming.uploads import gold_table
    out_root = _stream_tables(spark, sf_dir)
    ident = gold_table(spark, out_root, "run_meta").select(
        F.col("run_hash").alias("combatlog_hash"), F.col("challenge_mode_id").alias("start_event"))
    docs = DT.leaderboard(spark, f"{out_root}/top_keys").read()
    players = docs.select("combatlog_hash", "patch", "dungeon_id", "keylevel", F.explode("player_damage").alias("p"))
    return players.join(ident, "combatlog_hash").select(
        "start_event", "patch", "dungeon_id", "keylevel", F.col("p.player_id").alias("player_id"), F.col("p.damage").alias("damage"))


def t4_stream_dedup(spark, sf_dir):
    """T4: the first runs that keyed streaming state finds among the run hashes of the upload
    streams, against those that the ledger kept: one row per run, in both exactly once."""
    from keyroll.session import scratch_path
    from keyroll.streaming import first_runs as FR
    from keyroll.streaming.uploads import gold_table
    out_root, first = _stream_tables(spark, sf_dir), scratch_path(spark, "first-runs")
    FR.start_first_runs(spark, f"{out_root}/upload_hashes", first, scratch_path(spark, "first-ckpt"),
                        max_files=STREAM_FILES_PER_TRIGGER).awaitTermination()
    ident = gold_table(spark, out_root, "run_meta").select("run_hash", F.col("challenge_mode_id").alias("start_event"))
    return FR.against_ledger(spark, first, f"{out_root}/ledger").join(ident, "run_hash", "left").drop("run_hash")


def s13_upload_metrics(spark, sf_dir):
    """S13 + D5: what the streams recorded of every upload and its copy together (which of
    the two is the duplicate depends on batch order): files, their types, records, runs,
    duplicates, and whether every file has a size."""
    from keyroll.streaming.uploads import gold_table
    m = gold_table(spark, _stream_tables(spark, sf_dir), "upload_metrics")
    return m.groupBy(F.regexp_extract("upload_id", "^[0-9]+", 0).alias("upload")).agg(
        F.count(F.lit(1)).alias("files"), F.array_join(F.array_sort(F.collect_set("file_type")), "+").alias("types"),
        F.sum("records").cast("bigint").alias("records"), F.sum("runs").cast("bigint").alias("runs"),
        F.sum("duplicate_runs").cast("bigint").alias("duplicate_runs"), F.min(F.col("bytes") > 0).alias("sized"))


def t3_stream_rejects(spark, sf_dir):
    """T3 + S5 + S7: of every upload a file that is cut, has another suffix or a bad key
    (or is whole), through the streams; the files in ``rejects``, with the reason."""
    from keyroll.session import scratch_path
    from keyroll.sources.fixtures import write_refused_files
    from keyroll.streaming.uploads import gold_table, start_upload_streams
    out_root = scratch_path(spark, "refused-out")
    start_upload_streams(spark, write_refused_files(spark, sf_dir), out_root, scratch_path(spark, "refused-ckpt"),
                         max_files_per_trigger=None, log_year=LOG_YEAR)
    rejects = gold_table(spark, out_root, "rejects").filter(F.col("path").isNotNull())
    return rejects.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.substring_index("reason", ":", 1).alias("reason"))


# The late bound and the retention of the query below.
LATE_AFTER, RETAIN = dt.timedelta(hours=12), dt.timedelta(hours=18)


def t5_late_and_expired(spark, sf_dir):
    """T5 + F5: the B4 uploads in four batches (number modulo 4) under a late bound and a
    retention: per upload whether it came too late, or how many runs and how much
    damage the fact tables still hold of it."""
    from keyroll.session import scratch_path
    from keyroll.streaming.uploads import gold_table, process_batch
    lines = B.log_lines(spark, sf_dir)
    first = lines.groupBy("upload_id").agg(F.min("ts").alias("first"))
    folder = F.concat_ws("/", F.lit("s3://landing/upload"), F.year("first"), F.month("first"), F.dayofmonth("first"), F.hour("first"))
    paths = first.select("upload_id", F.concat(folder, F.lit("/"), F.col("upload_id"), F.lit(".txt")).alias("path"))
    lines = lines.join(paths, "upload_id").select("path", "pos", "value", F.pmod(F.col("upload_id").cast("bigint"), F.lit(4)).alias("batch"))
    out_root = scratch_path(spark, "late-out")
    for batch in range(4):
        process_batch(spark, lines.filter(F.col("batch") == batch).drop("batch"), batch, out_root, log_year=LOG_YEAR,
                      late_after=LATE_AFTER, retain=RETAIN)
    late = gold_table(spark, out_root, "rejects").filter("reason = 'late'")
    late = late.select(F.regexp_extract("path", "([^/]+)[.]txt$", 1).alias("upload_id"), F.lit("late").alias("state"),
                       F.lit(0).cast("bigint").alias("runs"), F.lit(0).cast("bigint").alias("damage"))
    runs = gold_table(spark, out_root, "run_meta").groupBy("upload_id").agg(F.count(F.lit(1)).alias("runs"))
    damage = gold_table(spark, out_root, "damage").groupBy("upload_id").agg(F.sum("damage").cast("bigint").alias("damage"))
    kept = runs.join(damage, "upload_id", "left").select(
        F.col("upload_id").cast("string").alias("upload_id"), F.lit("kept").alias("state"), "runs",
        F.coalesce("damage", F.lit(0).cast("bigint")).alias("damage"))
    return late.unionByName(kept)


QUERIES.update({"t2_stream_documents": t2_stream_documents, "t4_stream_dedup": t4_stream_dedup, "s13_upload_metrics": s13_upload_metrics,
                "t3_stream_rejects": t3_stream_rejects, "t5_late_and_expired": t5_late_and_expired})
QUERIES["t1_stream_keys_result"] = t1_stream_keys_result


# ------------------------------------------------------------ optional tier
def o1_encounters(spark, sf_dir):
    """O1: boss-encounter segments inside runs, with kill flag and length."""
    from keyroll.operators.runs import encounter_segments
    res = _ingest(spark, sf_dir, events=E.READ_EVENTS + (E.ENCOUNTER_START, E.ENCOUNTER_END))
    enc = res.encounters.withColumn("time_ms", T.log_time_millis(F.col("ts_text"), LOG_YEAR))
    seg = (encounter_segments(enc).join(_all_start_events(res), "run_id")
           .join(res.runs.select("run_id", "upload_id"), "run_id"))
    return seg.select("upload_id", "start_event", "encounter_id", "encounter_name", "closed", "kill", "duration_ms")


def o2_healing(spark, sf_dir):
    """O2: healing per player and hashed or unhashed run (heal, overhealing, absorbed)."""
    res = _ingest(spark, sf_dir, events=E.READ_EVENTS + E.HEAL_EVENTS)
    return (res.all_heals.join(_all_start_events(res), "run_id")
            .groupBy("upload_id", "start_event", "caster_id", "caster_name")
            .agg(F.sum("heal").cast("bigint").alias("heal"), F.sum("overheal").cast("bigint").alias("overheal"),
                 F.sum("absorbed").cast("bigint").alias("absorbed"), F.count(F.lit(1)).alias("n")))


def o2_healing_docs(spark, sf_dir):
    """O2: the healing documents of the kept runs, one row per player and spell."""
    from keyroll.operators import gold as G
    res = _ingest(spark, sf_dir, events=E.READ_EVENTS + E.HEAL_EVENTS)
    docs = G.healing_docs(res.heals.filter(~F.col("duplicate")), res.kept_meta())
    ident = res.run_meta.select(F.col("run_hash").alias("combatlog_hash"), F.col("challenge_mode_id").alias("start_event"))
    p = docs.join(ident, "combatlog_hash").select("start_event", "keylevel", "dungeon_id", F.posexplode("player_healing").alias("player_pos", "p"))
    s = p.select("start_event", "keylevel", "dungeon_id", "player_pos", "p.player_id", F.col("p.healing").alias("player_total"),
                 F.posexplode("p.healing_per_spell").alias("spell_pos", "s"))
    return s.select("start_event", "keylevel", "dungeon_id", "player_pos", "player_id", "player_total", "spell_pos", "s.spell_id",
                    F.col("s.healing").alias("spell_healing"))


def p13_rejects_all_events(spark, sf_dir):
    """P13 with heal and encounter lines read too: the reason, and the line as it was written."""
    res = _ingest(spark, sf_dir, events=E.READ_EVENTS + E.OPTIONAL_EVENTS)
    body = F.regexp_extract("line", "^[^ ]+ [^ ]+  (.*)$", 1)
    return res.rejects.groupBy("upload_id", "event", "reason").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("line").isNotNull() & (F.substring_index(body, ",", 1) == F.col("event"))).alias("lines"))


QUERIES.update({"o2_healing_docs": o2_healing_docs, "p13_rejects_all_events": p13_rejects_all_events})
QUERIES.update({"o1_encounters": o1_encounters, "o2_healing": o2_healing})


def e2e_keys_result_fanout(spark, sf_dir):
    """Q11 parity: the keys query with the reference's row multiplication
    (a run with two version lines has two patch facts, so every player row
    appears twice) and the reference's patch rule (version line inside the
    run, Q2)."""
    res = _ingest(spark, sf_dir, with_copies=True)
    meta = res.kept_meta()
    keys = R.keys_result(res.kept_damage(), meta, fanout=True)
    ident = meta.select(F.col("run_hash").alias("combatlog_hash"), "upload_id",
                        F.col("challenge_mode_id").alias("start_event"))
    return keys.join(ident, "combatlog_hash").drop("combatlog_hash")


QUERIES["e2e_keys_result_fanout"] = e2e_keys_result_fanout
