"""End-to-end checks on hand-written upload lines, parity switches, split
invariance of the file source and replay idempotence of the stream batch."""

import gzip
import os
from pyspark.sql import functions as F

from keyroll.functions import scoring as S
from keyroll.operators import relational as R
from keyroll.plans.ingest import ingest

def line(time: str, event: str, *fields, size: int | None = None, at: dict | None = None) -> str:
    """A log line of ``size`` tokens: the given fields, ``at`` by position, zeros."""
    tokens = [event, *map(str, fields)]
    tokens += ["0"] * ((size or len(tokens)) - len(tokens))
    for i, v in (at or {}).items():
        tokens[i] = str(v)
    return f"{time}  {','.join(tokens)}"


ANA = ("Player-1-A1", '"Ana, the First-Realm"', "0x511", "0x0")
BEN = ("Player-2-B2", '"Ben-Realm"', "0x512", "0x0")
FOE = ("Creature-7-1", '"Old Foe"', "0x10a48", "0x0")
IMP = ("Creature-7-2", '"Imp"')
VERSION = line("1/24 16:40:00.000", "COMBAT_LOG_VERSION", 16, "ADVANCED_LOG_ENABLED", 1, "BUILD_VERSION", "9.0.2", "PROJECT_ID", 1)
# One upload: a run with a spell hit, a swing, a summoned pet's swing, a pet
# nobody summoned, a hit on a friend, and a line of an event that is not read.
SAMPLE = [
    VERSION,
    line("1/24 16:47:38.068", "CHALLENGE_MODE_START", '"De Other Side"', 2291, 377, 10, "[10", 123, 3, "121]"),
    VERSION,
    line("1/24 16:47:51.662", "SPELL_DAMAGE", *ANA, *FOE, 901, '"Cold Bolt"', "0x20", size=39, at={29: 4321}),
    line("1/24 16:48:22.684", "SWING_DAMAGE", *ANA, *FOE, size=36, at={26: 765}),
    line("1/24 16:50:53.696", "SPELL_SUMMON", *BEN, *IMP, "0xa28", "0x0", 31234, '"Call Imp"', "0x20"),
    line("1/24 16:51:00.000", "SWING_DAMAGE", *IMP, "0x2112", "0x0", *FOE, size=36, at={26: 88}),
    line("1/24 16:55:26.219", "SWING_DAMAGE", "Pet-7-3", '"Stray"', "0x1112", "0x0", *FOE, size=36, at={26: 99}),
    line("1/24 16:56:00.000", "SPELL_DAMAGE", *BEN, *ANA, 902, '"Jab"', "0x20", size=39, at={29: 11}),
    line("1/24 17:23:07.443", "CHALLENGE_MODE_END", 2291, 1, 10, 2136094),
    line("1/24 17:24:00.000", "SWING_DAMAGE_LANDED", *ANA, *FOE),
]


def _lines(spark, rows, upload="u1"):
    return spark.createDataFrame([(upload, i, v) for i, v in enumerate(rows)], "upload_id string, pos long, value string")


def test_sample_upload(spark):
    res = ingest(_lines(spark, SAMPLE), log_year=2021)
    meta = res.run_meta.collect()
    assert len(meta) == 1
    m = meta[0]
    assert (m.dungeon_name, m.dungeon_id, m.key_level, m.patch, m.finished, m.duration) == \
        ("De Other Side", 2291, 10, "9.0.2", 1, 2136094)
    assert (m.two_affix_id, m.four_affix_id, m.seven_affix_id, m.ten_affix_id) == (10, 123, 3, 121)
    dmg = {(r.caster_id, r.spell_id, r.spell_name): r.damage for r in res.damage.collect()}
    assert dmg == {
        ("Player-1-A1", 901, "Cold Bolt"): 4321,
        ("Player-1-A1", S.AUTO_ATTACK_SPELL_ID, "Auto Attack"): 765,
        ("Player-2-B2", 31234, "Call Imp"): 88,                  # pet swing under the summon spell
    }
    assert res.rejects.count() == 0


def test_outside_lines_and_reopened_run(spark):
    rows = ['1/1 00:00:00.000  CHALLENGE_MODE_END,1,1,1,1',          # END outside: ignored
            '1/1 00:00:01.000  CHALLENGE_MODE_START,"A",2291,1,2,[9,7,4]',
            SAMPLE[3].replace("4321", "5"),
            '1/1 00:00:02.000  CHALLENGE_MODE_START,"B",2289,1,3,[9,7,4]',   # closes the first run
            SAMPLE[3].replace("4321", "6"),
            'no separator here']
    res = ingest(_lines(spark, rows), log_year=2021)
    runs = sorted((r.closed, r.start_pos, r.end_pos) for r in res.runs.collect())
    assert runs[0][:2] == (False, 1) and runs[0][2] == 2
    assert runs[1][:2] == (False, 3)
    assert {r.reason for r in res.rejects.collect()} == {"no_separator"}
    assert sorted(r.damage for r in res.damage.collect()) == [5, 6]


def test_failfast_and_parity(spark):
    bad = SAMPLE[:4] + [SAMPLE[3].replace(",4321,", ",43x,")] + SAMPLE[9:10]
    q = ingest(_lines(spark, bad), log_year=2021)
    assert q.run_meta.count() == 1 and q.damage.count() == 1
    f = ingest(_lines(spark, bad), log_year=2021, mode="failfast")
    assert f.run_meta.count() == 0
    p = ingest(_lines(spark, [SAMPLE[1], SAMPLE[3] + "  trailing", SAMPLE[9]]), log_year=2021, parity=True)
    assert p.damage.count() == 1


def test_duplicate_upload_and_ledger(spark):
    lines = _lines(spark, SAMPLE, "u1").unionByName(_lines(spark, SAMPLE, "u2"))
    res = ingest(lines, log_year=2021)
    dec = {r.upload_id: r.duplicate for r in res.hashes.collect()}
    assert dec == {"u1": False, "u2": True}
    ledger = res.hashes.filter(~F.col("duplicate")).select("run_hash")
    again = ingest(_lines(spark, SAMPLE, "u3"), log_year=2021, ledger=ledger)
    assert [r.duplicate for r in again.hashes.collect()] == [True]


def test_parity_switches_on_scores(spark):
    df = spark.createDataFrame([(2284, 1470000)], "d long, dur long")
    _, i0 = S.timed_as_percent(F.col("d"), F.col("dur"))
    _, i1 = S.timed_as_percent(F.col("d"), F.col("dur"), corrected=True)
    r = df.select(i0.alias("a"), i1.alias("b")).first()
    assert (r.a, r.b) == (2, 3)


def test_split_invariance(spark, tmp_path):
    from keyroll.sources.logfiles import read_uploads
    folder = tmp_path / "upload" / "2021" / "1" / "24" / "16"
    folder.mkdir(parents=True)
    body = "\n".join(SAMPLE * 200) + "\n"
    (folder / "aaaaaaaa.txt").write_text(body)
    with gzip.open(folder / "bbbbbbbb.txt.gz", "wt") as fh:
        fh.write(body)
    def runs(max_bytes):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(max_bytes))
        try:
            res = ingest(read_uploads(spark, str(tmp_path)), log_year=2021)
            per_run = R.damage_per_player(res.damage).groupBy("run_hash").agg(F.sum("damage").alias("damage"))
            return sorted((r.upload_id, r.damage) for r in
                          per_run.join(res.run_meta.select("run_hash", "upload_id"), "run_hash").collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert runs(4096) == runs(128 * 1024 * 1024)


def test_stream_batch_replay_is_idempotent(spark, tmp_path):
    from keyroll.streaming.uploads import process_batch
    out = str(tmp_path / "out")
    lines = spark.createDataFrame([("s3://b/upload/2021/1/24/16/cccc.txt", i, v) for i, v in enumerate(SAMPLE)],
                                  "path string, pos long, value string")
    process_batch(spark, lines, 0, out, log_year=2021)
    first = sorted(map(tuple, spark.read.parquet(os.path.join(out, "damage")).select("run_hash", "damage").collect()))
    process_batch(spark, lines, 0, out, log_year=2021)           # replay of batch 0
    again = sorted(map(tuple, spark.read.parquet(os.path.join(out, "damage")).select("run_hash", "damage").collect()))
    assert first == again and len(first) == 3
    process_batch(spark, lines, 1, out, log_year=2021)           # same upload again: duplicate
    assert spark.read.parquet(os.path.join(out, "damage")).count() == 3
    docs = spark.read.parquet(os.path.join(out, "top_keys"))
    assert docs.count() == 1


def test_a_batch_leaves_no_scratch_tables(spark, tmp_path):
    """The tables of a batch stay, what it stored on the way does not."""
    from keyroll.session import ensure_checkpoint_dir, scratch_path, scratch_scope
    from keyroll.streaming.uploads import gold_table, process_batch
    shared = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(shared))
    lines = spark.createDataFrame([("s3://b/upload/2021/1/24/16/dddd.txt", i, v) for i, v in enumerate(SAMPLE)],
                                  "path string, pos long, value string")
    process_batch(spark, lines, 0, str(tmp_path / "out"), log_year=2021)
    assert set(os.listdir(shared)) == before
    assert gold_table(spark, str(tmp_path / "out"), "run_meta").count() == 1
    with scratch_scope(spark):
        inner = scratch_path(spark, "inner")
        spark.range(3).write.parquet(inner)
    kept = scratch_path(spark, "kept")
    spark.range(3).write.parquet(kept)
    assert not os.path.exists(inner.removeprefix("file:")) and spark.read.parquet(kept).count() == 3


def test_a_cut_gzip_leaves_its_lines_and_one_reject(spark, tmp_path):
    """The run that breaks off is stored, but not in the ledger; its whole upload is no duplicate."""
    from keyroll.streaming.uploads import gold_table, start_upload_streams
    folder = tmp_path / "landing" / "upload" / "2021" / "1" / "24" / "16"
    folder.mkdir(parents=True)
    import random
    rng = random.Random(3)
    hits = [SAMPLE[3].replace(",4321,", f",{rng.randrange(10 ** 9)},") for _ in range(400)]
    text = "\n".join([SAMPLE[0], SAMPLE[1], *hits, SAMPLE[9]]) + "\n"
    whole = gzip.compress(text.encode())
    (folder / "cut.txt.gz").write_bytes(whole[:len(whole) * 2 // 3])
    (folder / "good.txt").write_text("\n".join(SAMPLE) + "\n")
    out = str(tmp_path / "out")

    def run():
        start_upload_streams(spark, str(tmp_path / "landing"), out, str(tmp_path / "ckpt"), max_files_per_trigger=10, log_year=2021)
    run()
    rejects = [(r.path.rsplit("/", 1)[1], r.reason) for r in gold_table(spark, out, "rejects").collect() if r.path]
    assert rejects == [("cut.txt.gz", "archive: EOFError")]
    cut = gold_table(spark, out, "upload_metrics").filter("upload_id = 'cut'").first()
    assert cut.fault == "archive: EOFError" and 100 < cut.records < 402 and cut.runs == 1 and cut.file_type == "gz"
    assert gold_table(spark, out, "ledger").count() == 1            # that of good.txt
    again = folder.parent / "17"
    again.mkdir()
    (again / "cut2.txt.gz").write_bytes(whole)
    run()
    metrics = {m.upload_id: (m.runs, m.duplicate_runs) for m in gold_table(spark, out, "upload_metrics").collect()}
    assert metrics == {"good": (1, 0), "cut": (1, 0), "cut2": (1, 0)}


def test_late_uploads_and_retention(spark, tmp_path):
    """Batch by batch: the watermark of the earlier batches, replays, dropped partitions."""
    import datetime as dt

    from keyroll.streaming import late as L
    from keyroll.streaming.uploads import gold_table, process_batch
    out = str(tmp_path / "out")

    def batch(n, *uploads):
        rows = [(f"s3://b/upload/{when:%Y/%-m/%-d/%-H}/{name}.txt", i, v.replace("4321", str(value)))
                for name, when, value in uploads for i, v in enumerate(SAMPLE)]
        process_batch(spark, spark.createDataFrame(rows, "path string, pos long, value string"), n, out, log_year=2021,
                      late_after=dt.timedelta(hours=1), retain=dt.timedelta(days=2))

    day = dt.datetime(2021, 1, 24, 16)
    batch(0, ("a", day, 1), ("b", day - dt.timedelta(hours=9), 2))        # the first batch has no watermark
    for _ in range(2):                                                    # and its replay
        batch(1, ("c", day - dt.timedelta(hours=1), 3), ("d", day - dt.timedelta(hours=2), 4), ("e", day + dt.timedelta(days=2), 5))
    late = [r.path.rsplit("/", 1)[1] for r in gold_table(spark, out, "rejects").filter("reason = 'late'").collect()]
    assert late == ["d.txt"]
    assert sorted(r.upload_id for r in gold_table(spark, out, "run_meta").collect()) == ["a", "b", "c", "e"]
    batch(2, ("f", day + dt.timedelta(days=4), 6))                        # drops the 24th: more than two days behind
    assert sorted(r.upload_id for r in gold_table(spark, out, "run_meta").collect()) == ["e", "f"]
    assert {str(r.upload_date) for r in gold_table(spark, out, "damage").select("upload_date").distinct().collect()} == {"2021-01-26", "2021-01-28"}
    assert L.expire(spark, f"{out}/damage", "upload_date", dt.date(2021, 1, 26)) == []
    assert gold_table(spark, out, "ledger").count() == 5                  # the ledger does not expire


def test_fanout_parity(spark):
    """Q11: two version lines inside the run -> two patch facts -> every
    player row (and document entry) twice with fanout=True, once by default."""
    from keyroll.operators import gold as G
    rows = SAMPLE[1:3] + [SAMPLE[0]] + SAMPLE[3:]
    res = ingest(_lines(spark, rows), log_year=2021)
    meta, dmg = res.kept_meta(), res.kept_damage()
    plain = R.keys_result(dmg, meta).collect()
    fan = R.keys_result(dmg, meta, fanout=True).collect()
    assert len(plain) == 2 and len(fan) == 4
    assert sorted(map(tuple, fan)) == sorted(map(tuple, plain * 2))
    doc = G.leaderboard_docs(dmg, meta, fanout=True).first()
    assert len(doc.player_damage) == 4
    assert len(G.leaderboard_docs(dmg, meta).first().player_damage) == 2


def test_file_stream_one_upload_per_batch(spark, tmp_path):
    """S8 + T1 + D2/D4 through the real file stream: one file per trigger,
    the copy of an upload is skipped by the ledger of an earlier batch."""
    from keyroll.streaming.uploads import gold_table, start_upload_streams
    folder = tmp_path / "landing" / "upload" / "2021" / "1" / "24" / "16"
    folder.mkdir(parents=True)
    other = [SAMPLE[1], SAMPLE[3].replace(",4321,", ",5,"), SAMPLE[9]]
    for name, rows in (("aaaa.txt", SAMPLE), ("bbbb.txt", SAMPLE), ("cccc.txt", other)):
        (folder / name).write_text("\n".join(rows) + "\n")
    out = str(tmp_path / "out")
    start_upload_streams(spark, str(tmp_path / "landing"), out, str(tmp_path / "ckpt"),
                         max_files_per_trigger=1, log_year=2021, sequential=True)
    metrics = gold_table(spark, out, "batch_metrics").filter("stream = 'text'").collect()
    assert len(metrics) == 3 and all(m.runs == 1 for m in metrics)
    assert sum(m.duplicate_runs for m in metrics) == 1
    meta = gold_table(spark, out, "run_meta")
    assert meta.count() == 2                                   # the copy is not written again
    assert gold_table(spark, out, "ledger").count() == 2


def test_a_broken_archive_does_not_stop_the_others(spark, tmp_path):
    import zipfile

    from keyroll.sources import logfiles as LF
    folder = tmp_path / "upload" / "2021" / "1" / "24" / "16"
    folder.mkdir(parents=True)
    text = "\n".join(SAMPLE) + "\n"
    with zipfile.ZipFile(folder / "good.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.txt", text[:300])          # a line runs over into the next member
        z.writestr("b.txt", text[300:].replace("\n", "\r\n"))
    data = bytearray((folder / "good.zip").read_bytes())
    data[60:90] = b"x" * 30
    (folder / "damaged.zip").write_bytes(data)
    (folder / "nonsense.zip").write_bytes(b"not an archive")
    lines = LF.read_uploads(spark, str(tmp_path), dense_line_no=True).filter("upload_id = 'good'").orderBy("line_no").collect()
    assert [r.value for r in lines] == SAMPLE and [r.line_no for r in lines] == list(range(1, len(SAMPLE) + 1))
    broken = {r.path.rsplit("/", 1)[1] for r in LF.broken_archives(spark, str(tmp_path)).collect()}
    assert broken == {"damaged.zip", "nonsense.zip"}


def test_positions_do_not_overflow(spark):
    from keyroll.sources.logfiles import line_position
    offsets = [0, 1 << 30, 3 << 30, 1 << 43]
    df = spark.createDataFrame([(o, (7 << 33) | 5) for o in offsets], "o long, r long")
    assert [r[0] for r in df.select(line_position(F.col("o"), F.col("r"))).collect()] == [o + 5 for o in offsets]


def test_an_oversized_upload_is_labelled_not_dropped(spark, tmp_path, monkeypatch):
    from keyroll.sources import logfiles as LF
    monkeypatch.setitem(LF.MAX_KB, "txt", 0)
    folder = tmp_path / "upload" / "2021" / "1" / "24" / "16"
    folder.mkdir(parents=True)
    (folder / "big.txt").write_text("\n".join(SAMPLE * 3) + "\n")
    assert LF.read_uploads(spark, str(tmp_path)).count() == 3 * len(SAMPLE)
    assert [r.reason for r in LF.rejected_files(spark, str(tmp_path)).collect()] == ["too_big"]


def test_refused_and_damaged_files_are_in_the_rejects(spark, tmp_path):
    """A stream over a zip that is damaged after its first member, files with
    another suffix and bad keys: each has its row in ``rejects``; the batch path too."""
    import zipfile

    from keyroll.sources import logfiles as LF
    from keyroll.streaming.uploads import gold_table, process_batch, start_upload_streams
    landing = tmp_path / "landing"
    folder = landing / "upload" / "2021" / "1" / "24" / "16"
    folder.mkdir(parents=True)
    text = "\n".join(SAMPLE) + "\n"
    with zipfile.ZipFile(folder / "cut.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.txt", text)
        z.writestr("b.txt", text)
        at = z.infolist()[1].header_offset
    data = bytearray((folder / "cut.zip").read_bytes())
    data[at + 40:at + 80] = b"x" * 40
    (folder / "cut.zip").write_bytes(data)
    (folder / "good.txt").write_text(text)
    (folder / "other.log").write_text(text)
    (landing / "upload" / "short.txt").write_text(text)
    (landing / "upload" / "short.zip").write_bytes(data)
    out = str(tmp_path / "out")
    start_upload_streams(spark, str(landing), out, str(tmp_path / "ckpt"), max_files_per_trigger=10, log_year=2021)

    def files(rows):
        return sorted((r.path.rsplit("/", 1)[1], r.reason.split(":")[0], r.upload_id, r.pos) for r in rows if r.path)
    want = [("cut.zip", "archive", "cut", len(SAMPLE)), ("other.log", "suffix", None, None),
            ("short.txt", "key", None, None), ("short.zip", "key", None, None)]
    assert files(gold_table(spark, out, "rejects").collect()) == want
    assert gold_table(spark, out, "run_meta").count() == 1         # good.txt; the first member of cut.zip is its copy
    lines = LF.read_uploads(spark, str(landing), faults=True)
    refused = LF.refused_files(LF.list_uploads(spark, str(landing)))
    assert files(ingest(lines, log_year=2021, refused=refused).rejects.collect()) == want
    kept = ingest(lines, log_year=2021, mode="failfast", refused=refused)
    assert {r.upload_id for r in kept.hashes.collect()} == {"good"}
    bad_key = spark.createDataFrame([("s3://b/upload/x.txt", i, v) for i, v in enumerate(SAMPLE)],
                                    "path string, pos long, value string")
    process_batch(spark, bad_key, 0, str(tmp_path / "direct"), log_year=2021)
    assert files(gold_table(spark, str(tmp_path / "direct"), "rejects").collect()) == [("x.txt", "key", None, None)]


def test_small_compressed_files_share_a_chunk():
    import gzip

    import pandas as pd

    from keyroll.sources import logfiles as LF
    whole = [gzip.compress(f"a{i}\nb{i}\n".encode()) for i in range(5)]
    cut = gzip.compress(b"".join(b"line %d\n" % i for i in range(3000)))[:-20]
    contents = [*whole[:2], cut, *whole[2:]]
    files = pd.DataFrame({"path": [f"u{i}.txt.gz" for i in range(6)], "content": contents})
    frames = list(LF._expand_packed([files]))
    assert len(frames) == 1
    for i, content in enumerate(contents):
        own = frames[0][frames[0]["path"] == f"u{i}.txt.gz"]
        assert list(own["pos"]) == list(range(len(own))) and set(own["size"]) == {len(content)}
        assert own["error"].notna().sum() == (i == 2) and (i == 2 or len(own) == 2)


def test_a_micro_batch_is_bounded_by_bytes(spark, tmp_path):
    from keyroll.streaming.uploads import gold_table, start_upload_streams
    folder = tmp_path / "landing" / "upload" / "2021" / "1" / "2" / "3"
    folder.mkdir(parents=True)
    for i in range(70):
        (folder / f"u{i}.txt").write_text("1/2 03:04:05.000  ZONE_CHANGE,1\n")
    out = str(tmp_path / "out")
    start_upload_streams(spark, str(tmp_path / "landing"), out, str(tmp_path / "ckpt"), max_files_per_trigger=None, log_year=2021)
    metrics = gold_table(spark, out, "upload_metrics")
    assert metrics.count() == 70 and metrics.select("batch_id").distinct().count() == 1
