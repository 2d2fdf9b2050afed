"""Library calls that no registered query exercises: ledger delete (D6),
retention (F5), the late-data bound (T5), latest-wins documents and
point / range reads (S10-S12), JSON bodies (X12)."""

import datetime as dt

from pyspark.sql import functions as F

from keyroll.functions import scoring as S
from keyroll.operators import dedup as D
from keyroll.operators import facts as FA
from keyroll.sources import sinks as SK


def test_ledger_delete(spark):
    ledger = spark.createDataFrame([("a",), ("b",), ("c",)], "run_hash string")
    gone = spark.createDataFrame([("b",), ("x",)], "run_hash string")
    assert sorted(r.run_hash for r in D.delete_from_ledger(ledger, gone).collect()) == ["a", "c"]


def test_retention(spark):
    now = dt.datetime(2024, 6, 1)
    df = spark.createDataFrame([(1, dt.datetime(2023, 5, 1)), (2, dt.datetime(2024, 1, 1))], "id int, ingest_time timestamp")
    assert [r.id for r in FA.retain(df, now).collect()] == [2]


def test_late_bound_is_a_watermark(spark):
    from keyroll.streaming.uploads import late_bound
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1))], "id int, ingest_time timestamp")
    plan = late_bound(df)._jdf.queryExecution().logical().toString()
    assert "EventTimeWatermark" in plan


def test_latest_documents_and_reads(spark):
    docs = spark.createDataFrame([
        ("P", "10#1", dt.datetime(2024, 1, 1), 0, "old"),
        ("P", "10#1", dt.datetime(2024, 1, 2), 1, "new"),
        ("P", "11#1", dt.datetime(2024, 1, 1), 0, "x"),
        ("P", "09#1", dt.datetime(2024, 1, 1), 0, "y"),
        ("Q", "99#1", dt.datetime(2024, 1, 1), 0, "z"),
    ], "pk string, sk string, created_at timestamp, batch_id long, v string")
    latest = SK.latest_documents(docs)
    assert latest.count() == 4
    assert SK.point_read(docs, "P", "10#1").first().v == "new"
    assert SK.point_read(docs, "P", "nope").count() == 0
    down = [r.sk for r in SK.range_read(latest, "P", bound="11#1", limit=11).collect()]
    assert down == ["10#1", "09#1"]
    up = [r.sk for r in SK.range_read(latest, "P", bound="09#1", forward=True, limit=1).collect()]
    assert up == ["10#1"]


def test_json_body(spark):
    df = spark.createDataFrame([(1, "a")], "keylevel int, dungeon_name string")
    assert df.select(S.to_json_body("keylevel", "dungeon_name")).first()[0] == '{"keylevel":1,"dungeon_name":"a"}'


def test_class_filter(spark):
    from keyroll.operators.extras import filter_by_player_class
    docs = spark.createDataFrame([("h1", [("p", "mage", "fire")]), ("h2", [("q", "rogue", "sub")])],
                                 "combatlog_hash string, player_damage array<struct<player_id:string,class:string,specc:string>>")
    assert [r.combatlog_hash for r in filter_by_player_class(docs, "mage", "fire").collect()] == ["h1"]
    assert filter_by_player_class(docs, "mage", "frost").count() == 0


def test_upload_gates(spark, tmp_path):
    """S5 + S6 + S7: suffix, key shape and the strict size limit."""
    from keyroll.sources import logfiles as LF
    good = tmp_path / "upload" / "2020" / "10" / "7" / "23"
    good.mkdir(parents=True)
    (good / "e894fa50.txt").write_text("x\n")
    (good / "e894fa50.log").write_text("x\n")
    short = tmp_path / "upload" / "2020"
    (short / "nokey.txt").write_text("x\n")
    rej = {r.path.rsplit("/", 1)[-1]: r.reason for r in LF.rejected_files(spark, str(tmp_path)).collect()}
    assert rej == {"e894fa50.log": "suffix", "nokey.txt": "key"}
    ok = LF.list_uploads(spark, str(tmp_path)).filter("accepted").collect()
    assert [(r.upload_id, str(r.upload_date), r.upload_hour, r.file_type) for r in ok] == \
        [("e894fa50", "2020-10-07", 23, "txt")]
    sizes = spark.createDataFrame([("txt", 450 * 1024 * 1024 + 1023), ("txt", 450 * 1024 * 1024 + 1024),
                                   ("gz", 40 * 1024 * 1024 + 1023), ("zip", 40 * 1024 * 1024 + 1024)],
                                  "t string, b long")
    assert [r[0] for r in sizes.select(LF.size_ok(F.col("t"), F.col("b"))).collect()] == [True, False, True, False]
