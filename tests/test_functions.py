"""Expression-level tests: the reference's unit cases re-stated on Spark
columns (comma split, quote trim, integer bounds, mm:ss, percent, timed)."""

import pytest
from pyspark.sql import functions as F

from keyroll.functions import scoring as S
from keyroll.functions import tokens as T


def one(spark, col, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


@pytest.mark.parametrize("text,expected", [
    ("hello,world", ["hello", "world"]),
    ('"hello, world",yo', ['"hello, world"', "yo"]),
    ('a,,b', ["a", "", "b"]),
    ('a,"x\\",y",z', ['a', '"x\\",y"', 'z']),
    ('a,"open, never closed', ['a', '"open, never closed']),
    ('"n-R",0x1,"Enemy, the Big",1', ['"n-R"', "0x1", '"Enemy, the Big"', "1"]),
])
def test_split_tokens(spark, text, expected):
    assert one(spark, T.split_tokens(F.col("v")), text) == expected


@pytest.mark.parametrize("text,expected", [('"quoted"', "quoted"), ('"', ""), ('""', ""), ("none", "none"),
                                           ('""x""', '"x"')])
def test_trim_one_quote(spark, text, expected):
    assert one(spark, T.trim_one_quote(F.col("v")), text) == expected


@pytest.mark.parametrize("text,expected", [("2147483647", 2147483647), ("-2147483647", -2147483647),
                                           ("2147483648", None), ("12a", None), (" 1", None), ("1.0", None)])
def test_parse_int32(spark, text, expected):
    assert one(spark, T.parse_int32(F.col("v")), text) == expected


@pytest.mark.parametrize("text,expected", [("9223372036854775807", 9223372036854775807),
                                           ("-9223372036854775807", -9223372036854775807),
                                           ("9223372036854775808", None)])
def test_parse_int64(spark, text, expected):
    assert one(spark, T.parse_int64(F.col("v")), text) == expected


def test_split_header(spark):
    h, b = T.split_header(F.col("v"))
    row = spark.createDataFrame([("1/24 16:47:38.068  A,B  C",)], "v string").select(h.alias("h"), b.alias("b")).first()
    assert (row.h, row.b) == ("1/24 16:47:38.068", "A,B  C")
    _, bp = T.split_header(F.col("v"), parity=True)
    assert one(spark, bp, "1/24 16:47:38.068  A,B  C") == "A,B"
    assert one(spark, b, "no separator") is None


def test_log_time(spark):
    ms = one(spark, T.log_time_millis(F.col("v"), 2021), "1/24 16:47:38.068")
    assert ms == 1611506858068


def test_min_sec_to_millis(spark):
    assert one(spark, S.min_sec_to_millis(F.col("v")), "43:00") == 2580000
    assert one(spark, S.min_sec_to_millis(F.col("v")), "60:00") is None
    assert one(spark, S.min_sec_to_millis(F.col("v")), "4:00") is None


def test_percent_and_timed(spark):
    df = spark.createDataFrame([(180.0, 180.0)], "a double, b double")
    assert df.select(S.duration_as_percent(F.col("a"), F.col("b"))).first()[0] == 100.0
    rows = spark.createDataFrame([(10,), (30,), (70,), (100,)], "d long").select(
        S.timed(F.col("d"), F.lit(80), F.lit(60), F.lit(20)).alias("t")).collect()
    assert [r.t for r in rows] == [3, 2, 1, 0]


def test_recorded_document_values(spark):
    """The recorded keys result: Sanguine Depths, level 18, 2414145 ms."""
    df = spark.createDataFrame([(2284, 2414145, 18, "14c40b3c-fa46-48a4-b5e4-1b148dfa1e1a", 10, 123, 3, 121)],
                               "d long, dur long, lvl long, h string, a2 long, a4 long, a7 long, a10 long")
    pct, intime = S.timed_as_percent(F.col("d"), F.col("dur"))
    r = df.select(S.sort_key(F.col("lvl"), pct, F.col("h")).alias("sk"), intime.alias("intime"),
                  S.duration_mmss(F.col("dur")).alias("mmss"),
                  S.affix_names(F.col("a2"), F.col("a4"), F.col("a7"), F.col("a10")).alias("aff")).first()
    assert r.sk == "18#101.899430#14c40b3c-fa46-48a4-b5e4-1b148dfa1e1a"
    assert r.intime == 1
    assert r.mmss == "40:14"
    assert r.aff == "Fortified, Spiteful, Volcanic, Prideful"


def test_affix_stops_at_zero(spark):
    df = spark.createDataFrame([(9, 0, 3, 121), (10, 7, 0, 121), (99, 6, 12, 0)], "a long, b long, c long, d long")
    got = [r[0] for r in df.select(S.affix_names(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert got == ["Tyrannical", "Fortified, Bolstering", ", Raging, Grievous"]


def test_unknown_dungeon_and_zero_duration(spark):
    df = spark.createDataFrame([(1, 100), (2291, 0)], "d long, dur long")
    pct, intime = S.timed_as_percent(F.col("d"), F.col("dur"))
    rows = df.select(pct.alias("p"), intime.alias("i")).collect()
    assert (rows[0].p, rows[0].i) == (0.0, 0)
    assert (rows[1].p, rows[1].i) == (1000.0, 0)


def test_sort_key_text_order_quirk(spark):
    """Q12: text order puts 98.5 above 102.3 within a level."""
    df = spark.createDataFrame([("10#98.500000#a",), ("10#102.300000#b",)], "sk string")
    assert [r.sk for r in df.orderBy(F.col("sk").desc()).collect()][0] == "10#98.500000#a"


def _split_model(s):
    """P2 semantics as a plain scan: a comma outside quotes
    splits; a quote opens when outside, and closes when inside unless the
    previous character is a backslash."""
    res, beg, inside = [], 0, False
    for i, ch in enumerate(s):
        if ch == "," and not inside:
            res.append(s[beg:i])
            beg = i + 1
        elif ch == '"':
            if not inside:
                inside = True
            elif i > 0 and s[i - 1] != "\\":
                inside = False
    res.append(s[beg:])
    return res


def test_split_tokens_random(spark):
    import random
    rnd = random.Random(11)
    texts = ["".join(rnd.choice('a,"  ,') for _ in range(rnd.randint(0, 30))) for _ in range(600)]
    # escaped quotes inside a quoted field do not close it
    texts += ['x,"a\\",b",y', '"\\",",z', 'p,"q\\"\\",r",s']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    got = {r.i: r.p for r in df.select("i", T.split_tokens(F.col("v")).alias("p")).collect()}
    bad = [(t, got[i], _split_model(t)) for i, t in enumerate(texts) if got[i] != _split_model(t)]
    assert not bad, bad[:5]
