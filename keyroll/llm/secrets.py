"""Secret scans: fixed patterns plus sliding-window character entropy.

All of it is built-in expressions over one row's text. Spark has no function
that returns match positions, so they are rebuilt from lengths: the pieces
between the matches (``split``) and the matches (``regexp_extract_all``)
alternate, and their running sum gives every start and end in code points.

Entropy candidates are long runs of token characters outside the fixed spans; of a
run that a fixed span cuts, the pieces beside it.
A window of ``WINDOW`` characters slides over each candidate; the counts per
character of the candidate's class and ``S = sum(c * log2 c)`` are updated for
the character that enters and the one that leaves, and the window's entropy is
``log2(WINDOW) - S / WINDOW``. S is kept in whole 1e-9 bits, so it is exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in listed order, their patterns and shortest lengths.
# Of hex and access runs the shortest length is part of the pattern: a maximal
# run is matched whole either way. An assignment's value is checked afterwards.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW
# Character classes, tried in this order: pattern of the whole candidate, its
# alphabet (case kept) and the entropy in bits a window must reach.
CLASSES = (
    (r"^[0-9A-Fa-f]+$", "0123456789abcdefABCDEF", 2.85),
    (r"^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 3.45),
    (r"^.*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.65),
)
# A word: lower case, capitalised, capitals, or several put together, each with a capital
# and two small letters at least. Letters in any other order of cases are no word.
WORD = "([a-z]+([A-Z]{1,5}[a-z]{2,})*|[A-Z][a-z]*([A-Z]{1,5}[a-z]{2,})*|[A-Z]+)"
# Candidates that are never secrets: words and joined words, numbers, UUIDs,
# dates and times, and paths of words.
ALLOWED = (
    rf"^[+/_=-]*{WORD}([+/_=-]+{WORD})*[+/_=-]*$",
    r"^[0-9+/_=-]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9]{4}-?[0-9]{2}-?[0-9]{2}[T_-]?[0-9]{0,6}Z?$",
    rf"^/?({WORD}[0-9]{{0,4}}[/_=-]+)+({WORD}[0-9]{{0,4}})?$",
)
SCALE = 10 ** 9
BLOCK = 128


def _s_term(c: int) -> int:
    return round(c * math.log2(c) * SCALE) if c else 0


def _s_limit(bits: float) -> int:
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * SCALE)


def _running(lengths: Column) -> Column:
    """Running sums of an array, in blocks so that appending stays cheap."""
    empty = F.array().cast("array<bigint>")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")),
                         lambda b: F.slice(lengths, b * BLOCK + 1, BLOCK))

    def one(acc: Column, x: Column) -> Column:
        end = acc["at"] + x
        return F.struct(end.alias("at"), F.concat(acc["ends"], F.array(end)).alias("ends"))

    def block(acc: Column, xs: Column) -> Column:
        inner = F.aggregate(xs, F.struct(acc["at"].alias("at"), empty.alias("ends")), one)
        return F.struct(inner["at"].alias("at"), F.concat(acc["ends"], F.array(inner["ends"])).alias("ends"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<array<bigint>>").alias("ends"))
    return F.flatten(F.aggregate(blocks, start, block)["ends"])


def _matches(text: Column, pattern: str, kind: str, value_group: int | None = None) -> Column:
    """Array of (start, kind, end, word) of the leftmost non-overlapping matches."""
    p = F.lit(pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    values = F.regexp_extract_all(text, p, F.lit(value_group)) if value_group else found
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    lengths = F.zip_with(gaps, found, lambda g, m: (F.length(g) + F.length(m)).cast("bigint"))
    spans = F.zip_with(
        F.zip_with(found, values, lambda m, v: F.struct(m.alias("m"), v.alias("v"))), _running(lengths),
        lambda x, end: F.struct((end - F.length(x["m"])).alias("start"), F.lit(KINDS.index(kind)).alias("kind"),
                                end.alias("end"), x["m"].alias("word"), x["v"].alias("value")))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,word:string,value:string>>")
    return F.when(text.rlike(pattern), spans).otherwise(none)


def _least_s(word: Column, alphabet: str) -> Column:
    """Least S over the windows of a candidate, by incremental counts."""
    at = F.transform(F.split(word, ""), lambda c: F.instr(F.lit(alphabet), c))
    leaving = F.concat(F.array_repeat(F.lit(0), WINDOW), F.slice(at, F.lit(1), F.size(at) - WINDOW))
    steps = F.zip_with(at, leaving, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    terms = F.array(*[F.lit(_s_term(c)).cast("bigint") for c in range(WINDOW + 2)])

    def term(c: Column) -> Column:
        return F.get(terms, c)

    def step(acc: Column, x: Column) -> Column:
        # The entering character first, then the leaving one (0: none yet).
        c_in = F.get(acc["c"], x["a"] - 1)
        c_out = F.get(acc["c"], x["b"] - 1) + F.when(x["a"] == x["b"], 1).otherwise(0)
        s = (acc["s"] + term(c_in + 1) - term(c_in)
             + F.when(x["b"] > 0, term(c_out - 1) - term(c_out)).otherwise(F.lit(0).cast("bigint")))
        counts = F.transform(acc["c"], lambda c, i: c + F.when(i + 1 == x["a"], 1).otherwise(0)
                             - F.when(i + 1 == x["b"], 1).otherwise(0))
        n = acc["n"] + 1
        return F.struct(counts.alias("c"), s.alias("s"), n.alias("n"),
                        F.when(n >= WINDOW, F.least(acc["low"], s)).otherwise(acc["low"]).alias("low"))

    start = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("c"), F.lit(0).cast("bigint").alias("s"),
                     F.lit(0).alias("n"), F.lit(2 ** 62).cast("bigint").alias("low"))
    return F.aggregate(steps, start, step)["low"]


def _secret_like(word: Column) -> Column:
    """The candidate's class has a window of enough entropy and no allow-list
    pattern matches (tested first: it is the cheaper test)."""
    verdict = F.lit(False)
    for pattern, alphabet, bits in reversed(CLASSES):
        verdict = F.when(word.rlike(pattern), _least_s(word, alphabet) <= F.lit(_s_limit(bits))).otherwise(verdict)
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | word.rlike(pattern)
    return F.when(allowed, F.lit(False)).otherwise(verdict)


def _beside(run: Column, base: Column) -> Column:
    """The pieces of a run outside the fixed spans that are long enough: where a span
    covers the run's word, blanks take its place."""
    def blank(word: Column, b: Column) -> Column:
        begin = F.greatest(b["start"] - run["start"], F.lit(0).cast("bigint")).cast("int")
        end = (F.least(b["end"], run["end"]) - run["start"]).cast("int")
        return F.concat(F.substring(word, F.lit(1), begin), F.repeat(F.lit(" "), end - begin),
                        F.substring(word, end + 1, F.length(word)))

    inside = F.filter(base, lambda b: (b["start"] < run["end"]) & (b["end"] > run["start"]))
    left = F.aggregate(inside, run["word"], blank)
    pieces = F.transform(_matches(left, CANDIDATE, "entropy"), lambda p: F.struct(
        (p["start"] + run["start"]).alias("start"), p["kind"].alias("kind"), (p["end"] + run["start"]).alias("end"),
        p["word"].alias("word"), p["value"].alias("value")))
    return F.when(F.size(inside) == 0, F.array(run)).otherwise(pieces)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (a struct of the input columns) with ``base`` and ``found``:
    arrays of (start, kind, end, word) in code points, end exclusive, ordered by
    start, then kind as listed in ``KINDS``.

    ``base`` are the pattern spans; ``found`` adds the entropy candidates outside
    them. A null text is empty and has no spans; repeated rows
    are scanned one by one; an empty table gives no rows.
    """
    t = F.col("t")
    parts = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    parts = parts.select(
        "row",
        F.filter(_matches(t, ASSIGN, "assign", 2), lambda s: F.length(s["value"]) >= ASSIGN_VALUE).alias("assign"),
        _matches(t, ACCESS, "access").alias("access"), _matches(t, HEX, "hex").alias("hex"),
        _matches(t, CANDIDATE, "entropy").alias("runs"))
    parts = parts.select("row", "runs", F.array_sort(F.concat("assign", "access", "hex")).alias("base"))
    fresh = F.filter(F.flatten(F.transform("runs", lambda r: _beside(r, F.col("base")))), lambda r: _secret_like(r["word"]))
    found = F.when((F.size("runs") > 0), F.array_sort(F.concat("base", fresh))).otherwise(F.col("base"))
    return parts.select("row", "base", found.alias("found"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts per base kind, the SHA-256 of the base spans and all spans as text."""
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")

    return scanned.select("row", count("assign").alias("n_assign"), count("access").alias("n_access"),
                          count("hex").alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
                          _joined(F.col("found")).alias("spans"))
