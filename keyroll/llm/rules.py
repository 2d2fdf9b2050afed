"""Quality rules: a threshold table compiled into one projection.

Every measure is a built-in expression over the text of a single row, so the
rules run inside the scan stage: no shuffle, no user function, and a document
of any length or a source of any size stays in its own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyroll.llm.common import SPACE, WORD, words

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that for on with as was by at it this from or are an be a "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "de la le et les des en un du une que est pour qui dans par sur pas au avec "
    "el los las se del y con para su al lo como o es"
).split()

STOP_FORMS = sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)})
# A word between single spaces that the next one repeats; a word with a letter.
PAIR = r"\x20([^\x20\x09-\x0D]++)(?=\x20\1\x20)"
LETTERED = r"[^\x20\x09-\x0D]*?\p{L}[^\x20\x09-\x0D]*"

# (measure, lowest allowed, highest allowed); None leaves a side open.
# A document is kept when the base rules hold and every measure is in range.
THRESHOLDS = (
    ("mean_word_length", 1.5, 25.0),
    ("symbol_ratio", None, 0.25),
    ("stop_word_ratio", 0.01, None),
    ("dup_line_ratio", None, 0.6),
    ("pair_repeat_ratio", None, 0.3),
    ("alpha_word_ratio", 0.5, None),
)


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b)).otherwise(F.lit(0.0))


def _covered(hashes: Column) -> Column:
    """Words lying in a window whose hash occurs at least twice: sort the
    (hash, position) pairs, keep positions with an equal neighbour, and add up
    the non-overlapping part of each kept window in order of position."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    after = F.slice(pairs, F.lit(2), F.size(hashes))
    # Equal neighbours: both positions of the pair are repeated windows.
    hits = F.flatten(F.filter(
        F.zip_with(pairs, after, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))),
        lambda x: x.isNotNull()))
    ordered = F.sort_array(F.array_distinct(hits))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(
        ordered, start,
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"].cast("bigint"))


def apply_rules(docs: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """Measures and verdict of every row: ``row`` (a struct of the input columns,
    so no name can clash), the counts, the ratios, ``base_failed``, ``kept``.

    Words, lines and window hashes are built by inner projections from the
    row's own text. A null text is an empty one: no words, so the base rules
    fail. Repeated rows are judged one by one; an empty table gives no rows.
    """
    parts = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("t"),
                        words(F.col(text)).alias("w"))
    n = F.size("w")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(
        *[F.get("w", i + k) for k in range(WINDOW)])))
    parts = parts.select(
        "row", "t", "w", n.cast("bigint").alias("n_words"),
        F.coalesce(windows, F.array().cast("array<bigint>")).alias("h"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    repeated = F.size(F.array_distinct("h")) < F.size("h")
    counts = parts.select(
        "row", "n_words",
        F.length(F.regexp_replace("t", SPACE, "")).cast("bigint").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(repeated, _covered(F.col("h"))).otherwise(F.lit(0).cast("bigint")).alias("n_repeat_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.size(F.filter("w", lambda w: w.isin(STOP_FORMS))).alias("n_stop"),
        F.regexp_count("t", F.lit(PAIR)).alias("n_pairs"), F.regexp_count("t", F.lit(LETTERED)).alias("n_alpha"))
    ratios = counts.select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        _ratio("word_chars", "n_words").alias("mean_word_length"), _ratio("n_symbols", "n_words").alias("symbol_ratio"),
        _ratio("n_stop", "n_words").alias("stop_word_ratio"), _ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        _ratio("n_pairs", "n_words").alias("pair_repeat_ratio"), _ratio("n_alpha", "n_words").alias("alpha_word_ratio"))
    n = F.col("n_words")
    failed = (n < 20) | (100 * F.col("n_repeat_words") > 30 * n)
    return ratios.withColumn("base_failed", failed).withColumn("kept", ~failed & in_range(thresholds))


def in_range(thresholds=THRESHOLDS) -> Column:
    """The threshold table as one boolean expression."""
    out = F.lit(True)
    for name, low, high in thresholds:
        if low is not None:
            out = out & (F.col(name) >= F.lit(float(low)))
        if high is not None:
            out = out & (F.col(name) <= F.lit(float(high)))
    return out


def keep_passing(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    # A filter on a plain expression would be pushed below the projections and
    # build the words anew for every window; one that is not deterministic is not.
    passed = F.col("kept") & (F.spark_partition_id() >= 0)
    return apply_rules(docs, text).withColumn("passed", passed).filter("passed").select("row.*")
