"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a language's most frequent n-grams (one to three
letters, words padded with a blank) in order of frequency. A document's own list
is compared with each profile: every n-gram costs the distance between its two
ranks, or the profile length if the language does not have it; the language with
the least sum is the prediction.

Profiles are learned from at most about ``SAMPLE`` documents per language; a
profile has ``LENGTH`` n-grams, so what is broadcast grows with the number of
languages only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyroll.llm.common import sized, store

LENGTH = 400
SAMPLE = 3_000
UNKNOWN = "und"
# Letters read at a time: bounds a task's memory for texts of any length.
CHUNK = 1 << 18

# Letters, and the marks that may stand on them; what has no letter is no text.
_OTHER, _LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")
_BLANK = np.uint64(32)


def _codes(padded: str) -> np.ndarray:
    """N-gram numbers of a run of words between blanks: 21 bits a character."""
    c = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    two = (c[:-1] << np.uint64(21)) | c[1:]
    three = (two[:-1] << np.uint64(21)) | c[2:]
    return np.concatenate([c[c != _BLANK], two, three[c[1:-1] != _BLANK]])


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a whole text and their counts."""
    letters = _OTHER.sub(" ", (text or "").lower()).strip()
    if not _LETTER.search(letters):
        letters = ""
    codes, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    at = 0
    while at < len(letters):
        end = len(letters) if at + CHUNK >= len(letters) else letters.rfind(" ", at, at + CHUNK)
        end = end if end > at else at + CHUNK
        new, n = np.unique(_codes(f" {letters[at:end].strip()} "), return_counts=True)
        if len(codes):
            codes, where = np.unique(np.concatenate([codes, new]), return_inverse=True)
            counts = np.bincount(where, weights=np.concatenate([counts, n])).astype(np.int64)
        else:
            codes, counts = new, n
        at = end
    return codes, counts


def ranked(codes: np.ndarray, counts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The most frequent n-grams, most frequent first; equal counts by number."""
    return codes[np.lexsort((codes, -counts))[:length]]


def learn(labelled: DataFrame, sample: int = SAMPLE, length: int = LENGTH) -> list[tuple[str, np.ndarray]]:
    """Profiles from ``labelled`` (doc_id, text, lang); rows without a language
    are not read. Per language about ``sample`` rows count, those with the
    smallest hashes."""
    rows = labelled.filter("lang is not null").select("lang", "text", F.expr(
        "shiftrightunsigned(xxhash64(doc_id), 33)").alias("o"))
    share = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(sample)) / F.count(F.lit(1))).alias("share"))
    rows = rows.join(sized(store(share, "languages")), "lang").filter(F.col("o") < F.col("share") * (1 << 31)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, codes, counts = [], [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                c, n = ngrams(text.as_py())
                langs += [lang] * len(c)
                codes.append(c.view(np.int64))
                counts.append(n)
            if langs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(langs, pa.string()), pa.array(np.concatenate(codes)), pa.array(np.concatenate(counts))],
                    names=["lang", "code", "n"])

    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    sums = rows.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    top = sums.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= length)
    found: dict[str, list] = {}
    for r in top.collect():  # languages x length rows
        found.setdefault(r["lang"], []).append((r["r"], r["code"]))
    return [(lang, np.array([c for _, c in sorted(found[lang])], dtype=np.int64).view(np.uint64)) for lang in sorted(found)]


class Profiles:
    def __init__(self, profiles: list[tuple[str, np.ndarray]]):
        self.names = [name for name, _ in profiles]
        self.tables = []
        for _, codes in profiles:
            order = np.argsort(codes)
            self.tables.append((codes[order], order.astype(np.int64)))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: 1 less the out-of-place distance as a part of the
        greatest possible one. A tie goes to the first name."""
        own = ranked(*ngrams(text))
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        place = np.arange(len(own))
        costs = []
        for codes, ranks in self.tables:
            at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            cost = np.where(codes[at] == own, np.minimum(np.abs(ranks[at] - place), LENGTH), LENGTH)
            costs.append(int(cost.sum()))
        best = int(np.argmin(costs))
        return self.names[best], 1.0 - costs[best] / (LENGTH * len(own))


def predict(docs: DataFrame, profiles: list[tuple[str, np.ndarray]], text: str = "text",
            doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` of every row, from the whole text. A
    text that is null or has no letter is ``und`` with score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(shared.value)
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
