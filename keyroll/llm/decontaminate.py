"""Benchmark decontamination by latent semantic retrieval.

1. Inverse document frequencies of hashed words, counted over all documents.
2. A randomised singular value decomposition of the TF-IDF matrix A of the benchmark's
   passages: tasks multiply A'A with a random matrix, then ``POWERS`` times with the
   orthonormal basis of the result; the driver holds one matrix of buckets x rank and
   takes its QR. The rank is below the number of passages, so words that occur
   together in the benchmark share directions.
3. Every whole text is cut into overlapping windows; a window's latent vector is
   the sum of its words' vectors, and a window with a cosine of ``COSINE`` or more
   to a passage is a candidate. A window's norm is that of its full TF-IDF vector, so
   words outside the benchmark lower the cosine; a passage's is its latent one.
   Vectors are only added up where the words' greatest possible shares can
   reach the cosine.
4. Beside it, for passages that the projection loses or that are outweighed by the
   other words of a window, the exact product: from an inverted index of the passages'
   words a window that holds ``COVER`` of a passage is a candidate too.
5. Around a candidate the longest common subsequence of words with the item is
   taken. A share of ``COPY`` of the item's words is a leak; from ``PARAPHRASE``
   on it is one if the item's answer (its last sentence) is there as well.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyroll.llm.common import store

DIMENSIONS = 1 << 16
# Most directions of the basis, further ones while it is sought, and rounds of power iteration.
RANK, OVERSAMPLE, POWERS = 64, 16, 2
SEED = 20
# Window and step in words, and the words of a text that are handled at a time.
BLOCK = 8
WINDOW = 4 * BLOCK
CHUNK = 1 << 15
# Rows of the latent matrix that are handled at a time.
ROWS = 1024
# Words of a benchmark passage.
PASSAGE = 48
# Items that are searched for at a time: their index is broadcast (under 100 MB).
ITEMS = 16_384
COSINE = 0.42
# Share of a passage's length that a window's product with it has to reach, for
# passages that are outweighed by the other words of a window.
COVER = 0.5
COPY, PARAPHRASE, ANSWER = 0.7, 0.5, 0.8

_MARKS = string.punctuation.encode()
_NO_WORD = np.uint64(xxhash.xxh3_64_intdigest(b""))
MATCH = "array<struct<item_id:{0},cosine:double,lcs:bigint,item_words:bigint,answer:double,start:bigint>>"


def hashed(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text in order, without their case and outer
    punctuation; words of punctuation only are left out."""
    words = (text or "").lower().encode().split()
    stripped = map(bytes.strip, words, repeat(_MARKS))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, stripped), dtype=np.uint64, count=len(words))
    return h[h != _NO_WORD]


def buckets(words: np.ndarray) -> np.ndarray:
    """Dimensions of hashed words."""
    return (words % np.uint64(DIMENSIONS)).astype(np.int64)


def document_frequency(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Inverse document frequency per bucket over all documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMENSIONS + 1, np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                b = np.unique(buckets(hashed(t.as_py())))
                df[b] += 1
                n += 1
        df[DIMENSIONS] = n
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(df[used])], names=["b", "df"])

    sums = docs.select(F.col(text).alias("text")).mapInArrow(count, "b long, df long").groupBy("b").agg(F.sum("df").alias("df"))
    df = np.zeros(DIMENSIONS + 1)
    for r in sums.collect():  # at most DIMENSIONS + 1 rows
        df[r["b"]] = r["df"]
    return np.log((df[DIMENSIONS] + 1) / (df[:DIMENSIONS] + 1)) + 0.05


def passages(words: np.ndarray) -> list[np.ndarray]:
    """An item's passages: the whole of it, or overlapping halves of PASSAGE words."""
    if len(words) <= PASSAGE:
        return [words] if len(words) else []
    step = PASSAGE // 2
    return [words[i:i + PASSAGE] for i in range(0, max(1, len(words) - step), step)]


def vector(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF vector of a passage (of hashed words), of length one."""
    index, tf = np.unique(buckets(words), return_counts=True)
    value = tf * idf[index]
    return index, value / np.linalg.norm(value)


def passage_vectors(items: DataFrame, idf: np.ndarray, text: str = "text") -> DataFrame:
    """The rows of the TF-IDF matrix: (index, value) of every passage."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [vector(p, idf) for t in batch.column(0) for p in passages(hashed(t.as_py()))]
            yield pa.RecordBatch.from_pydict({"index": pa.array([i for i, _ in rows], pa.list_(pa.int64())),
                                              "value": pa.array([v for _, v in rows], pa.list_(pa.float64()))})

    return store(items.select(F.col(text).alias("text")).mapInArrow(run, "index array<bigint>, value array<double>"), "passages")


def multiply(rows: DataFrame, used: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'A times ``basis``, both over the ``used`` dimensions. A task adds up its passages; the
    sums of all tasks are added by Spark, a row per dimension that a passage uses."""
    shared = rows.sparkSession.sparkContext.broadcast((used, basis))
    width = basis.shape[1]
    names = [f"c{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dimensions, q = shared.value
        out = np.zeros(q.shape)
        for batch in batches:
            for index, value in zip(batch.column(0), batch.column(1), strict=True):
                i, v = np.searchsorted(dimensions, index.values.to_numpy()), value.values.to_numpy()
                out[i] += np.outer(v, v @ q[i])
        held = np.flatnonzero(out.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(held), *[pa.array(out[held, k]) for k in range(width)]], names=["b", *names])

    product = rows.mapInArrow(run, "b bigint, " + ", ".join(f"{n} double" for n in names))
    found = product.groupBy("b").agg(*[F.sum(n).alias(n) for n in names]).toArrow()  # a row per used dimension
    shared.destroy()
    out = np.zeros(basis.shape)
    at = found["b"].to_numpy()
    for k, n in enumerate(names):
        out[at, k] = found[n].to_numpy()
    return out


def latent_basis(items: DataFrame, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Leading right singular vectors of the passages' TF-IDF matrix (dimensions x rank);
    at most half as many as there are passages. All steps but the result are held over
    the dimensions that passages use."""
    rows = passage_vectors(items, idf)
    count = rows.count()
    rank = min(rank, max(1, count // 2))
    basis = np.zeros((DIMENSIONS, rank), dtype=np.float32)
    if not count:
        return basis
    used = np.sort(rows.select(F.explode("index").alias("b")).distinct().toArrow()["b"].to_numpy())  # DIMENSIONS at most
    q = np.random.default_rng(SEED).standard_normal((len(used), min(count, len(used), rank + OVERSAMPLE)))
    for _ in range(1 + POWERS):
        q, _ = np.linalg.qr(multiply(rows, used, q))
    values, inner = np.linalg.eigh(q.T @ multiply(rows, used, q))
    found = q @ inner[:, np.argsort(values)[::-1][:rank]]
    basis[used, :found.shape[1]] = found
    return basis


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for y in b.tolist():
        u = v & where.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def answer_words(text: str, idf: np.ndarray) -> np.ndarray:
    """Words of the answer: of the last sentence, or of the last third of an item
    of one sentence, those at least as rare as the middle one."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s]
    words = hashed(sentences[-1]) if len(sentences) > 1 else hashed(text)[-max(1, len(hashed(text)) // 3):]
    words = np.unique(words)
    rarity = idf[buckets(words)]
    return words[rarity >= np.median(rarity)] if len(words) else words


class Searcher:
    """Finds a list of (key, text) items in texts, given the basis of their passages."""

    def __init__(self, items: list[tuple], idf: np.ndarray, basis: np.ndarray):
        self.items = [(key, hashed(t), answer_words(t, idf)) for key, t in items]
        self.lists = [words.tolist() for _, words, _ in self.items]
        owned = [(k, p) for k, (_, words, _) in enumerate(self.items) for p in passages(words)]
        self.owner = np.array([k for k, _ in owned], dtype=np.int64)
        rows = [vector(p, idf) for _, p in owned]
        used = np.unique(np.concatenate([i for i, _ in rows])) if rows else np.zeros(0, dtype=np.int64)
        # Row of a bucket; buckets that no passage uses have the last, empty one.
        self.row = np.full(DIMENSIONS, len(used), dtype=np.int64)
        self.row[used] = np.arange(len(used))
        self.vectors = np.vstack([basis[used] * idf[used][:, None], np.zeros((1, basis.shape[1]))]).astype(np.float32)
        latent = np.array([v @ basis[i] for i, v in rows], dtype=np.float32).reshape(len(rows), basis.shape[1])
        self.rows = (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-6)).T
        self.energy = (idf ** 2).astype(np.float32)
        # The inverted index: per bucket the passages that hold it, how often, and the share
        # of the passage that one such word brings; the shares of all its words sum up to 1.
        held = np.concatenate([self.row[i] for i, _ in rows]) if rows else used
        times = [np.unique(buckets(p), return_counts=True)[1] for _, p in owned]
        share = [v * idf[i] / np.linalg.norm(t * idf[i]) for (i, v), t in zip(rows, times, strict=True)]
        which = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows]).astype(np.int64)
        order = np.argsort(held, kind="stable")
        self.first = np.searchsorted(held[order], np.arange(len(used) + 2))
        none = np.zeros(0)
        self.holder, self.share = which[order], np.concatenate([none, *share])[order]
        self.times = np.concatenate([none, *times])[order]
        # Per used bucket the most it can add to the product with any passage, and
        # to the share of one.
        self.most, self.cover = (np.zeros(len(used) + 1, dtype=np.float32) for _ in range(2))
        np.maximum.at(self.cover, held[order], self.share.astype(np.float32))
        for at in range(0, len(used) if len(rows) else 0, ROWS):
            end = min(at + ROWS, len(used))
            self.most[at:end] = (self.vectors[at:end] @ self.rows).max(axis=1).clip(0)

    def candidates(self, words: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(item, first word, cosine) of every window of hashed words that is near an item."""
        if not len(self.owner) or not len(words):
            return
        for at in range(0, max(1, len(words) - WINDOW + BLOCK), CHUNK):
            part = buckets(words[at:at + CHUNK + WINDOW - BLOCK])
            n = -(-len(part) // BLOCK)
            pad = n * BLOCK - len(part)

            def blocks(x: np.ndarray) -> np.ndarray:
                x = np.concatenate([x, np.zeros((pad, *x.shape[1:]), x.dtype)]) if pad else x
                return x.reshape(n, BLOCK, *x.shape[1:]).sum(axis=1)

            def windows(x: np.ndarray) -> np.ndarray:
                k = WINDOW // BLOCK
                if len(x) <= k:
                    return x.sum(axis=0, keepdims=True)
                return sum(x[i:len(x) - k + 1 + i] for i in range(k))

            norm = np.sqrt(windows(blocks(self.energy[part])))
            row = self.row[part]
            found: dict[tuple[int, int], float] = {}
            open_ = np.flatnonzero(windows(blocks(self.most[row])) >= COSINE * norm - 1e-3)
            if len(open_):
                need = np.unique((open_[:, None] + np.arange(WINDOW // BLOCK)).ravel())
                need = need[need < n]
                sums = np.zeros((n, self.vectors.shape[1]), dtype=np.float32)
                index = (need[:, None] * BLOCK + np.arange(BLOCK)).ravel()
                inside = index < len(part)
                rows = np.zeros((len(index), self.vectors.shape[1]), dtype=np.float32)
                rows[inside] = self.vectors[row[index[inside]]]
                sums[need] = rows.reshape(len(need), BLOCK, -1).sum(axis=1)
                cosine = windows(sums)[open_] @ self.rows / norm[open_, None]
                for i, j in zip(*np.nonzero(cosine >= COSINE), strict=True):
                    place = int(open_[i]), int(self.owner[j])
                    found[place] = max(found.get(place, 0.0), float(cosine[i, j]))
            for i in np.flatnonzero(windows(blocks(self.cover[row])) >= COVER - 1e-3).tolist():
                for j in self.covered(row[i * BLOCK:i * BLOCK + WINDOW]).tolist():
                    found.setdefault((i, int(self.owner[j])), 0.0)
            for (i, item), cosine in sorted(found.items()):
                yield item, at + i * BLOCK, cosine

    def covered(self, row: np.ndarray) -> np.ndarray:
        """Passages of which a window (rows of its words) holds the share ``COVER``, from the
        inverted index; words count as often as the passage has them at most."""
        own, times = np.unique(row, return_counts=True)
        n = self.first[own + 1] - self.first[own]
        place = np.repeat(self.first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
        seen = np.minimum(np.repeat(times, n), self.times[place])
        held = np.bincount(self.holder[place], weights=self.share[place] * seen, minlength=len(self.owner))
        return np.flatnonzero(held >= COVER - 1e-6)

    def matches(self, text: str | None) -> list[dict]:
        words = hashed(text)
        spans: dict[int, list[list]] = {}
        for item, start, cosine in self.candidates(words):
            reach = len(self.items[item][1])
            low, high = max(0, start - reach), min(len(words), start + WINDOW + reach)
            found = spans.setdefault(item, [])
            if found and low <= found[-1][1] and high - found[-1][0] <= 8 * (reach + WINDOW):
                found[-1][1], found[-1][2] = high, max(found[-1][2], cosine)
            else:
                found.append([low, high, cosine])
        out = []
        for item, found in spans.items():
            key, own, answer = self.items[item]
            best = None
            for low, high, cosine in found:
                near = words[low:high]
                there = set(near.tolist())
                # No longer than the item's words that occur at all.
                if sum(w in there for w in self.lists[item]) < PARAPHRASE * len(own):
                    continue
                shared = common(own, near)
                if shared < PARAPHRASE * len(own):
                    continue
                told = float(np.isin(answer, near).mean()) if len(answer) else 1.0
                if shared >= COPY * len(own) or told >= ANSWER:
                    row = {"item_id": key, "cosine": cosine, "lcs": shared, "item_words": len(own), "answer": told, "start": low}
                    if best is None or shared > best["lcs"]:
                        best = row
            if best:
                out.append(best)
        return out


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """``row`` (a struct of the input columns) and ``matches`` (items that the
    text leaks, one entry per item, empty if none) for every row of ``docs``.

    Null and empty texts and items match nothing. Items without any text are
    skipped; equal items each match. Repeated rows are searched one by one. With
    an empty benchmark all rows have no matches. Whole texts are searched.
    """
    items = benchmark.filter("text is not null").select(F.col(item_id).alias("item_id"), "text")
    kind = items.schema["item_id"].dataType.simpleString()
    idf = document_frequency(docs, text)
    blocks = max(1, -(-items.count() // ITEMS))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    out = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"),
                      F.array().cast(MATCH.format(kind)).alias("matches"))
    schema = f"row {out.schema['row'].dataType.simpleString()}, text string, matches {MATCH.format(kind)}"
    for k in range(blocks):
        mine = items.filter(block == k)
        part = [(r["item_id"], r["text"]) for r in mine.collect()]  # about ITEMS rows
        shared = docs.sparkSession.sparkContext.broadcast((part, idf, latent_basis(mine, idf)))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(*shared.value)
            for batch in batches:
                old = batch.column(2).to_pylist()
                new = [o + searcher.matches(t.as_py()) for o, t in zip(old, batch.column(1), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(new, batch.schema.field(2).type)], names=batch.schema.names)

        out = out.mapInArrow(search, schema)
    return out.select("row", "matches")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``docs`` that leak no item, with the columns of ``docs``."""
    return find(docs, benchmark, text).filter(F.size("matches") == 0).select("row.*")
