"""Cross-tokenizer alignment: group the tokens two tokenizers make of one text.

Both tokenizers tile the UTF-8 bytes of a space and the text. All tokens of A
and B are sorted by start (``lexsort``); where a start reaches the running
maximum of the ends before it (``maximum.accumulate``), a group begins, and the
tokens that overlap are expanded within the groups. Three steps:

1. ``align`` takes every text once and stores its numbers, the hash of its groups
   and its linked pairs of ids (``a << 32 | b``) with how often each occurs.
2. ``pair_counts`` sums the pairs of all documents, tasks before the shuffle.
3. ``with_counts`` looks the counts up. The most frequent pairs, ``HEAD`` at most, are
   broadcast: a bound whatever the corpus. The limit is a power of two of the
   count, found from a histogram of at most 64 rows. Links of the other, rare
   pairs are joined with their counts by a shuffle; no such pair can be hot.

Where neither tokenizer can make a token over the border of a word and the
white space behind it (tested on A's splitting pattern and B's vocabulary), a
text is cut there, and what is known of a piece is kept for the next time it occurs. Such a border always
ends a group. A text whose bytes a piece fails to give is taken whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain, islice
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyroll.llm.common import store

HEAD = 1 << 20
KEPT_CHARS, KEPT_PIECES = 12_000_000, 600_000
UNIT, LONG = 100_000, 2_000_000
# Pieces encoded as one text, and what is put before them.
CHUNK, AHEAD = 200, " a"
# Unicode White_Space: what a byte-level pattern's \s means.
WHITE = "\t-\r \x85\xa0  -     　"
WHITES = set(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
CROSSES = re.compile(f"[^{WHITE}]([{WHITE}])")
MARK = "▁"
B_BITS = 32


def _pieces(merged: set[str]) -> re.Pattern:
    """White space and the word behind it, with what follows a white space that a
    token may hold after a word's end."""
    more = f"(?:[{re.escape(''.join(sorted(merged)))}][{WHITE}]*[^{WHITE}]*)*" if merged else ""
    return re.compile(f"[{WHITE}]*[^{WHITE}]+{more}|[{WHITE}]+")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable
    Latin-1 stands for itself, the other bytes follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers, the bytes of every id, and whether texts may be cut."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            known = all(c in alphabet for c in token)
            self.bytes_a[i] = bytes(alphabet[c] for c in token) if known else token.encode()
        names = [self.b.id_to_piece(i) for i in range(len(self.b))]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode()
                        for i, p in enumerate(names)]
        self.size_a, self.size_b = (np.array([len(x) for x in y], dtype=np.int64) for y in (self.bytes_a, self.bytes_b))
        self.space = self.b.piece_to_id(MARK)
        # A's pattern splits where white space begins; B may merge a few kinds of it with the word before.
        splits = self.a.normalizer is None and re.search(r"ByteLevel\(.*use_regex=True", repr(self.a.pre_tokenizer))
        merged = {c for x in self.bytes_b for c in CROSSES.findall(x.decode(errors="ignore"))}
        self.pieces = _pieces(merged) if splits and " " not in merged else None

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which pieces keep their bytes in both tokenizers, and of these the numbers of A
        and B tokens and the ids one after the other. Pieces are encoded ``CHUNK`` at a
        time as one text, which is cut at their ends by the bytes of the tokens;
        where that fails, and for those that end in white space, one by one."""
        good, n_a, n_b, ids_a, ids_b = [], [], [], [], []
        joint = [i for i, p in enumerate(pieces) if self.pieces and MARK not in p and p[-1] not in WHITES]
        alone = set(range(len(pieces))) - set(joint)
        for at in range(0, len(joint), CHUNK):
            chunk = joint[at:at + CHUNK]
            bodies = [pieces[i].encode() for i in chunk]
            text = AHEAD + "".join([pieces[i] for i in chunk])
            a = np.array(self.a.encode(text, add_special_tokens=False).ids, dtype=np.int64)
            b = np.array(self.b.encode(text[1:], num_threads=1), dtype=np.int64)
            whole = text.encode()
            if b"".join([self.bytes_a[i] for i in a.tolist()]) != whole or b"".join([self.bytes_b[i] for i in b.tolist()]) != whole:
                alone.update(chunk)
                continue
            ends = np.cumsum([len(AHEAD), *map(len, bodies)])
            for ids, size, n, out in ((a, self.size_a, n_a, ids_a), (b, self.size_b, n_b, ids_b)):
                cuts = np.searchsorted(np.cumsum(size[ids]), ends, side="right")
                n.append(np.diff(cuts))
                out.append(ids[cuts[0]:])
            good.append(np.array(chunk, dtype=np.int64))
        for i in sorted(alone):
            a, b = self.encode_one(pieces[i])
            if a and pieces[i].encode() == b"".join([self.bytes_a[t] for t in a]) == b"".join([self.bytes_b[t] for t in b]):
                for x, out in ((i, good), (len(a), n_a), (len(b), n_b)):
                    out.append(np.array([x], dtype=np.int64))
                ids_a.append(np.array(a, dtype=np.int64))
                ids_b.append(np.array(b, dtype=np.int64))
        none = np.zeros(0, dtype=np.int64)
        return tuple(np.concatenate([none, *x]) for x in (good, n_a, n_b, ids_a, ids_b))

    def encode_one(self, piece: str) -> tuple[list[int], list[int]]:
        """Ids of one piece. B puts a space before what it is given: a piece's own is left away."""
        a = self.a.encode(piece, add_special_tokens=False).ids
        if piece == " ":
            return a, [self.space]
        b = self.b.encode(piece[1:] if piece[0] == " " else piece, num_threads=1)
        return a, b if piece[0] == " " else b[1:] if b[:1] == [self.space] else []


def overlaps(len_a: np.ndarray, len_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From the byte lengths of two tilings of the same bytes: the group of every A
    and B token, and the index of the A and the B token of every link, by A token."""
    end_a, end_b = np.cumsum(len_a), np.cumsum(len_b)
    start_a, start_b = end_a - len_a, end_b - len_b
    starts, ends = np.concatenate((start_a, start_b)), np.concatenate((end_a, end_b))
    order = np.lexsort((ends, starts))
    reached = np.maximum.accumulate(ends[order])
    begins = np.ones(len(order), dtype=np.int64)
    begins[1:] = starts[order][1:] >= reached[:-1]
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(begins) - 1
    first = np.searchsorted(end_b, start_a, side="right")
    n = np.searchsorted(start_b, end_a, side="left") - first
    link_a = np.repeat(np.arange(len(len_a)), n)
    link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    return group[:len(len_a)], group[len(len_a):], link_a, link_b


class Aligned:
    """What is known of pieces: numbers of tokens, groups and links, the groups as
    text and the linked pairs of ids (``a << 32 | b``). Emptied when it is full."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        # Every id as text with what may stand behind it: A's , or |, then B's , or ; or nothing.
        self.texts = [f"{i}{end}" for count, ends in ((len(tokenizers.bytes_a), ",|"), (len(tokenizers.bytes_b), (",", ";", "")))
                      for end in ends for i in range(count)]
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str] = []
        self.numbers = np.zeros((0, 4), dtype=np.int64)  # tokens of A and B, groups, links; none: bytes differ
        self.first = np.zeros(1, dtype=np.int64)  # of a piece's pairs
        self.pairs = np.zeros(0, dtype=np.int64)

    @property
    def full(self) -> bool:
        return len(self.groups) > KEPT_PIECES or self.chars > KEPT_CHARS

    def of(self, pieces: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Group texts, numbers and pairs of pieces (those of failing ones are empty)."""
        tokens = self.tokenizers
        good, n_a, n_b, ids_a, ids_b = tokens.encode(pieces)
        texts, numbers = [""] * len(pieces), np.zeros((len(pieces), 4), dtype=np.int64)
        if not len(good):
            return texts, numbers, np.zeros(0, dtype=np.int64)
        group_a, group_b, link_a, link_b = overlaps(tokens.size_a[ids_a], tokens.size_b[ids_b])
        # A piece's tokens, groups and links are runs of those of all.
        end_a, end_b = np.cumsum(n_a), np.cumsum(n_b)
        last = group_a[end_a - 1] + 1
        n_links = np.bincount(np.repeat(np.arange(len(good)), n_a)[link_a], minlength=len(good))
        numbers[good] = np.column_stack((n_a, n_b, np.diff(last, prepend=0), n_links))
        # Behind an A token: | if it is its group's last; behind a B token: ; or, at a piece's end, nothing.
        bar = np.append(group_a[1:] != group_a[:-1], True)
        end = np.append(group_b[1:] != group_b[:-1], True).astype(np.int64)
        end[end_b - 1] = 2
        count_a, count_b = len(tokens.bytes_a), len(tokens.bytes_b)
        pick = np.concatenate((ids_a + bar * count_a, ids_b + end * count_b + 2 * count_a))
        order = np.argsort(np.concatenate((2 * group_a, 2 * group_b + 1)), kind="stable")
        words = [self.texts[i] for i in pick[order].tolist()]
        begin = 0
        for i, stop in zip(good.tolist(), (end_a + end_b).tolist(), strict=True):
            texts[i] = "".join(words[begin:stop])
            begin = stop
        return self._sorted(good, texts, numbers, n_links, ids_a[link_a] << B_BITS | ids_b[link_b])

    @staticmethod
    def _sorted(good: np.ndarray, texts: list[str], numbers: np.ndarray, n_links: np.ndarray,
                pairs: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Pairs in the order of the pieces (those taken one by one were put behind)."""
        if (np.diff(good) > 0).all():
            return texts, numbers, pairs
        order = np.argsort(np.repeat(good, n_links), kind="stable")
        return texts, numbers, pairs[order]

    def learn(self, pieces: list[str]) -> None:
        texts, numbers, pairs = self.of(pieces)
        self.index.update(zip(pieces, range(len(self.groups), len(self.groups) + len(pieces)), strict=True))
        self.chars += sum(map(len, pieces))
        self.groups += texts
        self.numbers = np.concatenate((self.numbers, numbers))
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(numbers[:, 3])))
        self.pairs = np.concatenate((self.pairs, pairs))


_ALIGNED: dict[tuple[str, str], Aligned] = {}


def _aligned(path_a: str, path_b: str) -> Aligned:
    """One table per worker process: pieces are looked up across tasks."""
    if (path_a, path_b) not in _ALIGNED:
        _ALIGNED[path_a, path_b] = Aligned(Tokenizers(path_a, path_b))
    return _ALIGNED[path_a, path_b]


def _units(texts: list[str | None], pieces: re.Pattern | None) -> Iterator[list[tuple[int, list[str]]]]:
    """(row, pieces) of a batch's texts, ``UNIT`` pieces or some more at a time; a text
    of more than ``LONG`` characters comes in several parts."""
    unit, held = [], 0
    for row, text in enumerate(texts):
        if not text:
            continue
        text = " " + text
        if pieces is None:
            parts = iter([[text]])
        elif len(text) <= LONG:
            parts = iter([pieces.findall(text)])
        else:
            found = (m.group() for m in pieces.finditer(text))
            parts = iter(lambda: list(islice(found, UNIT)), [])
        for part in parts:
            unit.append((row, part))
            held += len(part)
            if held >= UNIT:
                yield unit
                unit, held = [], 0
    if unit:
        yield unit


class _Rows:
    """Sums and group hashes of a batch's documents, and the linked pairs of all."""

    def __init__(self, table: Aligned, texts: list[str | None]):
        self.table, self.texts = table, texts
        self.failed: set[int] = set()

    def parts(self) -> Iterator[tuple[int, np.ndarray]]:
        """(row, numbers of its pieces in the table), part by part."""
        for unit in _units(self.texts, self.table.tokenizers.pieces):
            index = self.table.index
            flat = list(chain.from_iterable(part for _, part in unit))
            at = list(map(index.get, flat))
            if None in at:
                self.table.learn(list({p for p, i in zip(flat, at, strict=True) if i is None}))
                at = list(map(index.__getitem__, flat))
            places, begin = np.array(at, dtype=np.int64), 0
            lossy = self.table.numbers[places, 0] == 0
            for row, part in unit:
                stop = begin + len(part)
                if lossy[begin:stop].any():
                    self.failed.add(row)
                yield row, places[begin:stop]
                begin = stop


def _summed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


ROWS = ("row bigint, doc_id {key}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
        "pairs array<bigint>, times array<bigint>")


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Stored rows of ``docs``: row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and
    the linked ``pairs`` with their ``times`` (a pair may come in several entries).

    Null, empty and lossy texts have no tokens: zeros, empty lists and an empty
    ``groups_sha256``. Rows of equal id or text are all returned; a null id stays;
    other columns are not read; an empty table gives no rows.
    """
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _aligned(path_a, path_b)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            if table.full:
                table.clear()
            totals = np.zeros((len(texts), 4), dtype=np.int64)
            hashes: list[Any] = [None] * len(texts)
            pairs: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in texts]
            rows = _Rows(table, texts)
            for row, at in rows.parts():
                numbers = table.numbers[at]
                totals[row] += numbers.sum(axis=0)
                if hashes[row] is None:
                    hashes[row] = hashlib.sha256()
                else:
                    hashes[row].update(b";")
                hashes[row].update(";".join([table.groups[i] for i in at.tolist()]).encode())
                n = numbers[:, 3]
                place = np.arange(n.sum()) + np.repeat(table.first[at] - np.cumsum(n) + n, n)
                pairs[row].append(_summed(table.pairs[place]))
            for row in rows.failed:  # taken as a whole
                groups, numbers, found = table.of([" " + texts[row]])
                totals[row] = numbers[0]
                hashes[row] = hashlib.sha256(groups[0].encode()) if numbers[0, 0] else None
                pairs[row] = [_summed(found)]
            sizes = np.cumsum([0] + [sum(len(k) for k, _ in p) for p in pairs])
            lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(
                [np.zeros(0, dtype=np.int64), *(x[i] for p in pairs for x in p)]))) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(totals[:, i]) for i in range(4)],
                 pa.array([h.hexdigest() if h else "" for h in hashes], pa.string()), *lists],
                names=[f.split()[0] for f in ROWS.split(", ")])

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return store(source.mapInArrow(measure, ROWS.format(key=source.schema["doc_id"].dataType.simpleString())), "aligned")


def links(rows: DataFrame) -> DataFrame:
    """(row, pair, times) of aligned rows."""
    found = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l"))
    return found.select("row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): links of all documents per pair of ids; ``best`` if no pair of the
    same B id has more. There are at most as many B ids as entries in B's vocabulary."""
    counts = store(links(rows).groupBy("pair").agg(F.sum("times").alias("n")), "pair-counts")
    b = F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1))
    highest = counts.groupBy(b.alias("b")).agg(F.max("n").alias("highest"))
    marked = counts.withColumn("b", b).join(F.broadcast(highest), "b")
    return store(marked.select("pair", "n", (F.col("n") == F.col("highest")).alias("best")), "pair-best")


def frequent(counts: DataFrame, most: int = HEAD) -> int:
    """The least power of two that at most ``most`` counts reach."""
    sizes = {r["bits"]: r["n"] for r in counts.groupBy(F.length(F.bin("n")).alias("bits")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total, limit = 0, 1 << 63
    for bits in range(63, 0, -1):
        total += sizes.get(bits, 0)
        if total > most:
            break
        limit = 1 << (bits - 1)
    return limit


def with_counts(rows: DataFrame, head: int = HEAD) -> DataFrame:
    """Aligned rows (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256):
    ``n_best`` links have a pair that is the most frequent of its B id, and
    ``count_sum`` adds up the counts of all links' pairs."""
    counts = pair_counts(rows)
    limit = frequent(counts, head)
    reached = F.lit(False) if limit > 1 << 62 else F.col("n") >= limit
    top = F.broadcast(counts.filter(reached))  # ``head`` rows at most
    known = links(rows).join(top, "pair")
    if limit > 1:  # else every pair is among the frequent ones
        rest = links(rows).join(F.broadcast(counts.filter(reached).select("pair")), "pair", "left_anti")
        known = known.unionByName(rest.join(counts.filter(~reached), "pair"))
    sums = known.groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("count_sum"),
                                    F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))
    out = rows.drop("pairs", "times").join(sums, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
                      F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
