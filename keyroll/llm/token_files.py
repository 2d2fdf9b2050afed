"""Token-id output: length-delimited binary records with a separate offset index.

Documents are range-partitioned and sorted by ``doc_id``; every task writes one
record file and one index file straight to the shared folder, and the files
that count are those named in the stored manifest. A retried or speculative
task writes under another name, so a lost executor leaves no half-written file
in the result. Reading goes file by file, record by record.

Record file::

    b"KRTOK1" + width (1 byte: 2 or 4) + 0
    per record:  length u64 | masked crc32 of the length u32
                 payload    | masked crc32 of the payload u32
    payload:     1 byte (1: doc_id is null) | doc_id i64 | ids, ``width`` bytes each

Index file: per record the byte offset and the first token position in the
file, both i64. All numbers are little-endian.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyroll.llm.common import store
from keyroll.session import scratch_path

MAGIC = b"KRTOK1"
MASK = 0xA282EAD8
CACHE_WORDS = 1_000_000
# Capitals, accents, marks on words, white space of every kind, digits, other scripts.
PROBE = " ab,  Cd\n\tEF. don't Été (ÀÉÎ) x-y z... \"Quoted\" A1b2 ab\x0bAB\x0cab #tag e.g. 日本 ЯЮ ß İ a\u0301b "
MANIFEST = "part int, path string, index_path string, n_records bigint, n_tokens bigint, n_bytes bigint"
ROWS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
HEAD, CHECK, PAYLOAD, ENTRY = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<?q"), struct.Struct("<qq")


def masked_crc(data: bytes) -> int:
    """CRC-32 rotated and offset, so that a stored checksum of data that itself
    holds checksums stays useful."""
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK) & 0xFFFFFFFF


def framed(doc_id: int | None, ids: bytes) -> bytes:
    """One record: its length and payload, each followed by its checksum."""
    payload = PAYLOAD.pack(doc_id is None, doc_id or 0) + ids
    head = HEAD.pack(len(payload))
    return b"".join((head, CHECK.pack(masked_crc(head)), payload, CHECK.pack(masked_crc(payload))))


def entry(offset: int, tokens: int) -> bytes:
    return ENTRY.pack(offset, tokens)


class WordIds(dict):
    """Ids, as bytes of their width on disk, per white-space-delimited word.

    Right for tokenizers that drop white space and merge within a word only: a
    text's ids are then those of its words one after the other. Words are filled
    in through the tokenizer; of a plain word (Latin letters, then marks other than
    an apostrophe) its lower-cased letters and its marks are looked up apart, as the tokenizer
    splits them. Emptied when it holds ``CACHE_WORDS`` words.
    """

    PLAIN = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, tokenizer: Any, width: int):
        super().__init__()
        self.tokenizer, self.kind = tokenizer, np.dtype(f"<u{width}")
        ends = [i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")]
        self.ends = np.zeros(tokenizer.get_vocab_size() + 1, dtype=bool)
        self.ends[ends] = True

    def ids(self, text: str) -> bytes:
        words = text.encode().split()
        found = list(map(self.get, words))
        if None in found:
            self.add({w for w, f in zip(words, found, strict=True) if f is None})
            found = list(map(self.get, words))
            if None in found:  # a mark or word fell out when the table was emptied
                return b"".join(self.one(w) for w in words)
        return b"".join(found)

    def one(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def add(self, words: set[bytes]) -> None:
        if len(self) + 2 * len(words) > CACHE_WORDS:
            self.clear()
        split = {}
        for word in words:
            plain = self.PLAIN.fullmatch(word)
            if plain is None:
                self[word] = self.one(word)
            else:
                split[word] = plain[1].decode().lower().encode(), plain[2]
        stems = list({stem for stem, _ in split.values() if stem not in self})
        for at in range(0, len(stems), 1000):
            self.add_plain(stems[at:at + 1000])
        for word, (stem, marks) in split.items():
            if marks and marks not in self:
                self[marks] = self.one(marks)
            self[word] = self[stem] + (self[marks] if marks else b"")

    def add_plain(self, stems: list[bytes]) -> None:
        """Words of letters only, encoded in one text and cut at the word ends."""
        ids = np.array(self.tokenizer.encode(b" ".join(stems).decode(), add_special_tokens=False).ids, dtype=self.kind)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(stems) and cuts[-1] == len(ids):
            data, size, start = ids.tobytes(), self.kind.itemsize, 0
            for stem, end in zip(stems, (cuts * size).tolist(), strict=True):
                self[stem] = data[start:end]
                start = end
        else:
            for stem in stems:
                self[stem] = self.one(stem)


_ENCODERS: dict[str, tuple[Callable[[str], bytes], int]] = {}


def load_encoder(path: str) -> tuple[Callable[[str], bytes], int]:
    """Encoder of a tokenizer file (ids as bytes) and the bytes an id takes; one
    per worker process, so words are looked up across tasks."""
    if path not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        words = WordIds(tokenizer, 2 if tokenizer.get_vocab_size() <= 1 << 16 else 4)
        # Encoding by words has to give what encoding the whole gives.
        whole = words.one(PROBE.encode())
        _ENCODERS[path] = (words.ids if words.ids(PROBE) == whole else lambda text: words.one(text.encode()), words.kind.itemsize)
    return _ENCODERS[path]


def shared_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder of the shared storage (file, hdfs, s3, gs)."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


def write_files(docs: DataFrame, tokenizer: str, end_id: int = 1, text: str = "text",
                doc_id: str = "doc_id") -> DataFrame:
    """Encode every row of ``docs`` and write it; returns the stored manifest.

    A null text is empty: its record holds the end id only. Rows with a null
    ``doc_id`` come first; rows that share a ``doc_id`` all count and are
    ordered by a hash of their text. Other columns are not read. An empty table
    gives an empty manifest.
    """
    folder = scratch_path(docs.sparkSession, "tokens")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encode, width = load_encoder(tokenizer)
        end = end_id.to_bytes(width, "little")
        target, base = shared_fs(folder)
        name = f"{base}/part-{part:06d}-{uuid.uuid4().hex}"
        out = index = None
        records = tokens = offset = 0
        for batch in batches:
            for key, body in zip(batch.column(0), batch.column(1), strict=True):
                if out is None:
                    target.create_dir(base, recursive=True)
                    out, index = target.open_output_stream(f"{name}.rec"), target.open_output_stream(f"{name}.idx")
                    out.write(MAGIC + bytes([width, 0]))
                    offset = 8
                ids = encode(body.as_py()) + end
                record = framed(key.as_py(), ids)
                out.write(record)
                index.write(entry(offset, tokens))
                offset += len(record)
                tokens += len(ids) // width
                records += 1
        if out is not None:
            out.close()
            index.close()
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "path": [f"{folder}/{name.rsplit('/', 1)[1]}.rec"],
                "index_path": [f"{folder}/{name.rsplit('/', 1)[1]}.idx"], "n_records": [records],
                "n_tokens": [tokens], "n_bytes": [offset]})

    return store(ordered.mapInArrow(write, MANIFEST), "token-manifest")


class RecordFile:
    """Reader of one record file: in order, or one record by its byte offset."""

    def __init__(self, path: str):
        source, at = shared_fs(path)
        self.stream = source.open_input_file(at)
        head = self.stream.read(8)
        if head[:6] != MAGIC:
            raise ValueError(f"{path}: not a token record file")
        self.kind = np.dtype(f"<u{head[6]}")

    def record(self, offset: int) -> tuple[int | None, np.ndarray] | None:
        """The record at a byte offset; None at the end of the file."""
        self.stream.seek(offset)
        return self.next()

    def next(self) -> tuple[int | None, np.ndarray] | None:
        head = self.stream.read(12)
        if not head:
            return None
        (size,), (check,) = HEAD.unpack(head[:8]), CHECK.unpack(head[8:])
        if masked_crc(head[:8]) != check:
            raise ValueError("record length does not match its checksum")
        payload = self.stream.read(size)
        if masked_crc(payload) != CHECK.unpack(self.stream.read(4))[0]:
            raise ValueError("record does not match its checksum")
        null, key = PAYLOAD.unpack(payload[:PAYLOAD.size])
        return None if null else key, np.frombuffer(payload, dtype=self.kind, offset=PAYLOAD.size)


def read_index(path: str) -> list[tuple[int, int]]:
    """(byte offset, first token position) of each record of a file."""
    source, at = shared_fs(path)
    with source.open_input_file(at) as stream:
        return list(ENTRY.iter_unpack(stream.read()))


def read_files(manifest: DataFrame) -> DataFrame:
    """One row per record, read from the files: ``doc_id``, ``start`` (ids of all
    records before it, over all files in order), ``n_tokens`` and the CRC-32 of
    its ids as little-endian unsigned 32-bit integers. Checksums are verified."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = manifest.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("bigint"))
    files = files.select("part", "path", "first").repartition(max(1, manifest.count()), "part")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows, start, source = [], row["first"], RecordFile(row["path"])
                while (found := source.next()) is not None:
                    key, ids = found
                    rows.append((key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    return files.mapInArrow(read, ROWS)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)],
                                      names=["doc_id", "start", "n_tokens", "ids_crc32"])
