import random
import zlib

import numpy as np
import pytest

from keyroll.llm import queries, token_files
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(queries.tokenizer_path())


def expected(tokenizer, rows):
    """(doc_id, start, n, crc) in order of doc_id; null first."""
    out, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def read(frame):
    manifest = token_files.write_files(frame, queries.tokenizer_path())
    return manifest, sorted(map(tuple, token_files.read_files(manifest).collect()), key=lambda r: r[1])


def test_word_cache_equals_the_tokenizer(tokenizer, monkeypatch):
    rng = random.Random(4)
    parts = ["a", "B'll", "don't", "é", "é", "İ", "Σας", "ß", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", " ", " ", "\n", "\r", "\t", "12",
             "<|endoftext|>", "!!", "漢字", "😀", "́", "​", "</w>", "ﬁ", "'s", "×", "÷", "ÿ", "Ñandú,", "Word", "word...", "WORD!?", "<|ENDOFTEXT|>", "\x00", "x" * 300]
    raw, width = token_files.load_encoder(queries.tokenizer_path())
    assert width == 2

    def encode(text):
        return np.frombuffer(raw(text), dtype="<u2").tolist()

    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    monkeypatch.setattr(token_files, "CACHE_WORDS", 5)
    text = prose(rng, 300)
    assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_round_trip(docs, tokenizer):
    rng = random.Random(2)
    rows = [(i * 7 - 50, prose(rng, rng.randint(0, 60))) for i in range(300)] + [(10_000, None), (10_001, ""), (10_002, "w x " * 40_000)]
    rng.shuffle(rows)
    manifest, got = read(docs(rows).repartition(5))
    assert got == expected(tokenizer, rows)
    # The index leads to every record by itself, in any order.
    ids = {}
    for f in manifest.collect():
        source, index = token_files.RecordFile(f["path"]), token_files.read_index(f["index_path"])
        assert len(index) == f["n_records"]
        for offset, first in rng.sample(index, len(index)):
            key, tokens = source.record(offset)
            ids[key] = tokens.tolist()
    assert all(ids[k] == tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for k, t in rows)


def test_null_and_repeated_ids_and_empty_table(docs, tokenizer):
    rows = [(3, "b"), (None, "c"), (3, "b"), (1, None), (1, None)]
    assert read(docs(rows))[1] == expected(tokenizer, rows)
    both = read(docs([(3, "b"), (3, "a c d"), (2, "x")]))[1]
    assert [r[0] for r in both] == [2, 3, 3] and [r[1] for r in both[1:]] == [both[0][2], both[0][2] + both[1][2]]
    assert read(docs([]))[1] == []


def test_damaged_files_are_noticed(docs, tmp_path):
    manifest, _ = read(docs([(1, "some words here")]))
    path = manifest.collect()[0]["path"]
    source, at = token_files.shared_fs(path)
    data = bytearray(source.open_input_file(at).read())
    for where in (10, 30):
        bad = data.copy()
        bad[where] ^= 1
        (tmp_path / "x.rec").write_bytes(bad)
        with pytest.raises(ValueError, match="checksum"):
            token_files.RecordFile(str(tmp_path / "x.rec")).next()
