"""Cross-tokenizer alignment against whole-text encoding and plain loops."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from keyroll.llm import token_align as ta
from keyroll.llm.queries import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
TEXTS = ["Hello, world! It's fine.", "a", " ", "   ", "", None, "tail ", "x\n y\n\n  z\t", "日本語 text <0x0A> \x00", "▁lossy here",
         "café café́  nb sp", "</s> <unk> <|endoftext|>", "\nstarts", "a  b   c", "🎉🎉 party", " line  sep",
         "\x1c\x1d ctl \x85 x", "don't you'll WE'RE 123 4567,89", "f();\r\n  {\r}\r  end \r", "Hello, world! It's fine.", "　wide　space"]


def offsets(pieces):
    out, at = [], 0
    for x in pieces:
        out.append((at, at + len(x)))
        at += len(x)
    return out


def brute(rows):
    tokens = ta.Tokenizers(A, B)
    docs = []
    for key, text in rows:
        if not text:
            docs.append((key, [], [], [], []))
            continue
        a = tokens.a.encode(" " + text, add_special_tokens=False).ids
        b = tokens.b.encode(text)
        bytes_a, bytes_b = [tokens.bytes_a[i] for i in a], [tokens.bytes_b[i] for i in b]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            docs.append((key, [], [], [], []))
            continue
        at_a, at_b = offsets(bytes_a), offsets(bytes_b)
        cuts = sorted({e for _, e in at_a} & {e for _, e in at_b})
        groups, begin = [], 0
        for end in cuts:
            groups.append(",".join(str(i) for i, (s, _) in zip(a, at_a) if begin <= s < end) + "|"
                          + ",".join(str(i) for i, (s, _) in zip(b, at_b) if begin <= s < end))
            begin = end
        links = [(i, j) for i, (s, e) in zip(a, at_a) for j, (u, v) in zip(b, at_b) if s < v and u < e]
        docs.append((key, a, b, groups, links))
    count = Counter(x for *_, links in docs for x in links)
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    return sorted(((key, len(a), len(b), len(g), len(ls), sum(count[x] == best[x[1]] for x in ls), sum(count[x] for x in ls),
                    hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for key, a, b, g, ls in docs), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    marks = ["", "", "", ",", ";\r", "\r\n", ".", "!?", "\n", " ", " ", "\t", "'s", "é", "日本", "​", "▁"]
    word = lambda: "".join(rng.choice("abcdeilnorstuABC019_-") for _ in range(rng.randint(1, 9))) + (
        rng.choice(marks) if rng.random() < 0.5 else "")
    rows = [(i, " ".join(word() for _ in range(rng.randint(1, 60)))) for i in range(n)]
    return rows + [(1000 + i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (7, "same id"), (7, "same id")]


@pytest.mark.parametrize("head", [ta.HEAD, 40, 0])
def test_equals_brute_force(spark, head):
    """With all pairs broadcast, the most frequent only, and none."""
    rows = corpus(4, 60)
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, row int, n_a int").repartition(3)
    got = sorted((tuple(r) for r in ta.with_counts(ta.align(frame, A, B), head).collect()), key=str)
    assert got == brute(rows)


def test_small_table_and_units(spark, monkeypatch):
    """The table of pieces is emptied and long texts come in parts: same result."""
    monkeypatch.setattr(ta, "KEPT_PIECES", 30)
    monkeypatch.setattr(ta, "UNIT", 25)
    monkeypatch.setattr(ta, "LONG", 200)
    monkeypatch.setattr(ta, "CHUNK", 3)
    rows = corpus(9, 40) + [(5000, "word and more, " * 400)]
    texts = [t for _, t in rows]
    table = ta.Aligned(ta.Tokenizers(A, B))
    pattern = table.tokenizers.pieces
    parts = list(ta._units(texts, pattern))
    assert sum(len(p) for u in parts for r, p in u if r == len(rows) - 1) == len(pattern.findall(" " + texts[-1]))
    assert max(len(p) for u in parts for _, p in u) <= 100
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    got = sorted((tuple(r) for r in ta.with_counts(ta.align(spark.createDataFrame(
        rows, "doc_id long, text string").coalesce(1), A, B)).collect()), key=str)
    assert got == brute(rows)


def test_whole_texts_equal_cut_texts():
    tokens = ta.Tokenizers(A, B)
    for _, text in corpus(11, 80):
        if text:
            pieces = tokens.pieces.findall(" " + text)
            one_by_one = [tokens.encode_one(p) for p in pieces]
            assert [i for a, _ in one_by_one for i in a] == tokens.a.encode(" " + text, add_special_tokens=False).ids
            good, n_a, n_b, ids_a, ids_b = tokens.encode(pieces)
            kept = [one_by_one[i] for i in good.tolist()]
            assert ids_a.tolist() == [i for a, _ in kept for i in a] and n_b.tolist() == [len(b) for _, b in kept]
            assert ids_b.tolist() == [i for _, b in kept for i in b]
            lossy = b"".join(map(tokens.bytes_b.__getitem__, tokens.b.encode(text))) != (" " + text).encode()
            if not lossy:
                assert len(good) == len(pieces) and [i for _, b in one_by_one for i in b] == tokens.b.encode(text)


def test_frequent_limit(spark):
    counts = spark.createDataFrame([(i, n) for i, n in enumerate([1, 1, 2, 3, 4, 9, 9, 70])], "pair long, n long")
    for most in range(10):
        limit = ta.frequent(counts, most)
        reach = counts.filter(F.col("n") >= limit).count()
        assert reach <= most and (limit == 1 or counts.filter(F.col("n") >= limit // 2).count() > most)


def test_empty_table(spark):
    assert ta.with_counts(ta.align(spark.createDataFrame([], "doc_id long, text string"), A, B)).count() == 0
