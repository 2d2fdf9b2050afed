import random

import numpy as np

from keyroll.llm import decontaminate as dc
from tests.llm.conftest import prose


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[-1], last[j + 1]))
    return row[-1]


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 90))] for _ in range(2))
        assert dc.common(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)) == lcs(a, b)


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def tfidf(items, idf):
    """The TF-IDF matrix of the items' passages, dense."""
    rows = [dc.vector(p, idf) for _, t in items for p in dc.passages(dc.hashed(t))]
    full = np.zeros((len(rows), dc.DIMENSIONS))
    for k, (index, value) in enumerate(rows):
        full[k, index] = value
    return full


def topics(rng, count, size):
    """Items of a few topics: each takes half of its topic's words."""
    vocabulary = [[words(rng, 1) + f"t{t}w{i}" for i in range(60)] for t in range(count)]
    return [(k, " ".join(rng.sample(vocabulary[k % count], 30))) for k in range(size)], vocabulary


def test_basis_matches_exact_svd(spark):
    """The leading directions of numpy's full decomposition, by products and small QRs."""
    rng = random.Random(3)
    items, _ = topics(rng, 6, 90)
    idf = np.ones(dc.DIMENSIONS)
    basis = dc.latent_basis(bench(spark, items).repartition(4), idf, rank=6)
    full = tfidf(items, idf)
    _, exact, right = np.linalg.svd(full, full_matrices=False)
    assert basis.shape == (dc.DIMENSIONS, 6) and np.abs(basis.T @ basis - np.eye(6)).max() < 1e-6
    got = np.linalg.svd(full @ basis, compute_uv=False)
    assert np.abs(got - exact[:6]).max() < 1e-3 * exact[0]
    assert np.linalg.svd(right[:6] @ basis, compute_uv=False).min() > 0.99
    assert dc.latent_basis(bench(spark, items[:5]), idf).shape[1] == 2  # below the number of passages


def test_latent_cosine_finds_what_tf_idf_misses(spark):
    """A rewording by the topic's other words: near in the latent space, far in TF-IDF."""
    rng = random.Random(4)
    items, vocabulary = topics(rng, 8, 160)
    idf = np.ones(dc.DIMENSIONS)
    searcher = dc.Searcher(items, idf, dc.latent_basis(bench(spark, items), idf, rank=8))
    found = missed = 0
    for key, text in items[:40]:
        own = text.split()
        kept = set(rng.sample(own, 8))
        others = [w for w in vocabulary[key % 8] if w not in own]
        reworded = " ".join(w if w in kept else others.pop() for w in own)
        w = dc.hashed(reworded)
        window, passage = np.zeros(dc.DIMENSIONS), np.zeros(dc.DIMENSIONS)
        np.add.at(window, dc.buckets(w), 1.0)
        np.add.at(passage, dc.buckets(dc.hashed(text)), 1.0)
        plain = window @ passage / np.linalg.norm(window) / np.linalg.norm(passage)
        held = searcher.owner[searcher.covered(searcher.row[dc.buckets(w)])]
        missed += plain < dc.COSINE and key not in held
        cosine = {item: c for item, _, c in searcher.candidates(w)}
        found += cosine.get(key, 0) >= dc.COSINE and cosine[key] > plain + 0.1
    assert missed == 40 and found == 40


def test_leaks_and_clean_documents(spark, docs):
    rng = random.Random(7)
    items = [(i, words(rng, rng.randint(12, 70)) + ".") for i in range(30)]
    rows, leaked = [], {}
    for i in range(120):
        body = words(rng, rng.choice((0, 5, 40, 300, 2000))).split()
        if i % 3 == 0:
            k = rng.randrange(30)
            own = items[k][1].split()
            if i % 2:  # paraphrase: some words changed, punctuation and case too
                own = [w if rng.random() > 0.12 else words(rng, 1) for w in own]
                own = [w.upper() if rng.random() < 0.2 else w for w in own]
            at = rng.randint(0, len(body))
            body[at:at] = own
            leaked[i] = items[k][0]
        rows.append((i, " ".join(body)))
    got = {}
    for r in dc.find(docs(rows), bench(spark, items)).collect():
        if r["matches"]:
            got[r["row"]["doc_id"]] = {m["item_id"] for m in r["matches"]}
    assert {i: {k} for i, k in leaked.items()} == got
    kept = dc.clean(docs(rows), bench(spark, items))
    assert kept.columns == docs(rows).columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(120)) - set(leaked)


def test_answer_check(spark):
    rng = random.Random(11)
    question, answer = words(rng, 24), words(rng, 8)
    items = bench(spark, [(1, f"{question}. {answer}.")])
    head = question.split()
    half = " ".join(w if i % 3 else words(rng, 1) for i, w in enumerate(head))
    rows = [(1, f"{half} {answer}"), (2, f"{half} {words(rng, 8)}")]
    searcher = dc.Searcher([(1, f"{question}. {answer}.")], np.ones(dc.DIMENSIONS), dc.latent_basis(items, np.ones(dc.DIMENSIONS)))
    assert len(searcher.matches(rows[0][1])) == 1 and len(searcher.matches(rows[1][1])) == 0


def test_windows_match_brute_force(spark, monkeypatch):
    """Every window at or above the cosine is a candidate, over chunk borders too."""
    rng = random.Random(5)
    items = [(i, words(rng, 40)) for i in range(6)]
    idf = np.ones(dc.DIMENSIONS)
    searcher = dc.Searcher(items, idf, dc.latent_basis(bench(spark, items), idf))
    text = " ".join([words(rng, 200), items[2][1], words(rng, 90), items[4][1], words(rng, 33)])
    w = dc.hashed(text)
    latent, exact = set(), set()
    passages = tfidf(items, idf)
    for at in range(0, len(w) - dc.WINDOW + dc.BLOCK, dc.BLOCK):
        part = dc.buckets(w[at:at + dc.WINDOW])
        for p, owner in zip(searcher.rows.T, searcher.owner, strict=True):
            if searcher.vectors[searcher.row[part]].sum(0) @ p / np.sqrt(len(part)) >= dc.COSINE + 1e-6:
                latent.add((int(owner), at))
        for p, owner in zip(passages, searcher.owner, strict=True):
            if p[np.unique(part)].sum() / p.sum() >= dc.COVER:  # all weights are equal here
                exact.add((int(owner), at))
    want = latent | exact
    assert latent and exact
    for chunk in (1 << 15, 64):
        monkeypatch.setattr(dc, "CHUNK", chunk)
        assert {(k, at) for k, at, _ in searcher.candidates(w)} >= want and want


def test_edges(spark, docs):
    rows = [(1, None), (2, ""), (None, "a b c"), (3, "! ?"), (4, "a b c"), (4, "a b c")]
    for items in ([], [(1, None), (2, ""), (3, "!!")], [(1, "a b c"), (None, "a b c")]):
        got = dc.find(docs(rows), bench(spark, items)).collect()
        assert len(got) == 6
        hits = [len(r["matches"]) for r in got if r["row"]["text"] == "a b c"]
        assert hits == [2, 2, 2] if len(items) == 2 else not any(hits)
    assert dc.find(docs([]), bench(spark, [(1, "a b c")])).count() == 0


def test_copies_of_a_large_benchmark(spark, docs):
    """Verbatim copies are found whatever the number of items: 1,200 items of
    independent words, far more passages than one basis has directions."""
    rng = random.Random(13)
    items = [(i, words(rng, rng.randint(15, 59)) + ".") for i in range(1200)]
    rows, leaked = [], {}
    for i in range(300):
        body = words(rng, 400).split()
        if i % 3:
            own = rng.choice(items)
            at = rng.randint(0, len(body))
            body[at:at] = own[1].split()
            leaked[i] = {own[0]}
        rows.append((i, " ".join(body)))
    got = {r["row"]["doc_id"]: {m["item_id"] for m in r["matches"]}
           for r in dc.find(docs(rows), bench(spark, items)).collect() if r["matches"]}
    assert got == leaked


def test_long_item_of_many_passages(spark):
    """An item of many passages gives one match."""
    rng = random.Random(17)
    items = [(i, words(rng, n)) for i, n in enumerate((30, 400, 40, 45))]
    idf = np.ones(dc.DIMENSIONS)
    searcher = dc.Searcher(items, idf, dc.latent_basis(bench(spark, items), idf))
    assert len(searcher.owner) > 15
    for key, text in items:
        found = searcher.matches(f"{words(rng, 300)} {text} {words(rng, 300)}")
        assert [(m["item_id"], m["lcs"]) for m in found] == [(key, len(text.split()))]


def test_items_in_several_parts(spark, docs, monkeypatch):
    """A benchmark beyond the broadcast's size is searched part by part."""
    rng = random.Random(21)
    items = [(i, words(rng, 20)) for i in range(50)]
    rows = [(i, f"{words(rng, 100)} {items[i][1]} {words(rng, 50)} {items[i + 1][1]}") for i in range(30)]
    monkeypatch.setattr(dc, "ITEMS", 15)
    for r in dc.find(docs(rows), bench(spark, items)).collect():
        assert {m["item_id"] for m in r["matches"]} == {r["row"]["doc_id"], r["row"]["doc_id"] + 1}


def test_short_items_in_long_texts(spark):
    """Copies of items of 4 to 16 words are found among words that are rarer than theirs."""
    rng = random.Random(19)
    items = [(i, words(rng, rng.randint(4, 16))) for i in range(80)]
    idf = np.full(dc.DIMENSIONS, 3.0)
    idf[np.concatenate([dc.buckets(dc.hashed(t)) for _, t in items])] = 1.5
    searcher = dc.Searcher(items, idf, dc.latent_basis(bench(spark, items), idf))
    for key, text in items:
        body = words(rng, 300).split()
        at = rng.randint(0, len(body))
        body[at:at] = text.split()
        assert key in {m["item_id"] for m in searcher.matches(" ".join(body))}
