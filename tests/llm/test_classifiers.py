"""Quality classifier and language identification: held-out accuracy, edges."""

import random

import numpy as np
from pyspark.sql import functions as F

from keyroll.llm import langid, quality
from tests.llm.conftest import prose

EDGES = [(1, None), (2, ""), (3, " \n "), (4, "12 34 !!"), (5, "word"), (6, "Word " * 60_000), (6, "Word " * 60_000)]


def test_features_are_frequencies():
    index, value = quality.features("The cat the cat")
    # One and two words in a row, of two views; each view's values add up to the gain.
    assert len(index) == 4 + 3 + 4 + 3 and abs(value.sum() - 4 * quality.GAIN) < 1e-9
    assert quality.shape("Hello,") == "Aa," and quality.shape("ABC!!") == "A!" and quality.shape("12:30") == "9:9"
    assert len(quality.features(None)[0]) == 0


def test_ftrl_learns_and_shrinks():
    model = quality.Ftrl()
    one, two = np.array([3, 5]), np.array([4, 5])
    for _ in range(200):
        model.update(one, np.array([1.0, 1.0]), 1)
        model.update(two, np.array([1.0, 1.0]), 0)
    w = model.weights(slice(None))
    assert w[3] > 1 and w[4] < -1 and abs(w[5]) < 0.5 and np.count_nonzero(w) <= 4


def test_training_equals_a_plain_replay():
    """Follow-the-regularised-leader update by update, one number at a time."""
    import math
    rng = random.Random(5)
    rows = [(prose(rng, rng.randint(3, 30)) + rng.choice((" |", "")), rng.randint(0, 1)) for _ in range(60)]
    model, z, n = quality.Ftrl(), {}, {}

    def weight(i):
        zi, ni = z.get(i, 0.0), n.get(i, 0.0)
        if abs(zi) <= quality.L1:
            return 0.0
        return (math.copysign(quality.L1, zi) - zi) / ((quality.BETA + math.sqrt(ni)) / quality.ALPHA + quality.L2)

    for text, label in rows:
        index, value = quality.features(text)
        model.update(index, value, label)
        x = {quality._SIZE: 1.0}
        for i, v in zip(index.tolist(), value.tolist()):
            x[i] = x.get(i, 0.0) + v
        w = {i: weight(i) for i in x}
        p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w[i] * v for i, v in x.items())))))
        for i, v in x.items():
            g = (p - label) * v
            z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / quality.ALPHA * w[i]
            n[i] = n.get(i, 0.0) + g * g
    got = model.weights(slice(None))
    assert len(z) > 300 and all(abs(got[i] - weight(i)) < 1e-9 for i in z)
    assert np.count_nonzero(got) == sum(weight(i) != 0 for i in z)


def test_quality_held_out(docs):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        text = prose(rng, rng.randint(15, 120))
        rows.append((i, text if i % 3 else rng.choice((" | ".join(text.split()), " ".join(w + "***" for w in text.split()))), i % 3 and 1))
    frame = docs([r[:2] for r in rows])
    labels = frame.sparkSession.createDataFrame([(r[0], int(r[2])) for r in rows if r[0] % 2 == 0], "doc_id long, label int")
    weights = quality.train(frame, labels, sample=150)
    got = dict(quality.score(docs([r[:2] for r in rows]), weights).collect())
    right = sum((got[r[0]] >= 0.3) == bool(r[2]) for r in rows if r[0] % 2)
    assert right >= 0.97 * 200


def test_quality_edges(spark, docs):
    weights = quality.train(docs([]), docs([]).select("doc_id", F.lit(1).alias("label")))
    assert not weights.any()
    got = quality.score(docs(EDGES), weights).collect()
    assert len(got) == len(EDGES) and all(r["score"] == 0.5 for r in got)
    assert quality.score(docs([]), weights).count() == 0


def test_language_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    profiles = langid.learn(d.filter("doc_id % 2 = 0"), sample=60)
    assert [p[0] for p in profiles] == ["de", "en", "es", "fr"] and all(len(p[1]) == langid.LENGTH for p in profiles)
    got = langid.predict(d.filter("doc_id % 2 = 1"), profiles).join(d, "doc_id")
    n, right = got.count(), got.filter("lang_pred = lang").count()
    assert right >= 0.99 * n


def test_out_of_place_distance_by_hand():
    texts = {"xx": "aab aab", "yy": "zz zy"}
    profiles = [(k, langid.ranked(*langid.ngrams(t))) for k, t in texts.items()]
    model = langid.Profiles(profiles)
    for text in ("aab", "zy zz", "q", "aab zz"):
        own = langid.ranked(*langid.ngrams(text)).tolist()
        cost = {k: sum(abs(own.index(g) - p.tolist().index(g)) if g in p.tolist() else langid.LENGTH for g in own)
                for k, p in profiles}
        best = min(sorted(cost), key=cost.get)
        assert model.predict(text) == (best, 1 - cost[best] / (langid.LENGTH * len(own)))


def test_ngram_counts_do_not_depend_on_chunks(monkeypatch):
    text = prose(random.Random(1), 500) + " été Straße"
    whole = langid.ngrams(text)
    monkeypatch.setattr(langid, "CHUNK", 64)
    parts = langid.ngrams(text)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_what_is_no_letter(docs):
    """Superscripts, fractions, roman numerals, marks without a letter and symbols are no text."""
    profiles = [("en", langid.ranked(*langid.ngrams("word")))]
    rows = list(enumerate(["\u00b2 \u00bd", "\u2167 \u2460", "\u0301\u0301", "\u20ac \u221e _ 12", "\u00b2a", "e\u0301t\u00e9", "\u65e5\u672c"]))
    got = {r[0]: r[1] for r in langid.predict(docs(rows), profiles).collect()}
    assert [got[i] for i in range(7)] == ["und"] * 4 + ["en"] * 3


def test_language_edges(docs):
    profiles = langid.learn(docs([(1, "the cat", None)]))
    assert profiles == []
    got = {r[0]: (r[1], r[2]) for r in langid.predict(docs(EDGES), [("en", langid.ranked(*langid.ngrams("word")))]).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == [("und", 0.0)] * 4 and got[5] == ("en", 1.0) and got[6][0] == "en"
    assert langid.predict(docs([(1, "word")]), []).collect()[0][1] == "und"
