import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from keyroll.llm import mixing
from tests.llm.conftest import prose


def split(children, budget):
    """children: (name, cap, weight) -> budget each; the full ones first."""
    left, out, rest = sorted(children, key=lambda c: (c[1] / c[2], c[0])), {}, budget
    while left:
        name, cap, weight = left[0]
        if cap * sum(c[2] for c in left) > rest * weight:
            total = sum(c[2] for c in left)
            out.update({n: min(c, rest * w // total) for n, c, w in left})
            break
        out[name] = cap
        rest -= cap
        left.pop(0)
    return out


def brute(rows, weights, part, epochs, seed=17):
    """rows: (id, domain, lang, source, tokens); part: (a, b) for a / b of all."""
    w = lambda level, name: weights.get(level, {}).get(name, 1)
    leaf = defaultdict(int)
    for _, d, l, s, n in rows:
        leaf[d, l, s] += n
    cap = lambda *key: sum(n * epochs for k, n in leaf.items() if k[:len(key)] == key)
    budget = {}
    tops = split([(d, cap(d), w("domain", d)) for d in {k[0] for k in leaf}], sum(leaf.values()) * part[0] // part[1])
    for d, b1 in tops.items():
        for l, b2 in split([(l, cap(d, l), w("lang", l)) for l in {k[1] for k in leaf if k[0] == d}], b1).items():
            for s, b in split([(s, cap(d, l, s), w("source", s)) for s in {k[2] for k in leaf if k[:2] == (d, l)}], b2).items():
                budget[d, l, s] = b
    out = []
    for key, b in budget.items():
        total = leaf[key]
        whole, rest = divmod(b, max(total, 1))
        own = sorted(((hashlib.md5(f"{seed}:{whole}:{i}".encode()).hexdigest(), n, i) for i, *k, n in rows if tuple(k) == key))
        at = 0
        for _, n, i in own:
            out += [(i, e, b) for e in range(whole + (rest > 0 and at < rest))]
            at += n
    return sorted(out)


def test_matches_brute_force(docs):
    rng = random.Random(8)
    weights = {"domain": {"a": 5, "b": 1}, "lang": {"en": 3}, "source": {"s1": 4}}
    rows = []
    for i in range(400):
        d, l, s = rng.choice("aaab"), rng.choice(("en", "en", "de", "fr")), rng.choice(("s1", "s1", "s2", "s3"))
        rows.append((i, prose(rng, rng.choice((0, 1, 5, 40))), l, d + s))
    plain = [(i, s[0], l, s, len(t.split())) for i, t, l, s in rows]
    for part, epochs in (((3, 10), 1), ((9, 10), 1), ((2, 1), 3), ((9, 1), 2)):
        got = mixing.select_mix(docs(rows), F.substring("source", 1, 1), F.expr(f"available * {part[0]} div {part[1]}"), weights, epochs)
        assert sorted((r["row"]["doc_id"], r["epoch"], r["budget"]) for r in got.collect()) == brute(plain, weights, part, epochs)


def test_shortages_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "en", "x", 10), ("a", "de", "x", 1000), ("b", "en", "x", 1000)],
                                   "domain string, lang string, source string, tokens long")
    got = {(r[0], r[1]): r["budget"] for r in mixing.budgets(leaves, F.lit(400)).collect()}
    # a's English runs short by 90: a's German gets it, b stays at its share.
    assert got == {("a", "en"): 10, ("a", "de"): 190, ("b", "en"): 200}


def test_edges(spark, docs):
    mix = lambda d: mixing.select_mix(d, F.lit(None).cast("string"), F.expr("available"))
    assert mix(docs([])).count() == 0
    frame = docs([(1, None, None, None), (1, "a b", None, None), (1, "a b", None, None), (None, "c", "en", "s"), (2, "w " * 50_000)])
    out = mix(frame)
    assert out.select("row.*").columns == frame.columns
    assert sorted(r["tokens"] for r in out.collect())[-1] == 50_000 and out.count() >= 4
    odd = frame.withColumn("tokens", F.lit("x")).withColumn("budget", F.lit(1)).withColumn("key", F.lit(2))
    assert mix(odd).select("row.*").columns == odd.columns


def test_plan_has_no_python(docs):
    out = mixing.select_mix(docs([(1, "a")]), F.lit("x"), F.expr("available"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
