import random
import re
from collections import Counter

import pytest

from keyroll.llm import rules
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if grams[tuple(w[i:i + 8])] > 1:
            covered.update(range(i, i + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    line = prose(rng, 12)
    return [
        None, "", "   \n\t", "one", "a b c d e f g", "a b c d e f g h", "x " * 40, "\x1c\xa0 　word",
        f"{line}\n{line}\n\n{line} ", "the cat " * 30, prose(rng, 30) + " | # $ % & < > *", "😀 ünï " + prose(rng, 25),
        prose(rng, 400), prose(rng, 50) + " " + line + " " + prose(rng, 50) + " " + line,
        (prose(rng, 9) + " ") * 3 + prose(rng, 60), prose(rng, 20_000), "the " * 5000 + prose(rng, 5000)]


def test_counts_match_brute_force(docs, texts):
    got = {r["row"]["doc_id"]: r for r in rules.apply_rules(docs(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        n, chars, symbols, dup, repeat = brute(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            n, chars, symbols, dup, repeat), (i, (t or "")[:60])
        assert r["base_failed"] == (n < 20 or 100 * repeat > 30 * n)
        assert not (r["base_failed"] and r["kept"])


def test_verdicts(docs):
    rng = random.Random(5)
    good = prose(rng, 200)
    rows = [(1, good), (2, " | ".join(good.split())), (3, " ".join(f"{w}***" for w in good.split())),
            (4, " ".join(f"{w} {w} {w}" for w in good.split())), (5, " ".join(["12", "34", "567"] * 40)), (1, good)]
    kept = [r["doc_id"] for r in rules.keep_passing(docs(rows)).collect()]
    assert kept == [1, 1]


def test_clashing_columns_and_empty_table(spark, docs):
    odd = spark.createDataFrame([("the of and " * 30, 1, None, "x", 2.0)], "text string, n_words int, kept boolean, w string, h double")
    out = rules.apply_rules(odd).collect()[0]
    assert out["row"]["n_words"] == 1 and out["n_words"] == 90 and out["row"]["kept"] is None
    assert rules.keep_passing(odd).columns == odd.columns
    assert rules.apply_rules(docs([])).count() == 0


def test_plan_is_one_projection(docs):
    plan = rules.apply_rules(docs([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
