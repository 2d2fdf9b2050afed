import hashlib
import math
import random
import re
from collections import Counter

from keyroll.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    out = []
    for m in ASSIGN.finditer(text or ""):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text or ""):
        if len(m[0]) >= 20:
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9a-f]+", text or ""):
        if len(m[0]) >= 24:
            out.append((m.start(), 2, m.end()))
    return sorted(out)


def entropy_spans(text, fixed):
    masked = list(text or "")
    for start, _, end in fixed:
        masked[start:end] = " " * (end - start)
    for m in re.finditer(secrets.CANDIDATE, "".join(masked)):
        if any(re.search(p, m[0]) for p in secrets.ALLOWED):
            continue
        bits = next(b for p, _, b in secrets.CLASSES if re.search(p, m[0]))
        best = max(-sum(c / 20 * math.log2(c / 20) for c in Counter(m[0][i:i + 20]).values()) for i in range(len(m[0]) - 19))
        if best >= bits:
            yield m.start(), 3, m.end()


def joined(spans):
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def sample():
    rng = random.Random(1)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    texts = [
        None, "", "nothing here", "password=hunter2x", 'Token: "abc"', "token=token:abcdefg", "API_KEY = 'a1b2c3d4e5'",
        "é😀 secret : zzzzzzzz and PASSWD='qwerty1'", "AKIA" + "A" * 16, "AKIA" + "B" * 15, "xAKIAAKIA" + "C1" * 8,
        "0123456789abcdef01234567", "0123456789abcdef0123456", "DEADBEEF" * 4, key, f"{key}!{key}", f"a {key[:19]} b",
        "internationalization-and-localization", "123e4567-e89b-12d3-a456-426614174000", "2024-01-01T00:00:00Z",
        "aaaaaaaaaaaaaaaaaaaa1", "token=" + "ab" * 200, f"password={key} {key}",
        f"AKIA{'Q7' * 8}/{key}", f"{key}/AKIA{'Q7' * 8}={key}", f"{key[:21]}AKIA{'Q7' * 8}", "qWeRtYuIoPaSdFgHjKlZxCvBnM",
        "parseHTMLDocumentFromString/andOtherCamelCaseWords", "THE_QUICK_BROWN_FOX-jumps/Over", "aBcD/eFgHiJkL/mNoPqRsTuVwXyZ", "ſecret=abcdefgh toKen=abcdefgh",
        " ".join(f"token={i:06d}" for i in range(700)), ("word " * 3000) + key + (" word" * 3000), key * 60]
    for _ in range(40):
        texts.append("".join(rng.choice(["token", "=", ":", " ", '"', "abc", "AKIA", "9f" * 6, "Z1" * 5, key[:12], "é", "\n"])
                             for _ in range(rng.randint(1, 40))))
    return texts


def test_spans_match_brute_force(docs):
    texts = sample()
    rows = {r["row"]["doc_id"]: r for r in secrets.digest(secrets.scan(docs(list(enumerate(texts))))).collect()}
    extra = 0
    for i, t in enumerate(texts):
        fixed, r = base(t), rows[i]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for _, k, _ in fixed) for x in range(3)], t
        assert r["base_sha256"] == hashlib.sha256(joined(fixed).encode()).hexdigest(), t
        more = list(entropy_spans(t, fixed))
        extra += len(more)
        assert r["spans"] == joined(fixed + more), t
    assert extra > 5


def test_empty_table_clashing_names_and_copies(spark, docs):
    assert secrets.scan(docs([])).count() == 0
    odd = spark.createDataFrame([("token=abcdefg", [1], "z")] * 2, "text string, base array<int>, runs string")
    out = secrets.digest(secrets.scan(odd)).collect()
    assert [r["spans"] for r in out] == ["assign:0:13"] * 2 and out[0]["row"]["base"] == [1]


def test_no_python_in_the_plan(docs):
    plan = secrets.digest(secrets.scan(docs([(1, "a")])))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
