import random

from keyroll.llm import chat

SCHEMA = "conv_id long, turn int, role string, text string"


def brute(rows):
    convs = {}
    for c, t, r, x in set(rows):
        convs.setdefault(c, []).append((-1 if t is None else t, r is not None, r, x is not None, x))
    key = lambda s: (s[0], s[1], s[2] or "", s[3], s[4] or "")
    convs = {c: sorted(v, key=key) for c, v in convs.items()}

    def upto(c, turn):
        return tuple(s for s in convs[c] if s[0] <= turn)

    inner = {upto(c, s[0]) for c in convs for s in convs[c] if s[0] != convs[c][-1][0]}
    groups = {}
    for c, v in convs.items():
        if tuple(v) not in inner:
            groups.setdefault(tuple(v), []).append(c)
    return {min((c for c in g if c is not None), default=None): (
        len(v), len(g), "".join(f"<|{s[2] if s[1] else 'unknown'}|>\n{s[4] or ''}\n<|end|>\n" for s in v)) for v, g in groups.items()}


def run(spark, rows):
    got = chat.render(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len({r[0] for r in got}) == len(got)
    return {r["conv_id"]: (r["n_turns"], r["copies"], r["rendered"]) for r in got}


def test_snapshots_and_copies(spark, monkeypatch):
    rng = random.Random(6)
    for block in (1024, 2):
        monkeypatch.setattr(chat, "BLOCK", block)
        rows, c = [], 0
        for _ in range(30):
            full = [(t, "user" if t % 2 == 0 else "assistant", f"text {rng.randint(0, 3)}") for t in range(rng.randint(1, 9))]
            for end in rng.sample(range(1, len(full) + 1), rng.randint(1, len(full))) + [len(full)] * rng.randint(0, 2):
                rows += [(c, *s) for s in full[:end]]
                c += 1
        rows += rng.sample(rows, 10)
        assert run(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [(1, 0, None, None), (2, 0, None, ""), (3, 0, "", None), (4, None, "user", "a"), (4, 0, "user", "b"),
            (5, 0, "user", "x"), (5, 0, "user", "y"), (5, 5, "user", "z"), (None, 0, "user", "q"), (None, 1, "user", "r"),
            (6, 0, "user", "q"), (7, 0, "user", "w " * 100_000), (7, 0, "user", "w " * 100_000)]
    assert run(spark, rows) == brute(rows)
    assert chat.render(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_conversation_goes_in_blocks(spark):
    rows = [(1, t, "user", str(t)) for t in range(3000)] + [(2, t, "user", str(t)) for t in range(2048)]
    got = run(spark, rows)
    assert set(got) == {1} and got[1][0] == 3000


def test_plan_has_no_python(spark):
    plan = chat.render(spark.createDataFrame([(1, 0, "user", "a")], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
