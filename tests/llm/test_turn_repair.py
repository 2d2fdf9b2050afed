"""Conversation repair against an exhaustive search."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from keyroll.llm import turn_repair as tr

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile("(s?(ua)+)?")


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        mine = out.setdefault(conv, [])
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        mine += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def cheapest(rows):
    """Uniform-cost search over edit strings; of the cheapest the ASCII-least."""
    heap, best = [(0, "", 0, "", ())], None
    while heap:
        cost, audit, i, initials, lines = heapq.heappop(heap)
        if best is not None and cost > best[0]:
            break
        if i == len(rows) and LEGAL.fullmatch(initials):
            best = min(best or (cost, audit, lines), (cost, audit, lines))
        for role in ("user", "assistant"):
            if len(audit) < 2 * len(rows) + 3 and LEGAL.fullmatch(initials + role[0] + ("a" if role == "user" else "")):
                heapq.heappush(heap, (cost + 3, audit + "I", i, initials + role[0], lines + (f"{role}:",)))
        if i == len(rows):
            continue
        role, text, fault = rows[i]
        heapq.heappush(heap, (cost + 4, audit + "D", i + 1, initials, lines))
        if fault not in ("blank", "duplicate"):
            late = 3 if fault == "truncated" else 0
            for new, edit, price in ((role, "K", 0), ("user", "R", 3), ("assistant", "R", 3)):
                now = initials + new[:1]
                if new and any(LEGAL.fullmatch(now + more) for more in ("", "a", "ua")) and now != initials:
                    heapq.heappush(heap, (cost + price + late, audit + edit, i + 1, now, lines + (f"{new}:{text}",)))
    return best


def brute(rows):
    out = []
    for conv, mine in damaged(rows).items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked = set(), []
        for _, role, text in mine:
            stripped = text.rstrip(" \t\n\x0b\x0c\r")
            fault = ("blank" if not stripped else "duplicate" if (role, text) in seen
                     else "truncated" if stripped[-1] not in ".!?" else "")
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        n = {f: sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")}
        bad = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, lines = cheapest(marked)
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], bad, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def random_logs(seed, convs, longest):
    rng, rows = random.Random(seed), []
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t", None, "A b.\n", "a.b", "Zoë ok?  ", "x" * 3000 + "."]
    for conv in range(convs):
        for turn in range(rng.randint(0, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]) \
                if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            at = None if rng.random() < 0.05 else turn + (rng.random() < 0.1)
            rows.append((None if conv == 3 else conv, at, role, rng.choice(texts[:3] if rng.random() < 0.6 else texts)))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return rows


@pytest.mark.parametrize("bits", [tr.BLOCK_BITS, 1])
def test_equals_exhaustive_search(spark, monkeypatch, bits):
    """With blocks of two rows too, so that borders fall inside conversations."""
    monkeypatch.setattr(tr, "BLOCK_BITS", bits)
    rows = random_logs(5, 60, 7)
    frame = spark.createDataFrame([(*r, "clash", i) for i, r in enumerate(rows)],
                                  SCHEMA + ", conv string, pos int").repartition(4)
    got = sorted((tuple(r) for r in tr.audit(frame).collect()), key=str)
    assert got == brute(rows)


def test_long_conversation_in_blocks(spark, monkeypatch):
    """One conversation over many blocks equals the same walk in one block."""
    monkeypatch.setattr(tr, "BLOCK_BITS", 5)
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"Text {t}.") for t in range(700)]
    rows += [(2, 0, "user", "Hi."), (2, 1, "assistant", "Hello.")]
    got = {r["conv"]: r for r in tr.audit(spark.createDataFrame(rows, SCHEMA)).collect()}
    kept = sorted(damaged(rows)[1])
    marked, seen = "", set()
    for _, role, text in kept:
        marked += "-" if not text or (role, text) in seen else role[0] if text[-1] == "." else role[0].upper()
        seen.add((role, text))
    audits, states = tr.walk(marked, tr.FINAL)
    assert got[1]["audit"] == audits[0] + tr.CLOSING[states[0]]
    price = {"D": tr.DELETE, "I": tr.INSERT, "R": tr.REROLE, "K": 0}
    on_rows = [e for e in got[1]["audit"] if e != "I"]
    late = sum(tr.TRUNCATED for e, c in zip(on_rows, marked, strict=True) if e in "KR" and c.isupper())
    assert got[1]["cost"] == sum(price[e] for e in got[1]["audit"]) + late
    _, edits, _ = tr.repair(tr.damage(spark.createDataFrame(rows, SCHEMA)))
    assert edits.filter(F.col("conv") == 1).select("block").distinct().count() > 10


def test_empty_and_dropped(spark):
    assert tr.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    lost = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = tr.audit(spark.createDataFrame([(lost, 0, "user", "Hi.")], SCHEMA)).collect()[0]
    assert tuple(row) == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_vectors_are_kept_at_checkpoints_only():
    """A block's walk equals the walk over all its vectors."""
    rng = random.Random(3)
    for n in (1, 2, 9, 50, 101):
        codes = "".join(rng.choice("suaxSUAX-") for _ in range(n))
        vectors = [tr.FINAL]
        for code in reversed(codes):
            vectors.append(tr._back(code, vectors[-1]))
        assert tr.borders([tr.block_costs(codes)])[0] == vectors[-1]
        audits, states = tr.walk(codes, tr.FINAL)
        for s in range(4):
            whole = audits[s] + tr.CLOSING[states[s]]
            assert sum(e != "I" for e in whole) == n
