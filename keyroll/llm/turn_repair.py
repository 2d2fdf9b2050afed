"""Conversation structure repair: cheapest edits that make a log alternate.

A repaired conversation's roles read ``(s?(ua)+)?`` by their initials. Each row
is kept (0), re-roled to user or assistant (3) or deleted (4, the only choice
for a blank or duplicate row); an empty user or assistant turn is inserted
anywhere for 3, and a truncated row that is not deleted costs 3 more. Of the
cheapest edit sequences the ASCII-least string of initials (D, I, K, R) counts.

The cost of finishing from a state depends on the rows behind it, so vectors of
four state costs run backward and the edits are emitted forward. Vectors are
kept at checkpoints only; the rows between two checkpoints are recomputed when
the forward walk gets there. That is done on two levels:

* A conversation is cut into blocks of at most ``BLOCK`` rows. A block's 4 x 4
  least costs compose, so the vectors at block borders come from one small row
  per block, and every block is then walked by itself, from each state it can
  be entered in. No conversation is held in one task, whatever its share.
* Within a block of n rows, vectors are kept at every ``sqrt(n)``-th row.

Rows are ordered by one range sort over (conversation, turn, role, text); a
duplicate is a row that is not the first of its (conversation, role, text).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyroll.llm.common import store

SPACE_CHARS = r"[\x20\x09-\x0D]"
ENDS = ".!?"
BLOCK_BITS = 12
BLOCK = 1 << BLOCK_BITS
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NEVER = 1 << 40
# States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; done in 0 or 3.
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
TURN = (2, 2, 3, 2)  # the state after the user or assistant turn that may follow
FINAL = (0, 2 * INSERT, INSERT, 0)  # with the inserts that finish a pair
CLOSING = ("", "II", "I", "")
ROLE = {2: "user", 3: "assistant"}
# A row's code: its role's initial (x: another one), upper case if truncated; '-': must go.
Vector = tuple[int, int, int, int]


@lru_cache(maxsize=64)
def _moves(code: str) -> tuple[tuple[tuple[str, int, int], ...], ...]:
    """Per state the edits of a row in ASCII order: (initial, cost, next state)."""
    out = []
    for state in range(4):
        moves = [("D", DELETE, state)]
        if code != "-":
            extra = TRUNCATED if code.isupper() else 0
            if (after := NEXT.get(code.lower(), {}).get(state)) is not None:
                moves.append(("K", KEEP + extra, after))
            moves.append(("R", REROLE + extra, TURN[state]))
        out.append(tuple(moves))
    return tuple(out)


def _back(code: str, after: Vector) -> Vector:
    """State costs before a row, and before the inserts ahead of it, from those after it."""
    base = [min(cost + after[to] for _, cost, to in moves) for moves in _moves(code)]
    return tuple(min(base[s], INSERT + base[TURN[s]], 2 * INSERT + base[TURN[TURN[s]]]) for s in range(4))


@lru_cache(maxsize=100_000)
def block_costs(codes: str) -> tuple[Vector, ...]:
    """Least costs from the state before a block (row) to the state behind it (column)."""
    columns = []
    for end in range(4):
        costs = tuple(0 if s == end else NEVER for s in range(4))
        for code in reversed(codes):
            costs = _back(code, costs)
        columns.append(costs)
    return tuple(tuple(min(columns[e][s], NEVER) for e in range(4)) for s in range(4))


@lru_cache(maxsize=100_000)
def walk(codes: str, end: Vector) -> tuple[tuple[str, ...], tuple[int, ...]]:
    """Per state in which a block is entered: its ASCII-least cheapest edits, and
    the state behind it. ``end`` holds the state costs behind the block."""
    n = len(codes)
    step = max(1, isqrt(n))
    kept, costs = {n: end}, end  # checkpoints: every step-th row and the end
    for i in range(n - 1, -1, -1):
        costs = _back(codes[i], costs)
        if i % step == 0:
            kept[i] = costs
    audits, states = [[], [], [], []], [0, 1, 2, 3]
    for first in range(0, n, step):
        last = min(n, first + step)
        vectors = [kept[last]]  # recomputed from the checkpoint behind
        for i in range(last - 1, first - 1, -1):
            vectors.append(_back(codes[i], vectors[-1]))
        for i in range(first, last):
            after, before = vectors[last - 1 - i], vectors[last - i]
            for k in range(4):
                rest = before[states[k]]
                while True:
                    moves = dict((m[0], m) for m in _moves(codes[i])[states[k]])
                    # In ASCII order: delete, insert, keep, re-role.
                    edit = next(e for e in "DIKR" if (
                        INSERT + before[TURN[states[k]]] == rest if e == "I" else
                        e in moves and moves[e][1] + after[moves[e][2]] == rest))
                    audits[k].append(edit)
                    if edit != "I":
                        states[k] = moves[edit][2]
                        break
                    rest -= INSERT
                    states[k] = TURN[states[k]]
    return tuple("".join(a) for a in audits), tuple(states)


def borders(blocks: list[tuple[Vector, ...]]) -> list[Vector]:
    """State costs before every block, and behind the last one."""
    out = [FINAL]
    for costs in reversed(blocks):
        behind = out[-1]
        out.append(tuple(min(c + behind[e] for e, c in enumerate(row)) for row in costs))
    return out[::-1]


def damage(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """Rows (conv, turn, role, text) after the damage that crc32(``conv:turn``) % 20
    names: 0 drops the row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats
    it, 4 sets role user. A null is one space; a null turn stays null for the order.
    Other columns are not read."""
    def plain(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(plain(conv), F.lit(":"), plain(turn))) % 20
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), fate.alias("fate"),
                        plain(role).alias("role"), plain(text).alias("text")).filter("fate <> 0")
    cut = F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.regexp_replace("text", f"[{ENDS}]", ""))
    rows = rows.select("conv", "turn", F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                       cut.otherwise(F.col("text")).alias("text"),
                       F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")


def ordered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``pos``, a number that rises with (conv, turn, role, text), nulls
    first. Equal rows are spread by their place in the input, so that no range
    has to hold them all."""
    salted = rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    keys = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "salt"]
    numbered = salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("salt")
    return store(numbered.withColumn("pos", F.monotonically_increasing_id()), "turns-ordered")


def faults(rows: DataFrame) -> DataFrame:
    """(conv, block, pos, turn, initial, fault, code) of every ordered row; fault is
    its first of blank, duplicate, truncated, or ''."""
    last = F.substring(F.regexp_replace("text", f"{SPACE_CHARS}+$", ""), -1, 1)
    small = rows.select("conv", "turn", "pos", F.substring("role", 1, 1).alias("initial"), last.alias("last"),
                        F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit("again"), "text", "role").alias("h2"))
    firsts = small.groupBy("conv", "h1", "h2").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    marked = small.join(firsts, "pos", "left")
    fault = (F.when(F.col("last") == "", "blank").when(F.col("first").isNull(), "duplicate")
             .when(~F.col("last").isin(*ENDS), "truncated").otherwise(""))
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    marked = marked.select("conv", F.shiftright("pos", BLOCK_BITS).alias("block"), "pos", "turn",
                           known.alias("initial"), fault.alias("fault"))
    code = (F.when(F.col("fault").isin("blank", "duplicate"), "-")
            .when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial")))
    return marked.withColumn("code", code)


def _blocks(rows: DataFrame) -> DataFrame:
    """One row per block of a conversation: codes and positions in order, and counts."""
    grouped = rows.groupBy("conv", "block").agg(
        F.array_sort(F.collect_list(F.struct("pos", "initial", "code"))).alias("rows"),  # BLOCK rows at most
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    initials = F.array_join(F.transform("rows", lambda r: r["initial"]), "")
    pairs = F.transform(F.sequence(F.lit(1), F.length("initials")), lambda i: F.substring(F.col("initials"), i, F.lit(2)))
    legal = ("su", "ua", "au")
    return grouped.withColumn("initials", initials).select(
        "conv", "block", F.array_join(F.transform("rows", lambda r: r["code"]), "").alias("codes"),
        F.transform("rows", lambda r: r["pos"]).alias("at"), "blank", "duplicate", "truncated",
        F.substring("initials", 1, 1).alias("head"), F.substring("initials", -1, 1).alias("tail"),
        F.size(F.filter(pairs, lambda p: (F.length(p) == 2) & ~p.isin(*legal))).cast("bigint").alias("illegal"))


COSTS = "conv {conv}, block bigint, costs array<bigint>"
ENDINGS = "conv {conv}, block bigint, last boolean, total bigint, ending array<bigint>"
WALKS = "conv {conv}, block bigint, audits array<string>, states array<bigint>"
ENTRIES = "conv {conv}, block bigint, entry bigint"
EDITS = "conv {conv}, block bigint, step bigint, pos bigint, edit string, state bigint"


def _map(frame: DataFrame, row: callable, schema: str) -> DataFrame:
    """One or more rows out of each row, in Arrow batches."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        for batch in batches:
            out = [o for r in batch.to_pylist() for o in row(r)]
            kinds = kinds or {"conv": batch.schema.field("conv").type, "pos": pa.int64()}
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, kinds.get(n)) for n, c in zip(names, zip(*out, strict=True), strict=True)], names=names)

    conv = frame.schema["conv"].dataType.simpleString()
    return frame.mapInArrow(run, schema.format(conv=conv))


def _costs(r: dict) -> list[tuple]:
    return [(r["conv"], r["block"], [c for row in block_costs(r["codes"]) for c in row])]


def _endings(r: dict) -> list[tuple]:
    """From a conversation's blocks: the state costs behind each of them."""
    blocks = [tuple(tuple(b["costs"][4 * s:4 * s + 4]) for s in range(4)) for b in r["blocks"]]
    found = borders(blocks)
    return [(r["conv"], b["block"], i == len(blocks) - 1, found[0][0], list(found[i + 1]))
            for i, b in enumerate(r["blocks"])]


def _walks(r: dict) -> list[tuple]:
    audits, states = walk(r["codes"], tuple(r["ending"]))
    return [(r["conv"], r["block"], [a + CLOSING[s] if r["last"] else a for a, s in zip(audits, states, strict=True)],
             list(states))]


def _entries(r: dict) -> list[tuple]:
    out, state = [], 0
    for b in r["blocks"]:
        out.append((r["conv"], b["block"], state))
        state = b["states"][state]
    return out


def _edits(r: dict) -> list[tuple]:
    """One row per edit: its place, the row it is made on (inserts: none), and the
    state after it, which names the role of R and I."""
    out, state, i = [], r["entry"], 0
    for step, e in enumerate(r["audit"]):
        if e == "I":
            state, at = TURN[state], None
        else:
            state, at = next(m[2] for m in _moves(r["codes"][i])[state] if m[0] == e), r["at"][i]
            i += 1
        out.append((r["conv"], r["block"], step, at, e, state))
    return out


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Repairs the rows (conv, turn, role, text) of damaged or raw logs.

    Returns (conversations, edits, rows). ``conversations`` has per conversation the
    counts ``gaps blank duplicate truncated illegal``, the ``cost`` and the
    ``audit`` (initials of all edits in order). ``edits`` has one row per edit, in
    order of (block, step): its initial, ``pos`` of the row it is made on (inserts:
    null) and the ``state`` after it. ``rows`` are the ordered rows with ``pos``.
    A null conversation id is one conversation; rows of equal turn are ordered by
    role, then text; repeated rows are duplicates; role and text must not be null
    (``damage`` writes a space). An empty table gives no rows.
    """
    rows = ordered(turns)
    marked = store(faults(rows), "turns-marked")
    blocks = store(_blocks(marked), "turns-blocks")

    per_conv = _map(blocks.select("conv", "block", "codes"), _costs, COSTS).groupBy("conv").agg(
        F.array_sort(F.collect_list(F.struct("block", "costs"))).alias("blocks"))  # a row per BLOCK rows
    endings = store(_map(per_conv, _endings, ENDINGS), "turns-endings")
    at_block = F.expr("b.conv <=> e.conv and b.block = e.block")
    walks = store(_map(blocks.alias("b").join(endings.alias("e"), at_block).select("b.conv", "b.block", "codes", "last", "ending"),
                       _walks, WALKS), "turns-walks")
    chains = walks.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "states"))).alias("blocks"))
    entries = _map(chains, _entries, ENTRIES)
    chosen = store(walks.alias("b").join(entries.alias("e"), at_block).select(
        "b.conv", "b.block", F.get("audits", F.col("entry")).alias("audit"), "entry"), "turns-chosen")
    edits = _map(blocks.alias("b").join(chosen.alias("e"), at_block).select("b.conv", "b.block", "codes", "at", "audit", "entry"),
                 _edits, EDITS)

    ahead = F.lag("tail").over(Window.partitionBy("conv").orderBy("block"))  # a row per block
    counts = blocks.withColumn("border", F.concat(ahead, "head")).groupBy("conv").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        (F.sum("illegal") + F.count_if(F.col("border").isNotNull() & ~F.col("border").isin("su", "ua", "au"))).alias("illegal"))
    # The lowest and highest turn and how many there are; equal turns are merged before.
    gaps = rows.groupBy("conv", "turn").agg(F.lit(1)).groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint").alias("gaps"))
    total = endings.groupBy("conv").agg(F.max("total").alias("cost"))
    audits = chosen.groupBy("conv").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda b: b["audit"]), "").alias("audit"))
    out = counts
    for more in (gaps, total, audits):
        out = out.alias("l").join(more.alias("r"), F.expr("l.conv <=> r.conv")).select("l.*", *[f"r.{c}" for c in more.columns[1:]])
    return out, edits, rows


def repaired(edits: DataFrame, rows: DataFrame) -> DataFrame:
    """The repaired turns (conv, block, step, role, text), in order of (block, step)."""
    made = F.when(F.col("state") == 2, ROLE[2]).otherwise(ROLE[3])
    inserted = edits.filter(F.col("edit") == "I").select("conv", "block", "step", made.alias("role"), F.lit("").alias("text"))
    kept = edits.filter(F.col("edit").isin("K", "R")).join(rows.select("pos", F.col("role").alias("own"), "text"), "pos")
    role = F.when(F.col("edit") == "K", F.col("own")).otherwise(made)
    return kept.select("conv", "block", "step", role.alias("role"), "text").unionByName(inserted)


def text_digest(turns: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) over ``role:text`` of the repaired turns, newline-joined.
    A conversation's turns are streamed through the hash in order; none is held."""
    kind = turns.schema["conv"].dataType.simpleString()
    lines = turns.select("conv", "block", "step", F.concat("role", F.lit(":"), "text").alias("line"))
    lines = lines.repartition("conv").sortWithinPartitions("conv", "block", "step").select("conv", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, done, convs = None, None, [], pa.null()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], convs), pa.array([d[1] for d in done])],
                                             names=["conv", "repaired_sha256"])
            done.clear()
            return out

        for batch in batches:
            convs = batch.schema.field("conv").type
            for key, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is None or key != conv:
                    if state is not None:
                        done.append((conv, state.hexdigest()))
                    conv, state = key, hashlib.sha256(line.encode())
                else:
                    state.update(b"\n" + line.encode())
            if len(done) >= 10_000:
                yield flush()
        if state is not None:
            done.append((conv, state.hexdigest()))
            yield flush()

    return lines.mapInArrow(run, f"conv {kind}, repaired_sha256 string")


def audit(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Damage and repair in one: one row per original conversation, with the columns of
    ``repair`` and ``repaired_sha256``. A conversation without rows after the damage
    has zeros, an empty audit and the hash of the empty string."""
    found, edits, rows = repair(damage(turns, conv, turn, role, text))
    digests = text_digest(repaired(edits, rows))
    every = turns.select(F.col(conv).alias("conv")).distinct()
    out = every.alias("c").join(found.alias("f"), F.expr("c.conv <=> f.conv"), "left")
    out = out.join(digests.alias("d"), F.expr("c.conv <=> d.conv"), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(F.col("c.conv").alias("conv"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
