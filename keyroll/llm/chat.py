"""Chat formatting: collapse logged snapshots of one conversation, then render.

A logger that writes the conversation after every turn leaves rows whose turns
are a prefix of a longer log. Each turn's hash is salted with its turn number,
and the hash of a prefix is the exclusive-or of its turns' hashes, so prefix
hashes are running values that blocks of turns carry forward: a conversation
of any length is never sorted or held as one group until it is rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyroll.llm.common import store

# Turn numbers per block of a running hash.
BLOCK = 1024
HASHES = ("h1", "h2")


def prefixes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
             text: str = "text") -> DataFrame:
    """One row per conversation and turn number: the hash of all its turns up to
    that one, and ``last`` (the turn is its last). Equal rows count once; a null
    role or text is a value of its own, a null turn comes before all others."""
    # A hash per row, seeded twice, before equal rows are merged: no text is shuffled.
    # Nulls are told apart from empty strings.
    at = F.coalesce(F.col(turn).cast("bigint"), F.lit(-1))
    parts = (at, F.col(role).isNull(), F.coalesce(F.col(role), F.lit("")), F.col(text).isNull(), F.coalesce(F.col(text), F.lit("")))
    rows = turns.select(F.col(conv).alias("conv"), at.alias("turn"), F.xxhash64(F.lit("one"), *parts).alias("h1"),
                        F.xxhash64(F.lit("two"), *parts).alias("h2")).distinct()
    turns_ = rows.groupBy("conv", "turn").agg(*[F.bit_xor(h).alias(h) for h in HASHES])
    turns_ = store(turns_.withColumn("block", F.floor(F.col("turn") / BLOCK).cast("bigint")), "chat-turns")
    totals = turns_.groupBy("conv", "block").agg(*[F.bit_xor(h).alias(f"t_{h}") for h in HASHES], F.max("turn").alias("m"))
    ahead = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("conv", "block", F.max("m").over(Window.partitionBy("conv")).alias("end"),
                          *[F.coalesce(F.bit_xor(f"t_{h}").over(ahead), F.lit(0)).alias(f"c_{h}") for h in HASHES])
    run = Window.partitionBy("conv", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = turns_.select("conv", "block", "turn", *[F.bit_xor(h).over(run).alias(h) for h in HASHES])
    joined = inner.alias("i").join(carry.alias("c"), F.expr("i.conv <=> c.conv and i.block = c.block"))
    return joined.select(F.col("i.conv").alias("conv"), "turn", (F.col("turn") == F.col("end")).alias("last"),
                         *[F.col(h).bitwiseXOR(F.col(f"c_{h}")).alias(h) for h in HASHES])


def maximal(turns: DataFrame, **columns: str) -> DataFrame:
    """Conversations that no longer one extends: ``conv``, ``last_turn`` and
    ``copies`` (conversations with exactly these turns; the smallest id stands
    for them)."""
    found = store(prefixes(turns, **columns), "chat-prefixes")
    whole = found.filter("last").groupBy("turn", *HASHES).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("copies"))
    inner = found.filter("not last").select("turn", *HASHES).distinct()
    return whole.join(inner, ["turn", *HASHES], "left_anti").select("conv", F.col("turn").alias("last_turn"), "copies")


def render(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """One row per maximal conversation: id, distinct turn rows, copies, and the
    rendered text. Turns come in order of turn number, then role, then text; a
    null role is written 'unknown', a null text as an empty turn. Rows with a
    null conversation id are one conversation. An empty table gives no rows.
    """
    kept = store(maximal(turns, conv=conv, turn=turn, role=role, text=text), "chat-kept")
    rows = turns.select(F.col(conv).alias("conv"), F.coalesce(F.col(turn).cast("bigint"), F.lit(-1)).alias("turn"),
                        F.col(role).alias("role"), F.col(text).alias("text"))
    rows = rows.alias("r").join(kept.alias("k"), F.expr("r.conv <=> k.conv")).select("r.*", "copies")
    block = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"),
                     F.coalesce("text", F.lit("")), F.lit("\n<|end|>\n"))
    rows = rows.select("conv", "copies", F.struct(
        "turn", F.col("role").isNotNull().alias("r"), "role", F.col("text").isNotNull().alias("t"), "text",
        block.alias("block")).alias("s"))
    out = rows.groupBy("conv", "copies").agg(F.sort_array(F.collect_set("s")).alias("s"))  # the rendered document itself
    return out.select(F.col("conv").alias("conv_id"), F.size("s").cast("bigint").alias("n_turns"), "copies",
                      F.array_join(F.transform("s", lambda x: x["block"]), "").alias("rendered"))
