"""Mixing sources to target weights by hierarchical budgets.

The tree is domain > language > source. A node may use at most the tokens of its
leaves times ``max_epochs``; its parent's budget is split by weight, and what a
child cannot use goes to its siblings (level filling) before anything is left
for the parent's siblings, because a parent never receives more than its own
leaves can use. Every leaf then takes a token-prefix of its seeded epochs: whole
epochs first, and of the last one the documents in seeded order until the
budget is met.

The tree has one row per leaf; documents are never ordered as a whole. A leaf's
seeded order is cut into ``16 ** DIGITS`` buckets by the leading digits of the
key, and only the bucket in which the budget ends is ordered by document.
Budgets are exact integers (decimals), so the result does not depend on the
order of summation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyroll.llm.common import SPACE, sized, store

LEVELS = ("domain", "lang", "source")
DIGITS = 4
_WHOLE = "decimal(38,0)"

# Production parameters: whole weights per level, the budget of the whole mix
# over the available tokens, and how often a document may be used.
WEIGHTS = {"domain": {"d0": 3, "d1": 2, "d2": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 1},
           "source": {"src0": 2}}
TOTAL = "available * 6 div 10"
EPOCHS = 3


def _whole(c: Column) -> Column:
    return c.cast(_WHOLE)


def _fill(nodes: DataFrame, parent: list[str], name: str, budget: str, out: str) -> DataFrame:
    """Split ``budget`` of each parent among its children by ``weight``, none
    above its ``cap``: in order of cap / weight a child is full if the level that
    fills it fits the budget; the others share what is left by weight."""
    order = Window.partitionBy(*parent).orderBy(F.col("cap").cast("double") / F.col("weight"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(*parent)
    filled = F.coalesce(F.sum("cap").over(before), F.lit(0).cast(_WHOLE))
    open_weight = F.sum("weight").over(rest)
    nodes = nodes.withColumn("_used", _whole(filled)).withColumn("_open", open_weight)
    full = (_whole(F.col("cap")) * _whole(F.col("_open"))) <= (
        _whole(F.col(budget) - F.col("_used")) * _whole(F.col("weight")))
    nodes = nodes.withColumn("_full", full)
    # Level of the first child that is not full; one row per parent has it.
    nodes = nodes.withColumn("_left", F.min(F.when(~F.col("_full"), F.struct(
        F.col("cap").cast("double") / F.col("weight"), F.col(name), _whole(F.col(budget) - F.col("_used")).alias("rest"),
        F.col("_open").alias("open")))).over(whole))
    share = F.expr(f"cast(_left.rest as {_WHOLE}) * cast(weight as {_WHOLE}) div cast(_left.open as {_WHOLE})")
    given = F.when(F.col("_left").isNull() | F.col("_full"), F.col("cap")).otherwise(F.least("cap", _whole(share)))
    return nodes.withColumn(out, _whole(given)).drop("_used", "_open", "_full", "_left")


def budgets(leaves: DataFrame, total: Column, weights: dict[str, dict[str, int]] | None = None,
            max_epochs: int = 1) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens) with ``budget`` tokens each.

    ``total`` is the budget of the whole mix as an expression over the sum
    ``available``; ``weights`` gives whole positive weights per level and name
    (default 1). Names are matched as text; a null name is the text ''.
    """
    weights = weights or {}

    def weight(level: str) -> Column:
        out = F.lit(1)
        for name, w in weights.get(level, {}).items():
            out = F.when(F.col(level) == name, F.lit(int(w))).otherwise(out)
        return out.cast("bigint")

    capped = leaves.withColumn("cap", _whole(F.col("tokens") * max_epochs))
    top = capped.groupBy("domain").agg(_whole(F.sum("cap")).alias("cap"), _whole(F.sum("tokens")).alias("tokens"))
    top = (top.withColumn("root", F.lit(0)).withColumn("available", _whole(F.sum("tokens").over(Window.partitionBy("root"))))
           .withColumn("total", _whole(total)).withColumn("weight", weight("domain")))
    top = _fill(top, ["root"], "domain", "total", "b1").select("domain", "b1")
    mid = (capped.groupBy("domain", "lang").agg(_whole(F.sum("cap")).alias("cap")).join(top, "domain")
           .withColumn("weight", weight("lang")))
    mid = _fill(mid, ["domain"], "lang", "b1", "b2").select("domain", "lang", "b2")
    low = capped.join(mid, ["domain", "lang"]).withColumn("weight", weight("source"))
    return _fill(low, ["domain", "lang"], "source", "b2", "budget").select(
        *LEVELS, "tokens", F.col("budget").cast("bigint").alias("budget"))


def n_tokens(text: Column) -> Column:
    """Tokens of the budget: words of the text."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))
    return F.when(t == "", F.lit(0)).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("bigint")


def _key(seed: int, epoch: str, doc_id: str) -> Column:
    """Seeded order of an epoch: hexadecimal digits, compared as text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(epoch).cast("string"),
                             F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))


def select_mix(docs: DataFrame, domain: Column, total: Column, weights: dict[str, dict[str, int]] | None = None,
               max_epochs: int = 1, seed: int = 17, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Chosen rows: ``row`` (a struct of the input columns), ``epoch`` (from 0),
    ``tokens``, the leaf and its ``budget``.

    A leaf's prefix holds every document that starts before its budget is used
    up, so it ends with the document that reaches it. Null names are the leaf
    ''. A document without words costs nothing and comes with the prefix it
    falls into. Repeated rows (one id) are ordered by their tokens and count
    each. An empty table gives no rows.
    """
    leaf = [F.coalesce(c.cast("string"), F.lit("")).alias(n)
            for n, c in zip(LEVELS, (domain, F.col("lang"), F.col("source")), strict=True)]
    rows = docs.select(F.col(doc_id).alias("id"), *leaf, n_tokens(F.col(text)).alias("tokens"), F.struct("*").alias("row"))
    slim = store(rows.select("id", *LEVELS, "tokens"), "mix-sizes")
    leaves = slim.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    plan = budgets(leaves, total, weights, max_epochs)
    # Whole epochs, and the tokens to take of the epoch after them.
    plan = plan.select(*LEVELS, "budget", F.expr("budget div greatest(tokens, 1L)").alias("whole"),
                       F.expr("budget % greatest(tokens, 1L)").alias("part"))
    plan = store(plan, "mix-plan")
    last = slim.join(sized(plan), list(LEVELS)).filter("part > 0")
    last = last.withColumn("key", _key(seed, "whole", "id")).withColumn("bucket", F.substring("key", 1, DIGITS))
    sums = last.groupBy(*LEVELS, "part", "bucket").agg(F.sum("tokens").alias("n"))
    ahead = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge = (sums.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)).cast("bigint"))
            .filter("before < part and before + n >= part").select(*LEVELS, F.col("bucket").alias("edge"), "before"))
    edge = store(edge, "mix-edges")
    within = (last.join(edge, list(LEVELS)).filter("bucket = edge"))
    run = Window.partitionBy(*LEVELS).orderBy("key", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    cut = (within.withColumn("start", F.col("before") + F.coalesce(F.sum("tokens").over(run), F.lit(0)))
           .filter("start < part").groupBy(*LEVELS).agg(F.max(F.struct("key", "tokens")).alias("cut")))
    full = store(plan.join(cut, list(LEVELS), "left"), "mix-cuts")
    out = rows.join(sized(full), list(LEVELS))
    key = F.struct(_key(seed, "whole", "id").alias("key"), F.col("tokens"))
    epochs = F.col("whole") + F.when(F.col("cut").isNotNull() & (key <= F.col("cut")), 1).otherwise(0)
    out = out.withColumn("epochs", epochs.cast("int")).filter("epochs > 0")
    out = out.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    return out.select("row", "epoch", "tokens", *LEVELS, "budget")
