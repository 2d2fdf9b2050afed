"""Skew-safe as-of lookup and in-group ordinals.

Both replace a window over a whole group (an upload, a pet, a run), which
would put a hot group — possibly a third of all rows — into one task.
Instead the position axis is cut into blocks of ``block`` positions: the
windows run per (group, block), and a small per-block summary carries the
state of all earlier blocks into each block. No pairs are produced.

Positions are expected to be dense (row indexes, as the sources produce),
so a block holds up to ``block`` rows and the per-group summaries have one
row per ``block`` rows. Sparse positions stay correct but make the
summaries as large as the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK = 1 << 16


def asof_lookup(left: DataFrame, right: DataFrame, by: list[str], left_pos: str, right_pos: str,
                value_cols: list[str], inclusive: bool = False, block: int = DEFAULT_BLOCK,
                out: str = "asof") -> DataFrame:
    """Attach to every ``left`` row a struct column ``out`` with ``value_cols``
    (and ``_pos``) of the last ``right`` row with equal ``by`` keys and
    ``right_pos < left_pos`` (``<=`` when ``inclusive``); NULL when none.

    Cost: one shuffle of left + right rows by (by, block) and two small
    aggregates; every window holds at most one block of rows.
    """
    blk = "_asof_blk"
    val = F.struct(*[F.col(c) for c in value_cols], F.col(right_pos).alias("_pos"))
    r = right.select(*by, F.col(right_pos).alias("_p"), val.alias("_v"))
    r = r.withColumn(blk, F.floor(F.col("_p") / block))
    # One aggregate over (group, block): does the block hold left rows, and
    # which is its last right row. Then, per group over these few rows, the
    # last right row of all earlier blocks is carried into each left block.
    marks = (left.select(*by, F.floor(F.col(left_pos) / block).alias(blk), F.lit(True).alias("_has_left"),
                         F.lit(None).cast("bigint").alias("_p"), F.lit(None).cast(r.schema["_v"].dataType).alias("_v"))
             .unionByName(r.withColumn("_has_left", F.lit(False))))
    summary = marks.groupBy(*by, blk).agg(F.max("_has_left").alias("_has_left"), F.max_by("_v", "_p").alias("_v"))
    w = Window.partitionBy(*by).orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
    carry = (summary.withColumn("_carry", F.last("_v", ignorenulls=True).over(w))
                    .filter(F.col("_has_left") & F.col("_carry").isNotNull())
                    .select(*by, blk, F.col("_carry").alias("_v")))
    # Per block: the carried row first, then right and left rows in position
    # order; on equal positions right rows sort first when inclusive.
    tie_right, tie_left = (0, 1) if inclusive else (1, 0)
    lrows = left.withColumn("_p", F.col(left_pos)).withColumn(blk, F.floor(F.col("_p") / block)) \
        .withColumn("_src", F.lit(tie_left)).withColumn("_is_left", F.lit(True))
    rrows = r.withColumn("_src", F.lit(tie_right)).withColumn("_is_left", F.lit(False))
    crows = carry.withColumn("_p", F.lit(None).cast("bigint")).withColumn("_src", F.lit(-1)) \
        .withColumn("_is_left", F.lit(False))
    allrows = lrows.unionByName(rrows, allowMissingColumns=True).unionByName(crows, allowMissingColumns=True)
    w2 = Window.partitionBy(*by, blk).orderBy(F.col("_p").asc_nulls_first(), "_src") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    res = allrows.withColumn(out, F.last("_v", ignorenulls=True).over(w2)).filter(F.col("_is_left"))
    return res.select(*left.columns, out)


def ordinal_within(df: DataFrame, by: list[str], pos: str, block: int = DEFAULT_BLOCK,
                   out: str = "ordinal") -> DataFrame:
    """1-based rank of each row by ``pos`` inside its ``by`` group (positions
    unique within a group), computed per (group, block) plus the row counts
    of earlier blocks."""
    blk = "_ord_blk"
    d = df.withColumn(blk, F.floor(F.col(pos) / block))
    counts = d.groupBy(*by, blk).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(*by, blk).orderBy(pos))
    d = d.withColumn("_rn", within).join(offsets, [*by, blk])
    return d.withColumn(out, (F.col("_off") + F.col("_rn")).cast("bigint")).drop(blk, "_rn", "_off")


def next_row(df: DataFrame, by: list[str], pos: str, value_cols: list[str], block: int = DEFAULT_BLOCK,
             out: str = "next") -> DataFrame:
    """Attach a struct column ``out`` with ``value_cols`` (and ``_pos``) of the row that
    follows in the ``by`` group by ``pos`` (positions unique within a group); NULL for
    the last one. A block hands its first row to the rows of the blocks before it, so
    no window spans a group."""
    blk = "_next_blk"
    here = F.struct(*[F.col(c) for c in value_cols], F.col(pos).alias("_pos"))
    d = df.withColumn(blk, F.floor(F.col(pos) / block)).withColumn("_here", here)
    firsts = d.groupBy(*by, blk).agg(F.min_by("_here", pos).alias("_first"))
    later = firsts.select(*by, blk, F.lead("_first").over(Window.partitionBy(*by).orderBy(blk)).alias("_later"))
    inside = F.lead("_here").over(Window.partitionBy(*by, blk).orderBy(pos))
    d = d.withColumn("_inside", inside).join(later, [*by, blk])
    return d.withColumn(out, F.coalesce("_inside", "_later")).drop(blk, "_here", "_inside", "_later")
