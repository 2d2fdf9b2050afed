"""Serving reads over the gold tables.

Pages are keyset pages of ten rows read with one row of look-ahead: a
filtered ``orderBy().limit(11)`` becomes Spark's TakeOrderedAndProject
(per-task top 11, then a final top 11), never a full sort. Over the stored
board (:func:`board_page`) the scan is cut to the board's partitions and to a
range of the sort key that holds the page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyroll.functions import scoring as S
from keyroll.operators.sizing import rank_within
from keyroll.sources import documents as DT

# K7: what a page shows of each document.
PAGE_COLUMNS = ("player_damage", "duration_text", "deaths", "affixes", "keylevel", "dungeon_name",
                "dungeon_id", "combatlog_hash", "intime")


def keys_page(docs: DataFrame, pk_value: str, next_sk: str | None = None, prev_sk: str | None = None,
              index: str = "pk", columns=PAGE_COLUMNS) -> DataFrame:
    """K1-K7: one page of a leaderboard partition.

    ``index='pk'`` reads the overall board (K1), ``'gsi1'`` the per-dungeon
    board (K2). ``next_sk`` pages forward (``sk < cursor``, K3) and wins over
    ``prev_sk`` (``sk > cursor`` read ascending, K4). Every returned row
    carries the page fields ``first_sk, last_sk, first_page, last_page`` and
    its display position ``pos`` (1 = largest sk)."""
    key, sk = ("pk", "sk") if index == "pk" else ("gsi1pk", "gsi1sk")
    base = docs.filter(F.col(key) == F.lit(pk_value))
    limit = S.PAGE_SIZE + 1
    if next_sk:
        rows, backward, first_page = base.filter(F.col(sk) < F.lit(next_sk)), False, False
    elif prev_sk:
        rows, backward, first_page = base.filter(F.col(sk) > F.lit(prev_sk)), True, False
    else:
        rows, backward, first_page = base, False, True
    read_order = F.col(sk).asc() if backward else F.col(sk).desc()
    read = rows.orderBy(read_order).limit(limit)
    # Everything below runs on at most 11 rows.
    whole = Window.partitionBy(F.lit(1))
    rn = F.row_number().over(whole.orderBy(read_order))
    t = read.withColumn("_rn", rn).withColumn("_n", F.count(F.lit(1)).over(whole))
    t = t.filter(F.col("_rn") <= S.PAGE_SIZE)
    hit = F.col("_n") == limit
    last_page = F.lit(False) if backward else ~hit
    first = (~hit) if backward else F.lit(first_page)
    t = (t.withColumn("first_sk", F.max(sk).over(whole)).withColumn("last_sk", F.min(sk).over(whole))
          .withColumn("first_page", first).withColumn("last_page", last_page)
          .withColumn("pos", F.row_number().over(whole.orderBy(F.col(sk).desc()))))
    return t.select("pos", *columns, sk, "first_sk", "last_sk", "first_page", "last_page")


def board_page(board: DT.DocumentTable, patch: str, dungeon_id: int | None = None, next_sk: str | None = None,
               prev_sk: str | None = None, columns=PAGE_COLUMNS) -> DataFrame:
    """K1-K7 from the stored board: the page of a patch, or of one of its dungeons."""
    where = F.col("patch") == patch
    if dungeon_id is not None:
        where = where & (F.col("dungeon_id") == dungeon_id)
    rows = board.span(where, S.PAGE_SIZE + 1, below=next_sk, above=prev_sk)
    if dungeon_id is not None:
        return keys_page(rows, f"LOG#KEY#{patch}#{dungeon_id}", next_sk, prev_sk, index="gsi1", columns=columns)
    return keys_page(rows, f"LOG#KEY#{patch}", next_sk, prev_sk, columns=columns)


def stored_run_detail(details: DT.DocumentTable, run_hash: str) -> DataFrame:
    """Point read of one run's stored breakdown, one bucket and in it one range
    of keys; empty when missing."""
    key = f"LOG#KEY#{run_hash}#OVERALL_PLAYER_DAMAGE"
    return details.get(DT.of_bucket(key), key, key)


def page_numbers(docs: DataFrame, index: str = "pk") -> DataFrame:
    """K9: page number (0-based, ten rows a page) of every document on its
    board, computed for all boards at once with a skew-safe rank (a board
    may hold most of the rows, so no window partitioned by board)."""
    key, sk = ("pk", "sk") if index == "pk" else ("gsi1pk", "gsi1sk")
    ranked = rank_within(docs.select(key, sk, "combatlog_hash"), key, sk, descending=True)
    return ranked.withColumn("page", F.floor((F.col("rank") - 1) / S.PAGE_SIZE).cast("bigint"))
