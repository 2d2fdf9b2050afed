"""Player index: tables from players to their runs.

* ``player_runs``   one document per (player, run), in hash buckets of the player
                    and sorted by player, patch, dungeon and board key: the runs of a
                    player, or of a player in one dungeon, are one range of one bucket
* ``player_names``  one document per (name, player), sorted by the lower-cased name: a
                    search by prefix is one range
* ``players``       one document per player: the name of their latest run

A very active player's documents span many files of their bucket; no read holds
more than the range it asks for, and the writes sort by range, not by player.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyroll.operators.extras import player_runs as exploded
from keyroll.session import scratch_path
from keyroll.sources import documents as DT

BUCKETS = 64
SEARCH_PK = "PLAYER#SEARCH"
# Behind every text that begins with a prefix.
LAST = "\U0010ffff"


def runs_pk(player_id: Column) -> Column:
    return F.concat(F.lit("DUNGEON#PLAYER#"), player_id)


def id_pk(player_id: Column) -> Column:
    return F.concat(F.lit("PLAYER_ID#"), player_id)


def _initial(name: Column) -> Column:
    """Names of one first letter lie in one partition."""
    return F.pmod(F.coalesce(F.ascii(name), F.lit(0)), F.lit(BUCKETS)).cast("int")


def run_documents(docs: DataFrame) -> DataFrame:
    """Of leaderboard documents one document per (player, run)."""
    version = [c for c in ("created_at", "batch_id") if c in docs.columns]
    p = docs.select("patch", "dungeon_id", "combatlog_hash", "sk", "keylevel", "date", "intime", *version,
                    F.explode("player_damage").alias("p"))
    sk = F.concat_ws("#", "patch", F.col("dungeon_id").cast("string"), "sk")
    pk = runs_pk(F.col("p.player_id"))
    return p.select(pk.alias("pk"), sk.alias("sk"), F.concat_ws("#", pk, sk).alias("place"), F.col("p.player_id").alias("player_id"),
                    F.col("p.player_name").alias("player_name"), F.col("p.damage").alias("damage"), "patch", "dungeon_id",
                    "combatlog_hash", F.col("sk").alias("board_sk"), "keylevel", "date", "intime", *version,
                    DT.bucket(F.col("p.player_id"), BUCKETS).alias("bucket"))


def name_documents(docs: DataFrame) -> DataFrame:
    """One document per (name, player): the player's id, for reads that follow."""
    runs = run_documents(docs)
    found = runs.groupBy("player_name", "player_id").agg(*[F.max(c).alias(c) for c in ("created_at", "batch_id")])
    low = F.lower("player_name")
    return found.select(F.lit(SEARCH_PK).alias("pk"), F.concat_ws("#", low, "player_id").alias("sk"), "player_name", "player_id",
                        "created_at", "batch_id", _initial(low).alias("initial"))


def player_documents(docs: DataFrame) -> DataFrame:
    """One document per player: the name in the latest run (by date, then run hash) of
    the batch. A batch with older runs of a known player must not come last."""
    last = F.max(F.struct("date", "combatlog_hash", "player_name", "created_at", "batch_id")).alias("l")
    found = run_documents(docs).groupBy("player_id").agg(last)
    key = id_pk(F.col("player_id"))
    return found.select(key.alias("pk"), key.alias("sk"), "player_id", "l.player_name", F.col("l.date").alias("last_date"),
                        "l.created_at", "l.batch_id", DT.bucket(F.col("player_id"), BUCKETS).alias("bucket"))


class PlayerIndex:
    """The three tables under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.runs = DT.DocumentTable(spark, f"{root}/player_runs", {"bucket": "int"}, sort="place")
        self.names = DT.DocumentTable(spark, f"{root}/player_names", {"initial": "int"})
        self.players = DT.DocumentTable(spark, f"{root}/players", {"bucket": "int"}, sort="pk")

    def upsert(self, docs: DataFrame) -> None:
        """Add leaderboard documents (with ``created_at`` and ``batch_id``); they are made once
        and stored, for each of the tables reads them."""
        given = scratch_path(self.spark, "player-docs")
        columns = ("patch", "dungeon_id", "combatlog_hash", "sk", "keylevel", "date", "intime", "created_at", "batch_id")
        names = F.transform("player_damage", lambda p: F.struct(p["player_id"].alias("player_id"), p["player_name"].alias("player_name"),
                                                                p["damage"].alias("damage")))
        docs.select(*columns, names.alias("player_damage")).write.parquet(given)
        docs = self.spark.read.parquet(given)
        self.runs.upsert(run_documents(docs))
        self.names.upsert(name_documents(docs))
        self.players.upsert(player_documents(docs))

    def _range(self, player_id: str, prefix: str) -> DataFrame:
        place = f"DUNGEON#PLAYER#{player_id}#{prefix}"
        return self.runs.read().filter(
            (F.col("bucket") == DT.bucket(F.lit(player_id), BUCKETS)) & F.col("place").startswith(place) & (F.col("player_id") == player_id))

    def dungeon_runs(self, player_id: str, patch: str, dungeon_id: int) -> DataFrame:
        """All runs of a player in a dungeon and patch, best first."""
        return self._range(player_id, f"{patch}#{dungeon_id}#").orderBy(F.col("place").desc())

    def best_per_dungeon(self, player_id: str, patch: str) -> DataFrame:
        """A player's best run in every dungeon of a patch."""
        best = F.max(F.struct("board_sk", "combatlog_hash", "keylevel", "damage")).alias("b")
        found = self._range(player_id, f"{patch}#").groupBy("dungeon_id").agg(best, F.count(F.lit(1)).alias("runs"))
        return found.select("dungeon_id", F.col("b.board_sk").alias("sk"), "b.combatlog_hash", "b.keylevel", "b.damage", "runs")

    def recent(self, player_id: str, limit: int) -> DataFrame:
        """A player's most recent runs (date, then run hash)."""
        return self._range(player_id, "").orderBy(F.col("date").desc(), "combatlog_hash").limit(limit)

    def by_id(self, player_id: str) -> DataFrame:
        """A player with their number of runs and latest date; empty if unknown."""
        key = f"PLAYER_ID#{player_id}"
        known = self.players.get(F.col("bucket") == DT.bucket(F.lit(player_id), BUCKETS), key, key)
        runs = self._range(player_id, "").groupBy("player_id").agg(F.count(F.lit(1)).alias("runs"), F.max("date").alias("last_date"))
        return known.select("player_id", "player_name").join(runs, "player_id")

    def search(self, prefix: str, limit: int, after: str | None = None) -> DataFrame:
        """Players whose name begins with ``prefix`` whatever the case, in order of
        (name, id), ``limit`` at a time behind the sort key ``after``."""
        low = prefix.lower()
        rows = self.names.read()
        if low:
            rows = rows.filter((F.col("initial") == _initial(F.lit(low))) & (F.col("sk") >= low) & (F.col("sk") < low + LAST))
        if after is not None:
            rows = rows.filter(F.col("sk") > after)
        return rows.orderBy("sk").limit(limit).select("sk", "player_name", "player_id")
