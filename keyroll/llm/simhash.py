"""Document fingerprints: SimHash with permuted block tables, in built-in functions.

Terms are words (A-Z, a-z alike) and pairs of neighbouring words. Every
occurrence votes: where a bit of its 128-bit hash is set, its weight counts for
that bit of the fingerprint, else against it. Two counters share a 64-bit sum,
so 64 sums per text hold all votes; texts are exploded to words and the votes
added before any shuffle. The weights bound a counter by the bytes of a text, so
no counter can run over into its neighbour.

Search: the fingerprint is cut into ``BLOCKS`` blocks. Fingerprints that differ
in at most ``RADIUS`` bits agree in ``BLOCKS - RADIUS`` blocks at least; there is
one table per choice of so many blocks, which are the permuted key's head, and an
equi-join per key finds all neighbours. Distinct fingerprints only are searched.
"""

from __future__ import annotations

import json
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyroll.llm.common import store, words

BITS = 128
LANES = 32
LOW = 0x00000001_00000001
PAIR_WEIGHT = 1
# Weight of a word by its length: common words are short.
WEIGHTS = (0, 0, 0, 1, 1, 2, 2, 3, 4)
RADIUS, BLOCKS = 6, 8
BUCKETS_PER_PARTITION, MOST_BUCKETS = 8, 1 << 16


def digest(text: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a text."""
    return [F.xxhash64(text), F.xxhash64(text, F.lit("again"))]


def _lane(h: Column, k: int) -> Column:
    """Bits k and k + 32 of a hash in the two halves of a long."""
    return F.shiftrightunsigned(h, k).bitwiseAND(F.lit(LOW))


def votes(texts: DataFrame, text: str, *keys: str) -> DataFrame:
    """Per key the fingerprint (f1, f2: two longs) of its text. A key whose texts are
    all equal has that text's fingerprint however often it is repeated: votes are then
    a multiple. A text without words has fingerprint 0."""
    w = words(F.lower(text))
    after = F.concat(F.slice(w, F.lit(2), F.size(w)), F.array(F.lit("")))
    rows = texts.select(*keys, F.explode_outer(F.arrays_zip(w.alias("w"), after.alias("after"))).alias("t"))
    rows = rows.select(*keys, F.col("t.w").alias("w"), F.col("t.after").alias("after"))
    by_length = F.array(*[F.lit(x).cast("bigint") for x in WEIGHTS])
    rows = rows.select(
        *keys, F.when(F.col("w").isNotNull(), F.get(by_length, F.least(F.length("w"), F.lit(len(WEIGHTS) - 1)))).otherwise(0).alias("n"),
        F.when(F.col("w").isNotNull(), F.lit(PAIR_WEIGHT).cast("bigint")).otherwise(0).alias("m"),
        *[F.xxhash64("w", F.lit(s)).alias(f"w{s}") for s in (1, 2)], *[F.xxhash64("w", "after", F.lit(s)).alias(f"p{s}") for s in (1, 2)])
    sums = [F.sum(F.col("n") * _lane(F.col(f"w{s}"), k) + F.col("m") * _lane(F.col(f"p{s}"), k)).alias(f"s{s}_{k}")
            for s in (1, 2) for k in range(LANES)]
    summed = rows.groupBy(*keys).agg(F.sum(F.col("n") + F.col("m")).alias("total"), *sums)

    def bits(s: int) -> Column:
        out = []
        for k in range(LANES):
            both = F.col(f"s{s}_{k}")
            for at, count in ((k, both.bitwiseAND(F.lit(0xFFFFFFFF))), (k + LANES, F.shiftrightunsigned(both, 32))):
                out.append(F.shiftleft((2 * count > F.col("total")).cast("bigint"), at))
        return reduce(lambda a, b: a.bitwiseOR(b), out)

    return summed.select(*keys, bits(1).alias("f1"), bits(2).alias("f2"))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """(d1, d2, f1, f2) per distinct text of ``docs``, by its digest (null: empty text)."""
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(body.alias("body")).select("body", *[c.alias(n) for c, n in zip(digest(F.col("body")), ("d1", "d2"))])
    return store(votes(keyed, "body", "d1", "d2"), "fingerprints")


def likeness(a: list[Column], b: list[Column]) -> Column:
    """Share of equal bits."""
    return (F.lit(BITS) - distance(a, b)) / F.lit(float(BITS))


def distance(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b)])


def as_text(f: list[Column]) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(x), 16, "0") for x in f]))


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, after, row): the text of the row that follows in ascending order of
    (doc_id, digest of the text), nulls first, after the last one that of the first.

    Rows are dealt to buckets of consecutive keys; a bucket also gets the first row
    of the one behind it, so no window leaves its bucket. The buckets' first keys come
    from Spark's own range partitioning of the keys and are all the driver holds.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.struct("doc_id", F.xxhash64("text").alias("h")))
    buckets = min(MOST_BUCKETS, BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = rows.select("key").repartitionByRange(buckets, "key").groupBy(F.spark_partition_id()).agg(F.min("key").alias("key"))
    found = [r["key"].asDict() for r in ranges.collect()]
    found.sort(key=lambda k: (k["doc_id"] is not None, k["doc_id"], k["h"]))
    kind = rows.schema["key"].dataType.simpleString()
    firsts = F.from_json(F.lit(json.dumps(found)), f"array<{kind}>")
    steps = [1 << i for i in range(len(found).bit_length() - 1, -1, -1)] if found else []
    # Binary search: the last bucket whose first key is not above the row's.
    at = F.aggregate(F.array(*[F.lit(s) for s in steps]) if steps else F.array().cast("array<int>"), F.lit(0), lambda i, s: i + F.when(
        F.coalesce(F.get(firsts, i + s) <= F.col("key"), F.lit(False)), s).otherwise(0))
    n = max(1, len(found))
    places = F.when(F.get(firsts, F.col("at")) == F.col("key"), F.array(
        F.struct(F.col("at").alias("bucket"), F.lit(0).alias("ghost")),
        F.struct(((F.col("at") + n - 1) % n).cast("int").alias("bucket"), F.lit(1).alias("ghost"))))
    places = places.otherwise(F.array(F.struct(F.col("at").alias("bucket"), F.lit(0).alias("ghost"))))
    dealt = rows.withColumn("at", at).select("key", "doc_id", "text", F.explode(places).alias("p")).select(
        "key", "doc_id", "text", "p.bucket", "p.ghost")
    order = Window.partitionBy("bucket").orderBy("ghost", "key")
    out = dealt.select("doc_id", "text", "ghost", F.lead("text").over(order).alias("after"),
                       (F.col("bucket") * F.lit(1 << 40) + F.row_number().over(order)).alias("row"))
    return out.filter("ghost = 0").drop("ghost")


def compare(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (32 hex
    digits), near_edited and near_next, and the two longs f1, f2.

    The edited text has its last quarter replaced by as many code points of the row
    that follows (all of it, if it has fewer). A null text is empty and, like any
    text without words, has fingerprint 0; rows of equal id follow each other in
    order of their texts' digests; equal rows are all returned; a null id comes
    first; other columns are not read; an empty table gives no rows.
    """
    known = fingerprints(docs, text)
    n, cut = F.length("text"), F.shiftright(F.length("text"), 2)
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("after"), F.lit(1), cut))
    rows = with_next(docs, doc_id, text).withColumn("edited", edited)
    keys = {"row": F.col("row"), "doc_id": F.col("doc_id"), "n_chars": n.cast("bigint"), "sha": F.unhex(F.sha2("edited", 256))}
    for side, column in (("own", "text"), ("next", "after")):
        keys |= {f"{side}{i}": c for i, c in enumerate(digest(F.col(column)))}
    rows = rows.select("edited", *[c.alias(k) for k, c in keys.items()])
    made = votes(rows, "edited", *keys)
    for side in ("own", "next"):
        other = known.select(F.col("d1").alias("x1"), F.col("d2").alias("x2"), *[F.col(f).alias(f"{side}_{f}") for f in ("f1", "f2")])
        made = made.join(other, (F.col(f"{side}0") == F.col("x1")) & (F.col(f"{side}1") == F.col("x2"))).drop("x1", "x2")
    own, after, changed = ([F.col(f"{p}f1"), F.col(f"{p}f2")] for p in ("own_", "next_", ""))
    return made.select("doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), as_text(own).alias("fingerprint"),
                       as_text(changed).alias("edited_fingerprint"), likeness(own, changed).alias("near_edited"),
                       likeness(own, after).alias("near_next"), own[0].alias("f1"), own[1].alias("f2"))


def counted(compared: DataFrame, query: Column) -> DataFrame:
    """``compared`` with ``n_near``: for the rows that ``query`` picks, how many other
    fingerprints of the table lie within ``RADIUS`` bits (other rows: null)."""
    compared = store(compared, "compared")
    asks = F.coalesce(query, F.lit(False))
    asked = compared.filter(asks).select("f1", "f2").distinct()
    found = neighbours(asked, compared.select("f1", "f2").distinct()).groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n"))
    found = asked.join(found, ["f1", "f2"], "left").select("f1", "f2", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_near"))
    # Only the rows that ask are dealt by fingerprint: a large group of copies shares one.
    out = compared.filter(asks).join(found, ["f1", "f2"], "left").select(*compared.columns, "n_near")
    rest = compared.filter(~asks).withColumn("n_near", F.lit(None).cast("bigint"))
    return out.unionByName(rest).drop("f1", "f2")


def _block(j: int) -> Column:
    width = BITS // BLOCKS
    side, at = divmod(j * width, 64)
    return F.shiftrightunsigned(F.col(("f1", "f2")[side]), at).bitwiseAND(F.lit((1 << width) - 1))


def tables(fingerprints: DataFrame) -> DataFrame:
    """(f1, f2, head, last): a fingerprint's row in every block table; ``head`` is the table's
    number and blocks, ``last`` the last of these blocks."""
    rows = []
    for i, chosen in enumerate(combinations(range(BLOCKS), BLOCKS - RADIUS)):
        head = reduce(lambda key, j: F.shiftleft(key, BITS // BLOCKS).bitwiseOR(_block(j)), chosen, F.lit(i).cast("bigint"))
        rows.append(F.struct(head.alias("head"), F.lit(chosen[-1]).alias("last")))
    return fingerprints.select("f1", "f2", F.explode(F.array(*rows)).alias("t")).select("f1", "f2", "t.*")


def neighbours(queries: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """All pairs (f1, f2 of a query, g1, g2 of another fingerprint, distance) within
    ``RADIUS`` bits. Both sides hold distinct fingerprints. A pair is made in the
    first table in which both agree, so once."""
    q, g = tables(queries).alias("q"), tables(fingerprints).select(
        F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("head").alias("g_head")).alias("g")
    differ = [F.col("f1").bitwiseXOR(F.col("g1")), F.col("f2").bitwiseXOR(F.col("g2"))]
    far = F.bit_count(differ[0]) + F.bit_count(differ[1])
    width = BITS // BLOCKS
    equal = []
    for j in range(BLOCKS):
        side, at = divmod(j * width, 64)
        same = F.shiftrightunsigned(differ[side], at).bitwiseAND(F.lit((1 << width) - 1)) == 0
        equal.append((same & (F.lit(j) <= F.col("last"))).cast("int"))
    first = reduce(lambda a, b: a + b, equal) == BLOCKS - RADIUS
    pairs = q.join(g, (F.col("head") == F.col("g_head")) & (far > 0) & (far <= RADIUS) & first)
    return pairs.select("f1", "f2", "g1", "g2", far.alias("distance"))
