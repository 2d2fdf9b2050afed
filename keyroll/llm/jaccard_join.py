"""N-gram Jaccard join with a token-group matrix.

Texts with the same shingle set form a class; everything below works on
classes, so copies never multiply. Exactness rests on one fact: if two sets of
sizes a and b reach the similarity, they share one of the first
``a - ceil(t a) + 1`` tokens of the one and the ``b - ceil(t b) + 1`` of the
other under any fixed order of the tokens (here: rare before frequent).

1. ``probes``: per document the tokens in the lowest ``PROBE`` part of the hash
   range (and as many more as the prefix needs). A token is lonely if a single
   class holds it. A class with more lonely probe tokens than its set may lose
   is linked to nothing and is dropped: one shuffle of (token, class) rows.
2. ``prefixes``: the remaining classes are read again and held against each
   other with all their tokens: lonely ones first, as above, then the shared ones
   counted exactly, rarest first; the prefix is their beginning, a shorter one
   against sets that are not smaller.
3. Groups: classes are put next to a leader found by minimum hash and are linked to it
   if the exact similarity holds. Linked classes, and those that reach ``LOOSE`` per
   cent with a leader, form a group; what is linked already needs no pair inside it.
   The rest of a group's classes are held against each other by blocks: a task
   takes two blocks, passes over pairs by bitmaps, and gives back the links that join
   parts that were not yet joined, so never more than it has classes.
4. The token-group matrix: (token, group) rows, the union of the members'
   tokens. A class queries the groups its prefix meets; a group qualifies if the
   class's overlap with its union reaches ``ceil(t n)``; only qualifying groups
   are opened, and members that share a prefix token compared.
5. Connected components over the links of both kinds.

Two sets are compared by parity bitmaps first (one bit per token, tokens folded
in by exclusive-or): the differing bits are a lower bound of the symmetric
difference, so whole sets travel only for pairs that can be similar.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyroll.llm.common import sized, store
from keyroll.llm.graph import components
from keyroll.llm.shingles import mixed, shingle_set

# The similarity: 100 * intersection >= PERCENT * union.
PERCENT = 80
# Part of the hash range whose tokens are probed.
PROBE = 0.27
# Rounds of grouping, each with another minimum hash.
ROUNDS = 3
# Similarity per cent with a leader from which a class belongs to its group.
LOOSE = 50
# Classes and tokens of a block of a group, and bits of a bitmap per token.
BLOCK_CLASSES, BLOCK_TOKENS, SPREAD = 2048, 1 << 20, 8

_LIMIT = np.uint64(int(PROBE * 2 ** 64))
_SEEDS = [np.uint64(0xD1B54A32D192ED03 * (2 * i + 1) & 0xFFFFFFFFFFFFFFFF) for i in range(ROUNDS)]


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def _digest(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _probe(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Tokens below the limit, and as many further ones as the prefix needs."""
    low = int(np.searchsorted(tokens, _LIMIT, side="left"))
    return tokens[:max(low, prefix_length(len(tokens), percent))] if len(tokens) else tokens


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    flat = np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _probes(docs: DataFrame, text: str, doc_id: str, percent: int) -> DataFrame:
    """doc_id, written (hash of the text as it is), n (set size), fp (128-bit digest of the
    set), cl (its first 64 bits) and probe tokens per row; fp is null for an empty set."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("written"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py()) for t in batch.column(1)]
            fps = [_digest(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "written": batch.column(2), "n": pa.array([len(s) for s in sets], pa.int64()),
                "fp": pa.array(fps, pa.binary()),
                "cl": pa.array([int.from_bytes(f[:8], "little", signed=True) if f else None for f in fps], pa.int64()),
                "probe": _lists([_probe(s, percent) for s in sets])})

    return store(rows.mapInArrow(run, "doc_id bigint, written bigint, n bigint, fp binary, cl bigint, probe array<bigint>"), "probes")


def _need(n: Column, percent: int) -> Column:
    """Length of the prefix of a set of size n."""
    return n - F.ceil(n * percent / 100).cast("bigint") + 1


def _survivors(probes: DataFrame, percent: int) -> DataFrame:
    """Classes with fewer lonely probe tokens than their prefix is long, with
    the smallest id of a document that holds the class."""
    seen = probes.filter("n > 0").select("cl", F.explode("probe").alias("token"))
    lonely = (seen.groupBy("token").agg(F.min("cl").alias("cl"), F.max("cl").alias("last"))
              .filter("cl = last").groupBy("cl").agg(F.count(F.lit(1)).alias("lonely")))
    classes = probes.filter("n > 0").groupBy("fp", "cl", "n").agg(F.min("doc_id").alias("first_id"))
    left = classes.join(lonely, "cl", "left").filter(
        F.coalesce("lonely", F.lit(0)) < _need(F.col("n"), percent))
    return store(left.select("fp", "first_id"), "survivors")


def parity(tokens: np.ndarray) -> np.ndarray:
    """Bitmap of a power of two of bits, at least as many as tokens: bit
    ``token mod size`` tells whether an odd number of tokens fell on it."""
    size = max(64, 1 << (len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _sets(docs: DataFrame, survivors: DataFrame, text: str, doc_id: str, percent: int) -> DataFrame:
    """Whole sets of the surviving classes, read again from the texts: one row
    per class with its tokens, parity bitmap and minimum hashes."""
    keep = sized(survivors.select("first_id").distinct())
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.join(keep, rows.doc_id.eqNullSafe(keep.first_id), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for t in batch.column(0) if len(s := shingle_set(t.as_py()))]
            if sets:
                yield pa.RecordBatch.from_pydict({
                    "fp": pa.array([_digest(s) for s in sets], pa.binary()),
                    "cl": pa.array([int.from_bytes(_digest(s)[:8], "little", signed=True) for s in sets], pa.int64()),
                    "n": pa.array([len(s) for s in sets], pa.int64()), "tokens": _lists(sets), "bits": _lists([parity(s) for s in sets]),
                    "keys": _lists([np.array([mixed(s ^ k).min() for k in _SEEDS]) for s in sets])})

    found = rows.mapInArrow(run, "fp binary, cl bigint, n bigint, tokens array<bigint>, bits array<bigint>, keys array<bigint>")
    return store(found.join(survivors.select("fp"), "fp", "left_semi").dropDuplicates(["fp"]), "sets")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """fp, n, shared (the tokens that other surviving classes have too, rarest
    first), asks and told (how many of them belong to the prefix against a set of
    at most, and of at least its own size) and alone (the part of the tokens no
    other has). Classes without a prefix are dropped, first by counting their
    lonely tokens, so that only the others' tokens are ranked."""
    rows = sets.select("cl", F.explode("tokens").alias("token"))
    lonely = (rows.groupBy("token").agg(F.min("cl").alias("cl"), F.max("cl").alias("last"))
              .filter("cl = last").groupBy("cl").agg(F.count(F.lit(1)).alias("lonely")))
    left = (sets.select("fp", "cl", "n").join(lonely, "cl", "left")
            .withColumn("take", _need(F.col("n"), percent) - F.coalesce("lonely", F.lit(0))).filter("take > 0"))
    left = sized(store(left.select("fp", "n", "take"), "left"))
    rows = sets.select("fp", F.explode("tokens").alias("token")).join(left, "fp")
    # What is lonely here was shared with dropped classes only: it comes first.
    often = rows.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    ranked = (rows.join(often, "token").groupBy("fp", "n")
              .agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("r")))  # one document's own tokens
    # Against sets that are not smaller the overlap must be 2 t / (1 + t) of its own size.
    overlap = F.ceil(2 * percent * F.col("n") / (100 + percent)).cast("bigint")
    asks = (_need(F.col("n"), percent) - F.col("n") + F.size("r")).cast("int")
    told = (1 - overlap + F.size("r")).cast("int")
    return store(ranked.filter(asks > 0).select(
        "fp", "n", F.transform("r", lambda x: x["token"]).alias("shared"), asks.alias("asks"), told.alias("told"),
        ((F.col("n") - F.size("r")) / F.col("n")).alias("alone")), "prefixes")


def _sizes_fit(n_a: str, n_b: str, percent: int) -> Column:
    return (100 * F.least(n_a, n_b)) >= (percent * F.greatest(n_a, n_b))


def _bits_apart(a: Column, b: Column) -> Column:
    """Differing bits of two bitmaps; the longer is folded onto the shorter."""
    def fold(x: Column, other: Column) -> Column:
        half = F.size(other)
        halves = F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) > half, halves).otherwise(x)

    apart = F.zip_with(fold(a, b), fold(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(apart, F.lit(0), lambda total, x: total + x)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the similarity: by size and bitmaps first, the
    remaining ones token by token. Sizes within the similarity differ by less
    than two, so bitmaps differ by one fold at most."""
    def side(name: str, column: str) -> DataFrame:
        return sets.select(F.col("fp").alias(name), F.col("n").alias(f"n{name}"), F.col(column).alias(f"s{name}"))

    near = pairs.join(side("a", "bits"), "a").join(side("b", "bits"), "b").filter(_sizes_fit("na", "nb", percent))
    may_differ = (100 - percent) * (F.col("na") + F.col("nb"))
    near = store(near.filter((100 + percent) * _bits_apart(F.col("sa"), F.col("sb")) <= may_differ).select("a", "b"), "near")

    def whole(name: str) -> DataFrame:
        return side(name, "tokens").join(sized(near.select(name).distinct()), name, "left_semi")

    both = whole("a").join(sized(near), "a").join(whole("b"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.filter(100 * shared >= percent * (F.col("na") + F.col("nb") - shared)).select("a", "b")


def _leader_links(keyed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links member - leader of the classes of ``keyed`` (fp, n, alone, keys). In each round
    those without a leader meet the class of their bucket (equal minimum hash) with
    the fewest own tokens."""
    links = None
    for r in range(ROUNDS):
        bucket = keyed.select("fp", "n", "alone", F.get("keys", F.lit(r)).alias("key"))
        leaders = (bucket.groupBy("key").agg(F.min(F.struct("alone", "fp", "n")).alias("l"), F.count(F.lit(1)).alias("c"))
                   .filter("c > 1").select("key", F.col("l.fp").alias("b"), F.col("l.n").alias("nb")))
        free = bucket if links is None else bucket.join(links.select(F.col("a").alias("fp")), "fp", "left_anti")
        pairs = (free.select(F.col("fp").alias("a"), "n", "key").join(leaders, "key").filter("a <> b")
                 .filter(_sizes_fit("n", "nb", percent)).select("a", "b"))
        found = store(_verified(pairs, sets, percent), "group-links")
        links = found if links is None else links.unionByName(found)
    return links


def _groups(nodes: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links to leaders, the part (node, label) that they join, and the groups (node,
    label) of parts whose first classes are loosely similar to a leader."""
    keyed = store(nodes.select("fp", "n", "alone").join(sets.select("fp", "keys"), "fp"), "keyed")
    near = store(_leader_links(keyed, sets, percent), "near-links")
    parts = components(near)
    firsts = keyed.join(parts.filter("node <> label").select(F.col("node").alias("fp")), "fp", "left_anti")
    loose = store(_leader_links(store(firsts, "firsts"), sets, min(LOOSE, percent)), "loose-links")
    return near, parts, components(near.unionByName(loose))


def _spread(tokens: np.ndarray, size: int) -> np.ndarray:
    """Parity bitmap of ``size`` bits."""
    odd = np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def block_links(left: list[tuple], right: list[tuple] | None, percent: int) -> list[tuple]:
    """Links between the classes (fp, part, tokens) of two blocks, or of one, such that
    every two similar classes are joined by parts and links; at most one per join."""
    every = left + (right or [])
    if len(every) < 2:
        return []
    sizes = np.array([len(t) for _, _, t in every])
    size = max(64, 1 << int(SPREAD * sizes.max() - 1).bit_length())
    bits = np.array([_spread(t, size) for _, _, t in every])
    parent = {p: p for _, p, _ in every}

    def root(p):
        while parent[p] != p:
            parent[p] = p = parent[parent[p]]
        return p

    out = []
    begin = len(left) if right is not None else 0
    for x in range(len(left) if right is not None else len(every)):
        fp, part, tokens = every[x]
        ys = np.arange(max(begin, x + 1) if right is None else begin, len(every))
        ys = ys[100 * np.minimum(sizes[ys], sizes[x]) >= percent * np.maximum(sizes[ys], sizes[x])]
        if not len(ys):
            continue
        apart = np.bitwise_count(bits[ys] ^ bits[x]).sum(axis=1, dtype=np.int64)
        for y in ys[(100 + percent) * apart <= (100 - percent) * (sizes[ys] + sizes[x])].tolist():
            if root(part) == root(every[y][1]):
                continue
            shared = len(np.intersect1d(tokens, every[y][2], assume_unique=True))
            if 100 * shared >= percent * (len(tokens) + len(every[y][2]) - shared):
                parent[root(part)] = root(every[y][1])
                out.append((fp, every[y][0]))
    return out


def _inner_links(sets: DataFrame, parts: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Links between the parts of a group, block by block."""
    placed = groups.select("node", F.col("label").alias("g")).join(parts.select("node", F.col("label").alias("part")), "node", "left")
    placed = store(placed.withColumn("part", F.coalesce("part", "node")), "group-parts")
    members = placed.join(sets.select(F.col("fp").alias("node"), "n"), "node")
    split = members.groupBy("g").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("n"))
    split = split.filter("p <> q").select("g", F.greatest(
        F.ceil(F.col("size") / BLOCK_CLASSES), F.ceil(F.col("n") / BLOCK_TOKENS)).cast("int").alias("blocks"))
    rows = placed.join(sized(store(split, "split-groups")), "g").join(sets.select(F.col("fp").alias("node"), "tokens"), "node")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("g", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "part", "tokens")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [(bytes(f), bytes(p), np.asarray(t, dtype=np.int64).view(np.uint64))
               for f, p, t in zip(pdf["node"], pdf["part"], pdf["tokens"], strict=True)]
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        if i == j:
            links = block_links(own, None, percent)
        else:
            here = (pdf["block"] == i).tolist()
            links = block_links([r for r, h in zip(own, here, strict=True) if h], [r for r, h in zip(own, here, strict=True) if not h], percent)
        return pd.DataFrame({"a": pd.Series([a for a, _ in links], dtype="object"), "b": pd.Series([b for _, b in links], dtype="object")})

    return store(rows.groupBy("g", "i", "j").applyInPandas(compare, "a binary, b binary"), "inner-links")


def _matrix_links(nodes: DataFrame, groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between classes of different groups, by the token-group matrix. Of
    two classes the one that is not smaller asks."""
    placed = store(nodes.join(groups, nodes.fp == groups.node, "left")
                   .select("fp", "n", "shared", "asks", "told", "alone", F.coalesce("label", "fp").alias("g")), "placed")
    span = placed.groupBy("g").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count(F.lit(1)).alias("size"))
    asking = placed.select("fp", "n", "g", F.explode(F.slice("shared", F.lit(1), F.col("asks"))).alias("token"))
    asked = placed.filter("told > 0").select("fp", "n", "g", F.explode(F.slice("shared", F.lit(1), F.col("told"))).alias("token"))
    head = asked.groupBy("token", F.col("g").alias("h")).agg(F.min("n").alias("smallest"))
    # Groups a class's prefix meets.
    met = asking.join(head, "token").filter("h <> g and smallest <= n").select("fp", "n", "h").distinct()
    met = met.join(span.withColumnRenamed("g", "h"), "h").filter(100 * F.col("most") >= percent * F.col("n"))
    met = store(met.select("fp", "n", "h", "least", "size"), "met")
    # Bound: overlap of the class with the group's union, as large as with the
    # smallest member that fits. A group of one is its member, compared below.
    large = met.filter("size > 1")
    opened = sized(store(large.select("h").distinct(), "asked"))
    # A group's members have most tokens in common: one of them gives all of its own, the
    # others those that it lacks.
    members = placed.join(opened, placed.g == opened.h, "left_semi")
    first = members.groupBy("g").agg(F.min(F.struct("alone", "fp"))["fp"].alias("fp"))
    first = sized(store(placed.select("fp", F.col("shared").alias("told_already")).join(first, "fp").select(
        "g", F.col("fp").alias("first"), "told_already"), "firsts-of-groups"))
    own = F.when(F.col("fp") == F.col("first"), F.col("shared")).otherwise(F.array_except("shared", "told_already"))
    matrix = members.join(first, "g").select(F.col("g").alias("h"), F.explode(own).alias("token")).distinct()
    tokens = placed.select("fp", F.explode("shared").alias("token"))
    hits = (large.join(tokens, "fp").join(matrix, ["h", "token"]).groupBy("fp", "n", "least", "h")
            .agg(F.count(F.lit(1)).alias("hits")))
    fits = F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100).cast("bigint"))
    open_ = (hits.filter((100 + percent) * F.col("hits") >= percent * (F.col("n") + fits)).select("fp", "h")
             .unionByName(met.filter("size = 1").select("fp", "h")))
    # Open: smaller members of a qualifying group that share a prefix token. The
    # test is part of the join, so a pair is made once, however much it shares.
    queries = open_.join(placed.select("fp", "n", F.slice("shared", F.lit(1), F.col("asks")).alias("mine")), "fp")
    members = placed.filter("told > 0").select(F.col("fp").alias("b"), F.col("g"), F.col("n").alias("nb"),
                                               F.slice("shared", F.lit(1), F.col("told")).alias("theirs"))
    fit = (F.col("h") == F.col("g")) & (F.col("nb") <= F.col("n")) & _sizes_fit("n", "nb", percent)
    pairs = queries.join(members, fit & F.arrays_overlap("mine", "theirs")).select(F.col("fp").alias("a"), "b")
    return store(_verified(pairs, sets, percent), "matrix-links")


def components_of(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """The rows of :func:`labelled` without ``written``: one row per row of ``docs``."""
    return labelled(docs, text, doc_id, percent).drop("written")


def labelled(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``
    (smallest ``doc_id`` reachable by links, itself included) and ``written``, a
    hash of the text.

    A null or wordless text has an empty set and is linked to nothing, its own
    id is its component. Rows with equal texts are linked, whatever their ids;
    rows that share a ``doc_id`` but not a text are not. A null ``doc_id`` never
    names a component unless every row of it is null. An empty table gives no
    rows; other columns are not read.
    """
    probes = _probes(docs, text, doc_id, percent)
    sets = _sets(docs, _survivors(probes, percent), text, doc_id, percent)
    nodes = _prefixes(sets, percent)
    near, parts, groups = _groups(nodes, sets, percent)
    links = near.unionByName(_inner_links(sets, parts, groups, percent)).unionByName(_matrix_links(nodes, groups, sets, percent))
    labels = components(links)
    first = probes.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    linked = labels.join(first, labels.node == first.fp).select("node", "label", "first_id")
    least = linked.groupBy("label").agg(F.min("first_id").alias("least"))
    named = first.join(linked.join(least, "label").select(F.col("node").alias("fp"), "least"), "fp", "left")
    named = store(named.select("fp", F.coalesce("least", "first_id").alias("component_id")), "components")
    return probes.select("doc_id", F.col("n").alias("n_shingles"), "fp", "written").join(named, "fp", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "written")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """``docs`` without the rows whose component holds a smaller ``doc_id``.

    A row is meant by its id and text: of rows that share an id each goes or stays
    by its own text. A row without id goes if its component holds a row with one,
    otherwise all such rows stay. Rows without words stay. Of repeated rows (one id
    and one text) all stay: they are one document.
    """
    found = labelled(docs, text, doc_id, percent).filter(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    drop = sized(store(found.select(F.col("doc_id").alias("_id"), F.col("written").alias("_written")).distinct(), "dropped-rows"))
    same = docs[doc_id].cast("bigint").eqNullSafe(drop["_id"]) & (F.xxhash64(docs[text]) == drop["_written"])
    return docs.join(drop, same, "left_anti")
