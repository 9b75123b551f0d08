"""Near copies of the pipeline: SimHash blocks, and beyond their radius rare shingles, verified on whole shingle sets.

Texts are alike if the Jaccard similarity of their sets of five-word shingles is 4/5 or more. Equal sets are one node.
Three bits of a fingerprint do not reach that far (README has figures), so likely links come from two sources:

* SimHash fingerprints within ``simhash.MAX_BITS``, by their pigeonhole blocks;
* shingles in common. Of two such sets each holds four fifths of the other, so both have a shingle in common among their
  first n - ceil(4n/5) + 1, in any order that all sets share: looking at these alone finds every pair. The order puts
  frequent shingles last, which keeps buckets small; frequencies are counted over all texts in ``SLOTS`` slots. In a
  bucket, bitmaps of shingle parities (no more bits differ than shingles do) tell which pairs can be alike.

A bucket's task emits a spanning forest of its likely links, never all pairs. Their classes hold the true ones. The
forest's edges are verified on the sets; where some fail, the members of the likely class are compared on their sets
inside tasks, class against class, until nothing joins them. So no link is lost and none is made up, and what is
shuffled is linear in the buckets but for buckets and unsettled classes above ``BUCKET`` members, which are compared
as pairs of chunks.

Defined results: null texts and texts without a word are one class; texts of fewer words than a shingle are one shingle;
of a class the row with the smallest id stays, null ids last, and rows alike in all columns count as one; clashing
column names do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.llm import common, simhash

SHINGLE = 5
SEED = 42
#: Longs of a bitmap at least; a bitmap has a bit for each shingle or more, and folds to a smaller one.
PLANES = 16
#: Frequencies are counted in so many slots, whatever the input: 4 MB in each worker.
SLOTS = 1 << 22
#: Members of a bucket or class that one side of a comparison holds.
BUCKET = 1024


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The text's distinct word shingles as sorted hashes."""
    return np.unique(simhash.shingle_hashes(text, shingle, SEED))


def node(grams: np.ndarray) -> int:
    h = xxhash.xxh64_intdigest(grams.tobytes(), SEED)
    return h - (1 << 64) if h >> 63 else h


def bitmap(grams: np.ndarray) -> np.ndarray:
    bits = 64 * PLANES
    while bits < len(grams):
        bits *= 2
    ones = np.bincount((grams >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(ones.astype(np.uint8), bitorder="little").view(np.int64)


def prefix(grams: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The shingles to look at, the rarest by ``levels``; ties by hash."""
    if not len(grams):
        return grams
    rare = np.argsort(levels[(grams & np.uint64(SLOTS - 1)).astype(np.int64)], kind="stable")
    return grams[rare[: len(grams) - -(-4 * len(grams) // 5) + 1]]


class Likely:
    """The bitmaps of a group of sets; each longer one folds to the next shorter."""

    def __init__(self, sizes: np.ndarray, bits: pa.ListArray):
        offsets = bits.offsets.to_numpy()
        self.n, self.longs, values = sizes, np.diff(offsets), bits.values.to_numpy().view(np.uint64)
        self.place = np.zeros(len(sizes), np.int64)
        self.planes: dict[int, np.ndarray] = {}
        for k in np.unique(self.longs).tolist():
            own = np.flatnonzero(self.longs == k)
            self.place[own] = np.arange(len(own))
            self.planes[k] = values[offsets[own][:, None] + np.arange(k)]

    def near(self, i: int, others: np.ndarray) -> np.ndarray:
        """Which of ``others`` can be alike to ``i``: sizes within 4/5, and few enough differing bits."""
        n, m = self.n[i], self.n[others]
        others = others[5 * np.minimum(n, m) >= 4 * np.maximum(n, m)]
        longs, found = int(self.longs[i]), []
        for k in np.unique(self.longs[others]).tolist():
            at = others[self.longs[others] == k]
            theirs, own = self.planes[k][self.place[at]], self.planes[longs][self.place[i]]
            short = min(k, longs)
            theirs = np.bitwise_xor.reduce(theirs.reshape(len(at), -1, short), axis=1)
            own = np.bitwise_xor.reduce(own.reshape(-1, short), axis=0)
            found.append(at[9 * np.bitwise_count(theirs ^ own).sum(axis=1, dtype=np.int64) <= n + self.n[at]])
        return np.concatenate(found) if found else others


def likely_forest(nodes: np.ndarray, sizes: np.ndarray, bits: pa.ListArray) -> list[tuple[int, int]]:
    """Edges that connect all likely links of a group."""
    likely, rest, edges = Likely(sizes, bits), np.arange(len(nodes)), []
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = likely.near(i, rest)
            if len(hit):
                edges += [(int(nodes[i]), int(nodes[j])) for j in hit.tolist()]
                rest = np.setdiff1d(rest, hit, assume_unique=True)
                queue += hit.tolist()
    return edges


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    return 9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y))


def joining_edges(nodes: np.ndarray, classes: np.ndarray, sizes: np.ndarray, bits: pa.ListArray, grams: pa.ListArray) -> list[tuple[int, int]]:
    """Verified edges that join the classes of a group wherever two of their members are alike."""
    likely, rest, edges = Likely(sizes, bits), np.arange(len(nodes)), []
    ends, values = grams.offsets.to_numpy(), grams.values.to_numpy()
    while len(rest):
        mine = classes[rest] == classes[rest[0]]
        queue, rest = rest[mine].tolist(), rest[~mine]
        while queue and len(rest):
            i = queue.pop()
            joined: set[int] = set()
            for j in likely.near(i, rest).tolist():
                if classes[j] not in joined and alike(values[ends[i] : ends[i + 1]], values[ends[j] : ends[j + 1]]):
                    joined.add(int(classes[j]))
                    edges.append((int(nodes[i]), int(nodes[j])))
            if joined:
                new = np.isin(classes[rest], list(joined))
                queue += rest[new].tolist()
                rest = rest[~new]
    return edges


def levels(texts: DataFrame) -> np.ndarray:
    """For each slot how frequent its shingles are: thirds of a power of two, counted over all ``texts``."""

    def count(batches):
        n = np.zeros(SLOTS, np.int64)
        for b in batches:
            grams = [shingles(t) for t in b.column(0).to_pylist()]
            at, own = np.unique((np.concatenate(grams) & np.uint64(SLOTS - 1)).astype(np.int64), return_counts=True) if grams else ([], [])
            n[at] += own
        at = np.flatnonzero(n)
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(n[part])], names=["slot", "n"])

    counted = texts.mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1")
    found = counted.select("slot", F.floor(3 * F.log2("n")).cast("byte").alias("level")).toArrow()
    out = np.zeros(SLOTS, np.uint8)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def likely_links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) whose classes hold all pairs of ``nodes`` (node, n, fp, bits, prefix) that are alike."""
    prints = common.materialize(nodes.groupBy("fp").agg(F.min("node").alias("low")))
    close = simhash.links(prints.select("fp"), prints.count())
    end = lambda s: prints.select(F.col("fp").alias(s), F.col("low").alias(f"{s}2"))
    near = close.join(end("a"), "a").join(end("b"), "b").select(F.col("a2").alias("a"), F.col("b2").alias("b"))
    same = nodes.select("fp", F.col("node").alias("b")).join(prints, "fp").select(F.col("low").alias("a"), "b").where("a <> b")

    grams = nodes.select(F.explode("prefix").alias("gram"), "node")
    shared = common.materialize(grams.groupBy("gram").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("gram"))
    met = common.materialize(grams.join(shared.hint("merge"), "gram", "left_semi"))
    met = met.join(nodes.select("node", "n", "bits").hint("merge"), "node").select("gram", "node", "n", "bits")
    dealt = common.chunked(common.materialize(met), ["gram"], "node", BUCKET).drop("side")
    rare = common.by_group(dealt, ["gram", "i", "j"], likely_forest, "a long, b long")
    ordered = near.unionAll(same).unionAll(rare).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return common.materialize(ordered.distinct())


def verified(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """The edges whose ends are alike by ``sets`` (node, grams)."""
    side = lambda s: sets.select(F.col("node").alias(s), F.col("grams").alias(f"g{s}")).hint("merge")
    met = edges.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ga", "gb")

    def judge(batches):
        for b in batches:
            keep = [alike(x.values.to_numpy(), y.values.to_numpy()) for x, y in zip(b.column(2), b.column(3))]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return common.materialize(met.mapInArrow(judge, "a long, b long"))


def classed(members: DataFrame, edges: DataFrame) -> DataFrame:
    """``members`` with column class: the smallest node of their class by ``edges``."""
    found = simhash.components(edges).select("node", F.col("root").alias("class"))
    return members.join(found, "node", "left").withColumn("class", F.coalesce("class", "node"))


def representatives(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Of each class of near copies in ``df`` the row with the smallest id, all columns as they are.

    Rows are told apart by 128 bits of hash of all their columns; rows alike in all of them count as one.
    """
    spark = df.sparkSession
    common.ship(spark)
    cells = [*(F.col(f"`{c}`") for c in df.columns), *(F.col(f"`{c}`").isNull() for c in df.columns)]
    k1, k2 = F.xxhash64(*cells), F.xxhash64(F.lit(1), *cells)
    plain = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), k1.alias("k1"), k2.alias("k2"))
    shared = spark.sparkContext.broadcast(levels(plain.select("text")))
    names = ["doc_id", "k1", "k2", "node", "n", "fp", "bits", "prefix"]

    def describe(batches):
        longs = pa.list_(pa.int64())
        for b in batches:
            raw = [simhash.shingle_hashes(t, SHINGLE, SEED) for t in b.column(1).to_pylist()]
            found = [np.unique(h) for h in raw]
            fps = np.array(list(map(simhash.majority, raw)), np.uint64).view(np.int64)
            lists = [pa.array([f(g).view(np.int64) for g in found], longs) for f in (bitmap, lambda g: prefix(g, shared.value))]
            cols = [pa.array(map(node, found), pa.int64()), pa.array(map(len, found), pa.int64()), pa.array(fps), *lists]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), *cols], names=names)

    kind = T.StructType().add("doc_id", df.schema[doc_id].dataType)
    for c in names[1:]:
        kind = kind.add(c, T.LongType() if c not in ("bits", "prefix") else T.ArrayType(T.LongType()))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    same = [F.max(c).alias(c) for c in ("n", "fp", "bits", "prefix")]  # one value for a node
    nodes = plain.mapInArrow(describe, kind).groupBy("node").agg(F.min(order).alias("best"), *same)
    nodes = common.materialize(nodes)
    best = nodes.select("node", "best.none", "best.doc_id", "best.k1", "best.k2")

    links = likely_links(nodes)
    likely = common.materialize(classed(links.select(F.col("a").alias("node")).unionAll(links.select(F.col("b").alias("node"))).distinct(), links).withColumnRenamed("class", "root"))
    wanted = common.materialize(likely.select("node").join(best.select("node", "k1", "k2"), "node").select("k1", "k2"))
    texts = plain.select("k1", "k2", "text").join(wanted.hint("merge"), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("text")

    def whole(batches):
        for b in batches:
            found = [shingles(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(node, found), pa.int64()), pa.array([g.view(np.int64) for g in found], pa.list_(pa.int64()))], names=["node", "grams"])

    sets = common.materialize(texts.mapInArrow(whole, "node long, grams array<long>"))
    edges = verified(links, sets)
    members = common.materialize(classed(likely, edges))
    open_roots = members.groupBy("root").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("root")
    unsettled = common.materialize(members.join(open_roots.hint("merge"), "root", "left_semi"))
    if not unsettled.isEmpty():
        met = unsettled.join(nodes.select("node", "n", "bits").hint("merge"), "node").join(sets.hint("merge"), "node")
        dealt = common.chunked(met.select("root", "node", "class", "n", "bits", "grams"), ["root"], "node", BUCKET).drop("side")
        edges = edges.unionAll(common.by_group(dealt, ["root", "i", "j"], joining_edges, "a long, b long"))
        members = classed(likely, edges)

    placed = best.join(members.select("node", "class"), "node", "left").withColumn("class", F.coalesce("class", "node"))
    keep = placed.groupBy("class").agg(F.min(F.struct("none", "doc_id", "k1", "k2")).alias("best"))
    keep = common.materialize(keep.select(F.col("best.k1").alias("_k1"), F.col("best.k2").alias("_k2")))
    packed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), k1.alias("_k1"), k2.alias("_k2"))
    kept = packed.join(keep.hint("merge"), ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"])
    return kept.select("_row.*")
