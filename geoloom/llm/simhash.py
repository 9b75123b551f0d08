"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, exact Hamming verification, connected classes.

Equal fingerprints are one node. A fingerprint is cut into m blocks; two fingerprints that differ in at most d bits
agree on m - d blocks at least, so every choice of m - d blocks is a key, and m is chosen so that a key has few
fingerprints (all choices find the same links). Fingerprints with a key in common are compared inside one task as
bit arrays. A bucket above ``BUCKET`` fingerprints is cut into chunks, and each pair of chunks is a task of its own, so
that no task holds more than two chunks; and a task emits a spanning forest of the links it finds rather than all
pairs, which keeps the output linear in its input and loses no connection.

Classes come from contracting edges until none is left, in a number of rounds that is logarithmic in the longest path
for any order of the nodes; each round is written to the shared folder.

Defined results: null and empty texts have fingerprint zero and link like any other; repeated rows and equal ids are
kept, each as its own row; a row with a null id takes part in links, and a class with nothing but null ids has a null
component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm import common

SHINGLE = 3
MAX_BITS = 3
SEED = 42
#: Most fingerprints that one side of a comparison holds.
BUCKET = 512
#: Fingerprints that a key should have on average at most.
PER_KEY = 64


def majority(h: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes ``h``."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        ones += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Hashes of the text's word shingles in order, repeats included; none for a text without a word."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not w:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= shingle:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = np.concatenate([[0], ends[:-shingle]])
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist())], np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the text's word shingles, repeats included."""
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""
    common.ship(df.sparkSession)
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle, seed) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def block_masks(blocks: int, max_bits: int) -> list[int]:
    """For every choice of ``blocks - max_bits`` blocks the mask of their bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(masks, blocks - max_bits)]


def blocks_for(n: int, max_bits: int = MAX_BITS, per_key: int = PER_KEY) -> int:
    """The fewest blocks whose keys are long enough for ``n`` fingerprints."""
    blocks = max_bits + 1
    while blocks < max_bits + 5 and n / 2 ** (64 * (blocks - max_bits) / blocks) > per_key:
        blocks += 1
    return blocks


def forest(left: np.ndarray, right: np.ndarray | None, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two chunks (or within one): pairs of fingerprints."""
    nodes = left if right is None else np.concatenate([left, right])
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    other, shift = (left, 0) if right is None else (right, len(left))
    edges = []
    for i in range(len(left)):
        begin = i + 1 if right is None else 0
        near = np.flatnonzero(np.bitwise_count(other[begin:] ^ left[i]) <= max_bits) + begin + shift
        for j in near.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[b] = a
                edges.append((int(nodes[i]), int(nodes[j])))
    return edges


def links(fps: DataFrame, n: int, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fps`` (column fp) that connect all within ``max_bits`` bits."""
    masks = block_masks(blocks_for(n, max_bits), max_bits)
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("no"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(signed)])
    keyed = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.no", "k.key")
    dealt = common.chunked(keyed.select(F.col("no").cast("long").alias("no"), "key", "fp"), ["no", "key"], "fp", bucket)

    def solve(side: np.ndarray, rows: np.ndarray) -> list[tuple[int, int]]:
        rows = rows.view(np.uint64)
        found = forest(rows[side == 0], rows[side == 1] if side.any() else None, max_bits)
        return [tuple(np.array(e, np.uint64).view(np.int64).tolist()) for e in found]

    return common.by_group(dealt, ["no", "key", "i", "j"], solve, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of ``edges`` (a, b) the smallest node of its class.

    Each round every node points to the smallest of itself and its neighbours; pointers are doubled until they all end at
    a node that points to itself, and edges contract to those ends. A round halves the nodes at least, whatever their
    order, and a chain of pointers of length n takes log n doublings."""
    edges = common.materialize(edges.where("a <> b"))
    labels = None
    while not edges.isEmpty():
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = common.materialize(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("root")))
        while True:
            on = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            ahead = common.materialize(step.join(on, "root").select("node", F.col("next").alias("root"), (F.col("next") < F.col("root")).alias("moved")))
            common.release(step)
            step = ahead
            if ahead.where("moved").isEmpty():
                break
        step_to = lambda end: step.select(F.col("node").alias(end), F.col("root").alias(f"{end}2"))  # noqa: E731, B023
        if labels is None:
            labels = step.select("node", "root")
        else:
            onward = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = common.materialize(labels.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        last = edges
        edges = edges.join(step_to("a"), "a").join(step_to("b"), "b").where("a2 <> b2")
        edges = common.materialize(edges.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
        common.release(last)
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, max_bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """One row per row of ``df``: doc_id, fp, component_id (the smallest id reachable over links)."""
    docs = common.materialize(fingerprints(df, text, doc_id, shingle, seed))
    nodes = common.materialize(docs.groupBy("fp").agg(F.min("doc_id").alias("low")))
    found = components(links(nodes.select("fp"), nodes.count(), max_bits))
    classed = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    classed = common.materialize(classed)
    ids = common.materialize(classed.groupBy("root").agg(F.min("low").alias("component_id")))
    lookup = common.materialize(classed.join(ids, "root").select("fp", "component_id"))
    return docs.join(lookup, "fp").select("doc_id", "fp", "component_id")
