"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by their number q of distinct shingles, a class for each power of two. A document that contains a
share c of an item has ceil(c q) of its shingles at least, so each class has a least number of hits, below which a document
is no candidate for any of its items. Documents are read once, whatever the number of items: each shingle is looked up in
bit filters of the classes' shingles, which lie side by side (``FILTER_BITS`` slots of one bit for each class), and a
document goes on only in the classes of which it has hits enough. A phrase that many items and many documents begin with
is one hit, and brings no document into any class but those of items that are hardly more than the phrase.

Those documents are joined with the classes' MinHash signatures by class and hash. An item's signature has its smallest
hashes in an order that puts first what makes the fewest pairs, documents with the hash times items with it, counted
over all of both; it has as many as an item of the class may lack, and ``MORE`` in addition, so that a document that
contains the item has ``MORE`` at least: the search loses no item, however long the document is. Signature rows are
repeated under salts, over which documents are dealt, since a third of all documents may hold one passage. Pairs with
hits enough are verified on the shingles of words themselves.

Texts are compared as lower-case words of letters and digits, five words a shingle. Items of one to four words are
one shingle of their own length.

Defined results: null and empty texts and items without a word match nothing; one row for equal (doc_id, item_id),
with the figures of the one pair of texts that shares most; repeated documents without an id are one; empty tables
give an empty result; ids of any type are carried through, null ones too; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.llm import common

SHINGLE = 5
MIN_CONTAINMENT = 0.8
#: Slots of the filter over items that each Python worker holds: a byte each for up to eight classes, 32 MB.
FILTER_BITS = 1 << 25
#: Hashes of a signature beyond those that a containing document may lack, and hits that such a document has.
MORE = 3
#: Parts that documents of one signature hash are dealt over.
SALTS = 16
#: Bytes of text that are hashed at once.
PART_BYTES = 1 << 20

_WORD = re.compile(r"[^\W_]+")
_OTHER = re.compile(r"[\W_]+")
_ASCII = bytes(c | 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_RANDOM = np.random.default_rng(10)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, np.uint64)
_BYTE[32] = 0
_STEP, _NEXT, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def word_grams(w: list[str], k: int) -> set[tuple[str, ...]]:
    return set(zip(*(w[i:] for i in range(k))))


def plain(text: str | None) -> bytes:
    """The words of a text between spaces, in bytes."""
    text = text or ""
    if text.isascii():
        return text.encode().translate(_ASCII)
    return _OTHER.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


def hashed(texts: list[bytes], lengths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each shingle length: the hashes of all shingles of the ``texts``, and which text each is of."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    starts_of = np.cumsum([0, *(len(t) + 1 for t in texts)])
    letter = data != 32
    starts = np.flatnonzero(letter & ~np.concatenate([[False], letter[:-1]]))
    if not len(starts):
        return
    offset = np.arange(len(data)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(data)]]))) if starts[0] == 0 else None
    if offset is None:
        data = data[starts[0] :]
        starts_of, starts = starts_of - starts[0], starts - starts[0]
        offset = np.arange(len(data)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(data)]])))
    power = np.cumprod(np.full(int(offset.max()) + 1, _STEP, np.uint64))
    word = np.add.reduceat(_BYTE[data] * power[offset], starts)
    owner = np.searchsorted(starts_of, starts, side="right") - 1
    for k in lengths:
        n = len(word) - k + 1
        if n <= 0:
            continue
        h = word[:n].copy()
        for j in range(1, k):
            h = h * _NEXT + (word[j : j + n] ^ (word[j : j + n] >> np.uint64(29)))
        h = (h ^ (h >> np.uint64(32))) * _MIX
        h ^= h >> np.uint64(29)
        inside = owner[:n] == owner[k - 1 :]
        yield k, h[inside], owner[:n][inside]


def size_class(q: int) -> int:
    return (q - 1).bit_length()


def _slots(h: np.ndarray, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64(n_bits - 1)
    return (h & low).astype(np.int64), (h >> np.uint64(33) & low).astype(np.int64)


def shingled(items: DataFrame, containment: float) -> DataFrame:
    """For each item of ``items`` (item, text): item, class, k, q, need, and the hashes ``hs`` of all its shingles."""

    def run(batches):
        for b in batches:
            out = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = words(text)
                if w:
                    k = min(SHINGLE, len(w))
                    h = np.unique(np.concatenate([x[1] for x in hashed([plain(text)], [k])]))
                    q = len(word_grams(w, k))
                    out.append((item, size_class(q), k, q, math.ceil(containment * q - 1e-9), h.view(np.int64)))
            if out:
                cols = [pa.array(c, pa.int64()) for c in list(zip(*out))[:5]]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([o[5] for o in out], pa.list_(pa.int64()))], names=["item", "class", "k", "q", "need", "hs"])

    return items.select("item", "text").mapInArrow(run, "item long, class long, k long, q long, need long, hs array<long>")


@dataclass
class Planes:
    """Bit filters of the classes side by side: bit i of a slot is of the class ``classes[i]``."""

    classes: list[int]
    #: The fewest hits that any item of the class needs.
    floors: list[int]
    lengths: list[int]
    slots: np.ndarray

    def masks(self, h: np.ndarray) -> np.ndarray:
        a, b = _slots(h, len(self.slots))
        found = self.slots[a]
        at = np.flatnonzero(found)
        found[at] &= self.slots[b[at]]
        return found


def planes(held: DataFrame) -> Broadcast:
    """The filters of ``held`` (items as `shingled`), put together in an array of fixed size from 32768-bit pieces."""
    by_class = held.groupBy("class").agg(F.min("need"), F.collect_set("k")).orderBy("class").collect()  # one for each power of two
    kind = next(t for bits, t in ((8, np.uint8), (16, np.uint16), (32, np.uint32), (64, np.uint64)) if len(by_class) <= bits)
    slots = np.zeros(FILTER_BITS, kind)
    h = held.select("class", F.explode("hs").alias("h"))
    low = F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1))
    high = F.shiftrightunsigned("h", 33).bitwiseAND(F.lit(FILTER_BITS - 1))
    slot = h.select("class", F.explode(F.array(low, high)).alias("slot")).select("class", (F.col("slot") + 1).alias("slot"))
    pieces = slot.groupBy("class", F.bitmap_bucket_number("slot").alias("no")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    rank = {r[0]: i for i, r in enumerate(by_class)}
    for size, no, piece in pieces.toLocalIterator():
        bits = np.unpackbits(np.frombuffer(piece, np.uint8), bitorder="little")
        part = slots[(no - 1) * 32768 : (no - 1) * 32768 + len(bits)]
        part |= bits[: len(part)].astype(kind) << kind(rank[size])
    lengths = sorted({k for r in by_class for k in r[2]})
    return held.sparkSession.sparkContext.broadcast(Planes([r[0] for r in by_class], [r[1] for r in by_class], lengths, slots))


def hits(docs: DataFrame, shared: Broadcast, kind: T.DataType) -> DataFrame:
    """Of ``docs`` (row, doc_id, text) those with hits enough in a class: row, doc_id, text, and for every class with
    enough, side by side, ``classes`` and the distinct ``hashes`` found in it."""

    def run(batches):
        model = shared.value
        longs = pa.list_(pa.int64())
        for b in batches:
            texts = [plain(t) for t in b.column(2).to_pylist()]
            found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
            a = 0
            while a < len(texts):
                z, size = a + 1, len(texts[a])
                while z < len(texts) and size + len(texts[z]) <= PART_BYTES:
                    size, z = size + len(texts[z]), z + 1
                met = []
                for _, h, owner in hashed(texts[a:z], model.lengths):
                    mask = model.masks(h)
                    at = np.flatnonzero(mask)
                    met.append((h[at], owner[at], mask[at]))
                if met:
                    h, owner, mask = (np.concatenate(c) for c in zip(*met))
                    order = np.lexsort((h, owner))
                    h, owner, mask = h[order], owner[order], mask[order]
                    if len(h):
                        new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])
                        h, owner, mask = h[new], owner[new], mask[new]
                    for i, (name, floor) in enumerate(zip(model.classes, model.floors)):
                        at = np.flatnonzero(mask >> mask.dtype.type(i) & mask.dtype.type(1))
                        for d in np.flatnonzero(np.bincount(owner[at], minlength=z - a) >= floor).tolist():
                            own = h[at[np.searchsorted(owner[at], d) : np.searchsorted(owner[at], d, "right")]]
                            found.setdefault(a + d, []).append((np.full(len(own), name, np.int64), own.view(np.int64)))
                a = z
            if found:
                rows = pa.array(sorted(found), pa.int64())
                lists = [pa.array([np.concatenate([f[c] for f in found[i]]) for i in sorted(found)], longs) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(rows) for c in range(3)), *lists], names=["row", "doc_id", "text", "classes", "hashes"])

    schema = T.StructType().add("row", T.LongType()).add("doc_id", kind).add("text", T.StringType()).add("classes", T.ArrayType(T.LongType())).add("hashes", T.ArrayType(T.LongType()))
    return docs.mapInArrow(run, schema)


def signatures(held: DataFrame, met: DataFrame, containment: float) -> DataFrame:
    """For each entry of the signature of each item of ``held``: class, h, item, k, need, and the ``least`` hits that a
    document needs in it. ``met``: row, class, h of the documents."""
    each = held.select("item", "class", "k", "q", "need", F.explode("hs").alias("h"))
    docs = met.groupBy("class", "h").agg(F.count("*").alias("docs"))
    cost = each.groupBy("class", "h").agg(F.count("*").alias("items")).join(docs.hint("merge"), ["class", "h"], "left")
    cost = cost.select("class", "h", (F.col("items") * F.coalesce("docs", F.lit(0))).alias("pairs"))
    largest = F.pow(F.lit(2.0), F.col("class")).cast("long")
    sizes = (largest - F.ceil(containment * largest - 1e-9) + MORE).cast("int")
    own = each.join(cost.hint("merge"), ["class", "h"]).groupBy("item", "class", "k", "q", "need").agg(F.sort_array(F.collect_list(F.struct("pairs", "h"))).alias("all"))
    own = own.withColumn("mins", F.slice("all", F.lit(1), sizes))
    return own.select("item", "class", "k", "need", (F.size("mins") - (F.col("q") - F.col("need"))).alias("least"), F.explode("mins.h").alias("h"))


def candidates(held: DataFrame, found: DataFrame, containment: float) -> DataFrame:
    """Pairs of documents of ``found`` (as `hits`) and items of ``held`` with hits enough in the items' signatures:
    row, item, k, need."""
    met = found.select("row", F.explode(F.arrays_zip("classes", "hashes")).alias("hit")).select("row", F.col("hit.classes").alias("class"), F.col("hit.hashes").alias("h"))
    wanted = common.materialize(signatures(held, met, containment))
    salted = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = met.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    pairs = dealt.join(salted.hint("merge"), ["class", "h", "salt"]).groupBy("row", "item", "k", "need", "least").count()
    return pairs.where(F.col("count") >= F.col("least")).select("row", "item", "k", "need")


def _found(docs: DataFrame, items: DataFrame, kind: T.DataType, containment: float) -> DataFrame:
    """Verified pairs of ``docs`` (doc_id, text) and ``items`` (item, text): doc_id, text, item, n_shared, n_shingles."""
    common.ship(docs.sparkSession)
    held = common.materialize(shingled(items, containment))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    found = common.materialize(hits(rows, planes(held), kind))
    pairs = common.materialize(candidates(held, found, containment))
    # An item may be in a third of all documents: its text is repeated under the salts, and only then meets theirs.
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    texts = items.select("item", F.col("text").alias("item_text"), F.explode(salts).alias("salt"))
    named = pairs.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(texts.hint("merge"), ["item", "salt"]).drop("salt")
    both = named.join(found.select("row", "doc_id", "text").hint("merge"), "row")
    both = both.select("row", "doc_id", "text", "item", "item_text", "k", "need").sortWithinPartitions("row")

    def verify(batches):
        last, w, grams = None, [], {}
        for b in batches:
            keep, shared, total = [], [], []
            for i, (row, text, item_text, k, need) in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 2, 4, 5, 6)))):
                if row != last:
                    last, w, grams = row, words(text), {}
                if k not in grams:
                    grams[k] = word_grams(w, k)
                q = word_grams(words(item_text), k)
                if (n := len(q & grams[k])) >= need:
                    keep.append(i)
                    shared.append(n)
                    total.append(len(q))
            if keep:
                at = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in (1, 2, 3)), pa.array(shared, pa.int64()), pa.array(total, pa.int64())], names=["doc_id", "text", "item", "n_shared", "n_shingles"])

    schema = T.StructType().add("doc_id", kind).add("text", T.StringType()).add("item", T.LongType()).add("n_shared", T.LongType()).add("n_shingles", T.LongType())
    return both.mapInArrow(verify, schema)


def _numbered(items: DataFrame, item_text: str, item_id: str) -> DataFrame:
    """The distinct items that have text, written once so that their numbers stay: item, item_id, text."""
    own = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where(F.length("text") > 0).distinct()
    return common.materialize(own.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"))


def contained_items(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", containment: float = MIN_CONTAINMENT) -> DataFrame:
    """One row per (doc_id, item_id) whose document contains ``containment`` of the item's shingles or more:
    doc_id, item_id, n_shared, n_shingles, containment."""
    own = _numbered(items, item_text, item_id)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = _found(rows, own, docs.schema[doc_id].dataType, containment)
    share = (F.col("n_shared") / F.col("n_shingles")).alias("containment")
    named = found.select("doc_id", "item", "n_shared", "n_shingles", share).join(own.select("item", "item_id"), "item")
    best = named.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_shared", "n_shingles")).alias("best"))
    return best.select("doc_id", "item_id", "best.n_shared", "best.n_shingles", "best.containment")


def without_items(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", containment: float = MIN_CONTAINMENT) -> DataFrame:
    """The rows of ``docs`` whose text contains no item, all columns as they are. A text decides for its rows, so ids
    may be null or repeated; rows are told apart by 128 bits of hash of their text."""
    h1, h2 = F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), F.col(text)).alias("h2")
    own = _numbered(items.withColumn("_none", F.lit(0)), item_text, "_none")
    found = _found(docs.select(F.lit(0).cast("long").alias("doc_id"), F.col(text).alias("text")), own, T.LongType(), containment)
    leaks = common.materialize(found.select(F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), F.col("text")).alias("h2")).distinct())
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), h1, h2)
    # By sort-merge at every size: what is found grows with the documents, and one plan costs alike throughout.
    return packed.join(leaks.hint("merge"), ["h1", "h2"], "left_anti").select("_row.*")
