"""Language identification with bit-sliced Bloom filters of character n-grams.

Training counts, on the executors, in how many sampled documents of each language an n-gram occurs, and inserts it
for a language where its rate is at least a set share of its highest rate over all languages. The filters of all
languages lie side by side: a slot holds one bit for each language, so that the AND of an n-gram's slots is the mask
of all languages that contain it. A text's score for a language is the share of its n-grams whose mask has that
bit, corrected for the filter's rate of false positives.

Defined results: null texts and texts without a letter are ``und`` with score 0; ties go to the language that sorts
first; repeated rows are predicted alike; with nothing to learn from every text is ``und``; an empty table gives an
empty result; a null id is carried through; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm import common

#: Characters of an n-gram; words are bounded by a space.
NGRAM = 3
#: About so many labelled documents of each language are learned from, drawn by a hash of their id.
SAMPLE_DOCS_PER_LANG = 1500
#: An n-gram goes to a language where it is in this share of the sampled documents at least,
MIN_DOC_RATE = 0.01
#: and where its rate is this share of its highest rate at least.
MIN_RELATIVE_RATE = 0.34
#: Slots a stored n-gram (rounded up to a power of two) and hash functions.
SLOTS_PER_NGRAM = 8
HASHES = 2
UNDETERMINED = "und"

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_LETTERS = np.array([c.isalpha() for c in map(chr, range(65536))], bool)


def ngrams(text: str) -> tuple[np.ndarray, bool]:
    """The text's n-grams as numbers (21 bits a character), and whether it has a letter. All but letters is space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTERS[np.minimum(codes, 65535)]
    for i in np.flatnonzero(codes > 65535).tolist():
        letter[i] = chr(codes[i]).isalpha()
    if not letter.any():
        return np.zeros(0, np.uint64), False
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after each word
    c = np.where(letter, codes, np.uint32(32))[keep]
    c = np.concatenate([[np.uint32(32)], c, [np.uint32(32)] if c[-1] != 32 else []]).astype(np.uint64)
    if len(c) < NGRAM:
        return np.zeros(0, np.uint64), True
    h = c[: len(c) - NGRAM + 1]
    for i in range(1, NGRAM):
        h = (h << np.uint64(21)) | c[i : len(c) - NGRAM + 1 + i]
    return h, True


@dataclass
class BloomPlanes:
    """Bloom filters of all languages, eight of them in each plane of bytes."""

    langs: list[str]
    planes: list[np.ndarray]
    bits: int

    @classmethod
    def build(cls, members: dict[str, np.ndarray]) -> BloomPlanes:
        langs = sorted(members)
        most = max((len(m) for m in members.values()), default=1)
        self = cls(langs, [], max(10, int(np.ceil(np.log2(SLOTS_PER_NGRAM * max(most, 1))))))
        self.planes = [np.zeros(1 << self.bits, np.uint8) for _ in range(-(-len(langs) // 8))]
        for i, lang in enumerate(langs):
            for slot in self.slots(members[lang]):
                np.bitwise_or.at(self.planes[i // 8], slot, np.uint8(1 << i % 8))
        return self

    def slots(self, grams: np.ndarray) -> list[np.ndarray]:
        shift = np.uint64(64 - self.bits)
        return [((grams ^ (grams >> np.uint64(29))) * m) >> shift for m in _MIX[:HASHES]]

    def false_rates(self) -> np.ndarray:
        fill = [np.count_nonzero(self.planes[i // 8] & (1 << i % 8)) / (1 << self.bits) for i in range(len(self.langs))]
        return np.array(fill) ** HASHES

    def shares(self, grams: np.ndarray) -> np.ndarray:
        """For each language the corrected share of ``grams`` it contains: masks are looked up once for all languages."""
        slots = self.slots(grams)
        counts = np.zeros(8 * len(self.planes))
        for i, plane in enumerate(self.planes):
            mask = plane[slots[0]]
            for s in slots[1:]:
                mask = mask & plane[s]
            by_mask = np.bincount(mask, minlength=256)
            counts[8 * i : 8 * i + 8] = by_mask @ ((np.arange(256)[:, None] >> np.arange(8)) & 1)
        false = self.false_rates() if not hasattr(self, "_false") else self._false
        self._false = false
        return np.clip((counts[: len(self.langs)] / max(len(grams), 1) - false) / (1 - false), 0, 1)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", docs_per_lang: int = SAMPLE_DOCS_PER_LANG) -> BloomPlanes:
    """Filters from rows of known language. What reaches the driver is bounded by the rates that an n-gram needs."""
    spark = labelled.sparkSession
    common.ship(spark)
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return BloomPlanes.build({})
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(17)), F.lit(1 << 30))
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, float(min(1.0, docs_per_lang / n))).otherwise(share)

    def count(batches):
        seen: dict[str, list] = {}
        docs: dict[str, int] = {}
        for b in batches:
            for t, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                docs[name] = docs.get(name, 0) + 1
                seen.setdefault(name, []).append(np.unique(ngrams(t)[0]))
        for name, grams in seen.items():
            g, n = np.unique(np.concatenate(grams), return_counts=True)
            g, n = np.append(g, np.uint64(0)), np.append(n, docs[name])  # 0: the number of documents
            yield pa.record_batch({"lang": [name] * len(g), "gram": g.view(np.int64), "n": n.astype(np.int64)}, schema=pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())]))

    grams = rows.where(draw < share * (1 << 30)).select("text", "lang").mapInArrow(count, "lang string, gram long, n long")
    grams = common.materialize(grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    docs = {r["lang"]: r["n"] for r in grams.where("gram = 0").collect()}
    least = F.lit(float("inf"))
    for name, n in docs.items():
        least = F.when(F.col("lang") == name, max(2.0, MIN_DOC_RATE * n)).otherwise(least)
    frequent = grams.where((F.col("gram") != 0) & (F.col("n") >= least)).toPandas()
    frequent["rate"] = frequent["n"] / frequent["lang"].map(docs)
    top = frequent.groupby("gram")["rate"].transform("max")
    frequent = frequent[frequent["rate"] >= MIN_RELATIVE_RATE * top]
    none = frequent.iloc[:0]
    by = dict(list(frequent.groupby("lang")))
    return BloomPlanes.build({name: by.get(name, none)["gram"].to_numpy(np.int64).view(np.uint64) for name in docs})


def classify(model: BloomPlanes, text: str | None) -> tuple[str, float, float]:
    """(language, score from 0 to 1: its part of all languages' shares, share of n-grams the language has)."""
    grams, any_letter = ngrams(text or "")
    if not any_letter or not model.langs:
        return UNDETERMINED, 0.0, 0.0
    shares = model.shares(grams)
    best = int(np.argmax(shares))
    total = float(shares.sum())
    return model.langs[best], float(shares[best] / total) if total else 0.0, float(shares[best])


def identify(df: DataFrame, model: BloomPlanes, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``df``: doc_id, lang_pred, score, coverage. Whole texts; the model's size is bounded by its rates."""
    spark = df.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def predict(batches):
        for b in batches:
            found = [classify(shared.value, t) for t in b.column(1).to_pylist()]
            cols = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "lang_pred", "score", "coverage"])

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double, coverage double")


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 2 when divided by 4. A null id is held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


#: A text whose best language has less than this share of its n-grams is in none of the languages learned.
MIN_COVERAGE = 0.2


def accept(df: DataFrame, model: BloomPlanes, text: str = "text", min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """The rows of ``df``, all columns as they are, whose text is in a language that the model knows."""
    spark = df.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast(model)
    place = df.columns.index(text)

    def run(batches):
        for b in batches:
            found = [classify(shared.value, t) for t in b.column(place).to_pylist()]
            yield b.filter(pa.array([lang != UNDETERMINED and coverage >= min_coverage for lang, _, coverage in found], pa.bool_()))

    return df.mapInArrow(run, df.schema)
