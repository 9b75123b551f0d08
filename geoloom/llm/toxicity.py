"""Toxicity: bags of character n-grams with embeddings, averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams, word boundaries included; a passage of ``PASSAGE`` words is
the mean of its words; a linear softmax over passages gives the probabilities of both classes. Since words are only
their n-grams, a misspelling that was never seen has most of the vectors of the word it is made from. A document is as
toxic as its worst passage: a few words count alike in a short text and in a long one. In training, passages are
weighted by how toxic they are thought to be, evenly at first, then ever more sharply; n-grams and passages are left out at
random, so that neither a single n-gram carries a word nor a single passage a document; and vectors without use shrink to
zero.

The model is fitted in the driver on a sample that does not grow with the data: about ``DOCS_PER_CLASS`` labelled rows of
each class by a hash of their id, none longer than ``LONGEST`` code points; losses are weighted so that scores keep the
classes' true rates. Scoring reads every whole text in one pass, without a shuffle: of the softmax over two classes each
n-gram needs one number.

Defined results: null and empty texts and texts without a letter or digit have the score of a text without any evidence;
several labels of one id count as the largest, a label of a null id or a null label not at all; with one class to learn
from all scores are that class, with none they are 0; repeated rows score alike; an empty table gives an empty result; ids
of any type are carried through; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm import common
from geoloom.llm.langid import held_out

#: Sizes of n-grams; a word has a boundary at both ends.
NGRAMS = (3, 4, 5)
BUCKET_BITS = 18
DIM = 8
#: Words of a passage; passages start every half of that.
PASSAGE = 6
#: About so many labelled documents of each class are learned from,
DOCS_PER_CLASS = 1500
#: none longer than this.
LONGEST = 50_000
EPOCHS = 100
#: Lengths of the steps of embeddings, softmax and bias.
RATE = (0.2, 0.02, 0.02)
#: What each vector loses of its length in a step.
SHRINK = 0.03
#: Part of the largest gradient below which an n-gram counts as having little evidence.
SLACK = 0.1
#: N-grams of fewer documents of the sample are not learned.
MIN_DOCS = 4
DROPPED = 0.3
#: Part of the passages that a step does not see, so that no single passage explains a document.
HIDDEN = 0.8
#: How sharply passages are weighted in the end.
SHARP = 2.0
THRESHOLD = 0.3
SEED = 13
#: Code points that are taken apart at once; texts are cut between words only.
PART_CHARS = 1 << 20

_PRIME, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_LETTERS = np.array([c.isalnum() for c in map(chr, range(65536))], bool)


def codes_of(text: str | None) -> np.ndarray:
    """Code points of the words of a text in lower case, one space before, between and after them; empty if it has none."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTERS[np.minimum(codes, 65535)]
    for i in np.flatnonzero(codes > 65535).tolist():
        letter[i] = chr(codes[i]).isalnum()
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after each word
    c = np.where(letter, codes, np.uint32(32))[keep]
    return np.concatenate([[32], c, [32] if c[-1] != 32 else []]).astype(np.uint64) if len(c) else np.zeros(0, np.uint64)


def grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, number of its word) of every n-gram that lies in one word and its boundaries."""
    space = codes == 32
    before = np.concatenate([[0], np.cumsum(space)])
    buckets, owners = [], []
    for n in NGRAMS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        at = np.flatnonzero(before[n - 1 : n - 1 + m] == before[1 : 1 + m])  # no space but at the ends
        h = np.full(len(at), n, np.uint64)
        for i in range(n):
            h = (h ^ codes[at + i]) * _PRIME
        h = (h ^ (h >> np.uint64(31))) * _MIX
        buckets.append((h >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
        owners.append(before[at + 1] - 1)
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owners)


def parts(codes: np.ndarray):
    """``codes`` in parts of about ``PART_CHARS``, cut at spaces that both parts keep."""
    a = 0
    while a < len(codes) - 1:
        z = min(a + PART_CHARS, len(codes) - 1)
        while codes[z] != 32:
            z += 1
        yield codes[a : z + 1]
        a = z


def passage_starts(words: int) -> np.ndarray:
    """First words of the passages: the last passage ends with the text."""
    step = PASSAGE // 2
    return np.arange(0, max(words - step, 1), step)


@dataclass
class Model:
    #: For each bucket what it adds to the log odds of its word.
    weight: np.ndarray
    bias: float
    #: The score that all texts get, where there were not both classes to learn from.
    fixed: float | None = None

    def word_odds(self, text: str | None) -> np.ndarray:
        found = []
        for codes in parts(codes_of(text)):
            bucket, owner = grams(codes)
            words = int(owner.max()) + 1 if len(owner) else 0
            n = np.bincount(owner, minlength=words)
            found.append(np.bincount(owner, self.weight[bucket], words) / np.maximum(n, 1))
        return np.concatenate(found) if found else np.zeros(0)

    def score(self, text: str | None) -> float:
        if self.fixed is not None:
            return self.fixed
        odds, z = self.word_odds(text), 0.0
        if len(odds):
            sums = np.concatenate([[0.0], np.cumsum(odds)])
            starts = passage_starts(len(odds))
            ends = np.minimum(starts + PASSAGE, len(odds))
            z = float(((sums[ends] - sums[starts]) / (ends - starts)).max())
        return float(1 / (1 + np.exp(-np.clip(z + self.bias, -500, 500))))


def _segments(size: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)


def fit(texts: list[str], toxic: np.ndarray, weight: np.ndarray, seed: int = SEED) -> Model:
    """Embeddings and softmax, fitted together by gradient steps over the whole sample; ``weight`` is a row's part of the loss."""
    rng = np.random.default_rng(seed)
    # Distinct words with their n-grams, and every passage as numbers of words.
    lists = [bytes(codes_of(t).astype("<u4")).decode("utf-32-le", "surrogatepass").split(" ")[1:-1] for t in texts]
    vocab: dict[str, int] = {}
    numbers = [np.array([vocab.setdefault(w, len(vocab)) for w in words], np.int64) for words in lists]
    gram, word = grams(codes_of(" ".join(vocab)))
    order = np.argsort(word, kind="stable")
    gram, word = gram[order], word[order]
    used, gram = np.unique(gram, return_inverse=True)
    word_at = _segments(np.bincount(word, minlength=len(vocab)))
    spans = [(d, s, min(s + PASSAGE, len(x))) for d, x in enumerate(numbers) if len(x) for s in passage_starts(len(x)).tolist()]
    doc = np.array([d for d, _, _ in spans])
    token = np.concatenate([numbers[d][s:e] for d, s, e in spans])
    size = np.array([e - s for _, s, e in spans])
    passage_at, passage = _segments(size), np.repeat(np.arange(len(spans)), size)
    have, doc = np.unique(doc, return_inverse=True)
    doc_at = _segments(np.bincount(doc))
    y, loss_weight = toxic[have].astype(np.float32), (weight[have] / weight[have].sum()).astype(np.float32)
    seen = np.unique(np.repeat(doc, size) * len(vocab) + token) % len(vocab)  # each word of each document once
    docs_with = np.bincount(gram, np.bincount(seen, minlength=len(vocab))[word], len(used))
    learned = (docs_with >= MIN_DOCS).astype(np.float32)[:, None]
    by_token, by_gram = np.argsort(token, kind="stable"), np.argsort(gram, kind="stable")
    token_at, gram_at = _segments(np.bincount(token, minlength=len(vocab))), _segments(np.bincount(gram, minlength=len(used)))
    # A softmax over two classes depends on the difference of their weights only. Means are linear, so that vectors are
    # multiplied by it first and single numbers are averaged; the gradients come back the same way.
    emb, out = learned * rng.normal(0, 0.1, (len(used), DIM)).astype(np.float32), rng.normal(0, 1, DIM).astype(np.float32)
    p = float((y * loss_weight).sum())
    state = [emb, out, np.array([np.log(p / (1 - p))], np.float32)]
    first, second = [np.zeros_like(s) for s in state], [np.zeros_like(s) for s in state]
    size = size.astype(np.float32)
    for epoch in range(EPOCHS):
        emb, out, bias = state
        keep = (rng.random(len(gram), np.float32) >= DROPPED).astype(np.float32)
        share = keep / np.maximum(np.add.reduceat(keep, word_at), 1)[word]
        odds = np.add.reduceat((emb @ out)[gram] * share, word_at)
        z = np.add.reduceat(odds[token], passage_at) / size
        e = np.exp(SHARP * epoch / EPOCHS * (z - np.maximum.reduceat(z, doc_at)[doc]))
        e *= np.maximum(rng.random(len(e), np.float32) >= HIDDEN, 1e-6)
        part = e / np.add.reduceat(e, doc_at)[doc]
        logit = np.add.reduceat(part * z, doc_at) + bias[0]
        wrong = (1 / (1 + np.exp(-logit)) - y) * loss_weight
        d_token = (wrong[doc] * part / size)[passage]
        d_word = np.add.reduceat(d_token[by_token], token_at)  # every word of the vocabulary occurs
        d_gram = np.add.reduceat((d_word[word] * share)[by_gram], gram_at)[:, None] * learned
        # Steps of like length for n-grams with evidence; those with little, beside the most, move in proportion to it.
        for i, g in enumerate((d_gram * out, (emb * d_gram).sum(0), wrong.sum(keepdims=True))):
            first[i] += 0.1 * (g - first[i])
            second[i] += 0.05 * (g * g - second[i])
            scale = np.sqrt(second[i])
            state[i] = state[i] - RATE[i] * first[i] / (scale + SLACK * scale.max() + 1e-12)
        # Vectors shrink by a fixed length and end at zero, so that few n-grams explain the labels (group lasso).
        length = np.sqrt((state[0] ** 2).sum(1, keepdims=True))
        state[0] *= np.maximum(0, 1 - SHRINK / np.maximum(length, 1e-12))
    odds = np.zeros(1 << BUCKET_BITS, np.float64)
    odds[used] = (state[0] @ state[1]).astype(np.float64)
    return Model(odds, float(state[2][0]))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", docs_per_class: int = DOCS_PER_CLASS) -> Model:
    """A model of ``label`` (0 or 1; by ``doc_id``) from a sample of the documents that are labelled and not held out."""
    spark = docs.sparkSession
    common.ship(spark)
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(doc_id))).groupBy(F.col(doc_id).alias("doc_id")).agg((F.max(F.col(label).cast("int")) > 0).cast("int").alias("toxic"))
    sizes = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Model(np.zeros(1), 0.0, float(max(sizes, default=0)))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(SEED)), F.lit(1 << 30))
    least = F.when(F.col("toxic") == 1, min(1.0, docs_per_class / sizes[1])).otherwise(min(1.0, docs_per_class / sizes[0]))
    # About twice docs_per_class rows of two numbers, whatever the tables' size.
    picked = F.broadcast(known.where(draw < least * (1 << 30)))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.char_length("text") <= LONGEST).join(picked, "doc_id")
    sample = sorted((r[0], r[1]) for r in rows.select("text", "toxic").collect())
    toxic = np.array([t for _, t in sample], np.int64)
    if len(set(toxic.tolist())) < 2:
        return Model(np.zeros(1), 0.0, float(toxic.max(initial=0)))
    counts = np.bincount(toxic)
    return fit([t for t, _ in sample], toxic, np.array([sizes[0] / counts[0], sizes[1] / counts[1]])[toxic])


def score(df: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``df``: doc_id, score, predicted."""
    spark = df.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast(model)  # of fixed size

    def run(batches):
        for b in batches:
            found = np.array([shared.value.score(t) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")
