"""Grouping of spelling variants: Aho-Corasick automata over the halves of words, sharded.

Words one edit apart share a half: the edit lies in one of a word's two halves, so the other stands unchanged at the
beginning or at the end of the other word. Every word's two halves are dealt into shards by a hash of the half; a task
builds one automaton over the halves of a shard and scans words with it. A word is scanned in the shards that may hold
a half of a word of its length, one more or one less (four halves of its own name them). A half that is met counts only
at its place, the beginning or the end, and only for words of fitting length; the rest is then verified. Words that
share a half are not all compared: what remains of each is looked up by its own halves, by the same argument.

A half that more than ``SHARD_HALVES`` words share is cut into chunks, one shard each, and words that it may be met in
are scanned in all of them. Counts are aggregated before the shuffle. Forms are followed to their end by doubling, in
a number of rounds that is logarithmic in the longest chain.

Defined results: a null or empty text has no words; a null id counts as the empty text in the hash; each row is a
document, so repeated rows count again; ties go to the word that is smaller in code-point order; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm import common

#: A word of a text.
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
MIN_CHARS = 5
MIN_COUNT = 3
#: A near word is a word's form if it is so many times as frequent.
FORM_RATIO = 2
#: One run of so many, by hash, loses a code point (a made misspelling).
NOISE = 97
#: Halves that an automaton holds, about, and words that may share a half in one shard.
SHARD_HALVES = 25_000
#: Words that are counted by one task, about.
ROWS_PER_TASK = 2_000_000


def spelled(run: Column, doc_id: Column) -> Column:
    """``run`` with A-Z lower-cased, and, where its hash says so, without one code point."""
    low = F.translate(run, string.ascii_uppercase, string.ascii_lowercase)
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), low).cast("binary"))
    at = F.pmod(h, F.char_length(low)).cast("int")
    return F.when(h % NOISE == 0, F.concat(F.substr(low, F.lit(1), at), F.substr(low, at + 2))).otherwise(low)


def vocabulary(df: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: the words of ``df`` and how often they occur."""
    runs = df.select(F.col(doc_id).alias("doc_id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0))).alias("run"))
    words = runs.select(spelled(F.col("run"), F.col("doc_id")).alias("word")).where(F.char_length("word") >= min_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes ``a`` into ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


class Rests:
    """What remains of the words of a half, found by the halves of the rest."""

    __slots__ = ("by",)

    def __init__(self):
        self.by: dict[tuple[int, int, str], list[tuple[str, str]]] = {}

    def add(self, rest: str, word: str) -> None:
        cut = len(rest) // 2
        self.by.setdefault((len(rest), 0, rest[:cut]), []).append((rest, word))
        self.by.setdefault((len(rest), 1, rest[cut:]), []).append((rest, word))

    def near(self, rest: str) -> Iterator[tuple[str, str]]:
        """(rest, word) of the words whose rest is one edit from ``rest``, each once."""
        for n in (len(rest) - 1, len(rest), len(rest) + 1):
            cut = n // 2
            for r, word in self.by.get((n, 0, rest[:cut]), ()):
                if one_edit(r, rest):
                    yield r, word
            if len(rest) >= n - cut:
                for r, word in self.by.get((n, 1, rest[len(rest) - (n - cut) :]), ()):
                    if r[:cut] != rest[:cut] and one_edit(r, rest):
                        yield r, word


class Shard:
    """An automaton over halves of words."""

    def __init__(self):
        self.halves: dict[str, list[Rests | None]] = {}
        self.automaton = None

    def add(self, word: str, last: int) -> None:
        cut = len(word) // 2
        half, rest = (word[cut:], word[:cut]) if last else (word[:cut], word[cut:])
        held = self.halves.setdefault(half, [None, None])
        if held[last] is None:
            held[last] = Rests()
        held[last].add(rest, word)

    def scan(self, word: str) -> Iterator[str]:
        """The words one edit from ``word`` of which this shard has the half that they share. A word both of whose halves
        are met comes by its first one only."""
        if not self.halves:
            return
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for half, held in self.halves.items():
                self.automaton.add_word(half, (len(half), *held))
            self.automaton.make_automaton()
        for end, (n, first, last) in self.automaton.iter(word):
            if first is not None and end == n - 1:
                for _, other in first.near(word[n:]):
                    yield other
            if last is not None and end == len(word) - 1:
                rest = word[: len(word) - n]
                for r, other in last.near(rest):
                    if not word.startswith(r):
                        yield other


def _halves(word: Column, n: Column) -> list[Column]:
    """The first and the last half that a word of length ``n`` would share with ``word``."""
    cut = F.floor(n / 2).cast("int")
    size = F.char_length(word)
    return [F.struct(F.lit(0).alias("last"), F.substr(word, F.lit(1), cut).alias("half")), F.struct(F.lit(1).alias("last"), F.substr(word, size - (n - cut) + 1, n - cut).alias("half"))]


def near_words(vocab: DataFrame, halves_per_shard: int = SHARD_HALVES) -> DataFrame:
    """All pairs of words of ``vocab`` (word, n) one edit apart, both ways: word, near, near_n."""
    spark = vocab.sparkSession
    common.ship(spark)
    words = vocab.count()
    shards = max(1, -(-2 * words // halves_per_shard))
    tasks = common.tasks_for(spark, 2 * words, halves_per_shard)
    size = F.char_length("word")
    own = vocab.select("word", "n", F.explode(F.array(*_halves(F.col("word"), size))).alias("h")).select("word", "n", "h.*")
    scans = F.array_distinct(F.array(*(h for d in (-1, 0, 1) for h in _halves(F.col("word"), size + d))))
    met = vocab.select("word", "n", F.explode(scans).alias("h")).select("word", "n", "h.*")
    heavy = common.materialize(own.groupBy("last", "half").count().where(F.col("count") > halves_per_shard).select("last", "half", F.ceil(F.col("count") / halves_per_shard).cast("long").alias("chunks")))
    zero = F.lit(0).cast("long")
    if heavy.isEmpty():
        own, met = own.withColumn("chunk", zero), met.withColumn("chunk", zero)
    else:
        one = F.lit(1).cast("long")
        own = own.join(heavy, ["last", "half"], "left").withColumn("chunk", F.pmod(F.xxhash64("word"), F.coalesce("chunks", one))).drop("chunks")
        met = met.join(heavy, ["last", "half"], "left").withColumn("chunk", F.explode(F.sequence(zero, F.coalesce("chunks", one) - 1))).drop("chunks")
    shard = F.pmod(F.xxhash64("last", "half", "chunk"), F.lit(shards)).alias("shard")
    rows = own.select(shard, F.lit(0).alias("scanned"), "word", "n", "last").unionByName(met.select(shard, F.lit(1).alias("scanned"), "word", "n", F.lit(0).alias("last")))
    schema = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])

    def run(batches):
        current, held, before = None, Shard(), None
        for b in batches:
            found: list[tuple[str, str, int]] = []
            for no, scanned, word, n, last in zip(*(c.to_pylist() for c in b.columns)):
                if no != current:
                    current, held, before = no, Shard(), None
                if not scanned:
                    held.add(word, last)
                elif word != before:  # two of its halves may name one shard
                    before = word
                    found.extend((other, word, n) for other in held.scan(word))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    placed = rows.repartition(tasks, "shard").sortWithinPartitions("shard", "scanned", "word")
    return placed.mapInArrow(run, "word string, near string, near_n long")


def follow(forms: DataFrame) -> DataFrame:
    """word, root: where the forms of ``forms`` (word, form) end. There are no circles: each form is more frequent."""
    at = common.materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = common.materialize(at.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = not new.where("moved").isEmpty()
        common.release(at)
        at = new
        if not moved:
            return at.select("word", "root")


def variants(df: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, halves_per_shard: int = SHARD_HALVES) -> DataFrame:
    """One row per word: word, n, n_near (words one edit from it), form, form_n (the most frequent of those, if it is
    ``FORM_RATIO`` times as frequent as the word) and root (where the forms end)."""
    vocab = common.materialize(vocabulary(df, text, doc_id, min_chars, min_count))
    best = near_words(vocab, halves_per_shard).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    fits = -F.col("best.less") >= FORM_RATIO * F.col("n")
    known = vocab.join(best.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"))
    known = common.materialize(known)
    roots = follow(known.where(F.col("form").isNotNull()))
    return known.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
