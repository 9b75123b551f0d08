"""Quality rules as a short-circuit cascade.

The base figures of every document are computed in full. Documents that pass the base rules go through the
remaining rules, which are ordered by what they reject per second, both measured on a sample of documents: the
first rule that rejects a document ends its evaluation. The order changes the time taken and never the verdict.

Defined results: a null or empty text has no words and fails the base; repeated rows are judged alike, each on
its own; a null ``doc_id`` is carried through; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm import common

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Documents whose rules are timed; a bound on the sample, whose only effect is the order of the rules.
SAMPLE_DOCS = 256

_SPACES = " \t\n\x0b\x0c\r"
#: Class of a character of the basic plane: 1 a letter, 2 an upper-case letter.
_CLASS = np.array([str.isalpha(c) + str.isupper(c) for c in map(chr, range(65536))], np.uint8)


@dataclass(frozen=True)
class Stats:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by a window of ``window`` (a power of two) words that occurs twice or more. Exact, O(n log n).

    Equal runs get equal numbers: pairs of words are numbered first, then pairs of pairs, and so on.
    """
    n = len(words)
    if n <= window:
        return 0
    last = dict(zip(words, range(n)))
    if len(last) == n:
        return 0
    ids = np.fromiter(map(last.__getitem__, words), np.int64, n)
    span, top, counts = 1, n, None
    while span < window:
        _, ids, counts = np.unique(ids[:-span] * top + ids[span:], return_inverse=True, return_counts=True)
        top, span = len(counts), span * 2
        if top == len(ids):
            return 0
    starts = np.flatnonzero(counts[ids] > 1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def stats(text: str | None) -> Stats:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes.split: ASCII white space only
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    return Stats(len(words), len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words))


def base_failed(s: Stats) -> bool:
    return s.n_words < 20 or 100 * s.n_repeat_words > 30 * s.n_words


def _letters(text: str, at_least: int = 1) -> int:
    """Characters that are letters (2: upper-case letters)."""
    codes = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)
    n = int(np.count_nonzero(_CLASS[codes] >= at_least))
    if ((codes >> 10) == 54).any():  # high surrogates: characters above the basic plane
        n += sum(str.isalpha(c) + str.isupper(c) >= at_least for c in text if c > "\uffff")
    return n


#: name -> (text, stats) -> is rejected
RULES: dict[str, Callable[[str, Stats], bool]] = {
    "symbols_per_word": lambda t, s: s.n_symbols > 0.25 * s.n_words,
    "word_length": lambda t, s: not 2 * s.n_words <= s.word_chars <= 14 * s.n_words,
    "duplicate_lines": lambda t, s: s.n_dup_lines > 0.6 * (t.count("\n") + 1),
    "upper_case": lambda t, s: _letters(t, 2) > 0.5 * s.word_chars,
    "few_letters": lambda t, s: _letters(t) < 0.5 * s.word_chars,
    "shouting": lambda t, s: t.count("!!") > 0.3 * s.n_words,
    "bullet_lines": lambda t, s: (lines := t.split("\n")) and sum(x.lstrip()[:1] in ("-", "*", "•") and bool(x.strip()) for x in lines) > 0.9 * len(lines),
    "ellipsis_lines": lambda t, s: (lines := t.split("\n")) and sum(x.rstrip().endswith(("...", "…")) for x in lines) > 0.3 * len(lines),
}


def cascade_order(df: DataFrame, text: str = "text", doc_id: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> list[str]:
    """The rules' names, most rejections per second first, from at most ``sample_docs`` documents.

    The sample is drawn by a hash of the id from a scan of the id column alone, and timed on the executors.
    """
    ids = [r[0] for r in df.select(F.col(doc_id)).where(F.col(doc_id).isNotNull()).orderBy(F.xxhash64(F.col(doc_id)), F.col(doc_id)).limit(sample_docs).collect()]
    if not ids:
        return list(RULES)

    def measure(batches):
        cost, hits = dict.fromkeys(RULES, 0.0), dict.fromkeys(RULES, 0)
        n = 0
        for b in batches:
            for t in b.column(0).to_pylist():
                if base_failed(s := stats(t)):
                    continue
                n += 1
                for name, rule in RULES.items():
                    began = time.perf_counter()
                    hits[name] += bool(rule(t, s))
                    cost[name] += time.perf_counter() - began
        yield pa.record_batch({"rule": list(RULES), "cost": list(cost.values()), "hits": list(hits.values()), "n": [n] * len(RULES)}, schema=pa.schema([("rule", pa.string()), ("cost", pa.float64()), ("hits", pa.int64()), ("n", pa.int64())]))

    found = df.where(F.col(doc_id).isin(ids)).select(F.col(text)).mapInArrow(measure, "rule string, cost double, hits long, n long")
    rows = {r[0]: r for r in found.groupBy("rule").agg(F.sum("cost"), F.sum("hits"), F.sum("n")).collect()}
    rate = {k: (rows[k][2] + 0.5) / (rows[k][3] + 1) / max(rows[k][1] / max(rows[k][3], 1), 1e-9) if k in rows else 0.0 for k in RULES}
    return sorted(RULES, key=lambda k: (-rate[k], k))


def quality(df: DataFrame, text: str = "text", doc_id: str = "doc_id", order: list[str] | None = None) -> DataFrame:
    """One row per row of ``df``: its id, the base figures, ``kept`` and ``failed_rule``, the rule that ended the
    cascade (where several fail, which one depends on the order, and so on measured times; ``kept`` does not)."""
    common.ship(df.sparkSession)
    order = cascade_order(df, text, doc_id) if order is None else order
    kind = df.schema[doc_id].dataType.simpleString()
    figures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def judge(batches):
        rules = [(k, RULES[k]) for k in order]
        for b in batches:
            out: dict[str, list] = {k: [] for k in (*figures, "base_failed", "kept", "failed_rule")}
            for t in b.column(1).to_pylist():
                s = stats(t)
                for k in figures:
                    out[k].append(getattr(s, k))
                bad = base_failed(s)
                failed = "base" if bad else next((k for k, rule in rules if rule(t, s)), None)
                out["base_failed"].append(bad)
                out["kept"].append(failed is None)
                out["failed_rule"].append(failed)
            cols = [pa.array(out[k], pa.int64()) for k in figures] + [pa.array(out["base_failed"], pa.bool_()), pa.array(out["kept"], pa.bool_()), pa.array(out["failed_rule"], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", *out])

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(judge, f"doc_id {kind}, " + ", ".join(f"{k} long" for k in figures) + ", base_failed boolean, kept boolean, failed_rule string")
