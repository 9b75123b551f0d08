"""Mixing sources to target weights with hash-random order, distributed prefix sums and exact cuts.

Every document gets a random key from a hash of its id. Documents are range-sorted by (source, key), a distributed
prefix sum of their sizes places each one within its source, and the source's budget cuts that order: whole passes
first (epochs), then the documents up to the budget, of which the last is taken in part so that the budget is met to
the word. Budgets share the total by the sources' weights; none exceeds ``max_epochs`` times its source's size, and
what that leaves over goes to the others by weight until it is all placed.

Defined results: a null text has size 0 and nothing is taken of it; null is a source of its own, the last; a null id
is ordered first; repeated rows are each placed (equal keys are ordered by size, then text); an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm import common

WEIGHTS = (1.0, 2.0, 3.0)
MAX_EPOCHS = 3
SEED = 42
ROWS_PER_TASK = 2_000_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sources: DataFrame, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``sources`` (source, source_size, weight, one row each) with ``target``: the level, target / weight, is found by
    capping what lies above its limit and sharing the rest again, each step one aggregate of a single row."""
    level = 0.0
    limit = F.col("source_size") * float(max_epochs)
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0)
    while total:
        capped = limit < F.col("weight") * level
        spent, weight = sources.agg(F.sum(F.when(capped, limit).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight")))).first()
        above = (total - spent) / weight if weight else level
        if above <= level:
            break
        level = above
    return sources.withColumn("target", F.least(limit, F.col("weight") * F.lit(level)))


def _planned(rows: DataFrame, weights: Sequence[float], max_epochs: float, seed: int) -> DataFrame:
    """``rows`` (row, doc_id, source, size, mark, written once) with source_size, target, epochs and cut."""
    spark = rows.sparkSession
    order = [F.col("source").asc_nulls_last(), F.col("key"), F.col("doc_id"), F.col("size"), F.col("mark"), F.col("row")]
    sums = common.materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")))
    n_sources, n_docs = sums.agg(F.count("*"), F.coalesce(F.sum("docs"), F.lit(0))).first()
    parts = common.tasks_for(spark, n_docs, ROWS_PER_TASK)
    ranked = common.prefix_sum(sums.withColumn("_one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()], "_one", "_rank", 1 + n_sources // ROWS_PER_TASK)
    weight = F.lit([float(w) for w in weights])[(F.col("_rank") % len(weights)).cast("int")]
    sources = targets(common.materialize(ranked.withColumn("weight", weight)), max_epochs)
    starts = common.prefix_sum(sources, [F.col("source").asc_nulls_last()], "source_size", "source_start", 1 + n_sources // ROWS_PER_TASK)
    starts = common.materialize(starts.select(F.col("source").alias("of"), "source_size", "target", "source_start"))
    keyed = rows.withColumn("key", F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed)))
    placed = common.materialize(common.prefix_sum(keyed, order, "size", "before", parts))
    out = placed.join(starts, placed["source"].eqNullSafe(starts["of"]))
    budget = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    inside = F.col("before") - F.col("source_start")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), budget - passes * F.col("source_size") - inside)).cast("long")
    return out.withColumn("epochs", passes).withColumn("cut", cut)


def _row(doc_id: Column, source: Column, text: Column) -> list[Column]:
    """What a row is known by: its number, given once and written, so that equal ids and equal rows stay apart."""
    return [F.monotonically_increasing_id().alias("row"), doc_id.alias("doc_id"), source.alias("source"), common.count_words(text).alias("size"), F.xxhash64(text).alias("mark")]


def mix(df: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: Sequence[float] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per row of ``df``: doc_id, source, size, source_size, target, epochs (whole passes), cut (words of the
    pass after those), taken. ``weights`` go to the sources in code point order, null last, and repeat."""
    rows = common.materialize(df.select(*_row(F.col(doc_id), F.col(source), F.col(text))))
    out = _planned(rows, weights, max_epochs, seed)
    return out.select("doc_id", "source", "size", "source_size", "target", "epochs", "cut", (F.col("size") * F.col("epochs") + F.col("cut")).alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word. Only the one document that a source's budget cuts needs it."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, counts: pd.Series) -> pd.Series:
        def one(t, k):
            end = 0
            for m in islice(_WORD.finditer(t or ""), int(k)):
                end = m.end()
            return (t or "")[:end]

        return pd.Series([one(t, k) for t, k in zip(texts, counts)], dtype=object)

    return cut(text, n)


def mixed_rows(df: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: Sequence[float] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: every row of ``df`` as often as its source's budget takes it, and in its last taking cut to the
    words that the budget still holds. Columns are those of ``df``; rows that nothing is taken of are absent. Rows are
    numbered and written once, so budgets are met with repeated ids, null ids and equal rows alike."""
    spark = df.sparkSession
    common.ship(spark)
    own = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("doc")
    held = common.materialize(df.select(own, F.monotonically_increasing_id().alias("row")))
    rows = common.materialize(held.select("row", *_row(F.col("doc")[doc_id], F.col("doc")[source], F.col("doc")[text])[1:]))
    plan = common.materialize(_planned(rows, weights, max_epochs, seed).select("row", "size", "epochs", "cut").where("size > 0 AND (epochs > 0 OR cut > 0)"))
    taken = held.join(plan.hint("merge"), "row")
    whole = F.col("epochs") + (F.col("cut") == F.col("size")).cast("long")
    full = taken.where(whole > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), whole)))
    part = taken.where((F.col("cut") > 0) & (F.col("cut") < F.col("size")))
    part = part.withColumn("doc", F.col("doc").withField(f"`{text}`", first_words(F.col("doc")[text], F.col("cut"))))
    return full.select("doc.*").unionAll(part.select("doc.*"))
