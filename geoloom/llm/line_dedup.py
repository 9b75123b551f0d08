"""Line dedup against levelled sorted runs of line hashes.

A run is a table of (line hash, documents that hold it, largest id among them), bucketed and sorted by hash. Documents arrive in
batches of falling id. A batch's lines merge-anti-join the runs: lines that a run already proves common, with a larger
holder, are settled and add nothing; the rest becomes the batch's own run at level 0. A level that has ``FANOUT`` runs
is compacted into one run of the next level. After the last batch one more compaction gives the common lines, and
each document loses those of which it is not the largest holder: by the places at which it has them.

Defined results: a null or empty text is one empty line, which is never common; a null id counts as smaller than
every other; each row is a document, and rows with an equal id keep or lose a line alike; a repeat within one row
counts once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom import runtime
from geoloom.llm import common

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FANOUT = 2
SALTS = 32
#: Lines that a bucket of all runs may hold together: about 200 MB.
BUCKET_LINES = 4_000_000
_BLANK = " \t\n\x0b\x0c\r"
_LOWEST = -(1 << 63)


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    return F.btrim(F.translate(line, string.ascii_uppercase, string.ascii_lowercase), F.lit(_BLANK))


def digest(k: Column) -> Column:
    return F.unhex(F.md5(k))


class RunStore:
    """Levels of sorted runs: tables bucketed and sorted by line, so that joins merge them as they lie, without a shuffle
    or a sort. All runs have as many buckets as ``rows``, the lines to come, ask for. Their files are in the shared folder;
    ``close`` drops them and gives the session its settings back."""

    _ORDERED, _TASKS = "spark.sql.legacy.bucketedTableScan.outputOrdering", "spark.sql.shuffle.partitions"

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT, rows: int = 0, bucket_lines: int = BUCKET_LINES):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = common.tasks_for(spark, rows, bucket_lines)
        self.levels: list[list[tuple[str, str]]] = []
        #: A bucket is what one task of an aggregation by line holds, so each bucket is one file.
        wanted = {self._ORDERED: "true", self._TASKS: str(self.buckets)}
        # Without a default of our own: one that does not fit the setting's type is refused where the setting was never made.
        self.before = {k: spark.conf.get(k) for k in wanted}
        for k, v in wanted.items():
            spark.conf.set(k, v)

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name, _ in level]

    def add(self, batch: DataFrame) -> None:
        """``batch``: rows (line, holder), one for each document that has the line, holders below all added before."""
        own = batch.groupBy("line").agg(F.count("*").alias("n_docs"), F.max("holder").alias("top"))
        for run in self.runs():
            # An anti-join by name would be pushed below the aggregation, and a frequent line be shuffled row by row.
            known = run.where(F.col("n_docs") >= self.min_docs).select("line", F.lit(True).alias("known"))
            own = own.join(known.hint("merge"), "line", "left").where(F.col("known").isNull()).drop("known")
        self._put(0, own)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merging, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._merged([self.spark.table(name) for name, _ in merging]))
            self._remove(merging)
            level += 1

    def merged(self) -> DataFrame:
        return self._merged(self.runs())

    def close(self) -> None:
        for level in self.levels:
            self._remove(level)
        self.levels = []
        for k, v in self.before.items():
            self.spark.conf.set(k, v)

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for r in runs[1:]:
            other = r.select("line", F.col("n_docs").alias("n2"), F.col("top").alias("top2")).hint("merge")
            n = F.coalesce("n_docs", F.lit(0)) + F.coalesce("n2", F.lit(0))
            out = out.join(other, "line", "full").select("line", n.alias("n_docs"), F.greatest("top", "top2").alias("top"))
        return out

    def _put(self, level: int, rows: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        path, name = common.shared_dir(self.spark), f"line_run_{uuid.uuid4().hex}"
        rows.write.format("parquet").bucketBy(self.buckets, "line").sortBy("line").option("path", path).saveAsTable(name)
        self.levels[level].append((name, path))

    def _remove(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE {name}")
            runtime.delete(self.spark, path)


def _row(text: Column) -> Column:
    """Tells apart rows of one id, null ids above all: those that it does not tell apart lose the same lines."""
    return F.unhex(F.md5(text))


def _holder(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(_LOWEST))


def common_lines(df: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> tuple[DataFrame, DataFrame]:
    """(row, holder, line, pos) of all long lines of every document, and (line, n_docs, top) of the common ones."""
    spark = df.sparkSession
    holder = _holder(doc_id)
    bounds = df.agg(F.percentile_approx(holder, [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    bounds = sorted(set(bounds or []), reverse=True)
    no = F.lit(len(bounds))
    for i, b in reversed(list(enumerate(bounds))):  # batch 0 holds the largest ids
        no = F.when(holder > b, i).otherwise(no)
    # Sorted, so that a line's first place in a row is known; an array of one keeps this from being worked out again for each line.
    placed = F.transform(lines(F.col(text)), lambda x, i: F.struct(key(x).alias("key"), i.alias("pos")))
    placed = F.transform(F.filter(placed, lambda v: F.char_length(v["key"]) >= min_chars), lambda v: F.struct(digest(v["key"]).alias("line"), v["pos"].alias("pos")))
    rows = df.select(_row(F.col(text)).alias("row"), holder.alias("holder"), no.alias("batch"), F.explode(F.array(F.array_sort(placed))).alias("_all"))
    first = F.transform("_all", lambda v, j: F.struct(v["line"].alias("line"), v["pos"].alias("pos"), ((j == 0) | (F.get(F.col("_all"), j - 1)["line"] != v["line"])).alias("first")))
    rows = rows.select("row", "holder", "batch", F.inline(first))
    path = common.shared_dir(spark)
    rows.write.partitionBy("batch").parquet(path)
    held = spark.read.schema(rows.schema).parquet(path)
    store = RunStore(spark, min_docs, rows=held.count())
    try:
        for i in range(len(bounds) + 1):
            store.add(held.where((F.col("batch") == i) & F.col("first")).select("line", "holder"))
        found = common.materialize(store.merged().where(F.col("n_docs") >= min_docs))
    finally:
        store.close()
    return held.select("row", "holder", "line", "pos"), found


def dedup_lines(df: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """One row per row of ``df``: doc_id, n_lines, n_dropped, kept (the text of the lines that stay)."""
    held, found = common_lines(df, text, doc_id, min_chars, min_docs, batches)
    # A line may be in a third of all documents: its holders are dealt out by a salt, and its row repeated for each.
    salted = found.select("line", "top", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("holder", "row"), F.lit(SALTS)).cast("int")
    losing = held.withColumn("salt", salt).join(salted.hint("merge"), ["line", "salt"]).where(F.col("holder") < F.col("top"))
    drops = common.materialize(losing.groupBy("holder", "row").agg(F.collect_set("pos").alias("drop")))
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), _holder(doc_id).alias("holder"), _row(F.col(text)).alias("row"))
    # By sort-merge at every size: the drops grow with the documents, and one plan costs alike throughout.
    out = docs.join(drops.hint("merge"), ["holder", "row"], "left").withColumn("all", lines(F.col("text")))
    places = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), F.col("drop"))
    out = out.withColumn("stay", F.when(F.col("drop").isNull(), F.col("all")).otherwise(F.transform(places, lambda i: F.get(F.col("all"), i))))
    return out.select("doc_id", F.size("all").cast("long").alias("n_lines"), (F.size("all") - F.size("stay")).cast("long").alias("n_dropped"), F.array_join("stay", "\n").alias("kept"))
