"""What the corpus operators share: code shipping, prefix sums, and groups of rows that meet in a task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom import runtime
from geoloom.runtime import materialize, release, shared_dir  # noqa: F401  what operators take from here

#: Rows of an Arrow batch: long documents make batches of many rows large.
BATCH_ROWS = 256
#: Word separators of every operator here.
SPACE = "\\x20\\x09-\\x0D"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI (file, hdfs, s3, gs) and the path in it; works on executors."""
    return pafs.FileSystem.from_uri(uri)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers and bound their Arrow batches."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    runtime.ship(spark)


def tasks_for(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    """Partitions for ``rows`` small rows: at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_task))


def count_words(text: Column) -> Column:
    """Runs of characters that are not ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def prefix_sum(df: DataFrame, order: list[Column], value: str, out: str, partitions: int) -> DataFrame:
    """``df`` with ``out``: the sum of long column ``value`` over all rows before this one in ``order``.

    Rows are range-sorted, summed within each partition, and written, which fixes the partitions; the sums
    before each partition then come from one small row per partition. No task sees more than its own range.
    ``order`` should end in a unique key so that equal sort keys cannot pile up in one range.
    """
    spark = df.sparkSession
    ship(spark)
    ranged = df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("_part", F.spark_partition_id())
    schema = T.StructType([*ranged.schema.fields, T.StructField("_local", T.LongType())])

    def add(batches):
        before = 0
        for b in batches:
            v = b.column(b.schema.get_field_index(value)).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = before + np.cumsum(v)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends - v, pa.int64())], names=[*b.schema.names, "_local"])
            before = int(ends[-1]) if len(ends) else before

    local = materialize(ranged.mapInArrow(add, schema))
    sums = local.groupBy("_part").agg(F.max(F.col("_local") + F.col(value)).alias("_sum"))
    sums = sums.select(F.col("_part"), F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return local.join(sums, "_part").withColumn(out, F.col("_local") + F.col("_before")).drop("_part", "_local", "_before")


def chunked(keyed: DataFrame, keys: list[str], by: str, most: int) -> DataFrame:
    """``keyed`` with long columns i, j, side in front of which ``keys`` stand: a key with more than ``most`` rows is cut
    into chunks by a hash of ``by``, and each pair of chunks, or the chunk and itself, is a group (i, j) of its own.
    Each row is in as many groups as its key has chunks; side is 1 for rows of chunk j where j is not i."""
    heavy = materialize(keyed.groupBy(*keys).count().where(F.col("count") > most).select(*keys, F.ceil(F.col("count") / most).cast("long").alias("chunks")))
    rest = [c for c in keyed.columns if c not in keys]
    zero = F.lit(0).cast("long")
    if heavy.isEmpty():
        return keyed.select(*keys, zero.alias("i"), zero.alias("j"), zero.alias("side"), *rest)
    joined = keyed.join(heavy, keys, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1).cast("long")))
    joined = joined.withColumn("own", F.pmod(F.xxhash64(by), F.col("chunks")))
    dealt = joined.withColumn("with", F.explode(F.sequence(zero, F.col("chunks") - 1)))
    return dealt.select(*keys, F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), (F.col("own") > F.col("with")).cast("long").alias("side"), *rest)


def by_group(df: DataFrame, place: list[str], solve: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """Rows of equal ``place`` (long columns, the first of ``df``) meet in one task, which streams its groups through
    ``solve``: from the other columns of a group (arrays of numpy, or Arrow lists) to rows of long columns. Groups of
    one row are passed over."""
    names = [f.split(" ")[0] for f in schema.split(", ")]
    k = len(place)

    def run(batches):
        held: list[list] = []  # pieces of the group that may go on in the next batch
        current = None

        def whole() -> list[tuple]:
            if sum(len(p[0]) for p in held) < 2:
                return []
            if len(held) == 1:
                return solve(*held[0][k:])
            parts = zip(*(p[k:] for p in held))
            return solve(*[pa.concat_arrays(p) if isinstance(p[0], pa.Array) else np.concatenate(p) for p in parts])

        def batch(rows: list[tuple]):
            cols = np.array(rows, np.int64).reshape(-1, len(names)).T
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        for b in batches:
            n = b.num_rows
            if not n:
                continue
            cols = [c if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for c in b.columns]
            new = np.zeros(n - 1, bool)
            for c in cols[:k]:
                new |= c[1:] != c[:-1]
            starts = np.concatenate([[0], np.flatnonzero(new) + 1, [n]])
            out: list[tuple] = []
            for g in sorted({0, len(starts) - 2} | set(np.flatnonzero(np.diff(starts) > 1).tolist())):
                a, z = int(starts[g]), int(starts[g + 1])
                piece, name = [c[a:z] for c in cols], tuple(int(c[a]) for c in cols[:k])
                if name != current:
                    out += whole()
                    held, current = [], name
                held.append(piece)
            if out:
                yield batch(out)
        if held and (out := whole()):
            yield batch(out)

    return df.repartition(*place).sortWithinPartitions(*place).mapInArrow(run, schema)
