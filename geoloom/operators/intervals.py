"""Set algebra on half-open intervals (key, c0, c1), by windows over the interval ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, key: str, value: str) -> DataFrame:
    """Runs of consecutive integers: key, c0, c1."""
    w = Window.partitionBy(key).orderBy(value)
    runs = df.select(key, value).distinct().withColumn("_g", F.col(value) - F.row_number().over(w))
    return runs.groupBy(key, "_g").agg(F.min(value).alias("c0"), (F.max(value) + 1).alias("c1")).drop("_g")


def union(df: DataFrame, key: str = "key") -> DataFrame:
    """Overlapping and touching intervals merged; empty ones vanish."""
    w = Window.partitionBy(key).orderBy("c0", "c1")
    reach = F.max("c1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    parts = df.where("c0 < c1").withColumn("_new", F.when(F.col("c0") <= reach, 0).otherwise(1))
    parts = parts.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy(key, "_g").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1")).drop("_g")


def _swept(a: DataFrame, b: DataFrame, key: str, keep: Column) -> DataFrame:
    """Stretches between neighbouring ends where ``keep`` holds of the depths ``a`` and ``b``, merged."""
    ends = [df.where("c0 < c1").select(key, F.col(c).alias("at"), F.lit(s if left else 0).alias("da"), F.lit(0 if left else s).alias("db")) for df, left in ((a, True), (b, False)) for c, s in (("c0", 1), ("c1", -1))]
    events = ends[0]
    for e in ends[1:]:
        events = events.unionByName(e)
    events = events.groupBy(key, "at").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    w = Window.partitionBy(key).orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    swept = events.select(key, F.col("at").alias("c0"), F.lead("at").over(w).alias("c1"), F.sum("da").over(upto).alias("a"), F.sum("db").over(upto).alias("b"))
    return union(swept.where(keep & F.col("c1").isNotNull()).select(key, "c0", "c1"), key)


def difference(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    return _swept(a, b, key, (F.col("a") > 0) & (F.col("b") <= 0))


def intersection(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    return _swept(a, b, key, (F.col("a") > 0) & (F.col("b") > 0))


def clip(df: DataFrame, lo: int, hi: int) -> DataFrame:
    return df.withColumn("c0", F.greatest("c0", F.lit(lo))).withColumn("c1", F.least("c1", F.lit(hi))).where("c0 < c1")


def point_query(points: DataFrame, spans: DataFrame, key: str, at: str, value: str, values: list, block: int = 4096) -> DataFrame:
    """``points`` (key, at, any other columns) with ``found``: of the spans (key, c0, c1, value) that hold the point, the value
    that comes first in ``values``; null if none does.

    Points and starts of spans are merged in one sorted pass over each block of ``block`` places of a key: a span of a
    value holds the point if the furthest end among the starts up to it lies beyond it. Spans are cut at blocks, so a
    crowded key is many groups, and the cost is points and spans, not their product.
    """
    rows = points.select(F.col(key).alias("_key"), F.col(at).cast("long").alias("_at"), F.lit(1).alias("_point"), F.lit(None).cast("long").alias("_end"), F.lit(None).cast("int").alias("_rank"), F.struct(*(F.col(f"`{c}`") for c in points.columns)).alias("_row"))
    rows = rows.withColumn("_block", F.floor(F.col("_at") / block))
    rank = (F.array_position(F.array(*map(F.lit, values)), F.col(value)) - 1).cast("int")
    cut = spans.where("c0 < c1").select(F.col(key).alias("_key"), F.col("c0").cast("long").alias("c0"), F.col("c1").cast("long").alias("c1"), rank.alias("_rank")).where("_rank >= 0")
    cut = cut.withColumn("_block", F.explode(F.sequence(F.floor(F.col("c0") / block), F.floor((F.col("c1") - 1) / block))))
    starts = cut.select("_key", F.greatest("c0", F.col("_block") * block).alias("_at"), F.lit(0).alias("_point"), F.col("c1").alias("_end"), "_rank", F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), "_block")
    w = Window.partitionBy("_key", "_block").orderBy("_at", "_point").rowsBetween(Window.unboundedPreceding, 0)
    merged = rows.unionByName(starts)
    found = F.lit(None).cast(spans.schema[value].dataType)
    for i in reversed(range(len(values))):
        merged = merged.withColumn(f"_to{i}", F.max(F.when(F.col("_rank") == i, F.col("_end"))).over(w))
        found = F.when(F.col(f"_to{i}") > F.col("_at"), F.lit(values[i]).cast(spans.schema[value].dataType)).otherwise(found)
    return merged.withColumn("found", found).where("_point = 1").select("_row.*", "found")


def scanline_fill(edges: DataFrame, rows: int, key: str = "key") -> DataFrame:
    """Even-odd fill of polygons given by edges (key, ax, ay, bx, by): key, row, x0, x1 at each row's centre line.

    An edge covers the rows whose centre y has ylo <= y < yhi, so it is exploded to those rows only; crossings of a
    row are paired in order.
    """
    lo, hi = F.least("ay", "by"), F.greatest("ay", "by")
    first, last = F.greatest(F.ceil(lo - 0.5), F.lit(0)), F.least(F.ceil(hi - 0.5) - 1, F.lit(rows - 1))
    hit = edges.where(first <= last).withColumn("row", F.explode(F.sequence(first, last)))
    y = F.col("row") + 0.5
    hit = hit.withColumn("x", F.col("ax") + (y - F.col("ay")) / (F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax")))
    w = Window.partitionBy(key, "row").orderBy("x")
    paired = hit.withColumn("_n", F.row_number().over(w)).withColumn("x1", F.lead("x").over(w))
    return paired.where("_n % 2 = 1 AND x1 IS NOT NULL").select(key, "row", F.col("x").alias("x0"), "x1")
