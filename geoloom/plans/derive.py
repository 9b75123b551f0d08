"""Coordinates, paths and rasters derived from the star-schema tables by integer arithmetic.

Each frame has a SQL twin in ``SQL`` that gives the same rows, so that a query and its SQL start alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.runtime import dealt

GRID_COLS = 64
CELL = 0.01
#: Points of whole paths that a task holds: about 50 MB for each sort of them.
POINTS_PER_TASK = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lon_of(k: Column) -> Column:
    return (k * 7919 % 36000) / F.lit(100.0) - 180


def lat_of(k: Column) -> Column:
    return (k * 104729 % 17000) / F.lit(100.0) - 85


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("cust"), lon_of(k).alias("lon"), lat_of(k).alias("lat"), F.col("c_acctbal").alias("bal"), F.col("c_nationkey").alias("nation"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("supp"), lon_of(k * 31 + 7).alias("lon2"), lat_of(k * 31 + 7).alias("lat2"), F.col("s_acctbal").alias("sbal"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What paths are made of, those of an order in one task."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return dealt(li, POINTS_PER_TASK, "l_orderkey")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of a few kilometres: one for each order, a point for each of its lines."""
    li = _lines(spark, sf_dir)
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    lon = F.lit(100.0) + (F.col("l_partkey") * 7919 % 1000) / F.lit(1000.0)
    lat = F.lit(30.0) + (F.col("l_suppkey") * 104729 % 997) / F.lit(1000.0)
    return li.select(F.col("l_orderkey").alias("path"), F.row_number().over(w).cast("long").alias("seq"), lon.alias("lon"), lat.alias("lat"), (F.col("l_quantity") * 20).alias("alt_m"))


def spread_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same paths spread over the globe, twenty to a square of half a degree: each meets its neighbours only."""
    li = _lines(spark, sf_dir)
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    k = F.col("l_orderkey")
    square = F.floor(k / 20)
    lon = lon_of(square) + (F.col("l_partkey") * 7919 % 1000) / F.lit(2000.0)
    lat = lat_of(square) + (F.col("l_suppkey") * 104729 % 997) / F.lit(2000.0)
    return li.select(k.alias("path"), F.row_number().over(w).cast("long").alias("seq"), lon.alias("lon"), lat.alias("lat"), (F.col("l_quantity") * 20).alias("alt_m"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster of GRID_COLS columns from the parts: height, null in every 13th; surface by size."""
    k = F.col("p_partkey")
    h = F.when(F.col("p_partkey") % 13 != 0, (F.col("p_size") * 20 + F.col("p_partkey") * 31 % 50).cast("double"))
    return table(spark, sf_dir, "part").select(F.floor(k / GRID_COLS).cast("long").alias("r"), (k % GRID_COLS).cast("long").alias("c"), h.alias("h"), F.col("p_size").cast("long").alias("size"))


def segments_of_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask segments from the orders: row, class 1 or 2, c0, c1."""
    k = F.col("o_orderkey")
    c0 = k * 37 % 500
    return table(spark, sf_dir, "orders").select((k % 311).alias("row"), (F.lit(1) + k % 2).cast("int").alias("class"), c0.alias("c0"), (c0 + 1 + k * 13 % 9).alias("c1"))


#: Fixed test polygons and circles, in the region of the points or of the globe.
POLYGON = [[-60.0, -20.0], [40.0, -35.0], [95.0, 10.0], [30.0, 20.0], [20.0, 55.0], [-50.0, 40.0]]
LOCAL = [[100.2, 30.2], [100.6, 30.25], [100.55, 30.7], [100.3, 30.6]]


def polygon(vertices: list[list[float]]) -> Column:
    return F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in vertices])


SQL = {
    "cust": "cust AS (SELECT c_custkey AS cust, ((c_custkey * 7919) % 36000)::DOUBLE / 100 - 180 AS lon, ((c_custkey * 104729) % 17000)::DOUBLE / 100 - 85 AS lat, c_acctbal AS bal, c_nationkey AS nation FROM customer)",
    "supp": "supp AS (SELECT s_suppkey AS supp, (((s_suppkey * 31 + 7) * 7919) % 36000)::DOUBLE / 100 - 180 AS lon2, (((s_suppkey * 31 + 7) * 104729) % 17000)::DOUBLE / 100 - 85 AS lat2, s_acctbal AS sbal FROM supplier)",
    "pts": "pts AS (SELECT l_orderkey AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS seq, 100 + ((l_partkey * 7919) % 1000)::DOUBLE / 1000 AS lon, 30 + ((l_suppkey * 104729) % 997)::DOUBLE / 1000 AS lat, (l_quantity * 20)::DOUBLE AS alt_m FROM lineitem)",
    "seg": "seg AS (SELECT * FROM (SELECT *, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2, lead(alt_m) OVER w AS alt2 FROM pts WINDOW w AS (PARTITION BY path ORDER BY seq)) WHERE lon2 IS NOT NULL)",
    "xp": "xp AS (SELECT l_orderkey AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS seq, (((l_orderkey // 20) * 7919) % 36000)::DOUBLE / 100 - 180 + ((l_partkey * 7919) % 1000)::DOUBLE / 2000 AS lon, (((l_orderkey // 20) * 104729) % 17000)::DOUBLE / 100 - 85 + ((l_suppkey * 104729) % 997)::DOUBLE / 2000 AS lat, (l_quantity * 20)::DOUBLE AS alt_m FROM lineitem)",
    "grid": f"grid AS (SELECT p_partkey // {GRID_COLS} AS r, p_partkey % {GRID_COLS} AS c, CASE WHEN p_partkey % 13 <> 0 THEN (p_size * 20 + (p_partkey * 31) % 50)::DOUBLE END AS h, p_size::BIGINT AS size FROM part)",
    "mask": "mask AS (SELECT o_orderkey % 311 AS row, (1 + o_orderkey % 2)::INT AS class, (o_orderkey * 37) % 500 AS c0, (o_orderkey * 37) % 500 + 1 + (o_orderkey * 13) % 9 AS c1 FROM orders)",
}


def edges_sql(name: str, vertices: list[list[float]]) -> str:
    rows = ", ".join(f"({ax}::DOUBLE, {ay}::DOUBLE, {bx}::DOUBLE, {by}::DOUBLE)" for (ax, ay), (bx, by) in zip([vertices[-1], *vertices[:-1]], vertices))
    return f"{name}(ax, ay, bx, by_) AS (VALUES {rows})"


def haversine_sql(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return f"(2 * 6371000.0 * asin(least(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)), 1.0)))"


def bearing_sql(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    d = f"(radians({lon2}) - radians({lon1}))"
    a = f"degrees(atan2(sin({d}) * cos(radians({lat2})), cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) * cos(radians({lat2})) * cos({d})))"
    return f"(CASE WHEN {a} < 0 THEN {a} + 360 ELSE {a} END)"


def pmod_sql(x: str, m: str) -> str:
    return f"((({x}) - {m} * floor(({x}) / {m})))"
