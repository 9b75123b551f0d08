"""Map algebra on long rasters (r, c, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.geometry import base_cost, rect_intersects_polygon


def classify(grid: DataFrame, kind: Column, nodata_mult: float) -> DataFrame:
    """Adds ``cost`` (float): 1 on known surfaces, the multiplier on voids, infinite on walls."""
    return grid.withColumn("cost", base_cost(kind, F.lit(float(nodata_mult))).cast("float"))


def dilate(walls: DataFrame, k: int, rows: int, cols: int) -> DataFrame:
    """Cells within Chebyshev distance ``k`` of a wall cell (r, c). Spreads along columns, then along rows."""
    wide = walls.select("r", F.explode(F.sequence(F.greatest(F.col("c") - k, F.lit(0)), F.least(F.col("c") + k, F.lit(cols - 1)))).alias("c")).distinct()
    return wide.select(F.explode(F.sequence(F.greatest(F.col("r") - k, F.lit(0)), F.least(F.col("r") + k, F.lit(rows - 1)))).alias("r"), "c").distinct()


def distance_band(walls: DataFrame, k: int, rows: int, cols: int) -> DataFrame:
    """(r, c, d): Chebyshev distance to the nearest wall of the cells within ``k``, in two one-dimensional passes."""
    across = walls.select("r", F.col("c").alias("c0"), F.explode(F.sequence(F.greatest(F.col("c") - k, F.lit(0)), F.least(F.col("c") + k, F.lit(cols - 1)))).alias("c"))
    across = across.groupBy("r", "c").agg(F.min(F.abs(F.col("c") - F.col("c0"))).alias("dc"))
    down = across.select("c", "dc", F.col("r").alias("r0"), F.explode(F.sequence(F.greatest(F.col("r") - k, F.lit(0)), F.least(F.col("r") + k, F.lit(rows - 1)))).alias("r"))
    return down.groupBy("r", "c").agg(F.min(F.greatest(F.col("dc"), F.abs(F.col("r") - F.col("r0")))).alias("d"))


def soften(cost: DataFrame, band: DataFrame, k: int) -> DataFrame:
    """Raises ``cost`` near walls: up to one and a half times right beside one, falling to nothing at ``k`` cells."""
    near = band.where("d > 0").select("r", "c", (1 + 0.5 * (1 - F.col("d") / (k + 1))).alias("_by"))
    return cost.join(near, ["r", "c"], "left").withColumn("cost", (F.col("cost") * F.coalesce("_by", F.lit(1.0))).cast("float")).drop("_by")


def rasterise_polygons(cells: DataFrame, zones: DataFrame, cell_deg: float) -> DataFrame:
    """(r, c, zone) of the cells (r, c, with corner x0, y0) that a zone's polygon touches. Cells meet zones by coarse keys."""
    span = cell_deg * 16
    boxed = zones.withColumn("_x", F.explode(F.sequence(F.floor(F.array_min(F.transform("polygon", lambda v: v[0])) / span), F.floor(F.array_max(F.transform("polygon", lambda v: v[0])) / span))))
    boxed = boxed.withColumn("_y", F.explode(F.sequence(F.floor(F.array_min(F.transform("polygon", lambda v: v[1])) / span), F.floor(F.array_max(F.transform("polygon", lambda v: v[1])) / span))))
    eps = cell_deg * 1e-9
    keyed = cells.withColumn("_x", F.explode(F.sequence(F.floor((F.col("x0") - eps) / span), F.floor((F.col("x0") + cell_deg + eps) / span))))
    keyed = keyed.withColumn("_y", F.explode(F.sequence(F.floor((F.col("y0") - eps) / span), F.floor((F.col("y0") + cell_deg + eps) / span))))
    met = keyed.join(boxed, ["_x", "_y"])
    hit = met.where(rect_intersects_polygon(F.col("x0"), F.col("y0"), F.col("x0") + cell_deg, F.col("y0") + cell_deg, F.col("polygon")))
    return hit.select("r", "c", "zone").distinct()


def rasterise_circles(cells: DataFrame, zones: DataFrame, cell_deg: float) -> DataFrame:
    """(r, c, zone) of the cells whose centre lies in a zone's circle (clon, clat, radius_km)."""
    from geoloom.operators.joins import circles_containing

    centres = cells.withColumn("lon", F.col("x0") + cell_deg / 2).withColumn("lat", F.col("y0") + cell_deg / 2)
    return circles_containing(centres, zones).select("r", "c", "zone").distinct()


def ceiling_filter(cost: DataFrame, height: str, alt_m: float, clearance_m: float, slack_m: float = 300.0) -> DataFrame:
    """Cells whose ground with clearance reaches the flight level and a slack become walls."""
    return cost.withColumn("cost", F.when(F.col(height) + clearance_m >= alt_m + slack_m, float("inf")).otherwise(F.col("cost")).cast("float"))


def downsample(grid: DataFrame, k: int, value: str = "h") -> DataFrame:
    """Blocks of k x k cells: mean of known cells and the share of voids."""
    return grid.groupBy(F.floor(F.col("r") / k).alias("r"), F.floor(F.col("c") / k).alias("c")).agg(F.avg(value).alias("mean"), F.avg(F.when(F.col(value).isNull(), 1.0).otherwise(0.0)).alias("void_share"))


def synthetic_field(n: int) -> DataFrame:
    """A smooth test field of n x n costs from sines, with no random parts."""
    from pyspark.sql import SparkSession

    cells = SparkSession.getActiveSession().range(n * n)
    r, c = F.floor(F.col("id") / n).cast("int"), (F.col("id") % n).cast("int")
    return cells.select(r.alias("r"), c.alias("c"), (1 + 0.5 * (1 + F.sin(r * 0.13) * F.cos(c * 0.17))).cast("float").alias("cost"))


def grid_size(span_deg: Column, cell_m: float, most: int = 1024) -> Column:
    """Cells along a square region of ``span_deg`` for cells of about ``cell_m``, from 2 to ``most``."""
    return F.least(F.greatest(F.ceil(span_deg * 111_320.0 / cell_m), F.lit(2)), F.lit(most)).cast("int")


def pick_level(levels: DataFrame, wanted: float, key: str, cell: str = "cell") -> DataFrame:
    """For each key the coarsest level whose cell is at most ``wanted``, else the finest."""
    fits = F.when(F.col(cell) <= wanted, F.col(cell))
    best = levels.groupBy(key).agg(F.coalesce(F.max(fits), F.min(cell)).alias("_best"))
    return levels.join(best, key).where(F.col(cell) == F.col("_best")).drop("_best")


def mask_rgba(kind: Column) -> Column:
    """0xRRGGBBAA of a surface."""
    return F.when(kind == "Land", 0xC8D2AAFF).when(kind == "Lake", 0x9BC4E2FF).when(kind == "Water", 0x6FA8DCFF).otherwise(0).cast("long")


def void_statistics(grid: DataFrame, value: str = "h") -> DataFrame:
    """Cells, voids, share of voids, least, greatest and mean of a raster."""
    void = F.when(F.col(value).isNull(), 1).otherwise(0)
    return grid.agg(F.count("*").alias("cells"), F.sum(void).alias("voids"), F.avg(void.cast("double")).alias("void_share"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"))


def mask_area(mask: DataFrame, rows: int, cols: int) -> DataFrame:
    """Share of the grid that each class of segments covers."""
    return mask.groupBy("class").agg((F.sum(F.col("c1") - F.col("c0")) / float(rows * cols)).alias("share"))


def line_of_sight(rays: DataFrame, grid: DataFrame, n: int, key: str) -> DataFrame:
    """(key, blocked): rays (key, y1, x1, z1, y2, x2, z2 in cell units) sampled at n steps; blocked where the ray is at or
    below the height of a sampled cell; voids and cells outside do not block."""
    t = F.col("i") / float(n)
    s = rays.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(n))))
    s = s.withColumn("z", F.col("z1") + (F.col("z2") - F.col("z1")) * t)
    s = s.withColumn("r", F.floor(F.col("y1") + (F.col("y2") - F.col("y1")) * t)).withColumn("c", F.floor(F.col("x1") + (F.col("x2") - F.col("x1")) * t))
    met = s.join(grid.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col("h").alias("_h")), ["r", "c"], "left")
    return met.groupBy(key).agg(F.bool_or(F.coalesce(F.col("z") <= F.col("_h"), F.lit(False))).alias("blocked"))


