"""Windowed figures of moving vehicles from a stream of positions (vehicle, ts, lon, lat, alt_m)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators.joins import point_cells


def window_bounds(positions: DataFrame, every: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Box, altitudes and count of each vehicle in each window; rows later than ``late`` are left out. State is one small
    row for each vehicle and open window."""
    w = F.window("ts", every)
    box = [F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"), F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("alt_m").alias("low_m"), F.max("alt_m").alias("high_m"), F.count("*").alias("n")]
    out = positions.withWatermark("ts", late).groupBy("vehicle", w.alias("w")).agg(*box)
    return out.select("vehicle", F.col("w.start").alias("start"), *[c for c in out.columns if c not in ("vehicle", "w")])


def crowded_cells(positions: DataFrame, cell_deg: float, least: int, every: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Cells of the spatial joins that hold ``least`` positions or more in a window: where separation needs a look."""
    keyed = point_cells(positions, "lon", "lat", cell_deg).withWatermark("ts", late)
    out = keyed.groupBy("_band", "_cell", F.window("ts", every).alias("w")).agg(F.count("*").alias("n"), F.approx_count_distinct("vehicle").alias("vehicles"))
    return out.where(F.col("n") >= least).select(F.col("_band").alias("band"), F.col("_cell").alias("cell"), F.col("w.start").alias("start"), "n", "vehicles")
