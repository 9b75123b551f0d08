"""Windows over ordered points: (path, seq, lon, lat, alt_m)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.scalar import angle_diff_deg, bearing_deg, circumradius, haversine_m, local_xy


def along(path: str = "path") -> Window:
    return Window.partitionBy(path).orderBy("seq")


def nxt(c: str, n: int = 1, path: str = "path") -> Column:
    return F.lead(c, n).over(along(path))


def prv(c: str, n: int = 1, path: str = "path") -> Column:
    return F.lag(c, n).over(along(path))


def with_segments(points: DataFrame) -> DataFrame:
    """Each point but a path's last with the next one: lon2, lat2, alt2."""
    return points.withColumn("lon2", nxt("lon")).withColumn("lat2", nxt("lat")).withColumn("alt2", nxt("alt_m")).where("lon2 IS NOT NULL")


def segment_length() -> Column:
    return haversine_m(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"))


def path_lengths(points: DataFrame) -> DataFrame:
    lens = with_segments(points).groupBy("path").agg(F.sum(segment_length()).alias("length_m"), F.count("*").alias("n_segments"))
    return lens


def headings(points: DataFrame) -> DataFrame:
    return with_segments(points).withColumn("heading_deg", bearing_deg(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")))


def turn_angles(points: DataFrame) -> DataFrame:
    """Signed turn at every inner vertex."""
    h = points.withColumn("lon2", nxt("lon")).withColumn("lat2", nxt("lat"))
    h = h.withColumn("heading_deg", F.when(F.col("lon2").isNotNull(), bearing_deg(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"))))
    h = h.withColumn("before", prv("heading_deg"))
    return h.where("heading_deg IS NOT NULL AND before IS NOT NULL").withColumn("turn_deg", angle_diff_deg(F.col("heading_deg"), F.col("before")))


def climb_angles(points: DataFrame) -> DataFrame:
    """Angle of every segment; null on a segment without horizontal length."""
    s = with_segments(points).withColumn("run_m", segment_length())
    return s.withColumn("climb_deg", F.when(F.col("run_m") > 1e-9, F.degrees(F.atan(F.abs(F.col("alt2") - F.col("alt_m")) / F.col("run_m")))))


def vertex_radii(points: DataFrame) -> DataFrame:
    """Radius of the circle through each inner vertex and its neighbours, in metres about their mean."""
    p = points
    for c in ("lon", "lat"):
        p = p.withColumn(f"{c}_a", prv(c)).withColumn(f"{c}_b", nxt(c))
    p = p.where("lon_a IS NOT NULL AND lon_b IS NOT NULL")
    # In steps that each later one uses more than once, so that no expression is repeated in the generated code.
    p = p.withColumn("_lon0", (F.col("lon_a") + F.col("lon") + F.col("lon_b")) / 3).withColumn("_lat0", (F.col("lat_a") + F.col("lat") + F.col("lat_b")) / 3)
    flat = ["_xa", "_ya", "_x", "_y", "_xb", "_yb"]
    xy = [v for s in ("_a", "", "_b") for v in local_xy(F.col(f"lon{s}"), F.col(f"lat{s}"), F.col("_lon0"), F.col("_lat0"))]
    p = p.withColumns(dict(zip(flat, xy)))
    return p.withColumn("radius_m", circumradius(*map(F.col, flat))).drop("_lon0", "_lat0", *flat)


def cumulative_distance(points: DataFrame) -> DataFrame:
    step = haversine_m(F.lag("lon").over(along()), F.lag("lat").over(along()), F.col("lon"), F.col("lat"))
    p = points.withColumn("step_m", F.coalesce(step, F.lit(0.0)))
    return p.withColumn("along_m", F.sum("step_m").over(along().rowsBetween(Window.unboundedPreceding, 0)))


def anchor_interpolate(points: DataFrame, anchor: str, at: str, floor: Column | None = None) -> DataFrame:
    """Adds ``value``: between the last and the next row with a non-null ``anchor``, linear in ``at``; beyond the
    outer anchors the nearest one; never below ``floor``."""
    back = along().rowsBetween(Window.unboundedPreceding, 0)
    ahead = along().rowsBetween(0, Window.unboundedFollowing)
    mark = F.when(F.col(anchor).isNotNull(), F.col(at))
    p = points.withColumn("_v0", F.last(anchor, True).over(back)).withColumn("_v1", F.first(anchor, True).over(ahead))
    p = p.withColumn("_a0", F.last(mark, True).over(back)).withColumn("_a1", F.first(mark, True).over(ahead))
    t = F.when(F.col("_a1") > F.col("_a0"), (F.col(at) - F.col("_a0")) / (F.col("_a1") - F.col("_a0"))).otherwise(F.lit(0.0))
    value = F.coalesce(F.col("_v0") + (F.col("_v1") - F.col("_v0")) * t, F.col("_v0"), F.col("_v1"))
    return p.withColumn("value", F.greatest(value, floor) if floor is not None else value).drop("_v0", "_v1", "_a0", "_a1")


def drop_repeats(points: DataFrame, eps: float = 1e-12) -> DataFrame:
    """Points that are at least ``eps`` from the last one kept in longitude or latitude, renumbered from 0; a point with a null
    coordinate stays. What comes far enough from the one before it stays whatever came earlier, so a path falls into
    runs that do not depend on each other, most of one point; an ordered fold goes through each."""
    rest = [c for c in points.columns if c not in ("path", "seq")]
    apart = lambda lon, lat, lon2, lat2: F.greatest(F.abs(lon - lon2), F.abs(lat - lat2))
    step = F.when(prv("lon").isNotNull() & prv("lat").isNotNull() & F.col("lon").isNotNull() & F.col("lat").isNotNull(), apart(F.col("lon"), F.col("lat"), prv("lon"), prv("lat")))
    # Equal neighbours first, so that a run without a move is one point and not an array.
    p = points.withColumn("_step", step).where("_step IS NULL OR _step > 0").drop("_step").withColumn("_step", step)
    # One within eps of what was kept, and one more than 2 eps from that: the latter is more than eps from what was kept.
    new = F.when(F.col("_step") <= 2.5 * eps, 0).otherwise(1)
    p = p.withColumn("_run", F.sum(new).over(along().rowsBetween(Window.unboundedPreceding, 0)))
    runs = p.groupBy("path", "_run").agg(F.array_sort(F.collect_list(F.struct("seq", *rest))).alias("_all"))

    def keep(kept: Column, v: Column) -> Column:
        last = F.element_at(kept, -1)
        return F.when(apart(v["lon"], v["lat"], last["lon"], last["lat"]) < eps, kept).otherwise(F.array_append(kept, v))

    one = F.size("_all") == 1
    kept = F.when(one, F.col("_all")).otherwise(F.aggregate(F.slice("_all", 2, F.size("_all")), F.slice("_all", 1, 1), keep))
    out = runs.select("path", F.inline(kept))
    return out.withColumn("seq", (F.row_number().over(along()) - 1).cast("long")).select(*points.columns)


def delta_encode(df: DataFrame, value: str, key: str, order: str) -> DataFrame:
    """Adds ``delta``: the 16-bit wrapping difference from the value before (the first value itself)."""
    d = F.col(value).cast("int") - F.coalesce(F.lag(value).over(Window.partitionBy(key).orderBy(order)).cast("int"), F.lit(0))
    return df.withColumn("delta", wrap16(d))


def delta_decode(df: DataFrame, delta: str, key: str, order: str) -> DataFrame:
    """Adds ``value``: the running sum modulo 2^16, as a signed number."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("value", wrap16(F.sum(F.col(delta).cast("long")).over(w)))


def wrap16(x: Column) -> Column:
    return (F.pmod(x.cast("long") + 32768, F.lit(65536)) - 32768).cast("smallint")
