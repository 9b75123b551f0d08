"""Nearest segments and vertices of paths by a packed tree of boxes.

The segments of a path are packed in their order, ``FANOUT`` to a box, boxes to boxes, up to one: a level of the tree is
a table with a row for each box, which has its children. A search goes down a level a step, all queries at once: a query
meets the children of the boxes it still has, keeps those whose nearest possible item is not beyond the nearest that
some box must hold, and joins the next level by path and box. So a query looks at a few boxes a level, whatever the
length of its path. The upper levels, whose rows all queries of a path meet, are repeated under salts.

Distances are in degrees of latitude, longitude shrunk by a factor of the item (or of the path), of which a box knows
the range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.geometry import point_segment_m, point_segment_plane
from geoloom.operators import sequence
from geoloom.runtime import materialize

FANOUT = 32
SALTS = 8
#: Degrees by which a bound may be missed by rounding.
_SLACK = 1e-9
_BOX = ("x0", "y0", "x1", "y1", "k0", "k1")


def _level(items: DataFrame) -> DataFrame:
    """One row for each box of ``items`` (path, id, box, any others): path, node, kids."""
    rest = [c for c in items.columns if c not in ("path", "id")]
    grouped = items.groupBy("path", F.floor(F.col("id") / FANOUT).alias("node"))
    return grouped.agg(F.sort_array(F.collect_list(F.struct("id", *rest))).alias("kids"))


def _boxes(level: DataFrame) -> DataFrame:
    """The boxes of a level as items of the next."""
    ends = [(F.array_min if c.endswith("0") else F.array_max)(F.col(f"kids.{c}")).alias(c) for c in _BOX]
    return level.select("path", F.col("node").alias("id"), *ends)


def build(items: DataFrame) -> list[DataFrame]:
    """The levels of the tree over ``items`` (path, id from 0, x0, y0, x1, y1, k0, k1, any others), lowest first; the box 0
    of the last is the whole path. Where no path has more than one box it is the items as they are: they meet queries
    by path alone, and stay in the tasks that their path is in."""
    top = items.agg(F.max("id")).first()[0] or 0
    if top < FANOUT:
        return [items]  # no path has more than a box
    levels = [_level(items)]
    while top := top // FANOUT:
        levels.append(_level(_boxes(levels[-1])))
    return [materialize(level) for level in levels]


def search(queries: DataFrame, levels: list[DataFrame], after: str | None = None) -> DataFrame:
    """The items that may be nearest to each of ``queries`` (key, path, px, py; keys are distinct): its columns and the
    item's as ``item``. With a column ``after`` only items of a greater id count."""
    own = list(dict.fromkeys(["key", "path", "px", "py", *([after] if after else [])]))
    # A column of the first level's boxes: all queries begin with box 0.
    at = queries.select(*own, F.lit(0).cast("long").alias("node"), F.lit(float("inf")).alias("bound"))
    px, py = F.col("px"), F.col("py")
    for no in range(len(levels) - 1, 0, -1):
        salted = levels[no].withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = at.withColumn("_salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, ["path", "node", "_salt"])
        size = FANOUT**no

        def judge(k: Column) -> Column:
            gap_x, gap_y = F.greatest(k["x0"] - px, px - k["x1"], F.lit(0.0)), F.greatest(k["y0"] - py, py - k["y1"], F.lit(0.0))
            to_x, to_y = [F.abs(px - k[c]) * k["k1"] for c in ("x0", "x1")], [F.abs(py - k[c]) for c in ("y0", "y1")]
            least = F.sqrt(gap_x * k["k0"] * gap_x * k["k0"] + gap_y * gap_y)
            # Each side of a box touches an item: one is no further than the far end of the nearer side.
            most = F.least(*[F.sqrt(F.pow(F.least(*a), F.lit(2.0)) + F.pow(F.greatest(*b), F.lit(2.0))) for a, b in ((to_x, to_y), (to_y, to_x))])
            if after:
                most = F.when(k["id"] * size > F.col(after), most).otherwise(F.lit(float("inf")))
            return F.struct(k["id"].alias("id"), least.alias("least"), most.alias("most"))

        seen = met.withColumn("seen", F.transform("kids", judge))
        if after:
            seen = seen.withColumn("seen", F.filter("seen", lambda k: (k["id"] + 1) * size - 1 > F.col(after)))
        best = F.least(F.col("bound"), F.coalesce(F.array_min(F.col("seen.most")), F.lit(float("inf"))))
        seen = seen.withColumn("best", best).select(*own, "best", F.filter("seen", lambda k: k["least"] <= F.col("best") + _SLACK).alias("seen"))
        held = seen.groupBy(*own).agg(F.min("best").alias("bound"), F.flatten(F.collect_list("seen")).alias("seen"))
        at = held.select(*own, "bound", F.explode(F.filter("seen", lambda k: k["least"] <= F.col("bound") + _SLACK)).alias("kid")).select(*own, F.col("kid.id").alias("node"), "bound")
    if "kids" in levels[0].columns:
        met = at.join(levels[0], ["path", "node"]).select(*own, F.explode("kids").alias("item"))
    else:
        item = F.struct("id", *[c for c in levels[0].columns if c not in ("path", "id")])
        met = at.select(*own).join(levels[0].select("path", item.alias("item")), "path")
    return met.where(F.col("item.id") > F.col(after)) if after else met


def segments(path: DataFrame) -> DataFrame:
    """The segments of ``path`` (path, seq, lon, lat, alt_m) as items; their factor is that of their middle latitude."""
    s = sequence.with_segments(path)
    order = Window.partitionBy("path").orderBy("seq")
    k = F.greatest(F.cos(F.radians((F.col("lat") + F.col("lat2")) / 2)), F.lit(1e-6))
    box = [F.least("lon", "lon2").alias("x0"), F.least("lat", "lat2").alias("y0"), F.greatest("lon", "lon2").alias("x1"), F.greatest("lat", "lat2").alias("y1"), k.alias("k0"), k.alias("k1")]
    return s.select("path", (F.row_number().over(order) - 1).cast("long").alias("id"), *box, "seq", "lon", "lat", "alt_m", "lon2", "lat2", "alt2")


def nearest_segment(points: DataFrame, path: DataFrame, key: str) -> DataFrame:
    """(``key``, path, seq, distance_m, alt_m): for each of ``points`` (key, path, plon, plat; keys are distinct) the nearest
    segment of its path by distances rounded to a micrometre, ties to the first, and the height at its nearest point.
    Points without coordinates and paths of fewer than two points give none."""
    return nearest_in(points, build(segments(path)), key)


def nearest_in(points: DataFrame, levels: list[DataFrame], key: str) -> DataFrame:
    """``nearest_segment`` of paths whose tree is built already."""
    queries = points.select(F.col(key).alias("key"), "path", F.col("plon").alias("px"), F.col("plat").alias("py")).where("px IS NOT NULL AND py IS NOT NULL")
    met = search(queries, levels)
    i = F.col("item")
    d = point_segment_m(F.col("px"), F.col("py"), i["lon"], i["lat"], i["lon2"], i["lat2"])
    best = met.groupBy("key", "path").agg(F.min(F.struct(F.round(d, 6).alias("rounded"), i["seq"].alias("seq"), d.alias("d"), i.alias("item"))).alias("b"), F.first("px").alias("px"), F.first("py").alias("py"))
    b = F.col("b.item")
    k = F.cos(F.radians((b["lat"] + b["lat2"]) / 2))
    vx, vy = (b["lon2"] - b["lon"]) * k, b["lat2"] - b["lat"]
    along = (F.col("px") - b["lon"]) * k * vx + (F.col("py") - b["lat"]) * vy
    t = F.coalesce(F.least(F.greatest(F.try_divide(along, vx * vx + vy * vy), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return best.select(F.col("key").alias(key), "path", "b.seq", F.col("b.d").alias("distance_m"), (b["alt_m"] + (b["alt2"] - b["alt_m"]) * t).alias("alt_m"))


def match_anchors(anchors: DataFrame, vertices: DataFrame) -> DataFrame:
    """(path, anchor, seq): the vertices that a path's anchors (path, anchor, lon, lat; anchor gives their order) stand for:
    for each in turn the nearest vertex (path, seq, lon2, lat2) after the one before it by distances rounded to 1e-9 degrees, so
    that vertices as far on either side are ties in every engine, which go to the first; null where none is left. Longitude shrinks at the latitude of the path's first vertex.

    All anchors are searched at once; only those from the first that is not beyond the one before it are searched again, of
    each path one a round, so that paths whose anchors lie in order take one round.
    """
    in_path, order = Window.partitionBy("path"), Window.partitionBy("path").orderBy("seq")
    k = F.greatest(F.cos(F.radians(F.first("lat2").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))), F.lit(1e-6))
    v = vertices.select("path", "seq", "lon2", "lat2", (F.row_number().over(order) - 1).cast("long").alias("id"), k.alias("k"))
    levels = build(v.select("path", "id", F.col("lon2").alias("x0"), F.col("lat2").alias("y0"), F.col("lon2").alias("x1"), F.col("lat2").alias("y1"), F.col("k").alias("k0"), F.col("k").alias("k1"), "seq"))
    by_anchor = Window.partitionBy("path").orderBy("anchor")
    own = anchors.select("path", F.col("anchor"), F.col("lon").alias("px"), F.col("lat").alias("py"), (F.row_number().over(by_anchor) - 1).alias("no"))
    left = own.withColumn("key", F.struct("path", "no")).withColumn("after", F.lit(-1).cast("long"))
    found = None
    while True:
        i = F.col("item")
        d = point_segment_plane(F.col("px") * i["k0"], F.col("py"), i["x0"] * i["k0"], i["y0"], i["x0"] * i["k0"], i["y0"])
        near = search(left, levels, "after").groupBy("key").agg(F.min(F.struct(F.round(d, 9).alias("d"), i["id"].alias("id"), i["seq"].alias("seq"))).alias("b"))
        near = left.join(near, "key", "left").select("path", "no", F.col("b.id").alias("id"), F.col("b.seq").alias("seq"))
        if found is not None:
            kept = found.join(near.select("path", "no"), ["path", "no"], "left_anti")
            near = kept.unionByName(near)
        found = materialize(near)
        # An anchor after one without a vertex has none either, and is not searched again.
        beyond = F.max("id").over(Window.partitionBy("path").orderBy("no").rowsBetween(Window.unboundedPreceding, -1))
        none = F.max(F.when(F.col("id").isNull(), 1).otherwise(0)).over(Window.partitionBy("path").orderBy("no").rowsBetween(Window.unboundedPreceding, -1))
        wrong = found.withColumn("before", beyond).withColumn("none", F.coalesce(none, F.lit(0))).where("id IS NOT NULL AND (none = 1 OR id <= before)")
        first = materialize(wrong.withColumn("first", F.min("no").over(in_path)).where("no = first").select("path", "no", F.when(F.col("none") == 1, F.lit((1 << 62))).otherwise(F.col("before")).cast("long").alias("after")))
        if first.isEmpty():
            return own.join(found.select("path", "no", "seq"), ["path", "no"]).select("path", "anchor", "seq")
        left = own.join(first, ["path", "no"]).withColumn("key", F.struct("path", "no"))
