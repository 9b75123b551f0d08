"""Polyline transforms, validation and grouped searches on (path, seq, lon, lat, alt_m)."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators import kernels, pathtree, sequence

#: What a path may exceed its limits by before it fails.
SOFT_TURN_DEG, SOFT_RADIUS_RATIO, SOFT_CHORD_M, SOFT_CLIMB_DEG = 2.0, 0.95, 50.0, 2.0
_POINT = "path {kind}, seq long, lon double, lat double, alt_m double"


def _drawn(rows: DataFrame, parts: Column, value: Callable[[str], Column]) -> DataFrame:
    """The points that each row of a path stands for: one for each of ``parts`` (an array), with the coordinates that ``value``
    makes of its column ``_t``. They are numbered by how many the rows before have, so nothing is sorted again."""
    p = rows.withColumn("_parts", parts)
    before = F.sum(F.size("_parts")).over(sequence.along().rowsBetween(Window.unboundedPreceding, -1))
    p = p.withColumn("_before", F.coalesce(before, F.lit(0)))
    p = p.select(*rows.columns, "_before", F.posexplode("_parts").alias("_pos", "_t"))
    return p.select("path", (F.col("_before") + F.col("_pos")).cast("long").alias("seq"), *(value(c).alias(c) for c in ("lon", "lat", "alt_m")))


def _whole(p: DataFrame) -> DataFrame:
    """With the number of the path's points (_n) and its first ``seq`` (_first)."""
    w = Window.partitionBy("path")
    return p.withColumn("_n", F.count("*").over(w)).withColumn("_first", F.min("seq").over(w))


def chaikin(points: DataFrame) -> DataFrame:
    """One round of corner cutting: the ends stay, every segment gives its quarter points. Short paths stay as they are."""
    p = points.select("path", "seq", "lon", "lat", "alt_m")
    for c in ("lon", "lat", "alt_m"):
        p = p.withColumn(f"_{c}", sequence.nxt(c))
    none = F.array().cast("array<double>")
    end = F.when((F.col("_n") < 3) | (F.col("seq") == F.col("_first")) | F.col("_lon").isNull(), F.array(F.lit(0.0))).otherwise(none)
    cuts = F.when((F.col("_n") >= 3) & F.col("_lon").isNotNull(), F.array(F.lit(0.25), F.lit(0.75))).otherwise(none)
    return _drawn(_whole(p), F.concat(end, cuts), lambda c: F.when(F.col("_t") == 0, F.col(c)).otherwise(F.col(c) + (F.col(f"_{c}") - F.col(c)) * F.col("_t")))


def catmull_rom(points: DataFrame, samples: int) -> DataFrame:
    """A spline through all points with ``samples`` points a segment; paths of fewer than three stay as they are."""
    p = points.select("path", "seq", "lon", "lat", "alt_m")
    for c in ("lon", "lat", "alt_m"):
        p = p.withColumn(f"_0{c}", F.coalesce(sequence.prv(c), F.col(c))).withColumn(f"_2{c}", sequence.nxt(c)).withColumn(f"_3{c}", F.coalesce(sequence.nxt(c, 2), sequence.nxt(c)))
    none = F.array().cast("array<int>")
    first = F.when((F.col("_n") < 3) | (F.col("seq") == F.col("_first")), F.array(F.lit(0))).otherwise(none)
    curve = F.when((F.col("_n") >= 3) & F.col("_2lon").isNotNull(), F.sequence(F.lit(1), F.lit(samples))).otherwise(none)
    t = F.col("_t") / float(samples)

    def at(c: str) -> Column:
        a, b, d, e = F.col(f"_0{c}"), F.col(c), F.col(f"_2{c}"), F.col(f"_3{c}")
        return F.when(F.col("_t") == 0, b).otherwise((2 * b + t * ((d - a) + t * ((2 * a - 5 * b + 4 * d - e) + t * (3 * b - a - 3 * d + e)))) * 0.5)

    return _drawn(_whole(p), F.concat(first, curve), at)


def densify(points: DataFrame, every_m: float = 200.0, least: int = 2, most: int = 64) -> DataFrame:
    """Points along every segment: one for each ``every_m`` metres, from ``least`` to ``most``, its far end included."""
    s = sequence.with_segments(points).withColumn("n", F.least(F.greatest(F.ceil(sequence.segment_length() / every_m), F.lit(least)), F.lit(most)).cast("int"))
    s = s.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    t = F.col("i") / F.col("n")
    return s.select("path", "seq", "i", *[(F.col(a) + (F.col(b) - F.col(a)) * t).alias(a) for a, b in (("lon", "lon2"), ("lat", "lat2"), ("alt_m", "alt2"))])


def validate(points: DataFrame, max_turn_deg: float, min_radius_m: float, max_climb_deg: float) -> DataFrame:
    """One row per breach: path, rule, severity (issue, or warning inside the tolerance), seq."""

    def judged(df: DataFrame, rule: str, issue: Column, warning: Column) -> DataFrame:
        return df.select("path", F.lit(rule).alias("rule"), F.when(issue, "issue").when(warning, "warning").alias("severity"), "seq").where("severity IS NOT NULL")

    turn, radius, climb = F.abs(F.col("turn_deg")), F.col("radius_m"), F.col("climb_deg")
    short = points.groupBy("path").agg(F.count("*").alias("_n"), F.min("seq").alias("seq")).where("_n < 2")
    out = judged(short, "too_short", F.lit(True), F.lit(False))
    out = out.unionByName(judged(sequence.turn_angles(points), "turn", turn > max_turn_deg + SOFT_TURN_DEG, turn > max_turn_deg))
    # An array of one, exploded: the filter on severity is not pushed below the steps of the radius, which it would repeat.
    radii = sequence.vertex_radii(points).withColumn("radius_m", F.explode(F.array("radius_m")))
    out = out.unionByName(judged(radii, "radius", radius < min_radius_m * SOFT_RADIUS_RATIO, radius < min_radius_m * 0.99))
    return out.unionByName(judged(sequence.climb_angles(points), "climb", climb > max_climb_deg + SOFT_CLIMB_DEG, climb > max_climb_deg))


def choose_stage(stages: DataFrame) -> DataFrame:
    """Of the rows (path, stage, n_points, ok) of each path the one that passes with the fewest points; ties: the later."""
    best = stages.where("ok").groupBy("path").agg(F.min(F.struct("n_points", (-F.col("stage")).alias("s"))).alias("b"))
    return best.select("path", (-F.col("b.s")).alias("stage"), F.col("b.n_points").alias("n_points"))


def point_to_path(points: DataFrame, path: DataFrame, key: str) -> DataFrame:
    """(key, path, distance_m) from points (key, path, plon, plat) to the nearest segment of their path."""
    return pathtree.nearest_segment(points, path, key).select(key, "path", "distance_m")


def by_path(points: DataFrame, work: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """A path-wise kernel: array of (lon, lat, alt) in, array of the same columns out.

    Points are dealt by path and sorted, and each task streams over its batches: thousands of short paths cost one
    Arrow batch rather than a function call with a frame each. Only one path is held at a time beside the batch.
    """
    schema = _POINT.format(kind=points.schema["path"].dataType.simpleString())

    def run(batches):
        held: list[tuple] = []
        name, kind_ = None, object

        def solve(parts):
            out = np.asarray(work(np.concatenate(parts)), float).reshape(-1, 3)
            return name, out

        def frame(done):
            names = np.repeat(np.array([n for n, _ in done], dtype=kind_), [len(o) for _, o in done])
            rows = np.concatenate([o for _, o in done])
            seq = np.concatenate([np.arange(len(o)) for _, o in done])
            return pd.DataFrame({"path": names, "seq": seq, "lon": rows[:, 0], "lat": rows[:, 1], "alt_m": rows[:, 2]})

        for pdf in batches:
            if not len(pdf):
                continue
            kind_ = pdf["path"].dtype if pdf["path"].dtype.kind in "iuf" else object
            keys, xyz, done = pdf["path"].to_numpy(), pdf[["lon", "lat", "alt_m"]].to_numpy(float), []
            cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if held and keys[i] != name:
                    done.append(solve(held))
                    held = []
                name = keys[i]
                held.append(xyz[i:j])
            if done:
                yield frame(done)
        if held:
            yield frame([solve(held)])

    rows = points.where("path IS NOT NULL").select("path", "seq", "lon", "lat", "alt_m")
    return rows.repartition("path").sortWithinPartitions("path", "seq").mapInPandas(run, schema)


def simplify(points: DataFrame, tolerance_m: float) -> DataFrame:
    return by_path(points, lambda p: p[kernels.simplify(p, tolerance_m)])


def shortcut(points: DataFrame, obstacles: list[list[tuple[float, float]]]) -> DataFrame:
    """Any-angle shortcuts that do not pass through the convex hulls of ``obstacles`` (a bounded list of polygons)."""
    hulls = [kernels.convex_hull(o) for o in obstacles]
    return by_path(points, lambda p: p[kernels.shortcut(p[:, :2].tolist(), lambda a, b: not any(kernels.passes_convex(a, b, h) for h in hulls))])


def grade_limit(points: DataFrame, max_climb_deg: float, floor_m: float) -> DataFrame:
    def work(p: np.ndarray) -> np.ndarray:
        rad = np.radians(p[:, :2])
        d = np.diff(rad, axis=0)
        a = np.sin(d[:, 1] / 2) ** 2 + np.cos(rad[:-1, 1]) * np.cos(rad[1:, 1]) * np.sin(d[:, 0] / 2) ** 2
        along = np.concatenate([[0], np.cumsum(2 * kernels.EARTH * np.arcsin(np.sqrt(np.clip(a, 0, 1))))])
        return np.column_stack([p[:, :2], kernels.grade_limit(along, p[:, 2], np.full(len(p), floor_m), max_climb_deg)])

    return by_path(points, work)


def fillet(points: DataFrame, radius_m: float, min_turn_deg: float = 15.0) -> DataFrame:
    """Sharp corners replaced by arcs; altitudes along an arc are the corner's."""

    def work(p: np.ndarray) -> np.ndarray:
        if len(p) < 3:
            return p
        lat0 = p[:, 1].mean()
        kx, ky = math.cos(math.radians(lat0)) * kernels.DEG_M, kernels.DEG_M
        points = p.tolist()
        xy, out = [(v[0] * kx, v[1] * ky) for v in points], [points[0]]
        for a, b, c, (_, _, alt) in zip(xy, xy[1:], xy[2:], points[1:]):
            turn = abs((math.degrees(math.atan2(c[1] - b[1], c[0] - b[0]) - math.atan2(b[1] - a[1], b[0] - a[0])) + 180) % 360 - 180)
            arc = kernels.fillet(a, b, c, radius_m, radius_m / 8) if turn > min_turn_deg else [b]
            out += [(x / kx, y / ky, alt) for x, y in arc]
        return np.array([*out, points[-1]])

    return by_path(points, work)


def hulls(points: DataFrame, key: str) -> DataFrame:
    """Convex hull of each key's points (lon, lat): key, seq, lon, lat. Only each longitude's lowest and
    highest point can be on the hull, so no more than these reach the kernel."""
    ends = points.groupBy(key, "lon").agg(F.min("lat").alias("lo"), F.max("lat").alias("hi"))
    kind = points.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h = kernels.convex_hull([*zip(pdf["lon"], pdf["lo"]), *zip(pdf["lon"], pdf["hi"])])
        return pd.DataFrame({key: pdf[key].iloc[0], "seq": range(len(h)), "lon": [x for x, _ in h], "lat": [y for _, y in h]})

    return ends.groupBy(key).applyInPandas(run, f"{key} {kind}, seq long, lon double, lat double")


def visibility(legs: DataFrame, obstacles: list[list[tuple[float, float]]], inflate: float) -> DataFrame:
    """For legs (leg, x1, y1, x2, y2): leg, status, n_points, length in the legs' units. Legs are dealt over tasks, as they may
    lie in one file, and vectorised by Arrow batch; the obstacles' part of the graph is made once a task."""
    kind = legs.schema["leg"].dataType.simpleString()

    def run(batches):
        sights = kernels.Sights(obstacles, inflate)
        for pdf in batches:
            found = sights.paths(pdf[["x1", "y1"]].to_numpy(float), pdf[["x2", "y2"]].to_numpy(float))
            yield pd.DataFrame({"leg": pdf["leg"], "status": [s for s, _ in found], "n_points": [len(p) for _, p in found], "length": [sum(map(math.dist, p, p[1:])) for _, p in found]})

    dealt = legs.select("leg", "x1", "y1", "x2", "y2").repartition("leg")
    return dealt.mapInPandas(run, f"leg {kind}, status string, n_points long, length double")


def dubins_paths(legs: DataFrame, radius: float) -> DataFrame:
    """For legs (leg, x1, y1, a1, x2, y2, a2; angles in radians from east to north): leg, word, length; null if none."""
    kind = legs.schema["leg"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            found = [kernels.dubins(tuple(v[:3]), tuple(v[3:]), radius) for v in pdf[["x1", "y1", "a1", "x2", "y2", "a2"]].to_numpy(float)]
            yield pd.DataFrame({"leg": pdf["leg"], "word": [f[0] if f else None for f in found], "length": [sum(f[1]) * radius if f else None for f in found]})

    return legs.select("leg", "x1", "y1", "a1", "x2", "y2", "a2").mapInPandas(run, f"leg {kind}, word string, length double")


def arrivals(fields: DataFrame, sources: DataFrame) -> DataFrame:
    """Fast marching of each field: cells (field, r, c, cost) and one source (field, src_r, src_c) give (field, r, c, t).
    A field is one group; fields run in parallel. A field's size is bounded by its grid (1024 x 1024: 4 MB)."""
    kind = fields.schema["field"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.full((int(pdf["r"].max()) + 1, int(pdf["c"].max()) + 1), np.inf, np.float32)
        grid[pdf["r"], pdf["c"]] = pdf["cost"]
        t = kernels.fast_march(grid, (int(pdf["src_r"].iloc[0]), int(pdf["src_c"].iloc[0])))
        return pd.DataFrame({"field": pdf["field"], "r": pdf["r"], "c": pdf["c"], "t": t[pdf["r"], pdf["c"]]})

    return fields.join(sources, "field").select("field", "r", "c", "cost", "src_r", "src_c").groupBy("field").applyInPandas(run, f"field {kind}, r int, c int, t float")


def traces(times: DataFrame, ends: DataFrame, straight: bool = False) -> DataFrame:
    """Back-traces on arrival fields: ends (field, src_r, src_c, dst_r, dst_c) give (field, seq, r, c) from the source.
    ``straight`` keeps only the cells between which straight lines stay on cells that were reached: right for fields whose
    free cells cost the same."""
    kind = times.schema["field"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.full((int(pdf["r"].max()) + 1, int(pdf["c"].max()) + 1), np.inf, np.float32)
        grid[pdf["r"], pdf["c"]] = pdf["t"]
        e = pdf.iloc[0]
        found = kernels.back_trace(grid, (int(e["dst_r"]), int(e["dst_c"])), (int(e["src_r"]), int(e["src_c"]))) or []
        found = kernels.tighten(found, np.isinf(grid)) if straight else found
        return pd.DataFrame({"field": pdf["field"].iloc[:1].repeat(len(found)).to_numpy(), "seq": range(len(found)), "r": [p[0] for p in reversed(found)], "c": [p[1] for p in reversed(found)]})

    return times.join(ends, "field").select("field", "r", "c", "t", "src_r", "src_c", "dst_r", "dst_c").groupBy("field").applyInPandas(run, f"field {kind}, seq int, r int, c int")


def ways(cells: DataFrame) -> DataFrame:
    """Straight back-traces (field, seq, r, c) from source to target of fields whose free cells cost the same, as ``arrivals``
    and ``traces`` would give: ``cells`` (field, n, src_r, src_c, dst_r, dst_c, r, c, cost), of which a field's n x n follow
    each other in one partition. Only blocked cells, and the first of each field, go to Python; nothing is shuffled."""
    kind = cells.schema["field"].dataType.simpleString()

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now = None

        def way() -> pd.DataFrame:
            name, n, *ends = now
            src, dst = (ends[0], ends[1]), (ends[2], ends[3])
            if any(len(r) for r, _ in held):
                grid = np.ones((n, n), np.float32)
                for r, c in held:
                    grid[r, c] = np.inf
                times = kernels.fast_march(grid, src)
                found = kernels.back_trace(times, dst, src) or []
                found = kernels.tighten(found, np.isinf(times))[::-1]
            else:  # every line is clear, so the trace is straightened to its ends
                found = [src, dst][: 1 + (src != dst)]
            at = np.array(found, np.int32).reshape(-1, 2)
            return pd.DataFrame({"field": np.array([name] * len(at), object), "seq": np.arange(len(at), dtype=np.int32), "r": at[:, 0], "c": at[:, 1]})

        for pdf in batches:
            if not len(pdf):
                continue
            keys, r, c, walls = pdf["field"].to_numpy(), pdf["r"].to_numpy(), pdf["c"].to_numpy(), pdf["wall"].to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            done = []
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if now is None or keys[i] != now[0]:
                    if now is not None:
                        done.append(way())
                    held, now = [], (keys[i], *(int(pdf[k].iat[i]) for k in ("n", "src_r", "src_c", "dst_r", "dst_c")))
                shut = walls[i:j]
                held.append((r[i:j][shut], c[i:j][shut]))
            if done:
                yield pd.concat(done)
        if now is not None:
            yield way()

    wall = cells.withColumn("wall", F.isnan("cost") | (F.col("cost") == float("inf"))).where("wall OR (r = 0 AND c = 0)")
    return wall.select("field", "n", "src_r", "src_c", "dst_r", "dst_c", "r", "c", "wall").mapInPandas(run, f"field {kind}, seq int, r int, c int")


def geodesic_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Ellipsoidal distance (WGS84), vectorised over Arrow batches."""

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(kernels.vincenty_m(a, b, c, d))

    return distance(lon1, lat1, lon2, lat2)
