"""Scenarios in JSON to paths: strict parse, validation, cost field, fast marching, simplification, checks, output.

A scenario has vehicles with a start, a target and waypoints between, no-fly zones and obstacles (walls), restricted
zones with an altitude band, and parameters. One text row is one scenario; everything after the parse is relational
and runs for all scenarios at once, the fields as groups of one Arrow function. Terrain and zones only.

A restricted zone whose band holds a leg's altitude is passed under, or else over, where the climb fits between the leg's
ends and the zone; else it is a wall for that leg. A leg whose climbs turn out not to fit the path that was found (too near
an end, or to the next zone's) is planned once more with all its restricted zones as walls.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.functions.geometry import in_circle, point_in_polygon, polygon_boundary_km, rect_intersects_polygon, segment_circle_interval, segment_circle_km, segment_polygon_km
from geoloom.functions.scalar import EARTH_RADIUS_M, clamp, haversine_m
from geoloom.operators import conflicts, paths, profile, raster, sequence
from geoloom.operators.vehicles import DEFAULTS
from geoloom.runtime import materialize, tasks_for

_WAYPOINT = "struct<lon: double, lat: double, alt_m: double>"
_PROFILE = "struct<aircraft_type: string, cruise_speed_mps: double, speed_range_mps: array<double>, min_turn_radius_m: double, max_climb_angle_deg: double, max_bank_deg: double, ceiling_m: double>"
_ZONE = "struct<id: string, shape: string, geometry: struct<center: array<double>, radius_km: double, vertices: array<array<double>>>, alt_min_m: double, alt_max_m: double>"
#: The input contract.
SCENARIO = f"struct<scenario_id: string, aircraft: array<struct<id: string, profile: {_PROFILE}, start: {_WAYPOINT}, target: {_WAYPOINT}, mid_waypoints: array<{_WAYPOINT}>>>, no_fly_zones: array<{_ZONE}>, restricted_zones: array<{_ZONE}>, obstacles: array<{_ZONE}>, terrain: struct<source: string, path: string, mask_path: string>, parameters: map<string, double>>"
KEYS = ["scenario_id", "aircraft", "no_fly_zones", "restricted_zones", "obstacles", "terrain", "parameters"]
#: Reason codes of rejected inputs, in the order in which they are tested.
REASONS = ("malformed_json", "unknown_field", "missing_aircraft", "vehicle_params_inconsistent", "out_of_bounds", "illegal_coordinate", "degenerate_start_equals_target", "target_in_no_fly", "mid_waypoint_in_no_fly")
GRID, PAD_DEG = 48, 0.15
TOLERANCE_M = 500.0
#: Legs of which a task makes the fields, at most: about ten seconds.
LEGS_PER_TASK = 500
#: Texts that a task parses, at most: a few seconds.
TEXTS_PER_TASK = 10_000
#: Regions wider than this have cells of about so many metres, finer where a wall is a polygon.
WIDE_DEG, CELL_M, POLYGON_CELL_M = 2.5, 1_100.0, 600.0


def merged(value: Column, valid: Column, default) -> Column:
    """An override where it is valid, else the default."""
    return F.coalesce(F.when(valid & ~F.isnan(value), value), F.lit(default))


def only_keys(text: Column, keys: list[str]) -> Column:
    """Whether a JSON object has no other top-level keys; Spark's parser would pass over them in silence."""
    return F.size(F.array_except(F.json_object_keys(text), F.array(*map(F.lit, keys)))) == 0


#: The keys of each kind of object.
FIELDS = {
    "vehicle": ["id", "profile", "start", "target", "mid_waypoints"],
    "profile": ["aircraft_type", "cruise_speed_mps", "speed_range_mps", "min_turn_radius_m", "max_climb_angle_deg", "max_bank_deg", "ceiling_m"],
    "waypoint": ["lon", "lat", "alt_m"],
    "zone": ["id", "shape", "geometry", "alt_min_m", "alt_max_m"],
    "geometry": ["center", "radius_km", "vertices"],
    "terrain": ["source", "path", "mask_path"],
}


def strange_keys(text: Column) -> Column:
    """Whether an object at any level has a key that the contract does not know; false where the text is no JSON."""

    def objects(part: Column) -> Column:
        return F.coalesce(F.from_json(part, "array<map<string, string>>"), F.array().cast("array<map<string, string>>"))

    def odd(keys: Column, kind: str) -> Column:
        return F.coalesce(F.size(F.array_except(keys, F.array(*map(F.lit, FIELDS[kind])))) > 0, F.lit(False))

    def within(m: Column, key: str, kind: str) -> Column:
        return odd(F.json_object_keys(m[key]), kind)

    def vehicle(m: Column) -> Column:
        stops = F.exists(objects(m["mid_waypoints"]), lambda w: odd(F.map_keys(w), "waypoint"))
        return odd(F.map_keys(m), "vehicle") | within(m, "profile", "profile") | within(m, "start", "waypoint") | within(m, "target", "waypoint") | stops

    found = F.exists(objects(F.get_json_object(text, "$.aircraft")), vehicle) | odd(F.json_object_keys(F.get_json_object(text, "$.terrain")), "terrain")
    for zones in ("no_fly_zones", "restricted_zones", "obstacles"):
        found = found | F.exists(objects(F.get_json_object(text, f"$.{zones}")), lambda m: odd(F.map_keys(m), "zone") | within(m, "geometry", "geometry"))
    return found


def reason(lon: Column, lat: Column, lon2: Column, lat2: Column, limit: Column, zone_lon: Column, zone_lat: Column, radius_km: Column) -> Column:
    """The first test that a start and target fail, or ok."""
    return (
        F.when(limit < 0, "out_of_bounds")
        .when(haversine_m(lon, lat, lon2, lat2) < 100, "degenerate_start_equals_target")
        .when(in_circle(lon, lat, zone_lon, zone_lat, radius_km), "target_in_no_fly")
        .otherwise("ok")
    )


def parse(texts: DataFrame, column: str = "scenario") -> DataFrame:
    """``s`` (the scenario) and ``rejected`` (a reason, or null) of each text."""
    known = only_keys(F.col(column), KEYS) & ~strange_keys(F.col(column))
    p = texts.select(F.from_json(F.col(column), SCENARIO).alias("s"), known.alias("known"))
    return p.select("s", F.when(F.col("known").isNull(), "malformed_json").when(~F.col("known"), "unknown_field").when(F.coalesce(F.size("s.aircraft"), F.lit(0)) < 1, "missing_aircraft").alias("rejected"))


def _inside(p: Column, z: Column) -> Column:
    g = z["geometry"]
    circle = in_circle(p["lon"], p["lat"], g["center"][0], g["center"][1], g["radius_km"])
    return F.coalesce(F.when(z["shape"] == "circle", circle).otherwise(point_in_polygon(p["lon"], p["lat"], g["vertices"])), F.lit(False))


def _illegal(p: Column) -> Column:
    return F.coalesce(~(p["lon"].between(-180, 180) & p["lat"].between(-90, 90)), F.lit(True))


def validate(parsed: DataFrame) -> DataFrame:
    """Fills ``rejected`` with the first reason that applies."""
    s = F.col("s")
    vehicles, walls = s["aircraft"], F.coalesce(s["no_fly_zones"], F.array().cast(f"array<{_ZONE}>"))

    def bad_profile(v: Column) -> Column:
        p = v["profile"]
        span, radius = p["speed_range_mps"], p["min_turn_radius_m"]
        odd = (span[0] <= 0) | (span[1] < span[0])
        return F.coalesce(odd, F.lit(False)) | F.coalesce((p["aircraft_type"] == "FIXED_WING") & (radius < 1), F.lit(False))

    def bad_speed(v: Column) -> Column:
        speed = F.coalesce(v["profile"]["cruise_speed_mps"], v["profile"]["speed_range_mps"][0])
        return F.coalesce(~speed.between(1, 1000), F.lit(False))

    def mids(v: Column) -> Column:
        return F.coalesce(v["mid_waypoints"], F.array().cast(f"array<{_WAYPOINT}>"))

    tests = [
        ("vehicle_params_inconsistent", (F.size(F.array_distinct(F.transform(vehicles, lambda v: v["id"]))) < F.size(vehicles)) | F.exists(vehicles, bad_profile)),
        ("out_of_bounds", F.exists(vehicles, bad_speed) | F.coalesce(F.exists(s["restricted_zones"], lambda z: ~F.coalesce(z["alt_min_m"] < z["alt_max_m"], F.lit(False))), F.lit(False))),
        ("illegal_coordinate", F.exists(vehicles, lambda v: _illegal(v["start"]) | _illegal(v["target"]) | F.exists(mids(v), _illegal))),
        ("degenerate_start_equals_target", F.exists(vehicles, lambda v: haversine_m(v["start"]["lon"], v["start"]["lat"], v["target"]["lon"], v["target"]["lat"]) < 100)),
        ("target_in_no_fly", F.exists(vehicles, lambda v: F.exists(walls, lambda z: _inside(v["start"], z) | _inside(v["target"], z)))),
        ("mid_waypoint_in_no_fly", F.exists(vehicles, lambda v: F.exists(mids(v), lambda w: F.exists(walls, lambda z: _inside(w, z))))),
    ]
    found = F.col("rejected")
    for name, test in tests:
        found = F.coalesce(found, F.when(test, name))
    return parsed.withColumn("rejected", found)


def _reach_m(p: Column, z: Column) -> Column:
    """Metres from a waypoint to a zone's boundary; not above zero from inside."""
    g = z["geometry"]
    circle = haversine_m(p["lon"], p["lat"], g["center"][0], g["center"][1]) - g["radius_km"] * 1000
    return F.when(z["shape"] == "circle", circle).otherwise(polygon_boundary_km(p["lon"], p["lat"], g["vertices"]) * 1000)


def legs(valid: DataFrame) -> DataFrame:
    """One row per leg: field (its key), scenario_id, vehicle, leg, a and b (waypoints), walls, climb_deg, and passes: the
    restricted zones (z) that it goes under or over, and the height (level) that it takes there. Zones that it has to go
    round are among the walls; zones whose band holds neither end's altitude nor one between are no concern of it."""
    none = F.array().cast(f"array<{_ZONE}>")
    v = valid.where("rejected IS NULL").select("s.scenario_id", F.explode("s.aircraft").alias("v"), F.concat(F.coalesce("s.no_fly_zones", none), F.coalesce("s.obstacles", none)).alias("walls"), F.coalesce("s.restricted_zones", none).alias("zones"))
    stops = v.select("scenario_id", F.col("v.id").alias("vehicle"), F.coalesce("v.profile.max_climb_angle_deg", F.lit(DEFAULTS["max_climb_angle_deg"])).alias("climb_deg"), F.coalesce("v.profile.ceiling_m", F.lit(float("inf"))).alias("ceiling_m"), F.concat(F.array("v.start"), F.coalesce("v.mid_waypoints", F.array()), F.array("v.target")).alias("stops"), "walls", "zones")
    each = stops.select("*", F.posexplode(F.slice("stops", 1, F.size("stops") - 1)).alias("leg", "a")).withColumn("b", F.get("stops", F.col("leg") + 1))
    a, b = F.col("a.alt_m"), F.col("b.alt_m")

    def decided(z: Column) -> Column:
        lo, hi = z["alt_min_m"], z["alt_max_m"]
        way = profile.band_decision(lo, hi, F.col("ceiling_m"), F.lit(float("-inf")), _reach_m(F.col("a"), z), _reach_m(F.col("b"), z), a, b, F.col("climb_deg"))
        level = F.when(way == "below", lo - profile.BAND_GAP_M).when(way == "above", hi + profile.BAND_GAP_M)
        return F.struct(z.alias("z"), level.alias("level"))

    held = F.filter("zones", lambda z: (F.least(a, b) <= z["alt_max_m"]) & (F.greatest(a, b) >= z["alt_min_m"]))
    each = each.withColumn("decided", F.transform(held, decided))
    round_ = F.transform(F.filter("decided", lambda d: d["level"].isNull()), lambda d: d["z"])
    return each.select(
        F.concat_ws("/", "scenario_id", "vehicle", "leg").alias("field"), "scenario_id", "vehicle", "leg", "a", "b", F.concat("walls", round_).alias("walls"),
        "climb_deg", F.filter("decided", lambda d: d["level"].isNotNull()).alias("passes"),
    )


def alike(legs_: DataFrame) -> DataFrame:
    """``legs_`` with ``way``, a digest of all that a leg's way follows from: its ends, the shapes of its walls and passes, the climb."""
    shape = lambda z: F.struct(z["shape"].alias("shape"), z["geometry"].alias("geometry"))
    passes = F.transform("passes", lambda p: F.struct(shape(p["z"]).alias("z"), p["level"].alias("level")))
    return legs_.withColumn("way", F.sha2(F.to_json(F.struct("a", "b", "climb_deg", F.transform("walls", shape).alias("walls"), passes.alias("passes"))), 256))


def cost_cells(legs_: DataFrame, n: int = GRID) -> DataFrame:
    """Each leg with its place in a square field about it, and the cells of the fields: field, n, src_r, src_c, dst_r, dst_c, r, c,
    cost (infinite within half a cell of a wall, but for the cells of the leg's ends). A field has ``n`` cells a side, more in
    wide regions. The cells of a field follow each other, row by row, in one partition."""
    x0, x1 = F.least("a.lon", "b.lon"), F.greatest("a.lon", "b.lon")
    y0, y1 = F.least("a.lat", "b.lat"), F.greatest("a.lat", "b.lat")
    span = F.greatest(x1 - x0, y1 - y0) * 1.5 + 2 * PAD_DEG
    wanted = F.when(F.exists("walls", lambda z: z["shape"] == "polygon"), POLYGON_CELL_M).otherwise(CELL_M)
    side = F.when(span > WIDE_DEG, F.greatest(raster.grid_size(span, wanted), F.lit(n))).otherwise(F.lit(n))
    f = legs_.withColumn("n", side).withColumn("cell", span / F.col("n"))
    f = f.withColumn("west", (x0 + x1) / 2 - span / 2).withColumn("south", (y0 + y1) / 2 - span / 2)
    at = lambda v, o: F.least(F.greatest(F.floor((v - F.col(o)) / F.col("cell")), F.lit(0)), F.col("n") - 1).cast("int")

    def box(z: Column) -> Column:
        """The wall with the box about it, padded by a cell, so that most cells need no more than four comparisons."""
        g, pad = z["geometry"], F.col("cell")
        reach_y = g["radius_km"] / 111.0
        reach_x = reach_y / F.greatest(F.cos(F.radians(g["center"][1])), F.lit(1e-6))
        xs, ys = F.transform(g["vertices"], lambda v: v[0]), F.transform(g["vertices"], lambda v: v[1])
        circle = z["shape"] == "circle"
        pick = lambda c, p: F.when(circle, c).otherwise(p)
        return F.struct(
            z.alias("z"),
            (pick(g["center"][0] - reach_x, F.array_min(xs)) - pad).alias("x0"), (pick(g["center"][0] + reach_x, F.array_max(xs)) + pad).alias("x1"),
            (pick(g["center"][1] - reach_y, F.array_min(ys)) - pad).alias("y0"), (pick(g["center"][1] + reach_y, F.array_max(ys)) + pad).alias("y1"),
        )

    f = f.withColumn("boxes", F.transform("walls", box))
    f = f.select("boxes", "field", "scenario_id", "vehicle", "leg", "a", "b", "walls", "n", "west", "south", "cell", at(F.col("a.lat"), "south").alias("src_r"), at(F.col("a.lon"), "west").alias("src_c"), at(F.col("b.lat"), "south").alias("dst_r"), at(F.col("b.lon"), "west").alias("dst_c"))
    cells = f.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") * F.col("n") - 1))).withColumn("r", F.floor(F.col("i") / F.col("n")).cast("int")).withColumn("c", (F.col("i") % F.col("n")).cast("int"))
    x, y, cell = F.col("west") + F.col("c") * F.col("cell"), F.col("south") + F.col("r") * F.col("cell"), F.col("cell")

    def walled(w: Column) -> Column:
        z = w["z"]
        g = z["geometry"]
        near = (x <= w["x1"]) & (x + cell >= w["x0"]) & (y <= w["y1"]) & (y + cell >= w["y0"])
        circle = haversine_m(x + cell / 2, y + cell / 2, g["center"][0], g["center"][1]) <= g["radius_km"] * 1000 + cell * (math.pi / 180 * EARTH_RADIUS_M * 0.75)
        return F.when(~near, False).when(z["shape"] == "circle", F.coalesce(circle, F.lit(False))).otherwise(F.coalesce(rect_intersects_polygon(x - cell / 2, y - cell / 2, x + cell * 1.5, y + cell * 1.5, g["vertices"]), F.lit(False)))

    ends = ((F.col("r") == F.col("src_r")) & (F.col("c") == F.col("src_c"))) | ((F.col("r") == F.col("dst_r")) & (F.col("c") == F.col("dst_c")))
    cost = F.when(~ends & F.exists("boxes", walled), float("inf")).otherwise(1.0)
    return f, cells.select("field", "n", "src_r", "src_c", "dst_r", "dst_c", "r", "c", cost.cast("float").alias("cost"))


def fly(legs_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A way for each leg by fast marching, straightened and simplified: the legs' fields, and points (path: the field; seq, lon, lat, alt_m:
    from the one end's altitude to the other's by distance; along_m). Legs without a way have no points."""
    # A leg is a short row but a long job: legs are dealt by their number, not by their bytes.
    tasks = max(int(legs_.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-legs_.count() // LEGS_PER_TASK))
    # By a hash of the field and not by the field: a union of frames that are all dealt by it is taken to be dealt so as well,
    # and `simplify` then met a path's points in several tasks.
    legs_ = legs_.repartition(tasks, F.xxhash64("field"))
    fields, cells = cost_cells(legs_)
    traced = materialize(paths.ways(cells))
    own = fields.select("field", "west", "south", "cell", "a", "b")
    pts = traced.join(own, "field")
    pts = pts.select(F.col("field").alias("path"), (F.col("seq") + 1).cast("long").alias("seq"), (F.col("west") + (F.col("c") + 0.5) * F.col("cell")).alias("lon"), (F.col("south") + (F.col("r") + 0.5) * F.col("cell")).alias("lat"), F.col("a.alt_m").alias("alt_m"))
    first = traced.groupBy("field").agg(F.max("seq").alias("top")).join(own, "field")
    caps = first.select(F.col("field").alias("path"), F.lit(0).cast("long").alias("seq"), F.col("a.lon").alias("lon"), F.col("a.lat").alias("lat"), F.col("a.alt_m").alias("alt_m")).unionByName(first.select(F.col("field").alias("path"), (F.col("top") + 2).cast("long").alias("seq"), F.col("b.lon").alias("lon"), F.col("b.lat").alias("lat"), F.col("a.alt_m").alias("alt_m")))
    done = sequence.cumulative_distance(paths.simplify(pts.unionByName(caps), TOLERANCE_M)).drop("step_m")
    done = done.withColumn("_t", F.coalesce(F.try_divide("along_m", F.max("along_m").over(Window.partitionBy("path"))), F.lit(0.0)))
    done = done.join(own.select(F.col("field").alias("path"), F.col("a.alt_m").alias("_a"), F.col("b.alt_m").alias("_b")), "path")
    return materialize(fields.drop("boxes")), materialize(done.withColumn("alt_m", F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_t")).drop("_a", "_b", "_t"))


def climbs(points: DataFrame, legs_: DataFrame) -> DataFrame:
    """Where paths pass their restricted zones: path, level, first_m and last_m (the stretch along the path that is in the
    zone), way_m (the climb to the level, before and after it), fits (whether the climbs are on the path and clear of those
    of the zones next to it). Zones that a path does not meet give no row."""
    passes = legs_.select(F.col("field").alias("path"), F.col("a.alt_m").alias("_a"), F.col("b.alt_m").alias("_b"), "climb_deg", F.posexplode("passes").alias("no", "p")).select("path", "_a", "_b", "climb_deg", "no", "p.z", "p.level")
    total = F.max("along_m").over(Window.partitionBy("path"))
    seg = sequence.with_segments(points.withColumn("total_m", total)).withColumn("len", sequence.segment_length()).join(passes, "path")
    g, s = F.col("z.geometry"), [F.col(c) for c in ("lon", "lat", "lon2", "lat2")]
    circle = F.array_compact(F.array(segment_circle_interval(*s, g["center"][0], g["center"][1], g["radius_km"])))
    bands = F.when(F.col("z.shape") == "circle", circle).otherwise(profile.segment_bands(*s, g["vertices"]))
    met = seg.select("path", "no", "level", "total_m", "_a", "_b", "climb_deg", "along_m", "len", F.explode(bands).alias("t"))
    rise = F.greatest(F.abs(F.col("level") - F.col("_a")), F.abs(F.col("level") - F.col("_b")))
    out = met.groupBy("path", "no", "level", "total_m", (profile.CLIMB_SLACK * rise / F.tan(F.radians("climb_deg"))).alias("way_m")).agg(F.min(F.col("along_m") + F.col("len") * F.col("t.t0")).alias("first_m"), F.max(F.col("along_m") + F.col("len") * F.col("t.t1")).alias("last_m"))
    begin, end = F.col("first_m") - F.col("way_m"), F.col("last_m") + F.col("way_m")
    before = F.max(end).over(Window.partitionBy("path").orderBy("first_m", "no").rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn("fits", (begin >= 0) & (end <= F.col("total_m")) & F.coalesce(before <= begin, F.lit(True))).drop("no", "total_m")


def with_climbs(points: DataFrame, climbs_: DataFrame) -> DataFrame:
    """Paths with points where their climbs begin and end, and altitudes that keep each level for all of its stretch."""
    corners = F.array(F.col("first_m") - F.col("way_m"), F.col("first_m"), F.col("last_m"), F.col("last_m") + F.col("way_m"))
    seg = sequence.with_segments(points).withColumn("len", sequence.segment_length())
    new = seg.join(climbs_.select("path", F.explode(corners).alias("_at")), "path").where("_at > along_m + 0.01 AND _at < along_m + len - 0.01")
    t = (F.col("_at") - F.col("along_m")) / F.col("len")
    new = new.select("path", "seq", *[(F.col(c) + (F.col(d) - F.col(c)) * t).alias(c) for c, d in (("lon", "lon2"), ("lat", "lat2"), ("alt_m", "alt2"))], F.col("_at").alias("along_m"))
    own = climbs_.groupBy("path").agg(F.collect_list(F.struct("first_m", "last_m", "way_m", "level")).alias("_climbs"))
    every = points.select("path", "seq", "lon", "lat", "alt_m", "along_m").unionByName(new.distinct()).join(own, "path", "left")
    at = F.col("along_m")

    def lift(total: Column, c: Column) -> Column:
        share = clamp(F.least((at - c["first_m"]) / c["way_m"], (c["last_m"] - at) / c["way_m"]) + 1, 0, 1)
        return total + (c["level"] - F.col("alt_m")) * share

    lifted = F.col("alt_m") + F.coalesce(F.aggregate("_climbs", F.lit(0.0), lift), F.lit(0.0))
    order = Window.partitionBy("path").orderBy("along_m", "seq")
    return every.withColumn("alt_m", lifted).withColumn("seq", (F.row_number().over(order) - 1).cast("long")).drop("_climbs")


def plan(texts: DataFrame, column: str = "scenario") -> DataFrame:
    """One row per vehicle, or per rejected scenario: scenario_id, vehicle, status, error, n_points, distance_m,
    clearance_km (least distance of a path to a wall, null without walls), path (its points in order) and warnings
    (the other vehicles of the scenario that its path comes into conflict with). A vehicle has a solution if each of its legs
    has a way that touches no wall."""
    # A text is small and takes long to parse: texts are dealt by their number, too.
    texts = texts.repartition(tasks_for(texts.sparkSession, texts.count(), TEXTS_PER_TASK), column)
    valid = materialize(validate(parse(texts, column)))
    all_legs = materialize(alike(legs(valid)))
    # Legs that are alike have one way, which is found once.
    ones = materialize(all_legs.withColumn("field", F.col("way")).dropDuplicates(["field"]))
    fields, points = fly(ones)
    found = materialize(climbs(points, ones))
    bad = found.where("NOT fits").select("path").distinct()
    if not bad.isEmpty():
        again = ones.join(bad.withColumnRenamed("path", "field"), "field", "left_semi")
        again = again.withColumn("walls", F.concat("walls", F.transform("passes", lambda p: p["z"]))).withColumn("passes", F.slice("passes", 1, 0))
        fields2, points2 = fly(materialize(again))
        fields = fields.join(bad.withColumnRenamed("path", "field"), "field", "left_anti").unionByName(fields2)
        points = points.join(bad, "path", "left_anti").unionByName(points2)
        found = found.join(bad, "path", "left_anti")
    smooth = materialize(with_climbs(points, found))
    seg = sequence.with_segments(smooth).withColumn("len", sequence.segment_length()).join(fields.select(F.col("field").alias("path"), "walls"), "path")
    seg = materialize(seg.withColumnRenamed("path", "way"))

    def gap(z: Column) -> Column:
        g = z["geometry"]
        s = [F.col(c) for c in ("lon", "lat", "lon2", "lat2")]
        return F.when(z["shape"] == "circle", segment_circle_km(*s, g["center"][0], g["center"][1], g["radius_km"])).otherwise(segment_polygon_km(*s, g["vertices"]))

    clear = F.array_min(F.transform("walls", gap))
    at = F.struct("seq", F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"), "alt_m").alias("p"))
    ways = seg.groupBy("way").agg(F.count("*").alias("n"), F.sum("len").alias("len"), F.min(clear).alias("clear"), F.transform(F.array_sort(F.collect_list(at)), lambda q: q["p"]).alias("line"))
    each = all_legs.select("scenario_id", "vehicle", "leg", "way", F.struct(F.col("b.lon").alias("x"), F.col("b.lat").alias("y"), "b.alt_m").alias("end")).join(ways, "way", "left")
    has = lambda v: F.when(F.col("n").isNotNull(), v)
    # A point where two legs meet is the end of one and the start of the next: it is listed once.
    flown = each.groupBy("scenario_id", "vehicle").agg(
        F.count("*").alias("all_legs"), F.size(F.collect_set(has(F.col("leg")))).alias("legs"), (F.sum("n") + 1).alias("n_points"), F.sum("len").alias("distance_m"), F.min("clear").alias("clearance_km"),
        F.concat(F.flatten(F.transform(F.array_sort(F.collect_list(has(F.struct("leg", "line")))), lambda q: q["line"])), F.array(F.max(F.struct("leg", "end"))["end"])).alias("path"),
    )
    # Conflicts need a scenario with more than one vehicle.
    several = all_legs.groupBy("scenario_id").agg(F.min("vehicle").alias("_a"), F.max("vehicle").alias("_b")).where("_a < _b").select("scenario_id")
    both = all_legs.select("scenario_id", "vehicle", "leg", "way").join(several, "scenario_id", "left_semi").join(seg, "way")
    both = both.select("scenario_id", F.concat_ws("/", "scenario_id", "vehicle").alias("path"), (F.col("leg") * 1_000_000 + F.col("seq")).alias("seq"), F.col("lon").alias("ax"), F.col("lat").alias("ay"), F.col("lon2").alias("bx"), F.col("lat2").alias("by"), F.col("alt_m").alias("alt1"), "alt2")
    told = conflicts.conflict_warnings(conflicts.path_conflicts(materialize(both), within="scenario_id"))
    near = F.format_string("crossing with %s near (%.4f,%.4f) h=%.1fkm v=%.0fm", F.substring_index("other", "/", -1), "lon", "lat", "h_km", "v_m")
    told = told.groupBy(F.col("path").alias("_of")).agg(F.array_sort(F.collect_list(near)).alias("warnings"))
    done = flown.withColumn("_of", F.concat_ws("/", "scenario_id", "vehicle")).join(told, "_of", "left").withColumn("warnings", F.coalesce("warnings", F.array().cast("array<string>")))
    ok = (F.col("legs") == F.col("all_legs")) & F.coalesce(F.col("clearance_km") > 0, F.lit(True))
    done = done.select("scenario_id", "vehicle", F.when(ok, "success").otherwise("no_solution").alias("status"), F.lit(None).cast("string").alias("error"), F.when(ok, F.col("n_points")).alias("n_points"), F.when(ok, F.col("distance_m")).alias("distance_m"), F.when(ok, F.col("clearance_km")).alias("clearance_km"), F.when(ok, F.col("path")).alias("path"), F.when(ok, F.col("warnings")).alias("warnings"))
    bad = valid.where("rejected IS NOT NULL").select("s.scenario_id", F.lit(None).cast("string").alias("vehicle"), F.lit("input_invalid").alias("status"), F.col("rejected").alias("error"), F.lit(None).cast("long").alias("n_points"), F.lit(None).cast("double").alias("distance_m"), F.lit(None).cast("double").alias("clearance_km"), F.lit(None).cast(done.schema["path"].dataType).alias("path"), F.lit(None).cast("array<string>").alias("warnings"))
    return done.unionByName(bad)


def output_json(planned: DataFrame) -> DataFrame:
    """One JSON text per scenario: status, error, and its vehicles by id."""
    v = F.struct(F.col("vehicle").alias("id"), "status", "path", "distance_m", "warnings")
    out = planned.groupBy("scenario_id").agg(F.min("error").alias("error"), F.array_sort(F.collect_list(v)).alias("aircraft"), F.min(F.when(F.col("status") == "success", 1).otherwise(0)).alias("_ok"))
    status = F.when(F.col("error").isNotNull(), "input_invalid").when(F.col("_ok") == 1, "success").otherwise("no_solution")
    return out.select("scenario_id", F.to_json(F.struct(status.alias("status"), "error", "aircraft")).alias("json"))


def schema_json() -> str:
    """The input contract as a schema document."""
    return T.StructType.fromDDL(SCENARIO.removeprefix("struct<")[:-1]).json()


def from_customers(customers: DataFrame) -> DataFrame:
    """Scenario texts for tests and queries: one for each customer, a third of them with a restricted band on the way."""
    k = F.col("cust")
    point = lambda dx, dy: F.struct((F.lit(100.0) + k % 17 / F.lit(10.0) + dx).alias("lon"), (F.lit(30.0) + k % 13 / F.lit(10.0) + dy).alias("lat"), F.lit(1000.0).alias("alt_m"))
    zone = F.struct(F.lit("z").alias("id"), F.when(k % 2 == 0, "circle").otherwise("polygon").alias("shape"), F.struct(F.when(k % 2 == 0, F.array(F.lit(100.5) + k % 17 / F.lit(10.0), F.lit(30.05) + k % 13 / F.lit(10.0))).alias("center"), F.when(k % 2 == 0, F.lit(8.0)).alias("radius_km"), F.when(k % 2 == 1, F.transform(F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((0.4, -0.1), (0.6, -0.1), (0.6, 0.2), (0.4, 0.2))]), lambda p: F.array(F.lit(100.0) + k % 17 / F.lit(10.0) + p[0], F.lit(30.0) + k % 13 / F.lit(10.0) + p[1]))).alias("vertices")).alias("geometry"))
    vehicle = F.struct(F.lit("v1").alias("id"), F.struct(F.lit("FIXED_WING").alias("aircraft_type"), F.when(k % 11 == 0, 2000.0).otherwise(80.0).alias("cruise_speed_mps")).alias("profile"), point(0.0, 0.0).alias("start"), point(1.0, 0.1).alias("target"), F.array(point(0.8, 0.3)).alias("mid_waypoints"))
    band = F.struct(F.lit("b").alias("id"), F.lit("circle").alias("shape"), F.struct(F.array(F.lit(100.25) + k % 17 / F.lit(10.0), F.lit(30.17) + k % 13 / F.lit(10.0)).alias("center"), F.lit(5.0).alias("radius_km")).alias("geometry"), F.lit(800.0).alias("alt_min_m"), F.lit(3000.0).alias("alt_max_m"))
    bands = F.when(k % 3 == 0, F.array(band))
    return customers.select(F.to_json(F.struct(k.cast("string").alias("scenario_id"), F.array(vehicle).alias("aircraft"), F.array(zone).alias("no_fly_zones"), bands.alias("restricted_zones"))).alias("scenario"))
