"""Equivalence with brute force, and edge cases, of the relational operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from geoloom.operators import conflicts, intervals, joins, paths, raster, vehicles
from geoloom.plans import scenario
from geoloom.sources import georef


@pytest.fixture(scope="module")
def globe(spark):
    r = random.Random(5)
    pts = [(i, r.choice([r.uniform(-180, 180), 179.9, -179.9]), r.choice([r.uniform(-90, 90), 89.9, -89.5])) for i in range(300)]
    return spark.createDataFrame(pts, "a long, lon double, lat double").cache()


@pytest.mark.parametrize("radius", [20_000.0, 700_000.0])
def test_radius_join_finds_what_brute_force_finds(spark, globe, radius):
    """Also over the poles and over 180 degrees."""
    from geoloom.functions.scalar import haversine_m

    other = globe.select(F.col("a").alias("b"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    got = {(r["a"], r["b"]) for r in joins.radius_join(globe, other, radius).collect()}
    every = globe.crossJoin(other).where(haversine_m(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")) <= radius)
    assert got == {(r["a"], r["b"]) for r in every.collect()}


def test_nearest(spark, globe):
    sites = globe.where("a % 30 = 0").select(F.col("a").alias("site"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    got = {r["a"]: r["site"] for r in joins.nearest(globe, sites, "a", "site", 10.0).collect()}
    s = sites.collect()
    for r in globe.collect():
        assert got[r["a"]] == min(s, key=lambda x: ((x["lon2"] - r["lon"]) ** 2 + (x["lat2"] - r["lat"]) ** 2, x["site"]))["site"]


def test_empty_inputs(spark, globe):
    none = globe.limit(0)
    other = none.select(F.col("a").alias("b"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    assert joins.radius_join(globe, other, 1000.0).isEmpty()
    assert joins.nearest(globe, other.withColumnRenamed("b", "site"), "a", "site").isEmpty()
    p = spark.createDataFrame([], "path long, seq long, lon double, lat double, alt_m double")
    for df in (paths.chaikin(p), paths.catmull_rom(p, 3), paths.simplify(p, 5.0), paths.validate(p, 1.0, 1.0, 1.0)):
        assert df.isEmpty()


def test_interval_algebra_is_set_algebra(spark):
    r = random.Random(9)
    make = lambda: [(k, s, s + r.randint(0, 9)) for k in range(5) for s in (r.randint(0, 60) for _ in range(12))]
    a, b = make(), make()
    cells = lambda rows: {(k, v) for k, s, e in rows for v in range(s, e)}
    fa, fb = (spark.createDataFrame(x, "key int, c0 int, c1 int") for x in (a, b))
    for op, want in ((intervals.difference, cells(a) - cells(b)), (intervals.intersection, cells(a) & cells(b)), (lambda x, _: intervals.union(x), cells(a))):
        got = [(x["key"], x["c0"], x["c1"]) for x in op(fa, fb).collect()]
        assert cells(got) == want and len({(k, s) for k, s, _ in got}) == len(got)


def test_soften_and_levels(spark):
    walls = spark.createDataFrame([(2, 2)], "r long, c long")
    band = raster.distance_band(walls, 2, 5, 5)
    cost = spark.range(25).select(F.floor(F.col("id") / 5).alias("r"), (F.col("id") % 5).alias("c"), F.lit(1.0).alias("cost"))
    got = {(r["r"], r["c"]): round(r["cost"], 4) for r in raster.soften(cost, band, 2).collect()}
    assert got[2, 3] == round(1 + 0.5 * 2 / 3, 4) and got[0, 0] == round(1 + 0.5 / 3, 4) and got[2, 2] == 1.0
    levels = spark.createDataFrame([("t", 0, 1.0), ("t", 1, 2.0), ("t", 2, 4.0)], "key string, level int, cell double")
    assert [r["level"] for r in raster.pick_level(levels, 3.0, "key").collect()] == [1]
    assert [r["level"] for r in raster.pick_level(levels, 0.5, "key").collect()] == [0]


def test_scenarios(spark):
    ok = '{"scenario_id":"s","aircraft":[{"id":"v","start":{"lon":100,"lat":30,"alt_m":500},"target":{"lon":101,"lat":30,"alt_m":500}}],"no_fly_zones":[{"id":"z","shape":"circle","geometry":{"center":[100.5,30.0],"radius_km":10}}]}'
    bad = [ok.replace('"scenario_id"', '"surprise":1,"scenario_id"'), ok.replace('"lon":101,"lat":30', '"lon":100.5,"lat":30'), ok.replace('"lon":101,"lat":30', '"lon":100,"lat":30'), ok.replace('"lat":30,"alt_m":500},"target"', '"lat":99,"alt_m":500},"target"'), '{"scenario_id":"e","aircraft":[]}', "not json"]
    df = scenario.plan(spark.createDataFrame([(x,) for x in [ok, *bad]], "scenario string"))
    out = df.collect()
    done = [r for r in out if r["status"] == "success"]
    assert len(done) == 1 and done[0]["clearance_km"] > 0 and done[0]["distance_m"] > 96_000
    assert sorted(r["error"] for r in out if r["error"]) == ["degenerate_start_equals_target", "illegal_coordinate", "malformed_json", "missing_aircraft", "target_in_no_fly", "unknown_field"]
    assert '"status":"success"' in "".join(r["json"] for r in scenario.output_json(df.where("error IS NULL")).collect())
    assert "aircraft" in scenario.schema_json()


def test_nearest_matches_brute_force(spark):
    """Clustered sites, lone queries and ties: the nearest, then the smaller id, whatever the first cells' width."""
    r = random.Random(4)
    sites = [(i, r.gauss(0, 3), r.gauss(0, 3)) for i in range(60)] + [(60, 170.0, 80.0), (61, 170.0, 80.0)]
    asks = [(i, r.uniform(-180, 180), r.uniform(-85, 85)) for i in range(40)] + [(40, 171.0, 80.0)]
    want = {q: min(((x - a) ** 2 + (y - b) ** 2, s) for s, a, b in sites) for q, x, y in asks}
    q, s = spark.createDataFrame(asks, "q long, lon double, lat double"), spark.createDataFrame(sites, "s long, lon2 double, lat2 double")
    for cell in (None, 0.5, 50.0):
        got = {o["q"]: (o["d2"], o["s"]) for o in joins.nearest(q, s, "q", "s", cell).collect()}
        assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
        assert all(abs(got[k][0] - want[k][0]) < 1e-9 for k in want)
    assert joins.nearest(q, s.limit(0), "q", "s").isEmpty() and joins.nearest(q.limit(0), s, "q", "s").isEmpty()


def test_scenario_paths_and_warnings(spark):
    """Two vehicles that cross at one height, in two scenarios: each is told of the other of its own, paths go from
    start to target and stay out of the wall; keys that nobody knows are rejected at every level."""
    v = '{"id":"%s","start":{"lon":%s,"lat":%s,"alt_m":500},"target":{"lon":%s,"lat":%s,"alt_m":500}}'
    one = '{"scenario_id":"%s","aircraft":[' + v % ("v1", 100, 30, 101, 30) + "," + v % ("v2", 100.2, 29.6, 100.2, 30.4) + '],"no_fly_zones":[{"id":"z","shape":"circle","geometry":{"center":[100.6,30.0],"radius_km":10}}]}'
    odd = [one.replace('"alt_m":500}', '"alt_m":500,"speed":1}', 1), one.replace('"radius_km"', '"size":1,"radius_km"'), one.replace('"shape"', '"colour":"red","shape"'), one.replace('"id":"v2"', '"id":"v2","profile":{"wings":2}'), one.replace('"no_fly_zones"', '"terrain":{"planet":"x"},"no_fly_zones"')]
    texts = [one % "a", one % "b", *(o % "c" for o in odd)]
    df = scenario.plan(spark.createDataFrame([(t,) for t in texts], "scenario string")).cache()
    got = df.collect()
    assert sorted(o["error"] for o in got if o["error"]) == ["unknown_field"] * 5
    flown = {(o["scenario_id"], o["vehicle"]): o for o in got if not o["error"]}
    assert set(flown) == {(s, k) for s in "ab" for k in ("v1", "v2")} and all(o["status"] == "success" for o in flown.values())
    for (_, k), o in flown.items():
        ends = ((100, 30), (101, 30)) if k == "v1" else ((100.2, 29.6), (100.2, 30.4))
        assert (o["path"][0]["x"], o["path"][0]["y"]) == ends[0] and (o["path"][-1]["x"], o["path"][-1]["y"]) == ends[1]
        assert len(o["path"]) == o["n_points"] and o["clearance_km"] >= 0
        assert len(o["warnings"]) == 1 and o["warnings"][0].startswith("crossing with " + ("v2" if k == "v1" else "v1"))
    json = [o["json"] for o in scenario.output_json(df.where("error IS NULL")).collect()]
    assert len(json) == 2 and all('"warnings":["crossing with' in j and '"path":[{"x":100.0' in j for j in json)


def test_path_conflicts(spark):
    """Two paths that cross at one height, one above them, one that runs beside the first, and one far away."""
    rows = [("a", 0, 100.0, 30.0, 101.0, 30.0, 1000.0, 1000.0), ("b", 0, 100.5, 29.5, 100.5, 30.5, 1100.0, 1100.0), ("c", 0, 100.5, 29.5, 100.5, 30.5, 2000.0, 2000.0), ("d", 0, 100.2, 30.005, 100.9, 30.005, 900.0, 1000.0), ("e", 0, 50.0, 30.0, 51.0, 30.0, 1000.0, 1000.0)]
    s = spark.createDataFrame(rows, "path string, seq long, ax double, ay double, bx double, by double, alt1 double, alt2 double")
    got = {(o["path_1"], o["path_2"]): o for o in conflicts.path_conflicts(s).collect()}
    assert set(got) == {("a", "b"), ("a", "d")}  # b is more than 150 m above d where they meet
    ab = got["a", "b"]
    assert abs(ab["h_km"]) < 1e-9 and abs(ab["v_m"] - 100) < 1e-6 and abs(ab["lon"] - 100.5) < 1e-9 and abs(ab["lat"] - 30) < 1e-9
    assert abs(got["a", "d"]["h_km"] - 0.005 * 111.32) < 1e-6
    told = conflicts.conflict_warnings(conflicts.path_conflicts(s)).collect()
    assert sorted((o["path"], o["other"]) for o in told) == [("a", "b"), ("a", "d"), ("b", "a"), ("d", "a")]


def test_georefs_from_files(spark, tmp_path):
    (tmp_path / "a.tfw").write_text("0.5\n0\n0\n-0.25\n10\n50\n")
    (tmp_path / "a.prj").write_text('GEOGCS["GCS_WGS_1984"]')
    (tmp_path / "b.tfw").write_text("0.5 0.2 0 -0.25 10 50")
    got = {o["name"].rsplit("/", 1)[1]: o for o in georef.read_georefs(spark, f"file://{tmp_path}").collect()}
    a, b = got["a"], got["b"]
    assert (a["px"], a["py"], a["west"], a["north"], a["error"], a["epsg"]) == (0.5, 0.25, 9.75, 50.125, None, 4326)
    assert b["error"] == "rotated" and b["west"] is None and b["epsg"] is None
    keys = spark.createDataFrame([(1, 4326, 0), (2, 0, 3857), (0, 4326, 0), (2, 0, 32633)], "m int, g int, p int")
    assert [o[0] for o in keys.select(georef.geo_keys(F.col("m"), F.col("g"), F.col("p"))).collect()] == [4326, 3857, 4326, None]


def test_curve_success(spark):
    c = spark.createDataFrame([("x", 1.0), ("x", 3.0), ("x", None), ("y", None)], "k string, length double")
    assert {o["k"]: (o["n_ok"], o["n_all"], o["mean_length"]) for o in vehicles.curve_success(c, "k").collect()} == {"x": (2, 3, 2.0), "y": (0, 1, 0.0)}


def test_scenario_restricted_bands(spark):
    """Zones under, over and round which a leg goes: sampled along the paths, no point is in a wall or in a band."""
    import json

    def scene(name, zones, ceiling=None, alt=1000.0, walls=()):
        shape = lambda i, z: {"id": f"z{i}", "shape": "polygon" if isinstance(z[0], list) else "circle", "geometry": {"vertices": z[0]} if isinstance(z[0], list) else {"center": [z[0], 30.0], "radius_km": z[1]}}
        banded = [{**shape(i, z[:-1]), "alt_min_m": z[-1][0], "alt_max_m": z[-1][1]} for i, z in enumerate(zones)]
        at = lambda lon, h: {"lon": lon, "lat": 30.0, "alt_m": h}
        profile = {"max_climb_angle_deg": 15.0, **({"ceiling_m": ceiling} if ceiling else {})}
        return {"scenario_id": name, "aircraft": [{"id": "v", "profile": profile, "start": at(100.0, alt), "target": at(101.0, alt)}], "no_fly_zones": [shape(i, (z,)) if isinstance(z, list) else shape(i, z) for i, z in enumerate(walls)], "restricted_zones": banded}

    square = [[100.45, 29.9], [100.55, 29.9], [100.55, 30.1], [100.45, 30.1]]
    scenes = [
        scene("under", [(100.5, 8.0, (800, 3000))]), scene("over", [(100.5, 8.0, (400, 3000))]), scene("round", [(100.5, 8.0, (400, 3000))], ceiling=3200.0),
        scene("polygon", [(square, (800, 3000))]), scene("free", [(100.5, 8.0, (2000, 3000))]), scene("near start", [(100.12, 9.0, (800, 3000))]),
        scene("close", [(100.35, 8.0, (800, 3000)), (100.55, 8.0, (900, 3000))]), scene("both", [(100.5, 8.0, (800, 3000))], walls=[square]), scene("inside", [(100.0, 8.0, (800, 3000))]),
    ]
    got = {o["scenario_id"]: o for o in scenario.plan(spark.createDataFrame([(json.dumps(s),) for s in scenes], "scenario string")).collect()}
    assert {k for k, o in got.items() if o["status"] != "success"} == {"inside"}  # a start within its only way's wall
    heights = {k: {round(p["alt_m"]) for p in o["path"]} for k, o in got.items() if o["path"]}
    assert heights["under"] == {1000, 300} and heights["over"] == {1000, 3500} and heights["polygon"] == {1000, 300}
    assert all(heights[k] == {1000} for k in ("round", "free", "near start", "close"))
    inside = lambda x, y, v: sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(v, v[1:] + v[:1])) % 2 == 1
    for s in scenes:
        path = got[s["scenario_id"]]["path"] or []
        for p, q in zip(path, path[1:]):
            run = math.hypot((q["x"] - p["x"]) * math.cos(math.radians(30)), q["y"] - p["y"]) * 111_195
            assert abs(q["alt_m"] - p["alt_m"]) <= run * math.tan(math.radians(15)) + 1e-3
            for t in (i / 50 for i in range(51)):
                x, y, h = (p[c] + (q[c] - p[c]) * t for c in ("x", "y", "alt_m"))
                for z in s["restricted_zones"] + s["no_fly_zones"]:
                    g = z["geometry"]
                    within = inside(x, y, g["vertices"]) if "vertices" in g else math.hypot((x - g["center"][0]) * math.cos(math.radians(30)), y - g["center"][1]) * 111.195 < g["radius_km"] - 0.05
                    assert not (within and z.get("alt_min_m", -1e9) < h < z.get("alt_max_m", 1e9)), (s["scenario_id"], x, y, h)


def test_scenario_grid_of_wide_regions(spark):
    """Fields of wide regions have cells of about 1,100 m, 600 with a polygon among the walls; others 48 a side."""
    at = "struct<lon double, lat double, alt_m double>"
    zone = "struct<shape string, geometry: struct<center: array<double>, radius_km: double, vertices: array<array<double>>>>"
    poly = ("polygon", (None, None, [[50.0, 50.0], [50.1, 50.0], [50.1, 50.1]]))
    rows = [("small", (100.0, 30.0, 0.0), (100.5, 30.0, 0.0), []), ("wide", (100.0, 30.0, 0.0), (101.6, 30.0, 0.0), []), ("polygon", (100.0, 30.0, 0.0), (101.6, 30.0, 0.0), [poly])]
    f, cells = scenario.cost_cells(spark.createDataFrame(rows, f"field string, a {at}, b {at}, walls array<{zone}>").withColumns({c: F.lit("") for c in ("scenario_id", "vehicle", "leg")}))
    n = {o["field"]: (o["n"], round(o["cell"] * 111_320)) for o in f.collect()}
    assert n["small"][0] == 48 and n["wide"] == (274, 1097) and n["polygon"] == (501, 600)
    assert {o["field"]: o["count"] for o in cells.groupBy("field").count().collect()} == {k: v[0] ** 2 for k, v in n.items()}
