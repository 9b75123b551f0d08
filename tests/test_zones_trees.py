"""Containment by cells, merged point queries, searches of paths by box trees, and pyramids, against brute force."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from geoloom.operators import intervals, joins, pathtree, paths, profile, pyramid, zones


def star(r, cx, cy, size, n):
    return [[cx + size * (0.3 + 0.7 * r.random()) * math.cos(2 * math.pi * i / n), cy + size * (0.3 + 0.7 * r.random()) * math.sin(2 * math.pi * i / n)] for i in range(n)]


def inside(x, y, poly):
    odd = False
    for (ax, ay), (bx, by) in zip([poly[-1], *poly[:-1]], poly):
        if (by > y) != (ay > y) and x < (ax - bx) * (y - by) / (ay - by) + bx:
            odd = not odd
    return odd


def brute(points, polys):
    return sorted((k, z) for k, x, y in points if x is not None and y is not None for z, p in polys if len(p) >= 3 and inside(x, y, p))


POINT, ZONE = "id long, lon double, lat double", "zone long, polygon array<array<double>>"


def test_polygons_containing(spark):
    r = random.Random(7)
    polys = [(i, star(r, r.uniform(-150, 150), r.uniform(-70, 70), r.choice([0.01, 0.5, 5, 40]), r.choice([3, 4, 9, 60]))) for i in range(60)]
    polys += [(60, [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]), (61, [[0.0, 0.0], [1.0, 1.0]]), (62, []), (63, [[0.0, 0.0], [2.0, 2.0], [2.0, 0.0], [0.0, 2.0]])]
    points = [(i, r.uniform(-180, 180), r.uniform(-90, 90)) for i in range(1500)]
    for i in range(1500, 3000):  # near the polygons, and on their corners and sides
        p = r.choice([p for _, p in polys if len(p) > 2])
        a, b, t = r.choice(p), r.choice(p), r.choice([0.0, 0.5, r.random()])
        points.append((i, a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t))
    points += [(3000, 0.5, 0.5), (3001, 1.0, 0.5), (3002, 0.0, 0.5), (3003, 0.5, 0.0), (3004, None, 1.0), (3005, float("nan"), 1.0), (3006, 1.0, 1.0)]
    pts, zs = spark.createDataFrame(points, POINT), spark.createDataFrame(polys, ZONE)
    got = sorted((x["id"], x["zone"]) for x in zones.polygons_containing(pts, zs, "id").collect())
    assert got == brute([p for p in points if p[1] == p[1]], polys) and len(got) > 500
    assert zones.polygons_containing(pts.limit(0), zs, "id").isEmpty() and zones.polygons_containing(pts, zs.limit(0), "id").isEmpty()


def test_cover_of_a_large_polygon(spark):
    """Most points fall in inner cells, and no row holds more than a few of the 4,000 edges."""
    r = random.Random(8)
    poly = [[60 * (1 + 0.01 * r.random()) * math.cos(2 * math.pi * i / 4000), 60 * (1 + 0.01 * r.random()) * math.sin(2 * math.pi * i / 4000)] for i in range(4000)]
    inner, rim = zones.cover(zones.polygon_edges(spark.createDataFrame([(1, poly)], ZONE)))
    assert rim.selectExpr("max(size(edges))").first()[0] <= 64
    area = inner.selectExpr(f"sum(power({zones.WORLD_DEG} / power(2, level), 2))").first()[0]
    assert 0.95 < area / (math.pi * 60.3**2) < 1
    assert inner.select("level").distinct().count() > 4
    points = [(i, r.uniform(-70, 70), r.uniform(-70, 70)) for i in range(400)]
    got = sorted((x["id"], x["zone"]) for x in zones.polygons_containing(spark.createDataFrame(points, POINT), spark.createDataFrame([(1, poly)], ZONE), "id").collect())
    assert got == brute(points, [(1, poly)])


def test_zones_containing(spark):
    zs = [(1, "circle", 10.0, 10.0, 50.0, None, None, None), (2, "circle", 10.0, 10.0, 50.0, None, 100.0, 200.0), (3, "polygon", None, None, None, [[9.0, 9.0], [11.0, 9.0], [11.0, 11.0]], 0.0, 150.0)]
    z = spark.createDataFrame(zs, "zone long, shape string, clon double, clat double, radius_km double, polygon array<array<double>>, alt_min_m double, alt_max_m double")
    p = spark.createDataFrame([(1, 10.2, 10.0, 150.0), (2, 10.2, 10.0, 250.0), (3, 50.0, 0.0, 150.0), (4, 10.9, 9.1, 50.0)], "id long, lon double, lat double, alt_m double")
    assert sorted(map(tuple, zones.zones_containing(p, z, "id").collect())) == [(1, 1), (1, 2), (1, 3), (2, 1), (4, 3)]


def test_point_query(spark):
    r = random.Random(9)
    spans = [(r.randrange(4), r.choice([1, 2, 3]), a, a + r.choice([-1, 0, 1, 5, 300])) for a in (r.randrange(-50, 1000) for _ in range(200))]
    points = [(i, r.choice([0, 1, 2, 3, 9, None]), r.choice([None, *range(-60, 1100)]), i % 3) for i in range(2000)]
    points.append(points[7])
    s, p = spark.createDataFrame(spans, "k long, class int, c0 long, c1 long"), spark.createDataFrame(points, "id long, k long, c long, class int")
    want = sorted(((*x, next((v for v in (2, 1) if x[2] is not None and any(k == x[1] and c == v and a <= x[2] < b for k, c, a, b in spans)), None)) for x in points), key=repr)
    for block in (4096, 7):
        assert sorted(map(tuple, intervals.point_query(p, s, "k", "c", "class", [2, 1], block).collect()), key=repr) == want
    assert intervals.point_query(p, s.limit(0), "k", "c", "class", [1]).where("found is not null").isEmpty()


def test_mask_lookup_round_the_world(spark):
    mask = spark.createDataFrame([(0, 1, 350, 370), (0, 2, 100, 120), (0, 1, 110, 115)], "row long, class int, c0 long, c1 long")
    points = spark.createDataFrame([(0, c) for c in (349, 350, 359, 360, 369, 370, -1, 5, 9, 10, 100, 110, 115, 119, 120, 479)] + [(1, 355)], "row long, col long")
    got = {(x["row"], x["col"]): x["mask_class"] for x in joins.mask_lookup(points, mask, 360).collect()}
    assert {c for (row, c), k in got.items() if k == 1 and row == 0} == {350, 359, 360, 369, -1, 5, 9, 110}
    assert {c for (row, c), k in got.items() if k == 2} == {100, 115, 119, 479} and got[1, 355] == 0
    assert joins.mask_lookup(points, mask).columns == ["row", "col", "mask_class"]


def test_crowded_row(spark):
    """A row of a million segments against as many points takes one pass over both."""
    began = time.time()
    mask = spark.range(1_000_000).selectExpr("0L as row", "1 + cast(id % 2 as int) as class", "id * 3 as c0", "id * 3 + 2 as c1")
    points = spark.range(1_000_000).selectExpr("0L as row", "id * 3 + id % 3 as col")
    got = {x[0]: x[1] for x in joins.mask_lookup(points, mask).groupBy("mask_class").count().collect()}
    assert got[0] == 333_333 and abs(got[1] - got[2]) < 10 and time.time() - began < 60


# --- box trees of paths ------------------------------------------------------------------------------------------


def walk(r, n, step=0.01):
    x, y, out = r.uniform(-10, 10), r.uniform(40, 60), []
    for i in range(n):
        x, y = x + r.uniform(-step, step), y + r.uniform(-step, step)
        out.append((i * 3 + 1, x, y, r.uniform(0, 1000)))
    return out


def nearest(px, py, path):
    best = None
    for (s, ax, ay, ah), (_, bx, by, bh) in zip(path, path[1:]):
        k = max(math.cos(math.radians((ay + by) / 2)), 1e-6)
        vx, vy, wx, wy = (bx - ax) * k, by - ay, (px - ax) * k, py - ay
        t = min(max((wx * vx + wy * vy) / (vx * vx + vy * vy), 0), 1) if vx or vy else 0.0
        d = math.hypot(wx - t * vx, wy - t * vy) * math.pi / 180 * 6_371_000
        if best is None or (round(d, 6), s) < best[:2]:
            best = (round(d, 6), s, ah + (bh - ah) * t)
    return best


@pytest.fixture(scope="module")
def tracks(spark):
    r = random.Random(10)
    made = {p: walk(r, n) for p, n in ((1, 1), (2, 2), (3, 40), (4, 1500), (5, 1200))}
    made[6] = made[3][:20] + [(s + 200, x, y, h) for s, x, y, h in made[3][:20]]  # passes the same points twice
    return made, spark.createDataFrame([(p, *v) for p, vs in made.items() for v in vs], "path long, seq long, lon double, lat double, alt_m double")


def test_nearest_segment(spark, tracks):
    r = random.Random(11)
    made, df = tracks
    points = [(i, p, *((v := r.choice(made[p]))[1] + r.uniform(-0.1, 0.1), v[2] + r.uniform(-0.1, 0.1))) for i, p in enumerate(r.choice([2, 3, 4, 5, 6]) for _ in range(300))]
    points += [(900, 4, *made[4][700][1:3]), (901, 4, 170.0, -80.0), (902, 1, 0.0, 0.0), (903, 9, 0.0, 0.0), (904, 4, None, 1.0), (905, 6, *made[6][3][1:3])]
    pts = spark.createDataFrame(points, "id long, path long, plon double, plat double")
    got = {x["id"]: x for x in pathtree.nearest_segment(pts, df, "id").collect()}
    assert set(got) == {i for i, p, x, _ in points if p in (2, 3, 4, 5, 6) and x is not None}
    for i, p, x, y in points:
        if i in got:
            d, s, h = nearest(x, y, made[p])
            assert got[i]["seq"] == s and got[i]["distance_m"] == pytest.approx(d, abs=1e-5) and got[i]["alt_m"] == pytest.approx(h, abs=1e-3)
    assert {x["id"]: x["distance_m"] for x in paths.point_to_path(pts, df, "id").collect()} == {i: x["distance_m"] for i, x in got.items()}
    assert profile.height_on_path(pts, df, "id").count() == len(got)
    assert pathtree.nearest_segment(pts.limit(0), df, "id").isEmpty() and pathtree.nearest_segment(pts, df.limit(0), "id").isEmpty()


def test_search_meets_few_boxes(spark, tracks):
    made, df = tracks
    points = spark.createDataFrame([(i, 4, v[1] + 0.001, v[2]) for i, v in enumerate(made[4][::10])], "key long, path long, px double, py double")
    met = pathtree.search(points, pathtree.build(pathtree.segments(df)))
    assert met.count() < 12 * pathtree.FANOUT * points.count()  # of 47 boxes of a path that winds over itself


def test_match_anchors(spark, tracks):
    r = random.Random(12)
    made, df = tracks
    anchors = []
    for p, vs in made.items():
        picked = sorted(r.sample(range(len(vs)), min(4, len(vs)))) if p != 5 else [1100, 3, 500, 499]  # path 5: not in order
        anchors += [(p, i, vs[v][1] + 0.0001, vs[v][2]) for i, v in enumerate(picked)]
    anchors += [(1, 7, 0.0, 0.0), (1, 8, 0.0, 0.0)]  # more anchors than vertices
    want = {}
    for p, vs in made.items():
        k, at = math.cos(math.radians(vs[0][2])), -1
        for _, a, x, y in sorted(v for v in anchors if v[0] == p):
            left = [(math.hypot((v[1] - x) * k, v[2] - y), n) for n, v in enumerate(vs) if n > at]
            at = min(left)[1] if left else len(vs)
            want[p, a] = vs[at][0] if left else None
    vertices = df.selectExpr("path", "seq", "lon as lon2", "lat as lat2")
    got = {(x["path"], x["anchor"]): x["seq"] for x in pathtree.match_anchors(spark.createDataFrame(anchors, "path long, anchor long, lon double, lat double"), vertices).collect()}
    assert got == want and None in want.values()


def test_long_path(spark):
    """20,000 points on a path of 20,000 segments: not their product."""
    began = time.time()
    path = spark.range(20_001).selectExpr("1L as path", "id as seq", "id / 2000 + 0.01 * sin(id) as lon", "50 + 0.01 * cos(id * 1.7) as lat", "0.0 as alt_m").selectExpr("path", "seq", "cast(lon as double) lon", "cast(lat as double) lat", "cast(alt_m as double) alt_m")
    points = spark.range(20_000).selectExpr("id", "1L as path", "id / 2000 as plon", "cast(50.02 as double) as plat")
    assert pathtree.nearest_segment(points, path, "id").count() == 20_000 and time.time() - began < 60


# --- pyramids ----------------------------------------------------------------------------------------------------


def test_morton(spark):
    r = random.Random(13)
    cells = [(r.randrange(1 << 31), r.randrange(1 << 31)) for _ in range(200)] + [(0, 0), (0, 1), (1, 0), ((1 << 31) - 1, (1 << 31) - 1)]
    df = spark.createDataFrame(cells, "r long, c long")
    key = pyramid.morton(df.r, df.c)
    for x in df.select("r", "c", key.alias("k"), pyramid._gather(key).alias("c2")).collect():
        assert x.k == pyramid._morton(x.r, x.c) and x.c2 == x.c


@pytest.mark.parametrize("block_levels", [1, 3, 9])
def test_pyramid(spark, tmp_path, block_levels):
    r = random.Random(14)
    cells = {(y, x): None if r.random() < 0.3 else r.uniform(0, 100) for y in range(50) for x in range(70) if r.random() < 0.9}
    for y in range(8, 16):
        for x in range(8, 16):
            cells[y, x] = None  # void on all levels up to the third
    grid = spark.createDataFrame([(y, x, h) for (y, x), h in cells.items()], "r long, c long, h double")
    built = pyramid.build(grid, 5, block_levels=block_levels)
    got = {(x.level, x.r, x.c): (x.h, x.n) for x in built.collect()}
    want: dict = {}
    for (y, x), h in cells.items():
        for level in range(6):
            want.setdefault((level, y >> level, x >> level), []).append(h)
    assert set(got) == set(want)
    for k, hs in want.items():
        hs = [h for h in hs if h is not None]
        assert got[k][1] == len(hs) and (got[k][0] is None if not hs else got[k][0] == pytest.approx(sum(hs) / len(hs)))
    assert got[3, 1, 1] == (None, 0)
    path = str(tmp_path / "pyramid")
    pyramid.write(built, path, range_levels=3)
    box = pyramid.read_box(spark, path, 1, 3, 9, 12, 20, range_levels=3)
    assert {(x.r, x.c) for x in box.collect()} == {(y, x) for level, y, x in want if level == 1 and 3 <= y <= 12 and 9 <= x <= 20}
    files = {x[0] for x in box.select(F.input_file_name()).collect()}
    assert len(files) == 4 and all("level=1/" in f for f in files)  # two by two ranges of eight cells
    plan = box._jdf.queryExecution().executedPlan().toString()
    pruned = plan[plan.index("PartitionFilters") :].split("PushedFilters")[0]
    assert "level" in pruned and "range" in pruned


def test_pyramid_is_one_shuffle(spark):
    grid = spark.range(1000).selectExpr("id div 32 as r", "id % 32 as c", "cast(id as double) as h")
    plan = pyramid.build(grid, 4).where("level = 4")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_level_for():
    assert [pyramid.level_for(w, 0.5, 4) for w in (0, 0.2, 0.5, 0.9, 1.0, 3.9, 4.0, 99)] == [0, 0, 0, 0, 1, 2, 3, 4]


def test_points_pushed_out_of_zones(spark):
    """After the rounds nothing is inside but what lies in a nest of zones; what was outside stays; the way is the shortest."""
    r = random.Random(12)
    polys = [(z, star(r, (z % 8) * 20.0 - 70, (z // 8) * 20.0 - 30, 6.0, 5 + z % 9)) for z in range(32)]
    pts = [(i, r.uniform(-80, 80), r.uniform(-40, 40)) for i in range(1_500)] + [(9_001, None, 1.0), (9_002, polys[0][1][0][0], polys[0][1][0][1])]
    got = {v["id"]: v for v in zones.push_out(spark.createDataFrame(pts, POINT), spark.createDataFrame(polys, ZONE), "id", 200.0).collect()}
    assert got.keys() == {p[0] for p in pts} and not any(v["inside"] for v in got.values())
    held = dict(brute(pts, polys))
    assert not brute([(k, v["lon"], v["lat"]) for k, v in got.items()], polys)
    for k, x, y in pts:
        v = got[k]
        assert (v["moves"] > 0) == (k in held)
        if k not in held:
            assert (v["lon"], v["lat"]) == (x, y)
        elif v["moves"] == 1:
            ways = []
            for (ax, ay), (bx, by) in zip(dict(polys)[held[k]], dict(polys)[held[k]][1:] + dict(polys)[held[k]][:1]):
                c = math.cos(math.radians((ay + by) / 2))
                dx, dy = (bx - ax) * c, by - ay
                t = min(max(((x - ax) * c * dx + (y - ay) * dy) / (dx * dx + dy * dy), 0), 1)
                ways.append((math.hypot((x - ax) * c - t * dx, y - ay - t * dy), c))
            way, c = min(ways)
            assert math.hypot((v["lon"] - x) * c, v["lat"] - y) == pytest.approx(way + math.degrees(200 / 6_371_000), abs=1e-7)
    nested = [(1, [[0.0, 0.0], [9.0, 0.0], [9.0, 9.0], [0.0, 9.0]]), (2, [[-9.0, -9.0], [18.0, -9.0], [18.0, 18.0], [-9.0, 18.0]])]
    one = zones.push_out(spark.createDataFrame([(1, 4.0, 1.0)], POINT), spark.createDataFrame(nested, ZONE), "id", 100.0, 1).first()
    two = zones.push_out(spark.createDataFrame([(1, 4.0, 1.0)], POINT), spark.createDataFrame(nested, ZONE), "id", 100.0, 2).first()
    assert (one["moves"], one["inside"]) == (1, True) and (two["moves"], two["inside"]) == (2, False)
    none = zones.push_out(spark.createDataFrame([(1, 4.0, 1.0)], POINT), spark.createDataFrame([], ZONE), "id", 100.0).first()
    assert (none["moves"], none["inside"], none["lon"]) == (0, False, 4.0)
