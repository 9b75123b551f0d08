"""Block rasters, images drawn in other coordinates, fields marched by block, and ordered folds, against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.operators import blocks, kernels, paths, profile, sequence
from geoloom.runtime import ship


def frame(spark, a, names=("h",)):
    a = a[None] if a.ndim == 2 else a
    rows = [(int(r), int(c), *[None if np.isnan(b[r, c]) else float(b[r, c]) for b in a]) for r in range(a.shape[1]) for c in range(a.shape[2])]
    return spark.createDataFrame(rows, "r long, c long, " + ", ".join(f"{n} double" for n in names))


def brute(img, y, x):
    rows, cols = img.shape
    if not (0 <= y <= rows - 1 and 0 <= x <= cols - 1):
        return None
    r, c = int(y), int(x)
    r1, c1 = min(r + 1, rows - 1), min(c + 1, cols - 1)
    low = img[r, c] + (img[r, c1] - img[r, c]) * (x - c)
    up = img[r1, c] + (img[r1, c1] - img[r1, c]) * (x - c)
    v = low + (up - low) * (y - r)
    return None if np.isnan(v) else v


@pytest.mark.parametrize("projection", ["geographic", "web_mercator"])
def test_warp_equals_brute_force(spark, projection):
    ship(spark)
    rng = np.random.default_rng(3)
    img = rng.integers(0, 255, (2, 37, 50)).astype(float)
    img[0, rng.random((37, 50)) < 0.05] = np.nan
    if projection == "geographic":
        origin, cell = (10.0, 50.0), (0.01, 0.02)
    else:
        origin, cell = (1_113_194.9, 6_446_275.8), (1_113.2, 3_500.0)
    target = (9.973, 50.011, 0.0063, 0.0117, 91, 77)  # over all sides
    drawn = blocks.warp(blocks.to_blocks(frame(spark, img, ("a", "b")), ["a", "b"], 16), (37, 50), origin, cell, target, projection, 2, 16)
    got = {(v["band"], v["j"], v["i"]): v["value"] for v in blocks.target_cells(drawn, 91, 77, 16).collect()}
    assert len(got) == 2 * 77 * 91
    known = 0
    for (band, j, i), v in got.items():
        lon, lat = target[0] + i * target[2], target[1] - j * target[3]
        x, y = (lon, lat) if projection == "geographic" else (6378137.0 * math.radians(lon), 6378137.0 * math.log(math.tan(math.pi / 4 + math.radians(lat) / 2)))
        want = brute(img[band], (origin[1] - y) / cell[1], (x - origin[0]) / cell[0])
        assert (v is None) == (want is None)
        if want is not None:
            known += 1
            assert v == pytest.approx(want, abs=1e-6)
    assert known > 4_000


def test_warp_where_a_task_has_blocks_with_and_without_an_image(spark):
    ship(spark)
    img = np.arange(400.0).reshape(20, 20)
    drawn = blocks.warp(blocks.to_blocks(frame(spark, img), ["h"], 8).coalesce(1), (20, 20), (0.0, 1.0), (0.1, 0.1), (0.0, 1.0, 0.1, 0.1, 20, 80), block=8)
    got = {(v["j"], v["i"]): v["value"] for v in blocks.target_cells(drawn, 20, 80, 8).collect()}
    assert len(got) == 1600 and all(got[j, i] is None for j in range(20, 80) for i in range(20))
    assert all(got[j, i] == pytest.approx(img[j, i], abs=1e-9) for j in range(1, 19) for i in range(1, 19))


def test_warp_of_nothing_and_far_away(spark):
    empty = spark.createDataFrame([], "r long, c long, h double")
    drawn = blocks.warp(blocks.to_blocks(empty, ["h"], 8), (20, 20), (0.0, 1.0), (0.1, 0.1), (0.0, 1.0, 0.1, 0.1, 10, 9), block=8)
    assert {r["value"] for r in blocks.target_cells(drawn, 10, 9, 8).collect()} == {None}
    assert blocks.target_cells(drawn, 10, 9, 8).count() == 90
    far = blocks.warp(blocks.to_blocks(frame(spark, np.ones((20, 20))), ["h"], 8), (20, 20), (0.0, 1.0), (0.1, 0.1), (90.0, -40.0, 0.1, 0.1, 10, 9), block=8)
    assert {r["value"] for r in blocks.target_cells(far, 10, 9, 8).collect()} == {None}
    with pytest.raises(ValueError):
        blocks.warp(blocks.to_blocks(empty, ["h"], 8), (20, 20), (0.0, 1.0), (0.1, 0.1), (0.0, 1.0, 0.1, 0.1, 10, 9), "utm", block=8)


def test_whole_block_has_no_pixel_rows(spark):
    drawn = blocks.warp(blocks.to_blocks(frame(spark, np.ones((20, 20))), ["h"], 8), (20, 20), (0.0, 1.0), (0.1, 0.1), (0.0, 1.0, 0.1, 0.1, 20, 11), block=8)
    assert drawn.count() == 6 and "posexplode" not in drawn._jdf.queryExecution().toString()


@pytest.mark.parametrize("seed", [1, 2])
def test_field_by_blocks_equals_one_block(spark, seed):
    """256 x 256 in 16 blocks, with walls that the front must go round through several blocks."""
    ship(spark)
    rng = np.random.default_rng(seed)
    cost = rng.random((256, 256)).astype(np.float32) + 0.2
    cost[rng.random((256, 256)) < 0.1] = np.inf
    cost[60, :230] = np.inf
    cost[130, 30:] = np.inf
    cost[20:60, 150] = np.inf
    cost[200:220, 200:220] = np.inf
    cost[210, 210] = 1.0  # walled in
    want = kernels.fast_march(cost, (5, 9))
    rows = [("f", int(r), int(c), float(cost[r, c])) for r in range(256) for c in range(256)]
    at = spark.createDataFrame(rows, "field string, r int, c int, cost double")
    t, solves = blocks.arrivals_by_block(at, spark.createDataFrame([("f", 5, 9)], "field string, src_r int, src_c int"), 64)
    got = np.full((256, 256), np.nan, np.float32)
    for v in t.collect():
        got[v["r"], v["c"]] = v["t"]
    assert (np.isinf(got) == np.isinf(want)).all() and not np.isnan(got).any()
    ok = np.isfinite(want)
    assert np.allclose(got[ok], want[ok], rtol=1e-5)
    assert solves[0] == 1 and len(solves) <= 40 and max(solves) < 16  # never all at once: a block at rest is not run again


def test_fields_by_blocks_beside_each_other(spark):
    """Several fields, cells that no row names, a source beyond its field, and no field at all."""
    r = np.random.default_rng(5)
    rows = [(f, i, j, float(r.random() + 0.1)) for f in (1, 2) for i in range(20) for j in range(13) if r.random() < 0.9 or (i, j) == (0, 0)]
    rows += [(3, i, j, 1.0) for i in range(4) for j in range(4)]
    f = spark.createDataFrame(rows, "field int, r int, c int, cost double")
    s = spark.createDataFrame([(1, 0, 0), (2, 0, 0), (3, 400, 400)], "field int, src_r int, src_c int")
    got = {(v["field"], v["r"], v["c"]): v["t"] for v in blocks.arrivals_by_block(f, s, 5)[0].collect()}
    want = {(v["field"], v["r"], v["c"]): v["t"] for v in paths.arrivals(f, s).collect()}
    assert got.keys() == want.keys()
    assert all(g == pytest.approx(want[k], rel=1e-5) for k, g in got.items())
    none, solves = blocks.arrivals_by_block(f.limit(0), s, 5)
    assert none.count() == 0 and solves == []


def last_kept(points, eps):
    out = []
    for p in points:
        if not out or None in (p[0], p[1], out[-1][0], out[-1][1]) or abs(p[0] - out[-1][0]) >= eps or abs(p[1] - out[-1][1]) >= eps:
            out.append(p)
    return out


def test_repeats_are_those_of_the_last_kept_point(spark):
    """Slow drift, jitter, parked stretches, jumps there and back, and nulls; each compared with the last point kept."""
    r = random.Random(8)
    tracks = {1: [(0.0, 0.0)] * 50 + [(1.0, 1.0)], 2: [(i * 0.4, 0.0) for i in range(200)], 3: [(5.0, 5.0)], 5: [(0.0, 0.0), (None, 0.0), (0.0, 0.0), (0.0, None), (0.0, None), (0.2, 0.1)]}
    x = y = 0.0
    tracks[4] = []
    for _ in range(3_000):
        kind = r.random()
        x, y = (x, y) if kind < 0.3 else (x + r.uniform(-1.2, 1.2), y + r.uniform(-1.2, 1.2)) if kind < 0.9 else (x + r.uniform(-9, 9), y)
        tracks[4].append((x, y))
    rows = [(k, i * 3, a, b, float(i)) for k, t in tracks.items() for i, (a, b) in enumerate(t)]
    r.shuffle(rows)
    got = {}
    for v in sequence.drop_repeats(spark.createDataFrame(rows, "path long, seq long, lon double, lat double, alt_m double"), 1.0).orderBy("path", "seq").collect():
        got.setdefault(v["path"], []).append((v["seq"], v["lon"], v["lat"], v["alt_m"]))
    for k, t in tracks.items():
        want = last_kept([(a, b, float(i)) for i, (a, b) in enumerate(t)], 1.0)
        assert got[k] == [(i, *w) for i, w in enumerate(want)], k


def test_greedy_clusters_equal_the_fold(spark):
    """Over the date line and the poles, in dense spots, with repeats and nulls; a key of many points on few batches."""
    ship(spark)
    r = random.Random(4)
    rows = [(k, r.uniform(-180, 180), r.uniform(-90, 90)) for k in (1, 2) for _ in range(1_500)]
    rows += [(3, r.choice([-180.0, 179.99, 0.0]) + r.uniform(0, 0.01), r.choice([89.999, -89.9995, 10.0])) for _ in range(800)]
    rows += [(4, 7.0, 8.0)] * 50 + [(5, None, 1.0), (None, 1.0, 1.0)]
    radius = 700_000.0
    got = [tuple(v) for v in profile.greedy_clusters(spark.createDataFrame(rows, "k long, lon double, lat double"), "k", radius).collect()]
    want = []
    for k in (1, 2, 3, 4):
        centres = []
        for _, lon, lat in sorted(v for v in rows if v[0] == k):
            a, b = math.radians(lon), math.radians(lat)
            if not any(2 * 6_371_000.0 * math.asin(min(1.0, math.sqrt(math.sin((b - d) / 2) ** 2 + math.cos(b) * math.cos(d) * math.sin((a - c) / 2) ** 2))) <= radius for c, d in centres):
                want.append((k, len(centres), lon, lat))
                centres.append((a, b))
    assert sorted(got) == want


def test_small_blocks_rest_in_few_rounds(spark, monkeypatch):
    """Rounds follow districts, not blocks: 60 blocks in a row are one round, and as many again as a district has sides to cross."""
    r = np.random.default_rng(4)
    cost = r.uniform(1, 3, (240, 8))
    f = spark.createDataFrame([(1, i, j, float(cost[i, j])) for i in range(240) for j in range(8)], "field int, r int, c int, cost double")
    s = spark.createDataFrame([(1, 1, 1)], "field int, src_r int, src_c int")
    want = kernels.fast_march(cost, (1, 1))
    for cells, most in ((1024, 1), (40, 8)):
        monkeypatch.setattr(blocks, "DISTRICT", cells)
        t, solves = blocks.arrivals_by_block(f, s, 4)
        assert len(solves) <= most
        got = {(v["r"], v["c"]): v["t"] for v in t.collect()}
        assert len(got) == 240 * 8 and all(v == pytest.approx(want[k], rel=1e-5) for k, v in got.items())
