"""Invariants of the sequential kernels."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoloom.operators import kernels as K


def test_front_reaches_all_and_trace_ends_at_source():
    t = K.fast_march(np.ones((20, 30)), (3, 4))
    assert np.isfinite(t).all() and t[3, 4] == 0 and t[3, 29] == 25
    path = K.back_trace(t, (19, 29), (3, 4))
    assert path[0] == (19, 29) and path[-1] == (3, 4)
    assert all(t[a] > t[b] for a, b in zip(path, path[1:]))


def test_walls_block():
    c = np.ones((9, 9), np.float32)
    c[:, 4] = np.inf
    t = K.fast_march(c, (0, 0))
    assert not np.isfinite(t[:, 4:]).any() and K.back_trace(t, (0, 8), (0, 0)) is None
    assert K.nearest_reached(t, (0, 6), 4) == (0, 2)
    assert not np.isfinite(K.fast_march(c, (20, 0))).any()


@settings(max_examples=200, deadline=None)
@given(st.tuples(*[st.floats(-6, 6)] * 2, st.floats(0, 6.28)), st.tuples(*[st.floats(-6, 6)] * 2, st.floats(0, 6.28)))
def test_dubins_ends_at_the_goal(a, b):
    word, parts = K.dubins(a, b, 1.0)
    x, y, h = K.dubins_sample(a, word, parts, 1.0, 0.2)[-1]
    assert math.hypot(x - b[0], y - b[1]) < 1e-5
    assert abs((h - b[2] + math.pi) % (2 * math.pi) - math.pi) < 1e-5


def test_dubins_degenerate():
    assert K.dubins((0, 0, 0), (1, 1, 0), 0) is None
    assert K.dubins((math.nan, 0, 0), (1, 1, 0), 1) is None


def test_hull_holds_all_points():
    r = random.Random(3)
    pts = [(r.uniform(0, 9), r.uniform(0, 9)) for _ in range(200)]
    h = K.convex_hull(pts)
    assert all(K._side(a, b, p) >= -1e-9 for a, b in zip(h, h[1:] + h[:1]) for p in pts)
    assert K.convex_hull([(0, 0), (0, 0)]) == [(0, 0)]


def test_visibility_goes_round():
    status, path = K.visibility_path((0, 0), (10, 0), [[(4, -1), (6, -1), (6, 1), (4, 1)]], 0.5)
    assert status == "path" and len(path) == 4
    assert K.visibility_path((5, 0), (20, 0), [[(4, -1), (6, -1), (6, 1), (4, 1)]], 0.5)[0] == "impossible"
    assert K.visibility_path((0, 0), (10, 0), [[(4, -1), (6, -1), (6, 1), (4, 1)]], 0.5, 3)[0] == "search_truncated"


def hull_of(r, n=7):
    return K.convex_hull([(r.uniform(-5, 5), r.uniform(-5, 5)) for _ in range(n)])


def test_offset_moves_every_edge():
    r = random.Random(3)
    for _ in range(50):
        hull, by = hull_of(r), r.uniform(0.1, 2)
        out = K.offset_convex(hull, by)
        assert len(out) == len(hull)
        for (ax, ay), (bx, by_), p, q in zip(hull, hull[1:] + hull[:1], out, out[1:] + out[:1]):
            for x, y in (p, q):  # both ends of the moved edge lie at that distance from the old one's line
                assert ((y - ay) * (bx - ax) - (x - ax) * (by_ - ay)) / math.hypot(bx - ax, by_ - ay) == pytest.approx(-by)
    assert K.offset_convex([(0, 0), (1, 1)], 1) == K.offset_convex([(0, 0), (1, 0), (1, 1)], 0) == K.offset_convex([(0, 0), (0, 0), (1, 1)], 1) == []


def deepest(a, b, hull, n=4000):
    """The depth inside a hull of the deepest of many points of a segment."""
    best = -math.inf
    for k in range(n + 1):
        x, y = a[0] + (b[0] - a[0]) * k / n, a[1] + (b[1] - a[1]) * k / n
        best = max(best, min((qx - px) * (y - py) - (qy - py) * (x - px) for (px, py), (qx, qy) in zip(hull, hull[1:] + hull[:1])))
    return best


def passing_cases():
    r = random.Random(4)
    for _ in range(80):
        hull, a, b = hull_of(r), (r.uniform(-8, 8), r.uniform(-8, 8)), (r.uniform(-8, 8), r.uniform(-8, 8))
        if abs(d := deepest(a, b, hull)) > 0.05:  # clear cases: points are sampled
            yield hull, a, b, d > 0
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    yield square, (0.0, 0.0), (1.0, 0.0), False  # along a side
    yield square, (2.0, 0.5), (3.0, 0.5), False
    yield square, (0.2, 0.5), (0.8, 0.5), True  # within


def test_passing_against_samples(spark):
    from pyspark.sql import functions as F

    from geoloom.functions import geometry

    cases = list(passing_cases())
    assert all(K.passes_convex(a, b, h) == want for h, a, b, want in cases) and 10 < sum(c[3] for c in cases) < len(cases) - 10
    df = spark.createDataFrame([(i, [list(map(float, v)) for v in h], *a, *b) for i, (h, a, b, _) in enumerate(cases)], "i long, p array<array<double>>, ax double, ay double, bx double, by double")
    got = {x[0]: x[1] for x in df.select("i", geometry.segment_through_convex(*(F.col(c) for c in ("ax", "ay", "bx", "by")), F.col("p"))).collect()}
    assert got == {i: c[3] for i, c in enumerate(cases)}


def test_circle_interval_against_samples(spark):
    from pyspark.sql import functions as F

    from geoloom.functions import geometry

    r = random.Random(5)
    rows = [(i, r.uniform(-1, 1), 50 + r.uniform(-1, 1), r.uniform(-1, 1), 50 + r.uniform(-1, 1), r.uniform(5, 80)) for i in range(100)] + [(100, 0.0, 50.0, 0.0, 50.0, 9.0)]
    df = spark.createDataFrame(rows, "i long, ax double, ay double, bx double, by double, radius double")
    iv = geometry.segment_circle_interval(*(F.col(c) for c in ("ax", "ay", "bx", "by")), F.lit(0.0), F.lit(50.0), F.col("radius"))
    for i, got in df.select("i", iv).collect():
        _, ax, ay, bx, by, radius = rows[i]
        k = math.cos(math.radians((ay + by) / 2)) * 111.32
        reach = radius + max(math.hypot((bx - ax) * k, (by - ay) * 111.32) * 0.005, 1.0)
        n = [t / 2000 for t in range(2001) if math.hypot((ax + (bx - ax) * t / 2000) * k, (ay + (by - ay) * t / 2000 - 50) * 111.32) < reach] if i < 100 else []
        if n:
            assert got and got["t0"] == pytest.approx(min(n), abs=2e-3) and got["t1"] == pytest.approx(max(n), abs=2e-3)
        else:
            assert got is None or got["t1"] - got["t0"] < 1e-3


def test_tangents_touch(spark):
    from pyspark.sql import functions as F

    from geoloom.functions import geometry

    df = spark.createDataFrame([(5.0, 1.0, 2.0), (1.0, 0.0, 2.0), (2.0, 0.0, 2.0)], "x double, y double, r double")
    got = df.select("x", "y", "r", geometry.tangent_points(F.col("x"), F.col("y"), F.lit(0.0), F.lit(0.0), F.col("r")).alias("t"), geometry.common_tangents(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.col("x"), F.col("y"), F.lit(2.0)).alias("c")).collect()
    assert len(got[0]["t"]) == 2 and got[1]["t"] is None and got[2]["t"] is None
    for p in got[0]["t"]:
        assert abs(math.hypot(p["x"], p["y"]) - 2) < 1e-12 and abs(p["x"] * (5 - p["x"]) + p["y"] * (1 - p["y"])) < 1e-9
    assert [len(g["c"]) for g in got] == [4, 1, 2]  # apart; touching from inside; overlapping
    for t in got[0]["c"]:
        dx, dy = t["bx"] - t["ax"], t["by"] - t["ay"]
        assert abs(t["ax"] * dx + t["ay"] * dy) < 1e-9 and abs((t["bx"] - 5) * dx + (t["by"] - 1) * dy) < 1e-9


def test_simplify_keeps_the_tolerance():
    p = np.column_stack([np.linspace(0, 1, 60), 0.02 * np.sin(np.linspace(0, 9, 60)), np.zeros(60)])
    keep = K.simplify(p, 500)
    assert keep[0] == 0 and keep[-1] == 59 and len(keep) < 60
    assert all(K.chord_errors(p, i, j).max() <= 500 for i, j in zip(keep, keep[1:]) if j > i + 1)
    assert K.simplify(p[:1], 5) == [0] and K.simplify(p[:0], 5) == []


def test_grade_limit_holds():
    along, alt = np.arange(10) * 1000.0, np.array([0, 0, 900, 0, 0, 0, 0, 400, 0, 0], float)
    out = K.grade_limit(along, alt, np.zeros(10), 10)
    assert (out >= alt - 1e-9).all() and (np.abs(np.diff(out)) <= 1000 * math.tan(math.radians(10)) + 1e-6).all()


def test_fillet_is_tangent_and_push_out_leaves():
    arc = K.fillet((0, 0), (10, 0), (10, 10), 2, 0.2)
    assert np.allclose(arc[0], (8, 0)) and np.allclose(arc[-1], (10, 2))
    sq = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    out = K.push_out(np.array([[1.0, 2.0, 5.0], [9.0, 9.0, 5.0]]), sq, 0.1)
    assert np.allclose(out[0, :2], (-0.1, 2.0)) and np.allclose(out[1, :2], (9, 9))


def test_vincenty_known():
    d = K.vincenty_m([0, 0, 10], [0, 0, 10], [1, 0, 10], [0, 90, 10])
    assert np.allclose(d, [111319.491, 10001965.729, 0], atol=0.01)


def test_straighten():
    """Kept cells are the trace's, in order and with its ends, and the lines between them cross no blocked cell; without
    obstacles only the ends stay."""
    rng = np.random.default_rng(5)
    for k in range(30):
        blocked = rng.random((40, 40)) < (0.25 if k else 0)
        blocked[0, 0] = blocked[39, 39] = False
        t = K.fast_march(np.where(blocked, np.inf, 1).astype(np.float32), (0, 0))
        if not np.isfinite(t[39, 39]):
            continue
        trace = K.back_trace(t, (39, 39), (0, 0))
        kept = K.straighten(trace, blocked)
        assert kept[0] == trace[0] and kept[-1] == trace[-1]
        where = [trace.index(c) for c in kept]
        assert where == sorted(set(where)) and (k or len(kept) == 2)
        for (a, b), (i, j) in zip(zip(kept, kept[1:]), zip(where, where[1:])):
            if j > i + 1:
                for s in np.linspace(0, 1, 4 * max(abs(b[0] - a[0]), abs(b[1] - a[1])) + 1):
                    assert not blocked[round(a[0] + (b[0] - a[0]) * s), round(a[1] + (b[1] - a[1]) * s)]
        tight = K.tighten(trace, blocked)
        assert tight[0] == trace[0] and tight[-1] == trace[-1] and not any(blocked[c] for c in tight)
        assert sum(map(math.dist, tight, tight[1:])) <= sum(map(math.dist, kept, kept[1:])) + 1e-9
    assert K.tighten([], np.zeros((2, 2), bool)) == [] and K.tighten([(1, 1)], np.zeros((2, 2), bool)) == [(1, 1)]


def test_sights_equal_one_leg_at_a_time():
    r = np.random.default_rng(8)
    some = [[(x, y) for x, y in r.uniform(0, 1, 2) + r.uniform(-0.1, 0.1, (6, 2))] for _ in range(4)]
    ends = r.uniform(-0.2, 1.2, (400, 4)).round(2)
    ends[::50, 2:] = ends[::50, :2]
    for obstacles, inflate, most in ((some, 0.02, None), (some[:1], 0.02, None), ([], 0.02, None), (some, 0.02, 10), ([[(0.4, 0.4), (0.6, 0.4), (0.6, 0.6), (0.4, 0.6)]], 0.1, None)):
        got = K.Sights(obstacles, inflate, most).paths(ends[:, :2], ends[:, 2:])
        assert got == [K.visibility_path((a, b), (c, d), obstacles, inflate, most) for a, b, c, d in ends.tolist()]


def test_sights_of_many_legs_take_little_time():
    import time

    zone = [(100.2, 30.2), (100.6, 30.25), (100.55, 30.7), (100.3, 30.6)]
    y = 30 + np.arange(20_000) % 97 / 100
    began = time.time()
    assert len(K.Sights([zone], 0.02).paths(np.column_stack([y * 0 + 100, y]), np.column_stack([y * 0 + 101, y[::-1]]))) == 20_000
    assert time.time() - began < 3  # one at a time: some 0.4 ms each


def test_one_segment_is_judged_as_many_are():
    r = np.random.default_rng(12)
    hull = K.convex_hull(r.uniform(0, 1, (12, 2)).tolist())
    ends = np.concatenate([r.uniform(-0.5, 1.5, (3000, 4)), np.array([[*a, *b] for a in hull for b in hull])])
    want = K.all_pass_convex(ends[:, :2], ends[:, 2:], hull).tolist()
    assert 200 < sum(want) < 2800 and [K.passes_convex((a, b), (c, d), hull) for a, b, c, d in ends.tolist()] == want


def test_corners_and_sights_cost_microseconds():
    import time

    hull = [(100.2, 30.2), (100.6, 30.25), (100.55, 30.7), (100.3, 30.6)]
    for work, n, most in ((lambda: K.passes_convex((100.0, 30.5), (101.0, 30.4), hull), 20_000, 0.3), (lambda: K.fillet((0.0, 0.0), (5.0, 1.0), (4.0, 7.0), 1.0, 1.0), 10_000, 0.25)):
        best = 9.9
        for _ in range(3):
            began = time.perf_counter()
            for _ in range(n):
                work()
            best = min(best, time.perf_counter() - began)
        assert best < most
