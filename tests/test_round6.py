"""Findings of round 4: work that is done once, and what is written and read on the way."""

import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from geoloom.operators import conflicts, joins, kernels, meeting, paths, profile
from geoloom.plans import registry, scenario


def test_legs_that_are_alike_are_flown_once(spark, monkeypatch):
    """every leg was marched by itself, 25 ms each, however many were the same."""
    at = lambda lon: {"lon": lon, "lat": 30.0, "alt_m": 1000.0}
    zone = lambda name, r: {"id": name, "shape": "circle", "geometry": {"center": [100.5, 30.0], "radius_km": r}}
    one = lambda name, z: {"scenario_id": name, "aircraft": [{"id": "v", "start": at(100.0), "target": at(101.0), "mid_waypoints": [at(100.9)]}], "no_fly_zones": [z]}
    scenes = [one("a", zone("z", 8.0)), one("b", zone("other name", 8.0)), one("c", zone("z", 9.0))]
    counts, fly = [], scenario.fly
    monkeypatch.setattr(scenario, "fly", lambda legs_: (counts.append(legs_.count()), fly(legs_))[1])
    got = {o["scenario_id"]: o for o in scenario.plan(spark.createDataFrame([(json.dumps(s),) for s in scenes], "scenario string")).collect()}
    assert counts == [4] and all(o["status"] == "success" for o in got.values())
    assert got["a"]["path"] == got["b"]["path"] != got["c"]["path"]
    for o in got.values():
        assert [p["x"] for p in o["path"]][0] == 100.0 and [p["x"] for p in o["path"]][-1] == 101.0
        assert len(o["path"]) == o["n_points"] and sum(p["x"] == 100.9 for p in o["path"]) == 1


def test_ways_without_walls(spark):
    """a field without a wall gives its ends, as the march gave."""
    ends = [(6, 0, 0, 5, 5), (6, 2, 3, 2, 3), (7, 6, 1, 0, 4)]
    rows = [(f"f{k}", n, a, b, c, d, i // n, i % n, 1.0) for k, (n, a, b, c, d) in enumerate(ends) for i in range(n * n)]
    cells = spark.createDataFrame(rows, "field string, n int, src_r int, src_c int, dst_r int, dst_c int, r int, c int, cost float").coalesce(1)
    got = paths.ways(cells).groupBy("field").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "r", "c"))), lambda v: F.struct(v["r"], v["c"])).alias("w")).collect()
    want = {}
    for k, (n, a, b, c, d) in enumerate(ends):
        t = kernels.fast_march(np.ones((n, n), np.float32), (a, b))
        want[f"f{k}"] = kernels.tighten(kernels.back_trace(t, (c, d), (a, b)), np.isinf(t))[::-1]
    assert {o["field"]: [tuple(v) for v in o["w"]] for o in got} == want


def test_crossings_are_counted_in_their_cells(spark, monkeypatch):
    """the counts of all pairs, with paths of several segments, ends on sides of cells, and cells too crowded for one task."""
    rng = np.random.default_rng(5)
    rows = [(f"p{i % 70:03d}", i, *map(float, rng.integers(-40, 40, 4) / 8), *map(float, rng.integers(0, 900, 2))) for i in range(210)]
    rows += [("q0", 0, -5.0, 1.0, 5.0, 1.1, 5.0, 0.0), ("q1", 0, -5.0, 1.1, 5.0, 1.0, 0.0, 0.0), ("q2", 0, 1.0, -5.0, 1.0, 5.0, 0.0, 0.0), (None, 0, 1.0, -5.0, 1.0, 5.0, 0.0, 0.0), ("q3", 0, 1.0, -5.0, None, 5.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "path string, seq long, ax double, ay double, bx double, by double, alt1 double, alt2 double")
    met = joins.crossings(df.where("bx IS NOT NULL"), "path", "seq", "alt1", "alt2", 0.25)
    want = sorted(map(tuple, met.groupBy("path_1").agg(F.count("*"), F.min("height_gap")).collect()))
    count = lambda cell: sorted(map(tuple, joins.crossing_counts(df, "path", "alt1", "alt2", cell).collect()))
    assert count(0.25) == want and count(64.0) == want and sum(n for _, n, _ in want) > 1000
    monkeypatch.setattr(meeting, "PAIRS", 50)
    monkeypatch.setattr(meeting, "ROWS", 40)
    assert count(2.0) == want and count(64.0) == want


def test_crossings_join_makes_no_rows_of_pairs(spark):
    df = registry.queries()["crossings_join"](spark, "/root/testdata/sf0.001")
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_whole_cells():
    r = np.random.default_rng(1)
    keys = np.repeat(np.arange(60), r.integers(1, 30, 60))
    t = pa.table({"k": keys, "v": np.arange(len(keys))})
    for size, most in ((7, 20), (1000, 20), (3, 1000), (1, 1)):
        parts = list(meeting.whole_cells(t.to_batches(max_chunksize=size), ["k"], most))
        assert pa.concat_tables([p for p, _ in parts]).column("v").to_pylist() == list(range(len(keys)))
        whole = [set(p.column("k").to_pylist()) for p, crowded in parts if not crowded]
        assert sum(map(len, whole)) == len(set().union(*whole))
        assert not any(set(p.column("k").to_pylist()) & set().union(*whole) for p, crowded in parts if crowded)
    b, e = np.array([2, 2, 5, 4, 5]), np.array([4, 4, 5, 5, 5])
    for most in (1, 2, 100):
        got = [(int(i), int(j)) for x, y in meeting.pairs(b, e, most) for i, j in zip(x, y)]
        assert got == [(0, 2), (0, 3), (1, 2), (1, 3), (3, 4)]


def test_terrain_is_cleared_in_one_pass(spark, monkeypatch):
    """samples were written anew, and shuffled, in each round: 626 MB of disk for 6 x sf0.1."""
    r = np.random.default_rng(7)
    rows = [(f"p{p}", i, 100 + r.random(), 30 + r.random(), float(r.uniform(0, 900))) for p in range(40) for i in range(4)]
    rows += [("same", i, 100.5, 30.5, 100.0 * i) for i in range(3)] + [("null", 0, 100.1, 30.1, None), ("null", 1, None, 30.2, 5.0), ("null", 2, 100.9, 30.9, 5.0)]
    pts = spark.createDataFrame(rows, "path string, seq long, lon double, lat double, alt_m double")
    cells = [(i // 30, i % 30, float(h)) for i, h in enumerate(r.uniform(0, 1500, 900)) if i % 7] + [(3, 3, None), (4, 4, float("nan")), (5, 5, 100.0), (5, 5, 1400.0)]
    grid = spark.createDataFrame(cells, "r int, c int, h double")
    clear = lambda: profile.clear_terrain(pts, grid, 100.0, 30.0, 0.0371, 100.0, 2_000.0)
    out = clear()
    assert out.where("added")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2
    got = sorted(map(repr, out.collect()))
    monkeypatch.setattr(profile, "SAMPLES_AT_ONCE", 50)
    assert sorted(map(repr, clear().collect())) == got
    monkeypatch.setattr(profile, "CELLS_TO_ALL", 0)
    assert sorted(map(repr, clear().collect())) == got
    # Every sample of every segment is clear of its cell, whose height is the largest listed.
    high = {}
    for a, b, h in cells:
        if h is not None and h == h:
            high[a, b] = max(high.get((a, b), h), h)
    byseg, n = {}, 0
    for o in out.collect():
        byseg.setdefault((o["path"], o["seg"]), []).append((o["t"], o["alt_m"]))
    own = {(p, s): (x, y, z) for p, s, x, y, z in rows}
    for (p, s), (x, y, z) in own.items():
        if (p, s + 1) not in own or p == "null":
            continue
        x2, y2, z2 = own[p, s + 1]
        knots = sorted([*byseg[p, s], (1.0, z2)])
        d = math.radians(y2 - y), math.radians(x2 - x)
        m = 2 * 6_371_000 * math.asin(math.sqrt(math.sin(d[0] / 2) ** 2 + math.cos(math.radians(y)) * math.cos(math.radians(y2)) * math.sin(d[1] / 2) ** 2))
        k = max(math.ceil(m / 2_000), 2)
        for t in (i / k for i in range(1, k)):
            cell = high.get((math.floor((y + (y2 - y) * t - 30) / 0.0371), math.floor((x + (x2 - x) * t - 100) / 0.0371)))
            if cell is not None:
                n += 1
                assert np.interp(t, *zip(*knots)) >= cell + 100 - 1e-5
    assert n > 1000 and len(got) > len(rows) + 100


def test_conflicts_are_found_in_their_cells(spark, monkeypatch):
    """pairs of pieces were rows of a join, of all their segments each. Held against all pairs of segments."""
    r = np.random.default_rng(11)
    rows = []
    for p in range(60):
        x, y = r.uniform(0, 1.2, 2) + (0, 60)
        for s in range(r.integers(1, 9)):
            nx, ny = x + r.uniform(-0.2, 0.2), y + r.uniform(-0.2, 0.2)
            rows.append((f"p{p:02d}", s, float(x), float(y), float(nx), float(ny), float(r.uniform(0, 500)), float(r.uniform(0, 500)), p % 2))
            x, y = nx, ny
    rows += [("flat", 0, 0.5, 60.5, 0.5, 60.5, 100.0, 300.0, 0), ("flat", 1, 0.5, 60.5, None, 60.5, 1.0, 2.0, 0), ("high", 0, 0.2, 60.2, 0.9, 60.9, None, 5.0, 1), (None, 0, 0.2, 60.2, 0.9, 60.9, 1.0, 5.0, 1)]
    s = spark.createDataFrame(rows, "path string, seq long, ax double, ay double, bx double, by double, alt1 double, alt2 double, part int")
    lat = {}
    for p, i, _, ay, _, by, *_ in rows:
        lat.setdefault(p, {})[i] = (ay, by)
    mean = spark.createDataFrame([(p, float(sum(a for a, _ in v.values()) + v[max(v)][1]), len(v) + 1) for p, v in lat.items()], "path string, s double, n int")
    side = lambda n: s.dropna().join(mean, "path").select(*(F.col(c).alias(f"{c}_{n}") for c in (*s.columns, "s", "n")))
    both = side(1).join(side(2), F.col("path_1") < F.col("path_2"))
    near = conflicts.closest_approach(both, (F.col("s_1") + F.col("s_2")) / (F.col("n_1") + F.col("n_2"))).where("h_km <= 1.0")
    near = near.withColumn("v_m", F.abs(F.expr("alt1_1 + (alt2_1 - alt1_1) * ta - (alt1_2 + (alt2_2 - alt1_2) * tb)"))).where("v_m <= 150")
    best = F.min(F.struct("h_km", "v_m", "seq_1", "seq_2", F.expr("ax_1 + (bx_1 - ax_1) * ta").alias("lon"), F.expr("ay_1 + (by_1 - ay_1) * ta").alias("lat")))
    short = lambda df: sorted((o[0], o[1], *(round(x, 7) for x in o[2:])) for o in df.collect())
    found = near.groupBy("path_1", "path_2", "part_1", "part_2").agg(best.alias("b"))
    pick = lambda df: short(df.select("path_1", "path_2", "b.h_km", "b.v_m", "b.lon", "b.lat"))
    want, within = pick(found), pick(found.where("part_1 = part_2"))
    assert len(want) > 100 > len(within) > 30
    assert short(conflicts.path_conflicts(s)) == want and short(conflicts.path_conflicts(s, within="part")) == within
    assert "Join" not in conflicts.path_conflicts(s)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(meeting, "ROWS", 12)
    monkeypatch.setattr(meeting, "PAIRS", 40)
    monkeypatch.setattr(conflicts, "PIECE", 3)
    assert short(conflicts.path_conflicts(s)) == want and short(conflicts.path_conflicts(s, within="part", cell_deg=0.2)) == within
