"""Findings of round 3, taken up again: what a task holds, what is shuffled, and how many files are made."""

import random

import pytest
from pyspark.sql import functions as F

from geoloom import runtime
from geoloom.operators import conflicts, paths, pathtree, profile, pyramid
from geoloom.plans import derive, registry

POINT = "path long, seq long, lon double, lat double, alt_m double"


def shuffles(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange ") - plan.count("BroadcastExchange ")


def made_paths(spark, n: int, most: int = 7, seed: int = 3):
    r = random.Random(seed)
    rows = [(p, s, 100 + r.random(), 30 + r.random(), r.uniform(0, 900)) for p in range(n) for s in range(1, r.randint(1, most) + 1)]
    return rows, spark.createDataFrame(rows, POINT)


def test_dealt_follows_the_rows(spark):
    df = spark.range(100_000).withColumn("k", F.col("id") % 997)
    many = runtime.dealt(df, 1_000, "k")
    assert many.groupBy(F.spark_partition_id()).count().count() == 100
    assert runtime.dealt(df, 1_000_000, "k") is df


@pytest.mark.parametrize("draw", [paths.chaikin, lambda p: paths.catmull_rom(p, 3)])
def test_curves_are_drawn_where_their_path_is(spark, draw, monkeypatch):
    """one shuffle and no sort of what is drawn; there were several of each."""
    monkeypatch.setattr(derive, "POINTS_PER_TASK", 500)
    out = draw(derive.points(spark, "/root/testdata/sf0.001"))
    assert shuffles(out) == 1
    got = out.groupBy("path").agg(F.count("*").alias("n"), F.min("seq").alias("a"), F.max("seq").alias("z"), F.countDistinct("seq").alias("d")).collect()
    assert all(x.a == 0 and x.z == x.n - 1 == x.d - 1 for x in got)
    assert out.groupBy(F.spark_partition_id()).count().count() > 8


def test_curves_of_odd_paths(spark):
    rows = [(1, 5, 0.0, 0.0, 0.0), (2, 1, 1.0, 1.0, 1.0), (2, 9, 2.0, 2.0, 2.0), (3, 2, 0.0, 0.0, 0.0), (3, 4, 4.0, 8.0, 12.0), (3, 7, 8.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, POINT)
    cut = {(x.path, x.seq): (x.lon, x.lat) for x in paths.chaikin(df).collect()}
    assert cut == {(1, 0): (0, 0), (2, 0): (1, 1), (2, 1): (2, 2), (3, 0): (0, 0), (3, 1): (1, 2), (3, 2): (3, 6), (3, 3): (5, 6), (3, 4): (7, 2), (3, 5): (8, 0)}
    curve = {(x.path, x.seq): (x.lon, x.lat) for x in paths.catmull_rom(df, 2).collect()}
    assert set(curve) == {(1, 0), (2, 0), (2, 1), *((3, i) for i in range(5))}
    assert curve[3, 0] == (0, 0) and curve[3, 2] == (4, 8) and curve[3, 4] == (8, 0)


def test_terrain_meets_samples_where_they_are(spark, monkeypatch):
    """a grid too large for Spark's own broadcast is cut to what lies under the paths; samples were shuffled by cell."""
    rows, df = made_paths(spark, 60)
    grid = spark.createDataFrame([(r, c, float(r * 41 + c)) for r in range(-3, 40) for c in range(-3, 40)], "r long, c long, h double")
    args = (100.0, 30.0, 0.0371, 20_000.0, 8)
    want = sorted(map(tuple, profile.terrain_along(df, grid, *args).collect()))
    monkeypatch.setattr(profile, "CELLS_AS_THEY_ARE", 10)
    small = profile.terrain_along(df, grid, *args)
    assert shuffles(small) == 1
    monkeypatch.setattr(profile, "CELLS_TO_ALL", 10)
    large = profile.terrain_along(df, grid, *args)
    assert sorted(map(tuple, small.collect())) == want == sorted(map(tuple, large.collect())) and any(w[2] is not None for w in want)
    nowhere = profile.terrain_along(df.limit(0), grid, *args)
    assert nowhere.isEmpty()


def test_short_paths_meet_points_by_path(spark, monkeypatch):
    """paths of one box stay in the tasks that they are in; they were shuffled again by path and box."""
    monkeypatch.setattr(derive, "POINTS_PER_TASK", 500)
    for name in ("height_on_path", "point_polyline"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")
        assert shuffles(plan) == 2, name  # the points of the paths, and those that are asked for
    rows, df = made_paths(spark, 40, 12)
    asked = df.select(F.col("path").alias("id"), "path", F.lit(100.5).alias("plon"), F.lit(30.5).alias("plat")).distinct()
    few = sorted(map(tuple, pathtree.nearest_segment(asked, df, "id").collect()))
    monkeypatch.setattr(pathtree, "FANOUT", 4)
    assert sorted(map(tuple, pathtree.nearest_segment(asked, df, "id").collect())) == few and few


def test_conflicts_of_pieces(spark, monkeypatch):
    """short paths are shuffled by cells only, not by pairs; longer ones go in pieces, with the same result."""
    r = random.Random(9)
    rows = []
    for p in range(24):
        x, y = r.uniform(0, 1.2), r.uniform(0, 1.2)
        for s in range(r.randint(1, 12)):
            nx, ny = x + r.uniform(-0.2, 0.2), y + r.uniform(-0.2, 0.2)
            rows.append((p, s, x, y, nx, ny, r.uniform(0, 300), r.uniform(0, 300)))
            x, y = nx, ny
    s = spark.createDataFrame(rows, "path long, seq long, ax double, ay double, bx double, by double, alt1 double, alt2 double")
    one = conflicts.path_conflicts(s)
    keys = one._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(path_1" not in keys
    want = sorted(map(tuple, one.collect()))
    monkeypatch.setattr(conflicts, "PIECE", 3)
    assert sorted(map(tuple, conflicts.path_conflicts(s).collect())) == want and len(want) > 20
    assert sorted(map(tuple, conflicts.path_conflicts(s, cell_deg=0.1).collect())) == want
    assert conflicts.path_conflicts(s.limit(0)).isEmpty()


def test_pyramid_files_follow_the_raster():
    """a raster of 360 times as many rows has no more files a level for it, until they are full."""
    assert pyramid.range_levels_for(313, least=3) == 3
    for rows in (313, 1_876, 18_751, 32_768):
        k = pyramid.range_levels_for(rows, least=3)
        assert -(-rows // 2**k) <= 64
    assert pyramid.range_levels_for(10**9) == pyramid.RANGE_LEVELS
