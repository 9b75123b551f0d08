"""What the findings of round 3 were about: work that follows the results' size, not products of both sides."""

import numpy as np
from pyspark.sql import functions as F

from geoloom.operators import joins, paths, zones


def test_ways_are_traces_without_a_shuffle(spark):
    """fields of legs are marched where their cells are made; cells were shuffled twice, from one task."""
    rng = np.random.default_rng(3)
    n = 20
    rows = []
    for f in range(6):
        wall = rng.random((n, n)) < (0.0, 0.1, 0.2, 0.3, 0.35, 0.6)[f]
        wall[2, 1] = wall[17, 18] = False
        rows += [(f"f{f}", n, 2, 1, 17, 18, r, c, float("inf") if wall[r, c] else 1.0) for r in range(n) for c in range(n)]
    cells = spark.createDataFrame(spark.sparkContext.parallelize(rows, 1), "field string, n int, src_r int, src_c int, dst_r int, dst_c int, r int, c int, cost float")
    ends = cells.select("field", "src_r", "src_c", "dst_r", "dst_c").distinct()
    want = paths.traces(paths.arrivals(cells.select("field", "r", "c", "cost"), ends.select("field", "src_r", "src_c")), ends, straight=True)
    got = paths.ways(cells)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    order = lambda df: sorted(map(tuple, df.select("field", "seq", "r", "c").collect()))
    assert order(got) == order(want) and len({r[0] for r in order(got)}) >= 3


def _scene(spark, monkeypatch):
    """Points in small chunks and polygons over several tiles, some of them crossing themselves or beyond the points."""
    monkeypatch.setattr(zones, "TILE_POINTS", 40)
    rng = np.random.default_rng(4)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(-80, 80, (400, 2)) / 4)] + [(900, None, 1.0), (901, float("nan"), 1.0)]
    polys = [(z, [[float(a), float(b)] for a, b in rng.integers(-25, 25, (k, 2)) + rng.integers(-8, 8, 2)]) for z, k in enumerate((3, 4, 5, 8, 13, 40, 2))]
    polys += [(20, [[-1e6, -1e6], [1e6, -1e6], [1e6, 1e6], [-1e6, 1e6]]), (21, [[900.0, 0.0], [901.0, 0.0], [900.0, 1.0]])]
    inside = lambda x, y, p: sum((b[1] > y) != (a[1] > y) and x < (a[0] - b[0]) * (y - b[1]) / (a[1] - b[1]) + b[0] for a, b in zip([p[-1], *p], p)) % 2
    pairs = [(i, z) for i, x, y in pts if x is not None and x == x for z, p in polys if len(p) > 2 and inside(x, y, p)]
    return spark.createDataFrame(pts, "id long, lon double, lat double"), spark.createDataFrame(polys, "zone long, polygon array<array<double>>"), pairs


def test_zone_counts_without_pairs(spark, monkeypatch):
    """what zones contain is summed up in each tile; there was a row for each pair."""
    pts, polys, pairs = _scene(spark, monkeypatch)
    want = {z: (sum(b == z for _, b in pairs), min(a for a, b in pairs if b == z), sum(a for a, b in pairs if b == z)) for z in {b for _, b in pairs}}
    got = zones.zone_counts(pts, polys, "id").collect()
    assert {r["zone"]: (r["n"], r["first"], r["total"]) for r in got} == want and len(got) == len(want) >= 6
    assert zones.zone_counts(pts.limit(0), polys, "id").isEmpty() and zones.zone_counts(pts, polys.limit(0), "id").isEmpty()


def test_first_zones_without_pairs(spark, monkeypatch):
    """a point is done with its first zone; all its zones were listed. Zones and keys may be texts."""
    pts, polys, pairs = _scene(spark, monkeypatch)
    want = {a: min(z for i, z in pairs if i == a) for a, _ in pairs}
    assert dict(map(tuple, zones.first_zones(pts, polys, "id").collect())) == want
    text = zones.first_zones(pts.withColumn("id", F.col("id").cast("string")), polys.withColumn("zone", F.format_string("z%03d", "zone")), "id")
    assert dict(map(tuple, text.collect())) == {str(a): f"z{z:03d}" for a, z in want.items()}


def test_crossings_need_no_search_for_repeats(spark):
    """a pair counts in the first cell that both segments share; all pairs were shuffled whole to find repeats."""
    rng = np.random.default_rng(5)
    segs = [(i, 0, *map(float, rng.integers(-40, 40, 4) / 8), 0.0, 0.0) for i in range(120)]  # ends on sides of cells, too
    segs += [(500, 0, -5.0, 1.0, 5.0, 1.1, 0.0, 0.0), (501, 0, -5.0, 1.1, 5.0, 1.0, 0.0, 0.0), (502, 0, 1.0, -5.0, 1.0, 5.0, 0.0, 0.0)]
    df = spark.createDataFrame(segs, "path long, seq long, ax double, ay double, bx double, by double, alt1 double, alt2 double")
    met = joins.crossings(df, "path", "seq", "alt1", "alt2", 0.25)
    pairs = [(r["path_1"], r["path_2"]) for r in met.collect()]
    one = joins.crossings(df, "path", "seq", "alt1", "alt2", 64.0).distinct().collect()  # all but in one cell
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(r["path_1"], r["path_2"]) for r in one} and len(pairs) > 500
    assert "Aggregate" not in met._jdf.queryExecution().optimizedPlan().toString()
