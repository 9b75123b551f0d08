"""Patches, profiles, converters and streams."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from geoloom.operators import profile
from geoloom.sources import codecs as C
from geoloom.sources import readers as R
from geoloom.streaming import tracks

PATH = "path long, seq long, lon double, lat double, alt_m double"


def test_stitch(spark):
    p = spark.createDataFrame([(1, i, float(i), 0.0, 9.0) for i in range(6)] + [(2, 0, 5.0, 5.0, 1.0)], PATH)
    cut = profile.patch_range(p.where("path = 1"), F.lit(1.5), F.lit(-1.0), F.lit(3.5), F.lit(1.0))
    assert cut.collect() == [(1, 1, 4)]
    patch = spark.createDataFrame([(1, 0, 1.5, 1.0, 9.0), (1, 1, 3.5, 1.0, 9.0)], PATH)
    out = profile.stitch(p, patch, cut).orderBy("path", "seq").collect()
    assert [(r["seq"], r["lon"]) for r in out if r["path"] == 1] == [(0, 0), (1, 1), (2, 1.5), (3, 3.5), (4, 4), (5, 5)]
    assert [r["lon"] for r in out if r["path"] == 2] == [5.0]


def test_clearance(spark):
    p = spark.createDataFrame([(1, 0, 0.5, 0.5, 100.0), (1, 1, 3.5, 0.5, 100.0)], PATH)
    grid = spark.createDataFrame([(0, c, h) for c, h in enumerate([0.0, 0.0, 90.0, 0.0])], "r long, c long, h double")
    out = profile.clear_terrain(p, grid, 0.0, 0.0, 1.0, 50.0, 60_000.0).orderBy("seq").collect()
    assert [r["added"] for r in out] == [False, True, True, False] and {r["alt_m"] for r in out[1:3]} == {140.0}  # both ends of the hill
    assert profile.clear_terrain(p, grid.where("h < 0"), 0.0, 0.0, 1.0, 50.0).count() == 2 and profile.clear_terrain(p.limit(0), grid, 0.0, 0.0, 1.0, 50.0).isEmpty()
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (1, -1.0, 0.5, 0.0, 2.0)], "k int, min_lon double, min_lat double, max_lon double, max_lat double")
    assert profile.bounding_union(boxes, "k").collect() == [(1, -1.0, 0.0, 1.0, 2.0)]
    v = spark.range(1).select(profile.vertex_mean(F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(2.0), F.lit(4.0)))).alias("m")).first()["m"]
    assert (v["x"], v["y"]) == (1.0, 2.0)


def test_clearance_holds_everywhere(spark):
    """After the loop no sample of a long segment is too low; peaks far apart are found in the same rounds."""
    r = np.random.default_rng(6)
    heights = r.uniform(0, 1500, (40, 40))
    heights[20, 25] = np.nan
    grid = spark.createDataFrame([(int(a), int(b), None if np.isnan(v) else float(v)) for (a, b), v in np.ndenumerate(heights)], "r long, c long, h double")
    ends = [(1, 0, 0.05, 0.5, 900.0), (1, 1, 3.9, 3.3, 700.0), (1, 2, 0.2, 3.9, 2500.0), (2, 0, 1.0, 1.0, 5000.0), (2, 1, 2.0, 2.0, 5000.0)]
    out = profile.clear_terrain(spark.createDataFrame(ends, PATH), grid, 0.0, 0.0, 0.1, 120.0, 500.0).orderBy("path", "seq").collect()
    assert sum(x["added"] for x in out) > 5 and not any(x["added"] for x in out if x["path"] == 2)
    assert [(x["path"], x["lon"], x["lat"], x["alt_m"]) for x in out if not x["added"]] == [(p, x, y, h) for p, _, x, y, h in ends]
    track, at = [x for x in out if x["path"] == 1], 0
    for (_, _, ax, ay, ah), (_, _, bx, by, bh) in zip(ends[:3], ends[1:3]):
        stretch = [track[at]]
        while len(stretch) == 1 or track[at]["added"]:
            at += 1
            stretch.append(track[at])
        part = lambda x: (x["lon"] - ax) / (bx - ax)
        a, b = np.radians([ax, ay]), np.radians([bx, by])
        length = 2 * 6_371_000 * np.arcsin(np.sqrt(np.sin((b[1] - a[1]) / 2) ** 2 + np.cos(a[1]) * np.cos(b[1]) * np.sin((b[0] - a[0]) / 2) ** 2))
        n = int(np.ceil(length / 500))
        assert n > 500
        for t in np.arange(1, n) / n:
            floor = heights[int(np.floor((ay + (by - ay) * t) / 0.1)), int(np.floor((ax + (bx - ax) * t) / 0.1))]
            if not np.isnan(floor):
                assert np.interp(t, [part(x) for x in stretch], [x["alt_m"] for x in stretch]) >= floor + 120 - 1e-3


def test_converters(spark, tmp_path):
    h = np.random.default_rng(3).integers(-50, 3000, (300, 600)).astype(np.int16)
    (tmp_path / "in.arpack").write_bytes(C.write_pack(C.Grid(h, 7.0, 45.0, 0.01, 0.02), "raw"))
    cells = R.read_rasters(spark, str(tmp_path / "in.arpack"))
    R.write_packed(cells.where("r < 256 OR c >= 256"), str(tmp_path / "out.arpack"), 300, 600, 7.0, 45.0, 0.01, 0.02)
    back = C.read_pack((tmp_path / "out.arpack").read_bytes())
    want = h.copy()
    want[256:, :256] = C.VOID
    assert (back.h == want).all() and (back.lon, back.cell_lat) == (7.0, 0.02)
    f = np.arange(12, dtype="<f4").reshape(3, 4)
    f[1, 1] = np.nan
    (tmp_path / "g.bin").write_bytes(f.tobytes())
    (tmp_path / "g.txt").write_text("3 4 10 20\n0.5 0.5")
    out = R.read_float_grid(spark, str(tmp_path / "g.bin"), str(tmp_path / "g.txt"))
    assert out.where("h IS NULL").count() == 1 and out.agg({"lon": "max"}).first()[0] == 11.75
    tiles = tmp_path / "tiles"
    tiles.mkdir()
    for n in ("N39E116.hgt", "s05w003.hgt"):
        (tiles / n).write_bytes(b"x")
    assert sorted(R.tile_index(spark, str(tiles)).select("tile_lon", "tile_lat").collect()) == [(-3, -5), (116, 39)]


def test_stream(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(i % 3, t + datetime.timedelta(seconds=20 * i), 10 + i / 100, 50.0, 100.0 * i) for i in range(30)]
    spark.createDataFrame(rows, "vehicle long, ts timestamp, lon double, lat double, alt_m double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("vehicle long, ts timestamp, lon double, lat double, alt_m double").parquet(str(tmp_path / "in"))
    q = tracks.window_bounds(stream).writeStream.format("memory").queryName("bounds").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select sum(n) n, max(max_lon) x from bounds").first()
    assert got["n"] == 30 and got["x"] == 10.29
    batch = spark.read.parquet(str(tmp_path / "in"))
    assert sum(r["n"] for r in tracks.crowded_cells(batch, 1.0, 1).collect()) == 30
