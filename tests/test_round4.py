"""What the findings of round 3 were about: counts without pairs, and tasks that follow the input."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions import fixed, geometry
from geoloom.operators import joins, kernels, profile
from geoloom.plans import derive, registry
from geoloom.sources import codecs


@pytest.fixture
def globe(spark):
    """Points and sites over the globe, at the poles and on both sides of 180 degrees, some of them in one place."""
    rng = np.random.default_rng(11)
    at = lambda n: list(zip(rng.integers(-1800, 1800, n) / 10, rng.integers(-900, 901, n) / 10))
    pts = at(1500) + [(179.9, 0.0), (-179.9, 0.0), (0.0, 90.0), (120.0, -90.0), (None, 1.0)]
    pts += pts[:300]
    points = spark.createDataFrame([(i, None if x is None else float(x), float(y)) for i, (x, y) in enumerate(pts)], "cust long, lon double, lat double")
    sites = at(60) + [(179.95, 0.1), (-180.0, 0.0), (10.0, 90.0), (0.0, -89.0), (50.0, 50.0), (50.0, 50.0)]
    return points, spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(sites)], "supp long, lon2 double, lat2 double")


def _rows(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("radius_m, least", [(250_000.0, 5), (2_500_000.0, 60)])
def test_counts_by_site_are_those_of_the_pairs(globe, radius_m, least):
    """all pairs were made, in one task, only to be counted."""
    points, sites = globe
    pairs = joins.radius_join(points, sites, radius_m).groupBy("supp").agg(F.count("*"), F.min("cust"), F.min("distance_m"))
    got = joins.radius_counts(points, sites, radius_m, "cust", "supp")
    assert _rows(got) == _rows(pairs) and len(_rows(got)) >= least


def test_counts_by_point_are_those_of_the_pairs(globe):
    """as F11, by point, with circles of many sizes."""
    points, sites = globe
    circles = sites.select("supp", F.col("lon2").alias("clon"), F.col("lat2").alias("clat"), (F.lit(50.0) + F.col("supp") * 97 % 3000).alias("radius_km"))
    pairs = joins.circles_containing(points, circles, 5.0).groupBy("cust").agg(F.count("*"), F.min("supp"))
    got = joins.circle_counts(points, circles, "supp").select("cust", "n", "first")
    assert _rows(got) == _rows(pairs) and len(_rows(got)) > 500


def test_tile_files_are_dealt_over_tasks(spark, tmp_path, monkeypatch):
    """one task wrote all files, as their rows are few."""
    spark.range(40).selectExpr("id AS s_suppkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    made = []
    real = registry.tasks_for
    monkeypatch.setattr(registry, "tasks_for", lambda *a: made.append(real(*a)) or made[-1])
    monkeypatch.setattr(registry, "FILES_PER_TASK", 5)
    rows = registry.queries()["packed_tiles"](spark, str(tmp_path)).collect()
    assert made == [8] and sorted(r["supp"] for r in rows) == list(range(40)) and {r["n"] for r in rows} == {70 * 90}


def test_dted_records_are_made_at_once():
    """a column of heights at a time took most of the time; bytes are what they were."""
    h = (np.arange(7 * 5).reshape(7, 5) * 371 % 900 - 400).astype(np.int16)
    h[2, 3] = codecs.VOID
    data = codecs.write_dted(codecs.Grid(h, 7.0, 10.0, 1 / 120, 1 / 120))
    at = codecs.DTED_UHL + codecs.DTED_DSI + codecs.DTED_ACC
    for c in range(5):
        raw = [0xFFFF if v == codecs.VOID else 0x8000 | -v if v < 0 else v for v in h[:, c].tolist()]
        record = struct.pack(">B3sHH", 0xAA, c.to_bytes(3, "big"), c, 0) + struct.pack(">7H", *raw)
        assert data[at + c * 26 : at + c * 26 + 26] == record + struct.pack(">I", sum(record))
    assert (codecs.read_dted(data).h == h).all()


def test_a_polygon_given_once_is_measured_like_one_of_each_row(spark):
    """edges of the same polygon were folded row by row."""
    poly = [[0.0, 0.0], [4.0, 0.0], [4.0, 3.0], [2.0, 1.0], [0.0, 3.0]]
    rng = np.random.default_rng(5)
    rows = [tuple(map(float, r)) for r in rng.integers(-4, 14, (400, 4)) / 2] + [(0.0, 0.0, 4.0, 0.0), (1.0, 1.0, 1.0, 1.0), (-1.0, 0.0, 5.0, 0.0), (None, 1.0, 2.0, 2.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, ax double, ay double, bx double, by double")
    s, p = [F.col(c) for c in ("ax", "ay", "bx", "by")], derive.polygon(poly)
    wanted = [geometry.segment_polygon_km(*s, p), geometry.segment_polygon_deg(*s, p), profile.band_length(profile.segment_bands(*s, p), F.lit(1.0))]
    found = [fixed.segment_polygon_km(*s, poly), fixed.segment_polygon_deg(*s, poly), fixed.inside_share(*s, poly)]
    pairs = [v for c in zip(wanted, found) for v in c]
    for r in df.select("i", *[F.round(c, 9).alias(f"c{n}") for n, c in enumerate(pairs)]).orderBy("i").collect():
        assert (r["c0"], r["c2"], r["c4"]) == (r["c1"], r["c3"], r["c5"]), r
    assert df.select(fixed.segment_polygon_km(*s, poly[:2]).alias("d")).where("d IS NOT NULL").isEmpty()


def test_a_circle_given_once_is_met_like_one_of_each_row(spark):
    """every use of a length or a root worked it out anew."""
    rng = np.random.default_rng(6)
    rows = [tuple(map(float, r)) for r in rng.integers(-8, 9, (300, 4)) / 8] + [(0.5, 0.5, 0.5, 0.5), (None, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "ax double, ay double, bx double, by double")
    s = [F.col(c) for c in ("ax", "ay", "bx", "by")]
    want, got = geometry.segment_circle_interval(*s, F.lit(0.1), F.lit(0.2), F.lit(30.0)), fixed.circle_interval(*s, 0.1, 0.2, 30.0)
    both = [F.round(c[t], 12) for t in ("t0", "t1") for c in (want, got)]
    rows = df.select(*[c.alias(f"c{n}") for n, c in enumerate(both)]).collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in rows) and 20 < sum(r[0] is None for r in rows) < 290


def test_short_paths_are_simplified_on_floats():
    """paths of a few points went through small arrays; what is kept is what the chords allow."""
    rng = np.random.default_rng(7)
    for n in (0, 1, 2, 3, 4, 5, 9, kernels.SHORT, kernels.SHORT + 1):
        for _ in range(40):
            p = np.column_stack([100 + rng.integers(0, 40, n) / 40, 30 + rng.integers(0, 40, n) / 40, np.zeros(n)])
            want = [0] if n else []
            while want and want[-1] < n - 1:
                i = want[-1]
                want.append(next(j for j in range(n - 1, i, -1) if j == i + 1 or kernels.chord_errors(p, i, j).max() <= 20_000.0))
            assert kernels.simplify(p, 20_000.0) == want
