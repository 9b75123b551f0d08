"""Round trips and degenerate files."""

import numpy as np
import pytest

from geoloom.sources import codecs as C
from geoloom.sources import readers as R


@pytest.fixture
def grid():
    h = np.random.default_rng(0).integers(-500, 9000, (300, 520)).astype(np.int16)
    h[3, 4] = C.VOID
    return C.Grid(h, 100.0, 30.0, 0.01, 0.01)


@pytest.mark.parametrize("codec", C.CODECS)
def test_pack_round_trip(grid, codec):
    back = C.read_pack(C.write_pack(grid, codec))
    assert (back.h == grid.h).all() and (back.lon, back.lat, back.cell_lon) == (100, 30, 0.01)
    assert (C.read_pack(C.recompress(C.write_pack(grid, codec), "raw")).h == grid.h).all()


@pytest.mark.parametrize("cut", [0, 10, 300, 400, 5000])
def test_cut_short(grid, cut):
    with pytest.raises(C.FormatError):
        C.read_pack(C.write_pack(grid)[:cut])
    with pytest.raises(C.FormatError):
        C.read_mask(C.write_mask(np.array([[0, 1, 2, 5]]), 900, 10, 0, 0, 1)[: min(cut, 5000)])
    with pytest.raises(C.FormatError):
        C.read_dted(C.write_dted(C.Grid(grid.h[:121, :121], 0, 0, 1 / 120, 1 / 120))[:cut])
    with pytest.raises(C.FormatError):
        C.read_hgt(b"\0" * cut, "N01E001.hgt")


def test_names():
    assert C.hgt_corner("N39E116.hgt") == (116, 39) and C.hgt_corner("s05w003.HGT") == (-3, -5)
    with pytest.raises(C.FormatError):
        C.hgt_corner("tile.hgt")


def test_mask_and_tiff():
    s = np.array([[0, 1, 2, 5], [0, 2, 7, 9], [3, 1, 0, 4]])
    assert (C.read_mask(C.write_mask(s, 5, 10, 1.0, 2.0, 0.5))[1] == s).all()
    f = np.random.default_rng(1).random((40, 50)).astype(np.float32)
    f[2, 3] = -9999
    g = C.read_geotiff(C.write_geotiff(f, 10.0, 20.0, 0.1, "deflate", -9999.0))
    assert np.isnan(g.h[2, 3]) and np.allclose(g.h[5], f[5]) and (g.lon, round(g.lat, 9)) == (10, 20)


def test_readers(spark, grid, tmp_path):
    (tmp_path / "a.arpack").write_bytes(C.write_pack(grid))
    (tmp_path / "m.mask").write_bytes(C.write_mask(np.array([[0, 1, 2, 5]]), 5, 10, 0, 0, 1))
    cells = R.read_rasters(spark, str(tmp_path / "a.arpack"))
    assert cells.count() == grid.h.size and cells.where("h IS NULL").count() == 1
    assert R.checksums(spark, str(tmp_path / "a.arpack")).where("stored = found").count() == 1
    assert R.read_mask(spark, str(tmp_path / "m.mask")).collect() == [(0, 1, 2, 5)]
    assert [r["kind"] for r in R.list_files(spark, str(tmp_path)).collect()] == ["packed", None]
    R.register(spark)
    load = lambda: spark.read.format("packed_raster").load(str(tmp_path / "a.arpack"))
    assert load().where("block_col = 2 AND block_row >= 1").count() == (300 - 256) * (520 - 512)
    packed = load()
    assert packed.count() == grid.h.size
    again = R.decode_blocks(R.encode_blocks(packed.select("r", "c", "h"))).where("r < 300 AND c < 520")
    assert again.exceptAll(packed.select("r", "c", "h")).isEmpty()


def test_dted_and_hgt(spark, tmp_path):
    h = np.random.default_rng(2).integers(-300, 3000, (121, 121)).astype(np.int16)
    (tmp_path / "x.dt0").write_bytes(C.write_dted(C.Grid(h, -5.0, -30.0, 1 / 120, 1 / 120)))
    df = R.read_rasters(spark, str(tmp_path))
    assert df.agg({"h": "max"}).first()[0] == h.max() and df.agg({"lat": "min"}).first()[0] < -29.9


# --- GeoTIFF by chunk --------------------------------------------------------------------------------------------


def tiled_tiff(levels, tile, west=10.0, north=60.0, cell=0.01, order="<", codec=8, void=None):
    """A file of tiled float images, the north row first; ``levels`` are arrays, the finest first."""
    import struct
    import zlib

    body, heads = b"", []
    for h in levels:
        rows, cols = h.shape
        places, sizes = [], []
        for r in range(0, rows, tile):
            for c in range(0, cols, tile):
                t = np.zeros((tile, tile), f"{order}f4")
                t[: h[r : r + tile].shape[0], : h[:, c : c + tile].shape[1]] = h[r : r + tile, c : c + tile]
                raw = zlib.compress(t.tobytes()) if codec == 8 else t.tobytes()
                places.append(8 + len(body))
                sizes.append(len(raw))
                body += raw
        heads.append((rows, cols, places, sizes))
    out, at, first = body, 8 + len(body), None
    for no, (rows, cols, places, sizes) in enumerate(heads):
        tags = [(256, 4, "I", [cols]), (257, 4, "I", [rows]), (258, 3, "H", [32]), (259, 3, "H", [codec]), (277, 3, "H", [1]), (322, 4, "I", [tile]), (323, 4, "I", [tile]), (324, 4, "I", places), (325, 4, "I", sizes), (339, 3, "H", [3])]
        if not no:
            tags += [(33550, 12, "d", [cell, cell, 0.0]), (33922, 12, "d", [0.0, 0.0, 0.0, west, north, 0.0])]
            tags += [(42113, 2, "s", str(void).encode() + b"\0")] if void is not None else []
        heap_at, heap, entries = at + 6 + 12 * len(tags), b"", b""
        for tag, kind, code, values in tags:
            data = values if code == "s" else struct.pack(f"{order}{len(values)}{code}", *values)
            held = data.ljust(4, b"\0")
            if len(data) > 4:
                held = struct.pack(f"{order}I", heap_at + len(heap))
                heap += data
            entries += struct.pack(f"{order}HHI", tag, kind, len(values)) + held
        first = first or at
        end = heap_at + len(heap)
        out += struct.pack(f"{order}H", len(tags)) + entries + struct.pack(f"{order}I", end if no + 1 < len(heads) else 0) + heap
        at = end
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(f"{order}I", first) + out


@pytest.fixture(scope="module")
def tiff(tmp_path_factory):
    r = np.random.default_rng(5)
    fine = r.normal(500, 100, (300, 420)).astype(np.float32)
    fine[7, 9] = -9999
    levels = [fine, fine[::2, ::2].copy(), fine[::4, ::4].copy()]
    path = tmp_path_factory.mktemp("tiff") / "made.tif"
    path.write_bytes(tiled_tiff(levels, 64, void=-9999))
    return str(path), levels


def test_geotiff_levels(spark, tiff):
    path, levels = tiff
    data = open(path, "rb").read()
    for no, h in enumerate(levels):
        g = C.read_geotiff(data, no)
        assert g.h.shape == h.shape and g.extra["levels"] == 3 and g.cell_lon == pytest.approx(4.2 / h.shape[1])
        assert np.nanmax(np.abs(g.h - h[::-1])) == 0 and np.isnan(g.h).sum() == (h == -9999).sum()
        got = R.read_geotiff(spark, path).where(f"level = {no}").toPandas()
        assert len(got) == h.size and set(got["level"]) == {no}
        back = np.full(h.shape, np.nan)
        back[got["r"], got["c"]] = got["h"]
        assert np.array_equal(back, g.h, equal_nan=True)
        assert np.allclose(got["lon"], g.lon + (got["c"] + 0.5) * g.cell_lon) and np.allclose(got["lat"], g.lat + (got["r"] + 0.5) * g.cell_lat)
    assert R.read_geotiff(spark, path).where("level = 7").isEmpty()
    big = C.read_geotiff(tiled_tiff(levels, 128, order=">", codec=1), 1)  # the other order of bytes, and raw tiles
    assert (big.h == levels[1][::-1]).all()


@pytest.mark.parametrize("wanted, level", [(None, 0), (0.005, 0), (0.01, 0), (0.025, 1), (0.05, 2), (9.0, 2)])
def test_geotiff_level_by_cell(spark, tiff, wanted, level):
    assert {x[0] for x in R.read_geotiff(spark, tiff[0], wanted).select("level").distinct().collect()} == {level}


def test_geotiff_box_reads_its_tiles(spark, tiff, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThanOrEqual

    path, levels = tiff
    monkeypatch.setattr(R, "CELLS_PER_TASK", 64 * 64 * 3)
    reader = R.GeoTiffReader(path)
    assert sum(len(p.chunks) for p in reader.partitions()) == 35 and len(reader.partitions()) == 12
    box = [GreaterThanOrEqual(("lon",), 10.7), LessThanOrEqual(("lon",), 10.9), GreaterThanOrEqual(("lat",), 58.0), EqualTo(("level",), 0)]
    assert list(reader.pushFilters(box)) == box[:3]  # the level is settled, cells still have to be judged
    assert sum(len(p.chunks) for p in reader.partitions()) == 4  # one column of tiles, four of its five rows
    g = C.read_geotiff(open(path, "rb").read())
    lon, lat = g.lon + (np.arange(420) + 0.5) * 0.01, g.lat + (np.arange(300) + 0.5) * 0.01
    got = R.read_geotiff(spark, path).where("lon between 10.7 and 10.9 and lat >= 58").selectExpr("count(*)", "sum(h)").first()
    want = g.h[np.ix_(lat >= 58, (lon >= 10.7) & (lon <= 10.9))]
    assert got[0] == want.size and got[1] == pytest.approx(np.nansum(want))
    assert R.read_geotiff(spark, path).where("lon > 50").isEmpty()
    with pytest.raises(C.FormatError):
        C.tiff_tags(lambda at, n: b"II*\0\x08\0\0\0"[at : at + n])
