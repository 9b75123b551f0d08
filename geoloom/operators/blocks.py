"""Rasters as rows of square blocks, images drawn in other coordinates, and fields of any size marched block by block.

A block (br, bc, data) holds ``block`` + 1 rows and columns of each band, one band after the other: its own cells and, as a
rim, the first ones of the blocks below and to the right. So whatever lies between four cells lies in one block. Voids are NaN.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions.scalar import MERCATOR_MAX_LAT, MERCATOR_RADIUS_M, web_mercator
from geoloom.operators import kernels
from geoloom.runtime import materialize, release

BLOCK = 128
#: A rim has fallen where it is less than before by more than this share: rounding alone wakes no block.
FELL = 1e-12
#: Cells along a side of a district, whose blocks are marched in one task until they rest among themselves: 4 MB of costs.
DISTRICT = 1024
_SIDES = {"up": (-1, 0), "down": (1, 0), "left": (0, -1), "right": (0, 1)}
_FACING = {"up": "down", "down": "up", "left": "right", "right": "left"}


def to_blocks(grid: DataFrame, bands: list[str], block: int = BLOCK) -> DataFrame:
    """(br, bc, data) of cells (r, c from 0, and the bands); a block without cells has no row. One shuffle by block."""
    own = grid.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), *[F.col(b).cast("float").alias(f"v{i}") for i, b in enumerate(bands)])
    for v, b in (("r", "br"), ("c", "bc")):
        at = F.floor(F.col(v) / block)
        own = own.withColumn(b, F.explode(F.when((F.col(v) % block == 0) & (at > 0), F.array(at - 1, at)).otherwise(F.array(at))))
    own = own.where(f"r >= br * {block} AND c >= bc * {block}")
    wide = block + 1

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        data = np.full((len(bands), wide, wide), np.nan, np.float32)
        br, bc = int(pdf["br"].iloc[0]), int(pdf["bc"].iloc[0])
        r, c = (pdf["r"] - br * block).to_numpy(), (pdf["c"] - bc * block).to_numpy()
        for i in range(len(bands)):
            data[i, r, c] = pdf[f"v{i}"]
        return pd.DataFrame({"br": [br], "bc": [bc], "data": [data.ravel()], "own": [bool(((r < block) & (c < block)).any())]})

    made = own.groupBy("br", "bc").applyInPandas(fill, "br long, bc long, data array<float>, own boolean")
    return made.where("own").drop("own")


def _place(kind: str, lon, lat, np_: bool):
    """Image coordinates of longitudes and latitudes, as columns or as arrays."""
    if kind == "geographic":
        return lon, lat
    if kind != "web_mercator":
        raise ValueError(f"no image projection {kind!r}: geographic or web_mercator")
    if not np_:
        return web_mercator(lon, lat)
    phi = np.radians(np.clip(lat, -MERCATOR_MAX_LAT, MERCATOR_MAX_LAT))
    return MERCATOR_RADIUS_M * np.radians(lon), MERCATOR_RADIUS_M * np.log(np.tan(np.pi / 4 + phi / 2))


def warp(blocks: DataFrame, shape: tuple[int, int], origin: tuple[float, float], cell: tuple[float, float], target: tuple[float, float, float, float, int, int], projection: str = "geographic", bands: int = 1, block: int = BLOCK) -> DataFrame:
    """(tr, tc, data): an image of ``shape`` rows and columns drawn anew on a grid of longitudes and latitudes.

    The cell (0, 0) of the image lies at ``origin`` in its projection, x to the right by ``cell[0]``, y down by ``cell[1]``.
    ``target`` is (lon, lat, step_lon, step_lat, nx, ny): its point (0, 0), steps to the east and to the south, and size. A
    target block of nx x ny points has ``block`` rows and columns (fewer at the ends) of each band, double; between cells a
    value is bilinear; NaN outside the image and where one of the four cells is void. Both projections keep rows and
    columns apart, so a block's corners tell which blocks of the image it needs. A point is drawn from the one block
    that has its four cells, so blocks meet by key and no task holds more than a block of each at a time.
    """
    spark = blocks.sparkSession
    rows, cols = shape
    lon0, lat0, dlon, dlat, nx, ny = target
    high, wide = -(-ny // block), -(-nx // block)
    todo = spark.range(high * wide).select(F.floor(F.col("id") / wide).alias("tr"), (F.col("id") % wide).alias("tc"))

    def reach(j: Column, i: Column) -> tuple[Column, Column]:
        x, y = _place(projection, F.lit(lon0) + i * dlon, F.lit(lat0) - j * dlat, False)
        return (F.lit(origin[1]) - y) / cell[1], (x - F.lit(origin[0])) / cell[0]

    first = reach(F.col("tr") * block, F.col("tc") * block)
    last = reach(F.least(F.col("tr") * block + block, F.lit(ny)) - 1, F.least(F.col("tc") * block + block, F.lit(nx)) - 1)
    for name, a, b, n in (("br", first[0], last[0], rows), ("bc", first[1], last[1], cols)):
        lo, hi = F.greatest(F.floor((a - 1e-6) / block), F.lit(0)), F.least(F.floor((b + 1e-6) / block), F.lit((n - 1) // block))
        todo = todo.withColumn(name, F.explode_outer(F.when(lo <= hi, F.sequence(lo, hi))))
    side = block + 1

    def draw(batches):
        for pdf in batches:
            out = []
            for tr, tc, br, bc, data in pdf.itertuples(index=False):
                j, i = np.arange(tr * block, min(tr * block + block, ny)), np.arange(tc * block, min(tc * block + block, nx))
                pos, val = np.empty(0, np.int32), np.empty(0)
                if data is not None:
                    br, bc = int(br), int(bc)  # floats where the batch also has a target block without an image
                    x, y = _place(projection, lon0 + i * dlon, lat0 - j * dlat, True)
                    y, x = (origin[1] - y) / cell[1], (x - origin[0]) / cell[0]
                    jj = np.flatnonzero((y >= 0) & (y <= rows - 1) & (np.floor(y / block) == br))
                    ii = np.flatnonzero((x >= 0) & (x <= cols - 1) & (np.floor(x / block) == bc))
                    y, x = y[jj] - br * block, x[ii] - bc * block
                    # The last row and column have no next one: they stand for it, with no weight.
                    r0, c0 = np.floor(y).astype(int), np.floor(x).astype(int)
                    r1, c1 = np.minimum(r0 + 1, rows - 1 - br * block), np.minimum(c0 + 1, cols - 1 - bc * block)
                    fr, fc = (y - r0)[:, None], (x - c0)[None, :]
                    whole = np.asarray(data, np.float32).reshape(bands, side, side).astype(float)
                    got = []
                    for v in whole:
                        low, up = v[np.ix_(r0, c0)], v[np.ix_(r1, c0)]
                        low, up = low + (v[np.ix_(r0, c1)] - low) * fc, up + (v[np.ix_(r1, c1)] - up) * fc
                        got.append(low + (up - low) * fr)
                    val = np.stack(got).ravel()
                    at = jj[:, None] * len(i) + ii[None, :]
                    pos = (np.arange(bands)[:, None, None] * (len(j) * len(i)) + at[None]).ravel().astype(np.int32)
                out.append((tr, tc, pos, val))
            yield pd.DataFrame(out, columns=["tr", "tc", "pos", "val"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(pdf["tr"].iloc[0]), int(pdf["tc"].iloc[0])
        data = np.full(bands * (min(tr * block + block, ny) - tr * block) * (min(tc * block + block, nx) - tc * block), np.nan)
        for pos, val in zip(pdf["pos"], pdf["val"]):
            data[pos] = val
        return pd.DataFrame({"tr": [tr], "tc": [tc], "data": [data]})

    met = todo.join(blocks, ["br", "bc"], "left").select("tr", "tc", "br", "bc", "data")
    parts = met.mapInPandas(draw, "tr long, tc long, pos array<int>, val array<double>")
    return parts.groupBy("tr", "tc").applyInPandas(join, "tr long, tc long, data array<double>")


def target_cells(drawn: DataFrame, nx: int, ny: int, block: int = BLOCK) -> DataFrame:
    """(band, j, i, value) of the points of target blocks, void ones null."""
    wide = F.least(F.lit(block), nx - F.col("tc") * block)
    size = F.least(F.lit(block), ny - F.col("tr") * block) * wide
    at = drawn.select("tr", "tc", wide.alias("_w"), size.alias("_n"), F.posexplode("data").alias("_p", "_v"))
    in_band = F.col("_p") % F.col("_n")
    value = F.when(~F.isnan("_v"), F.col("_v"))
    return at.select(F.floor(F.col("_p") / F.col("_n")).cast("int").alias("band"), (F.col("tr") * block + F.floor(in_band / F.col("_w"))).alias("j"), (F.col("tc") * block + in_band % F.col("_w")).alias("i"), value.alias("value"))


# --- fields ------------------------------------------------------------------------------------------------------


def arrivals_by_block(fields: DataFrame, sources: DataFrame, block: int = 256) -> tuple[DataFrame, list[int]]:
    """Fast marching of fields larger than a task: (field, r, c, t) as ``paths.arrivals`` gives them, and how many blocks
    were awake at the start of each round.

    Cells (field, r, c from 0, cost) stand in square blocks; sources (field, src_r, src_c). A block is solved alone from the times
    on its rim, which are those of its neighbours' edges. What it finds on its own edges becomes their rims, and only
    blocks of which a rim fell are solved again, until none does. Times only fall, towards the one solution that
    all cells' updates agree on. Blocks of one district of ``DISTRICT`` cells a side wake each other within a task, and a round
    ends when they all rest: a front that crosses k districts settles in about k rounds, however small the blocks are. Cells
    that no row names are walls.
    """
    kind = fields.schema["field"].dataType.simpleString()
    key = ["field", "br", "bc"]
    rim_key, ddl = [*key, "side"], f"field {kind}, br long, bc long, side string, times array<double>, outer boolean"
    district = lambda: [F.floor(F.col(b) / side).alias(d) for b, d in (("br", "dr"), ("bc", "dc"))]

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["r"].to_numpy() % block, pdf["c"].to_numpy() % block
        data = np.full((block, block), np.nan, np.float32)  # which no row names
        data[r, c] = pdf["cost"].fillna(np.inf)
        one = pdf.iloc[:1]
        return pd.DataFrame({"field": one["field"], "br": one["br"], "bc": one["bc"], "data": [data.ravel()]})

    cells = fields.select("field", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col("cost").cast("float").alias("cost")).where("r >= 0 AND c >= 0")
    cells = cells.withColumn("br", F.floor(F.col("r") / block)).withColumn("bc", F.floor(F.col("c") / block))
    blocks = cells.groupBy(*key).applyInPandas(fill, f"field {kind}, br long, bc long, data array<float>")
    starts = sources.select("field", F.floor(F.col("src_r") / block).alias("br"), F.floor(F.col("src_c") / block).alias("bc"), (F.col("src_r") % block).cast("int").alias("sr"), (F.col("src_c") % block).cast("int").alias("sc"))
    blocks = materialize(blocks.join(starts, key, "left"))

    def solved(data, sr, sc, rims) -> np.ndarray:
        rim = np.full((block + 2, block + 2), np.inf)
        for at in rims if rims is not None else ():
            place = {"up": rim[0, 1:-1], "down": rim[-1, 1:-1], "left": rim[1:-1, 0], "right": rim[1:-1, -1]}[at["side"]]
            place[:] = at["times"]
        cost = np.nan_to_num(np.asarray(data, float), nan=np.inf, posinf=np.inf).reshape(block, block)
        return kernels.march(cost, None if pd.isna(sr) else (int(sr), int(sc)), rim)

    side = max(DISTRICT // block, 1)

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        """Rims that fell in or about a district, and whether from another district's block."""
        field, held, awake, fell = pdf["field"].iloc[0], {}, {}, {}
        for br, bc, data, sr, sc, rims, up in pdf[["br", "bc", "data", "sr", "sc", "rims", "awake"]].itertuples(index=False):
            held[br, bc] = data, sr, sc, {at["side"]: np.asarray(at["times"], float) for at in rims} if rims is not None else {}
            if up:
                awake[br, bc] = 0.0
        while awake:
            at = min(awake, key=lambda k: (awake[k], k))  # what fell to the least time first: it changes no more
            del awake[at]
            data, sr, sc, rims = held[at]
            t = solved(data, sr, sc, [{"side": k, "times": v} for k, v in rims.items()])
            for name, own in {"up": t[0], "down": t[-1], "left": t[:, 0], "right": t[:, -1]}.items():
                if not np.isfinite(own).any():
                    continue
                there, facing = (at[0] + _SIDES[name][0], at[1] + _SIDES[name][1]), _FACING[name]
                if there in held:
                    old = held[there][3].get(facing)
                    lower = np.isfinite(own) if old is None else own < old * (1 - FELL)
                    if not lower.any():
                        continue
                    held[there][3][facing] = own
                    awake[there] = min(awake.get(there, np.inf), float(own[lower].min()))
                fell[(*there, facing)] = there not in held, own
        return pd.DataFrame([(field, *k, own, outer) for k, (outer, own) in fell.items()], columns=[*rim_key, "times", "outer"])

    def with_rims(some: DataFrame, rims: DataFrame | None) -> DataFrame:
        if rims is None:
            return some.withColumn("rims", F.lit(None).cast("array<struct<side:string,times:array<double>>>"))
        return some.join(rims.groupBy(*key).agg(F.collect_list(F.struct("side", "times")).alias("rims")), key, "left")

    rims, fell, solves = None, None, []
    awake = blocks.where("sr IS NOT NULL")
    while n := awake.count():
        solves.append(n)
        near = blocks.withColumns(dict(zip(("dr", "dc"), district()))).join(awake.select("field", *district()).distinct(), ["field", "dr", "dc"], "left_semi")
        near = near.join(awake.select(*key, F.lit(True).alias("awake")), key, "left").withColumn("awake", F.coalesce("awake", F.lit(False)))
        found = with_rims(near, rims).groupBy("field", "dr", "dc").applyInPandas(settle, ddl)
        found = found.join(blocks.select(*key), key, "left_semi")
        if rims is not None:
            lower = F.exists(F.zip_with("times", "old", lambda a, b: a < b * (1 - FELL)), lambda x: x)
            found = found.join(rims.select(*rim_key, F.col("times").alias("old")), rim_key, "left").where(F.col("old").isNull() | lower).select(*rim_key, "times", "outer")
        before, fell = fell, materialize(found)
        kept = fell if rims is None else materialize(rims.join(fell.select(*rim_key), rim_key, "left_anti").unionByName(fell))
        release(*[old for old in (before, rims) if old is not None])
        rims, awake = kept, blocks.join(fell.where("outer").select(*key).distinct(), key, "left_semi")

    def times(batches):
        for pdf in batches:
            out = []
            for field, br, bc, data, sr, sc, rims_ in pdf.itertuples(index=False):
                named = np.flatnonzero(~np.isnan(np.asarray(data, float)))
                out.append((field, br, bc, named.astype(np.int32), solved(data, sr, sc, rims_).ravel()[named].astype(np.float32)))
            yield pd.DataFrame(out, columns=[*key, "at", "t"])

    done = with_rims(blocks, rims).select(*key, "data", "sr", "sc", "rims").mapInPandas(times, f"field {kind}, br long, bc long, at array<int>, t array<float>")
    done = done.select(*key, F.inline(F.arrays_zip("at", "t")))
    return done.select("field", (F.col("br") * block + F.floor(F.col("at") / block)).cast("int").alias("r"), (F.col("bc") * block + F.col("at") % block).cast("int").alias("c"), "t"), solves
