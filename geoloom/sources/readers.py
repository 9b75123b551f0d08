"""Readers and writers: raster files as long rows.

Files come through Spark's own binary reader, so any store that Spark reads will do, and one file is one task's work.
Packed rasters, which can cover the globe in one file, have a data source of their own: the driver reads the header,
filters on block rows and columns prune blocks, and each task decodes a range of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from geoloom.sources import codecs

CELL = pa.schema([("file", pa.string()), ("r", pa.int32()), ("c", pa.int32()), ("lon", pa.float64()), ("lat", pa.float64()), ("h", pa.float64())])
CELL_DDL = "file string, r int, c int, lon double, lat double, h double"
#: Which reader has a file, by extension; where a folder has several kinds, the first of these wins.
KINDS = {"dted": r"(?i)\.dt[0-2]$", "srtm": r"(?i)\.hgt$", "geotiff": r"(?i)\.tiff?$", "packed": r"(?i)\.(arpack|zstd)$"}
BLOCKS_PER_TASK = 64


def kind_of(path: str) -> str | None:
    import re

    return next((k for k, p in KINDS.items() if re.search(p, path)), None)


def _decode(kind: str) -> Callable[[bytes, str], codecs.Grid]:
    return {"srtm": codecs.read_hgt, "dted": lambda d, _: codecs.read_dted(d), "geotiff": lambda d, _: codecs.read_geotiff(d), "packed": lambda d, _: codecs.read_pack(d)}[kind]


def _cells(g: codecs.Grid, name: str, rows: int = 128) -> Iterator[pa.RecordBatch]:
    void = g.extra.get("void", codecs.VOID)
    for r0 in range(0, g.h.shape[0], rows):
        part = g.h[r0 : r0 + rows]
        n, m = part.shape
        r, c = np.repeat(np.arange(r0, r0 + n), m), np.tile(np.arange(m), n)
        h = part.ravel().astype(float)
        yield pa.record_batch([pa.repeat(pa.scalar(name, pa.string()), n * m), pa.array(r, pa.int32()), pa.array(c, pa.int32()), pa.array(g.lon + (c + 0.5) * g.cell_lon), pa.array(g.lat + (r + 0.5) * g.cell_lat), pa.array(h, mask=np.isnan(h) | (h == void))], schema=CELL)


def read_rasters(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Cells (file, r, c, lon, lat, h; voids null, row 0 south) of a file or of a folder's files of one kind."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if kind is None:
        kind = kind_of(path)
    if kind is None:
        names = files.select("path")
        kind = next((k for k, p in KINDS.items() if not names.where(F.col("path").rlike(p)).isEmpty()), None)
        codecs.need(kind is not None, f"no raster in {path}")
        codecs.need(kind != "geotiff", "a folder of GeoTIFF files has no tile names; name one file")
    decode = _decode(kind)

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield from _cells(decode(data, name.rsplit("/", 1)[1]), name)

    return files.where(F.col("path").rlike(KINDS[kind])).select("path", "content").mapInArrow(run, CELL_DDL)


def read_mask(spark: SparkSession, path: str) -> DataFrame:
    """Segments (row, class, c0, c1) of a mask."""

    def run(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                s = codecs.read_mask(data)[1]
                yield pa.record_batch({"row": s[:, 0], "class": s[:, 1].astype(np.int32), "c0": s[:, 2], "c1": s[:, 3]})

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "row long, class int, c0 long, c1 long")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, stored and found SHA-256 of packed rasters, computed by Spark itself."""
    files = spark.read.format("binaryFile").load(path)
    at = codecs.PACK_HEADER
    return files.select("path", F.lower(F.hex(F.substring("content", at + 1, 32))).alias("stored"), F.sha2(F.expr(f"substring(content, {at + 33})"), 256).alias("found"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, length of a folder's files, by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    kind = F.lit(None).cast("string")
    for k, p in reversed(KINDS.items()):
        kind = F.when(F.col("path").rlike(p), k).otherwise(kind)
    return files.select("path", kind.alias("kind"), "length").orderBy("path")


#: Cells that one task of a GeoTIFF decodes, about.
CELLS_PER_TASK = 1 << 22


class GeoTiff(DataSource):
    """``spark.read.format("geotiff").load(path)``: level, chunk, r, c, lon, lat, h (voids null, row 0 south) of one file.

    The driver reads the file's directories only. Each task reads a few chunks (tiles or strips) by their ranges. Filters
    on lon and lat drop chunks, filters on level whole images; of several images, without such a filter, the option
    ``cell_deg`` takes the coarsest whose cell is at most so wide, or else the finest, and level 0 is read without it.
    """

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return "level int, chunk int, r int, c int, lon double, lat double, h double"

    def reader(self, schema) -> DataSourceReader:
        wanted = self.options.get("cell_deg")
        return GeoTiffReader(self.options["path"], float(wanted) if wanted else None)


class Chunks(InputPartition):
    def __init__(self, level: int, layout: codecs.TiffLevel, chunks: list[tuple[int, int, int]]):
        self.level, self.layout, self.chunks = level, layout, chunks


class GeoTiffReader(DataSourceReader):
    def __init__(self, path: str, cell_deg: float | None = None):
        self.path = path if "://" in path or path.startswith("file:") else f"file://{path}"
        self.cell_deg, self.level = cell_deg, None
        self.bounds = {"lon": [-np.inf, np.inf], "lat": [-np.inf, np.inf]}

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name == "level" and isinstance(f, EqualTo) and self.level in (None, f.value):
                self.level = f.value
                continue
            if name in self.bounds:
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.bounds[name][0] = max(self.bounds[name][0], f.value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.bounds[name][1] = min(self.bounds[name][1], f.value)
            yield f  # cells of a chunk that is read still have to be judged

    def _pick(self, tags: list[dict]) -> list[int]:
        if self.level is not None:
            return [self.level] if 0 <= self.level < len(tags) else []
        if self.cell_deg is None:
            return [0]
        cells = [codecs.tiff_level(tags, i)[0].cell_lon for i in range(len(tags))]
        fits = [c for c in cells if c <= self.cell_deg + 1e-12]
        return [cells.index(max(fits) if fits else min(cells))]

    def partitions(self) -> list[InputPartition]:
        fs, where = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_file(where) as f:

            def read(at: int, n: int) -> bytes:
                f.seek(at)
                return f.read(n)

            tags = codecs.tiff_tags(read)
        out: list[InputPartition] = []
        (w, e), (s, n) = self.bounds["lon"], self.bounds["lat"]
        for level in self._pick(tags):
            t, places, sizes = codecs.tiff_level(tags, level)
            boxes = ((k, t.box(k)) for k in range(t.chunks))
            wanted = [(k, places[k], sizes[k]) for k, b in boxes if b[1] >= w and b[0] <= e and b[3] >= s and b[2] <= n]
            each = max(1, CELLS_PER_TASK // (t.wide * t.high))
            out += [Chunks(level, t, wanted[i : i + each]) for i in range(0, len(wanted), each)]
        return out or [Chunks(0, None, [])]

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        fs, where = pafs.FileSystem.from_uri(self.path)
        t = partition.layout
        with fs.open_input_file(where) as f:
            for k, at, size in partition.chunks:
                f.seek(at)
                h = t.decode(k, f.read(size))
                r0, c0, n, m = t.place(k)
                rows = np.arange(r0, r0 + n) if t.south_up else t.rows - 1 - np.arange(r0, r0 + n)
                for i in range(0, n, max(1, (1 << 18) // m)):  # a strip may be the whole image
                    part = h[i : i + max(1, (1 << 18) // m)]
                    r, c, v = np.repeat(rows[i : i + len(part)], m), np.tile(np.arange(c0, c0 + m), len(part)), part.ravel()
                    cols = [pa.array(np.full(len(r), x), pa.int32()) for x in (partition.level, k)] + [pa.array(r, pa.int32()), pa.array(c, pa.int32())]
                    cols += [pa.array(t.west + (c + 0.5) * t.cell_lon), pa.array(t.south + (r + 0.5) * t.cell_lat), pa.array(v, mask=np.isnan(v))]
                    yield pa.record_batch(cols, names=["level", "chunk", "r", "c", "lon", "lat", "h"])


def read_geotiff(spark: SparkSession, path: str, cell_deg: float | None = None) -> DataFrame:
    """Cells (level, chunk, r, c, lon, lat, h) of a GeoTIFF of any size, read by chunks; see `GeoTiff` for what filters do."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoTiff)
    reader = spark.read.format("geotiff")
    return (reader if cell_deg is None else reader.option("cell_deg", str(cell_deg))).load(path)


class PackedRaster(DataSource):
    """``spark.read.format("packed_raster").load(path)``: block_row, block_col, r, c, h (voids null)."""

    @classmethod
    def name(cls) -> str:
        return "packed_raster"

    def schema(self) -> str:
        return "block_row int, block_col int, r int, c int, h smallint"

    def reader(self, schema) -> DataSourceReader:
        return PackedReader(self.options["path"])


class Blocks(InputPartition):
    def __init__(self, numbers: list[int]):
        self.numbers = numbers


class PackedReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path if "://" in path or path.startswith("file:") else f"file://{path}"
        self.bounds = {"block_row": [0, 1 << 30], "block_col": [0, 1 << 30]}

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            held = self.bounds.get(f.attribute[0]) if isinstance(f, (EqualTo, GreaterThanOrEqual, LessThanOrEqual)) and len(f.attribute) == 1 else None
            if held is None:
                yield f
                continue
            if not isinstance(f, LessThanOrEqual):
                held[0] = max(held[0], f.value)
            if not isinstance(f, GreaterThanOrEqual):
                held[1] = min(held[1], f.value)

    def _head(self, f) -> codecs.PackHeader:
        f.seek(0)
        return codecs.PackHeader.parse(f.read(codecs.PACK_HEADER + 32))

    def partitions(self) -> list[InputPartition]:
        fs, where = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_file(where) as f:
            head = self._head(f)
        (r0, r1), (c0, c1) = self.bounds["block_row"], self.bounds["block_col"]
        wanted = [r * head.blocks_c + c for r in range(max(r0, 0), min(r1, head.blocks_r - 1) + 1) for c in range(max(c0, 0), min(c1, head.blocks_c - 1) + 1)]
        return [Blocks(wanted[i : i + BLOCKS_PER_TASK]) for i in range(0, len(wanted), BLOCKS_PER_TASK)] or [Blocks([])]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        fs, where = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_file(where) as f:
            head = self._head(f)
            for k in partition.numbers:
                f.seek(codecs.PACK_HEADER + 32 + 12 * k)
                at, n = np.frombuffer(f.read(12), np.dtype([("at", "<u8"), ("n", "<u4")]))[0].tolist()
                f.seek(at)
                br, bc = divmod(k, head.blocks_c)
                block = codecs.unpack_block(f.read(n), head.codec)[: head.rows - br * codecs.BLOCK, : head.cols - bc * codecs.BLOCK]
                rows, cols = block.shape
                r, c, h = np.repeat(np.arange(rows), cols) + br * codecs.BLOCK, np.tile(np.arange(cols), rows) + bc * codecs.BLOCK, block.ravel()
                yield pa.record_batch([pa.array(np.full(len(r), v), pa.int32()) for v in (br, bc)] + [pa.array(r, pa.int32()), pa.array(c, pa.int32()), pa.array(h, pa.int16(), mask=h == head.void)], names=["block_row", "block_col", "r", "c", "h"])


def encode_blocks(cells: DataFrame, codec: str = "deflate", void: int = codecs.VOID) -> DataFrame:
    """(block_row, block_col, data): every 256 x 256 block of cells (r, c, h) encoded, missing cells void."""
    blocked = cells.select(F.floor(F.col("r") / codecs.BLOCK).cast("int").alias("block_row"), F.floor(F.col("c") / codecs.BLOCK).cast("int").alias("block_col"), F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col("h").cast("int").alias("h"))

    def run(pdf):
        import pandas as pd

        block = np.full((codecs.BLOCK, codecs.BLOCK), void, np.int16)
        block[pdf["r"] % codecs.BLOCK, pdf["c"] % codecs.BLOCK] = pdf["h"].fillna(void)
        data = codecs._squeeze(codecs.delta_encode(block.ravel()).astype("<i2").tobytes(), codec)
        return pd.DataFrame({"block_row": pdf["block_row"].iloc[:1], "block_col": pdf["block_col"].iloc[:1], "data": [data]})

    return blocked.groupBy("block_row", "block_col").applyInPandas(run, "block_row int, block_col int, data binary")


def decode_blocks(blocks: DataFrame, codec: str = "deflate", void: int = codecs.VOID) -> DataFrame:
    """The cells (r, c, h) of encoded blocks."""

    def run(batches):
        for b in batches:
            for br, bc, data in zip(*(b.column(i).to_pylist() for i in range(3))):
                h = codecs.unpack_block(data, codecs.CODECS[codec]).ravel()
                r, c = np.divmod(np.arange(len(h)), codecs.BLOCK)
                yield pa.record_batch([pa.array(r + br * codecs.BLOCK, pa.int32()), pa.array(c + bc * codecs.BLOCK, pa.int32()), pa.array(h, pa.int16(), mask=h == void)], names=["r", "c", "h"])

    return blocks.select("block_row", "block_col", "data").mapInArrow(run, "r int, c int, h smallint")


def register(spark: SparkSession) -> None:
    """Makes ``packed_raster`` known to the session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PackedRaster)


def write_packed(cells: DataFrame, path: str, rows: int, cols: int, lon: float, lat: float, cell_lon: float, cell_lat: float, codec: str = "deflate", void: int = codecs.VOID) -> None:
    """One packed raster file from cells (r, c, h). Blocks are encoded on the executors; the driver streams them into
    the file a partition at a time, in block order, and then fills in the index and the checksum."""
    import hashlib
    import struct

    br, bc = -(-rows // codecs.BLOCK), -(-cols // codecs.BLOCK)
    empty = codecs.write_pack(codecs.Grid(np.full((1, 1), void, np.int16), lon, lat, cell_lon, cell_lat), codec, void)
    blank = empty[codecs.PACK_HEADER + 32 + 12 :]
    fs, where = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    body = where + ".body"
    index, at, start = [], codecs.PACK_HEADER + 32 + 12 * br * bc, 0
    with fs.open_output_stream(body, compression=None) as f:

        def put(data: bytes) -> None:
            nonlocal at
            f.write(data)
            index.append(struct.pack("<QI", at, len(data)))
            at += len(data)

        for row in encode_blocks(cells, codec, void).orderBy("block_row", "block_col").toLocalIterator():
            k = row["block_row"] * bc + row["block_col"]
            for _ in range(start, k):
                put(blank)
            put(bytes(row["data"]))
            start = k + 1
        for _ in range(start, br * bc):
            put(blank)
    head = codecs._HEAD.pack(codecs.PACK_MAGIC, codecs.PACK_VERSION, 1, rows, cols, lon, lat, cell_lon, cell_lat, 1.0, 1, 0, codecs.CODECS[codec], 0, codecs.BLOCK, br, bc, void, b"").ljust(codecs.PACK_HEADER, b"\0")

    def pieces():
        yield b"".join(index)
        with fs.open_input_stream(body, compression=None) as f:
            while data := f.read(1 << 20):
                yield data

    digest = hashlib.sha256()
    for data in pieces():
        digest.update(data)
    with fs.open_output_stream(where, compression=None) as out:
        out.write(head + digest.digest())
        for data in pieces():
            out.write(data)
    fs.delete_file(body)


def read_float_grid(spark: SparkSession, path: str, meta_path: str) -> DataFrame:
    """Cells of a raw float32 grid whose text file ``meta_path`` has its six numbers."""
    meta = spark.read.text(meta_path, wholetext=True).first()[0]

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield from _cells(codecs.read_float_grid(data, meta), name)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, CELL_DDL)


def tile_index(spark: SparkSession, path: str) -> DataFrame:
    """SRTM tiles of a folder by the corner in their names: path, tile_lon, tile_lat; points join on their floors."""
    found = r"([NS])(\d{1,2})([EW])(\d{1,3})\.HGT$"
    name = F.upper(F.regexp_extract("path", r"([^/]+)$", 1))
    part = lambda i: F.regexp_extract(name, found, i)
    sign = lambda i, minus: F.when(part(i) == minus, -1).otherwise(1)
    files = list_files(spark, path).where("kind = 'srtm'")
    return files.select("path", (sign(3, "W") * part(4).cast("int")).alias("tile_lon"), (sign(1, "S") * part(2).cast("int")).alias("tile_lat"))
