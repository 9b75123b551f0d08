"""Binary raster formats. Grids are int16 arrays with row 0 in the south; ``VOID`` marks missing cells."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import zstandard

VOID = -32768
BLOCK = 256
#: Fixed values of the formats.
PACK_MAGIC, PACK_HEADER, PACK_VERSION = b"ARPACK1\0", 288, 1
MASK_MAGIC, MASK_HEADER, MASK_VERSION = b"ARPACK_MASK_V2__", 64, 2
CODECS = {"raw": 0, "zstd": 1, "deflate": 2}
DTED_UHL, DTED_DSI, DTED_ACC = 80, 648, 2700


class FormatError(ValueError):
    """The bytes are not what their format demands."""


def need(ok: bool, what: str) -> None:
    if not ok:
        raise FormatError(what)


@dataclass
class Grid:
    """``h``: rows x cols, row 0 south; the origin is the corner (lon, lat) of cell (0, 0)."""

    h: np.ndarray
    lon: float
    lat: float
    cell_lon: float
    cell_lat: float
    extra: dict = field(default_factory=dict)


# --- SRTM and DTED -----------------------------------------------------------------------------------------------


def hgt_corner(name: str) -> tuple[int, int]:
    """(lon, lat) of the south-west corner in a name such as N39E116.hgt."""
    m = re.search(r"([NSns])(\d{1,2})([EWew])(\d{1,3})", name)
    need(m is not None, f"no corner in {name!r}")
    lat, lon = int(m[2]) * (-1 if m[1] in "Ss" else 1), int(m[4]) * (-1 if m[3] in "Ww" else 1)
    need(-90 <= lat < 90 and -180 <= lon < 180, f"corner out of range in {name!r}")
    return lon, lat


def read_hgt(data: bytes, name: str) -> Grid:
    n = {1201 * 1201 * 2: 1201, 3601 * 3601 * 2: 3601}.get(len(data))
    need(n is not None, f"{len(data)} bytes is no SRTM size")
    lon, lat = hgt_corner(name)
    return Grid(np.frombuffer(data, ">i2").reshape(n, n)[::-1].astype(np.int16), lon, lat, 1 / (n - 1), 1 / (n - 1))


def write_hgt(h: np.ndarray) -> bytes:
    need(h.shape in ((1201, 1201), (3601, 3601)), "an SRTM tile has 1201 or 3601 rows and columns")
    return h[::-1].astype(">i2").tobytes()


def _dted_angle(raw: bytes) -> float:
    m = re.fullmatch(rb"(\d{3})(\d{2})(\d{2})([NSEW]?)", raw)
    need(m is not None, f"bad DTED angle {raw!r}")
    return (int(m[1]) + int(m[2]) / 60 + int(m[3]) / 3600) * (-1 if m[4] in (b"S", b"W") else 1)


def dted_header(data: bytes) -> tuple[float, float, float, float]:
    """lon, lat, and the cell in degrees of longitude and latitude."""
    need(len(data) >= DTED_UHL and re.match(rb"UHL\d", data) is not None, "no UHL header")
    steps = re.fullmatch(rb"(\d{4})(\d{4})", data[20:28])
    need(steps is not None, "bad DTED intervals")
    cells = int(steps[1]) / 36000, int(steps[2]) / 36000
    need(min(cells) > 0, "degenerate DTED interval")
    return _dted_angle(data[4:12]), _dted_angle(data[12:20]), *cells


def read_dted(data: bytes) -> Grid:
    """Levels 0 to 2: a record for each longitude, south to north, heights in sign and magnitude."""
    lon, lat, cell_lon, cell_lat = dted_header(data)
    counts = re.fullmatch(rb"(\d{4})(\d{4})", data[47:55])
    need(counts is not None, "bad DTED counts")
    cols, rows = int(counts[1]), int(counts[2])
    at, size = DTED_UHL + DTED_DSI + DTED_ACC, 8 + 2 * rows + 4
    need(len(data) >= at + cols * size, "DTED is cut short")
    records = np.frombuffer(data, np.uint8, cols * size, at).reshape(cols, size)
    need(bool((records[:, 0] == 0xAA).all()), "bad DTED record")
    raw = np.ascontiguousarray(records[:, 8 : 8 + 2 * rows]).view(">u2").astype(np.int32)
    h = np.where(raw == 0xFFFF, VOID, np.where(raw & 0x8000, -(raw & 0x7FFF), raw))
    return Grid(h.T.astype(np.int16), lon, lat, cell_lon, cell_lat)


def write_dted(g: Grid, level: int = 0) -> bytes:
    def angle(v: float, marks: str) -> str:
        s = round(abs(v) * 3600)
        return f"{s // 3600:03d}{s // 60 % 60:02d}{s % 60:02d}{marks[v < 0]}"

    rows, cols = g.h.shape
    head = f"UHL{1 if level < 1 else level}{angle(g.lon, 'EW')}{angle(g.lat, 'NS')}{round(g.cell_lon * 36000):04d}{round(g.cell_lat * 36000):04d}".ljust(47) + f"{cols:04d}{rows:04d}"
    v = g.h.T.astype(np.int32)
    no = np.arange(cols)
    records = np.zeros((cols, 8 + 2 * rows + 4), np.uint8)
    records[:, 0], records[:, 1:4], records[:, 4:6] = 0xAA, no.astype(">u4").view(np.uint8).reshape(cols, 4)[:, 1:], no.astype(">u2").view(np.uint8).reshape(cols, 2)
    records[:, 8:-4] = np.ascontiguousarray(np.where(v == VOID, 0xFFFF, np.where(v < 0, 0x8000 | -v, v)).astype(">u2")).view(np.uint8)
    records[:, -4:] = records[:, :-4].sum(axis=1, dtype=np.int64).astype(">u4").view(np.uint8).reshape(cols, 4)
    return b"".join([head.ljust(DTED_UHL).encode(), b" " * (DTED_DSI + DTED_ACC), records.tobytes()])


# --- packed rasters ----------------------------------------------------------------------------------------------


def delta_encode(flat: np.ndarray) -> np.ndarray:
    """Wrapping 16-bit differences over the whole flattened block."""
    return np.diff(flat.astype(np.int16).view(np.uint16), prepend=np.uint16(0)).astype(np.uint16).view(np.int16)


def delta_decode(deltas: np.ndarray) -> np.ndarray:
    return np.cumsum(deltas.view(np.uint16), dtype=np.uint16).view(np.int16)


def _squeeze(raw: bytes, codec: str) -> bytes:
    return raw if codec == "raw" else zstandard.compress(raw) if codec == "zstd" else zlib.compress(raw, 6)


def _expand(raw: bytes, codec: int) -> bytes:
    try:
        return raw if codec == 0 else zstandard.decompress(raw, max_output_size=2 * BLOCK * BLOCK) if codec == 1 else zlib.decompress(raw)
    except (zstandard.ZstdError, zlib.error) as e:
        raise FormatError(f"block does not decompress: {e}") from e


_HEAD = struct.Struct("<8sIIII5dBBBBIIIh174s")  # magic to source, 256 bytes


@dataclass
class PackHeader:
    rows: int
    cols: int
    lon: float
    lat: float
    cell_lon: float
    cell_lat: float
    z_res: float
    datum: int
    codec: int
    blocks_r: int
    blocks_c: int
    void: int
    source: str

    @property
    def blocks(self) -> int:
        return self.blocks_r * self.blocks_c

    @classmethod
    def parse(cls, data: bytes) -> PackHeader:
        need(len(data) >= PACK_HEADER + 32, "packed raster is cut short")
        m, version, _, rows, cols, lon, lat, cell_lon, cell_lat, z, datum, _, codec, _, size, br, bc, void, source = _HEAD.unpack_from(data)
        need(m == PACK_MAGIC, "not a packed raster")
        need(version == PACK_VERSION and size == BLOCK and codec in CODECS.values(), "unknown version, block size or codec")
        need(rows > 0 and cols > 0 and br == -(-rows // BLOCK) and bc == -(-cols // BLOCK), "sizes do not agree")
        need(all(np.isfinite([lon, lat, cell_lon, cell_lat, z])) and cell_lon > 0 and cell_lat > 0, "degenerate cells")
        return cls(rows, cols, lon, lat, cell_lon, cell_lat, z, datum, codec, br, bc, void, source.rstrip(b"\0").decode("utf-8", "replace"))


def pack_index(data: bytes, head: PackHeader) -> np.ndarray:
    """Offsets and lengths of the blocks, row-blocks first; ``data`` starts at the file's start."""
    at = PACK_HEADER + 32
    need(len(data) >= at + 12 * head.blocks, "index is cut short")
    return np.frombuffer(data, np.dtype([("at", "<u8"), ("n", "<u4")]), head.blocks, at)


def unpack_block(raw: bytes, codec: int) -> np.ndarray:
    flat = np.frombuffer(_expand(raw, codec), "<i2")
    need(len(flat) == BLOCK * BLOCK, "block has a wrong size")
    return delta_decode(flat).reshape(BLOCK, BLOCK)


def read_pack(data: bytes, verify: bool = True) -> Grid:
    head = PackHeader.parse(data)
    if verify:
        need(hashlib.sha256(data[PACK_HEADER + 32 :]).digest() == data[PACK_HEADER : PACK_HEADER + 32], "checksum differs")
    h = np.empty((head.blocks_r * BLOCK, head.blocks_c * BLOCK), np.int16)
    for k, (at, n) in enumerate(pack_index(data, head).tolist()):
        need(at + n <= len(data), "block is cut short")
        r, c = divmod(k, head.blocks_c)
        h[r * BLOCK : (r + 1) * BLOCK, c * BLOCK : (c + 1) * BLOCK] = unpack_block(data[at : at + n], head.codec)
    return Grid(h[: head.rows, : head.cols], head.lon, head.lat, head.cell_lon, head.cell_lat, {"void": head.void, "source": head.source, "codec": head.codec})


def write_pack(g: Grid, codec: str = "deflate", void: int = VOID, source: str = "", z_res: float = 1.0, datum: int = 1) -> bytes:
    rows, cols = g.h.shape
    br, bc = -(-rows // BLOCK), -(-cols // BLOCK)
    full = np.full((br * BLOCK, bc * BLOCK), void, np.int16)
    full[:rows, :cols] = g.h
    blocks = [_squeeze(delta_encode(full[r * BLOCK : (r + 1) * BLOCK, c * BLOCK : (c + 1) * BLOCK].ravel()).astype("<i2").tobytes(), codec) for r in range(br) for c in range(bc)]
    ends = np.cumsum([len(b) for b in blocks]) + PACK_HEADER + 32 + 12 * len(blocks)
    index = b"".join(struct.pack("<QI", end - len(b), len(b)) for end, b in zip(ends.tolist(), blocks))
    head = _HEAD.pack(PACK_MAGIC, PACK_VERSION, 1, rows, cols, g.lon, g.lat, g.cell_lon, g.cell_lat, z_res, datum, 0, CODECS[codec], 0, BLOCK, br, bc, void, source.encode()[:174])
    body = index + b"".join(blocks)
    return head.ljust(PACK_HEADER, b"\0") + hashlib.sha256(body).digest() + body


def recompress(data: bytes, codec: str) -> bytes:
    """The same raster with its blocks under another codec."""
    head, g = PackHeader.parse(data), read_pack(data)
    return write_pack(g, codec, head.void, head.source, head.z_res, head.datum)


# --- land and sea masks ------------------------------------------------------------------------------------------


def read_mask(data: bytes) -> tuple[dict, np.ndarray]:
    """Header fields, and rows (row, class, c0, c1)."""
    need(len(data) >= MASK_HEADER and data[:16] == MASK_MAGIC, "not a mask")
    version, arcsec, rows, cols, lon, lat, res = struct.unpack_from(">4I3d", data, 16)
    need(version == MASK_VERSION, "unknown mask version")
    need(rows > 0 and cols > 0 and np.isfinite(res) and res > 0, "degenerate mask")
    need(len(data) >= MASK_HEADER + 8 * (rows + 1), "mask index is cut short")
    at = np.frombuffer(data, ">u8", rows + 1, MASK_HEADER).astype(np.int64)
    need(bool((np.diff(at) >= 0).all()) and at[0] >= MASK_HEADER and at[-1] <= len(data), "mask index is not in order")
    kind, out = np.dtype([("class", "u1"), ("c0", ">u4"), ("c1", ">u4")]), []
    for r in range(rows):
        a, z = int(at[r]), int(at[r + 1])
        if z - a < 4:
            continue
        (n,) = struct.unpack_from(">I", data, a)
        need(a + 4 + 9 * n <= z, "mask row is cut short")
        s = np.frombuffer(data, kind, n, a + 4)
        out.append(np.column_stack([np.full(n, r), s["class"], s["c0"], s["c1"]]).astype(np.int64))
    return {"arcsec": arcsec, "rows": rows, "cols": cols, "lon": lon, "lat": lat, "res": res}, np.concatenate(out) if out else np.zeros((0, 4), np.int64)


def write_mask(segments: np.ndarray, rows: int, cols: int, lon: float, lat: float, res: float, arcsec: int = 0) -> bytes:
    """``segments``: rows (row, class, c0, c1); within a row they are grouped by class."""
    parts, at = [], [MASK_HEADER + 8 * (rows + 1)]
    order = np.lexsort((segments[:, 2], segments[:, 1], segments[:, 0])) if len(segments) else []
    by_row: dict[int, list] = {}
    for row, kind, c0, c1 in segments[order].tolist() if len(segments) else []:
        by_row.setdefault(row, []).append(struct.pack(">BII", kind, c0, c1))
    for r in range(rows):
        s = by_row.get(r, [])
        parts.append(struct.pack(">I", len(s)) + b"".join(s))
        at.append(at[-1] + len(parts[-1]))
    return MASK_MAGIC + struct.pack(">4I3d", MASK_VERSION, arcsec, rows, cols, lon, lat, res).ljust(MASK_HEADER - 16, b"\0") + struct.pack(f">{rows + 1}Q", *at) + b"".join(parts)


# --- plain float grids and GeoTIFF -------------------------------------------------------------------------------


def read_float_grid(data: bytes, meta: str) -> Grid:
    """float32 rows, and a text of six numbers: rows, cols, longitude, latitude, cell in longitude and in latitude."""
    try:
        rows, cols, lon, lat, cell_lon, cell_lat = map(float, meta.split())
    except ValueError as e:
        raise FormatError("metadata is not six numbers") from e
    need(rows > 0 and cols > 0 and len(data) == 4 * int(rows) * int(cols), "grid has a wrong size")
    return Grid(np.frombuffer(data, "<f4").reshape(int(rows), int(cols)), lon, lat, cell_lon, cell_lat)


_TIFF_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}


def tiff_directories(data: bytes) -> list[dict[int, tuple]]:
    """The tags of each image of a classic TIFF file."""
    return tiff_tags(lambda at, n: data[at : at + n])


def tiff_tags(read: Callable[[int, int], bytes]) -> list[dict[int, tuple]]:
    """The same of a file of which ``read`` gives (offset, length): only its directories are read."""
    head = read(0, 8)
    need(head[:4] in (b"II*\0", b"MM\0*"), "not a TIFF file")
    order, out = "<" if head[:2] == b"II" else ">", []
    try:
        (at,) = struct.unpack_from(f"{order}I", head, 4)
        while at and len(out) < 64:
            (n,) = struct.unpack(f"{order}H", read(at, 2))
            entries, tags = read(at + 2, 12 * n + 4), {}
            for k in range(n):
                tag, kind, count = struct.unpack_from(f"{order}HHI", entries, 12 * k)
                code = _TIFF_TYPES.get(kind)
                if code is None:
                    continue
                fmt = f"{order}{count}s" if code == "s" else f"{order}{count * len(code)}{code[0]}"
                size, held = struct.calcsize(fmt), entries[12 * k + 8 : 12 * k + 12]
                tags[tag] = struct.unpack_from(fmt, held if size <= 4 else read(struct.unpack(f"{order}I", held)[0], size))
            out.append(tags | {0: (order,)})
            (at,) = struct.unpack_from(f"{order}I", entries, 12 * n)
    except struct.error as e:
        raise FormatError(f"TIFF is cut short: {e}") from e
    return out


def _lzw(data: bytes) -> bytes:
    out, table, width, last = bytearray(), [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
    bits = held = 0
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = table[:258], 9, b""
            continue
        need(code <= len(table), "bad LZW code")
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


@dataclass
class TiffLevel:
    """How one image of a GeoTIFF lies in its file and on the globe; its chunks are strips or tiles."""

    rows: int
    cols: int
    high: int
    wide: int
    tiled: bool
    codec: int
    predictor: int
    bands: int
    dtype: np.dtype
    void: float | None
    west: float
    south: float
    cell_lon: float
    cell_lat: float
    #: Whether row 0 is in the south.
    south_up: bool

    @property
    def across(self) -> int:
        return -(-self.cols // self.wide)

    @property
    def chunks(self) -> int:
        """Chunks of the first band."""
        return self.across * -(-self.rows // self.high)

    def place(self, k: int) -> tuple[int, int, int, int]:
        """First row, first column, rows and columns of a chunk in the image."""
        r, c = k // self.across * self.high, k % self.across * self.wide
        return r, c, min(self.high, self.rows - r), min(self.wide, self.cols - c)

    def box(self, k: int) -> tuple[float, float, float, float]:
        """Centres of the chunk's outermost cells: least and greatest longitude, least and greatest latitude."""
        r, c, n, m = self.place(k)
        low = r if self.south_up else self.rows - r - n
        return self.west + (c + 0.5) * self.cell_lon, self.west + (c + m - 0.5) * self.cell_lon, self.south + (low + 0.5) * self.cell_lat, self.south + (low + n - 0.5) * self.cell_lat

    def decode(self, k: int, raw: bytes) -> np.ndarray:
        """Band 0 of a chunk, voids NaN, in the image's order of rows."""
        _, _, n, m = self.place(k)
        raw = raw if self.codec == 1 else _lzw(raw) if self.codec == 5 else zlib.decompress(raw) if self.codec in (8, 32946) else None
        need(raw is not None, f"TIFF compression {self.codec} is not read")
        high, row, size = self.high if self.tiled else n, self.wide * self.bands, self.dtype.itemsize
        need(len(raw) >= high * row * size, "TIFF chunk is cut short")
        if self.predictor == 3:
            b = np.frombuffer(raw, np.uint8, high * row * size).reshape(high, -1)
            b = np.cumsum(b, axis=1, dtype=np.uint8).reshape(high, size, row)
            v = np.ascontiguousarray(b.transpose(0, 2, 1)).view(self.dtype.newbyteorder(">"))[..., 0]
        else:
            v = np.frombuffer(raw, self.dtype, high * row).reshape(high, row)
        v = v.reshape(high, self.wide, self.bands)
        if self.predictor == 2:
            v = np.cumsum(v, axis=1, dtype=v.dtype.newbyteorder("="))
        out = v[:n, :m, 0].astype(np.float64)
        if self.void is not None:
            out[out == self.void] = np.nan
        return out


def tiff_level(tags: list[dict[int, tuple]], level: int) -> tuple[TiffLevel, tuple, tuple]:
    """One image of a GeoTIFF, and the offsets and lengths of its chunks."""
    need(level < len(tags), f"no level {level}")
    base, t = tags[0], tags[level]
    need(256 in t and 257 in t, "TIFF without a size")
    cols, rows = t[256][0], t[257][0]
    bits, kind, planar = t.get(258, (8,))[0], t.get(339, (1,))[0], t.get(284, (1,))[0]
    tiled = 324 in t
    wide, high = (t[322][0], t[323][0]) if tiled else (cols, t.get(278, (rows,))[0])
    void, mark = None, t.get(42113) or base.get(42113)
    if mark:
        text = mark[0].rstrip(b"\0 ").decode("ascii", "replace")
        void = float(text) if re.fullmatch(r"[-+0-9.eE]+", text) else None
    need(33550 in base and 33922 in base, "GeoTIFF without a georeference")
    sx, sy = base[33550][0] * base[256][0] / cols, base[33550][1] * base[257][0] / rows
    i, j, _, x, y = base[33922][:5]
    south_up = sy < 0 or south_row_first(base, y, j)
    south = y - j * abs(base[33550][1]) if south_up else y + j * base[33550][1] - rows * sy
    dtype = np.dtype(t[0][0] + {1: "u", 2: "i", 3: "f"}[kind] + str(bits // 8))
    bands = 1 if planar == 2 else t.get(277, (1,))[0]
    found = TiffLevel(rows, cols, min(high, rows) if not tiled else high, wide, tiled, t.get(259, (1,))[0], t.get(317, (1,))[0], bands, dtype, void, x - i * base[33550][0], south, sx, abs(sy), south_up)
    return found, *((t[324], t[325]) if tiled else (t[273], t[279]))


def read_geotiff(data: bytes, level: int = 0) -> Grid:
    """Band 0 of one image of a GeoTIFF (strips or tiles; raw, LZW or deflate), with georeference and voids (NaN)."""
    tags = tiff_directories(data)
    t, places, sizes = tiff_level(tags, level)
    out = np.zeros((t.rows, t.cols), np.float64)
    for k in range(t.chunks):
        r, c, n, m = t.place(k)
        out[r : r + n, c : c + m] = t.decode(k, data[places[k] : places[k] + sizes[k]])
    return Grid(out if t.south_up else out[::-1], t.west, t.south, t.cell_lon, t.cell_lat, {"levels": len(tags)})


def south_row_first(base: dict[int, tuple], y: float, j: float) -> bool:
    """Whether row 0 is in the south: the reading that leaves the globe loses, else a tie point below row 0 says so."""
    height, sy = base[257][0], abs(base[33550][1])
    north_ok = abs(y + j * sy) <= 90 + 1e-9 and abs(y + j * sy - height * sy) <= 90 + 1e-9
    south_ok = abs(y - j * sy) <= 90 + 1e-9 and abs(y - j * sy + height * sy) <= 90 + 1e-9
    return south_ok if north_ok != south_ok else j > 0


def write_geotiff(h: np.ndarray, lon: float, lat: float, cell: float, codec: str = "deflate", void: float | None = None) -> bytes:
    """A float32 image in one strip, the north row first."""
    rows, cols = h.shape
    raw = h[::-1].astype("<f4").tobytes()
    body = zlib.compress(raw) if codec == "deflate" else raw
    entries = [(256, 4, (cols,)), (257, 4, (rows,)), (258, 3, (32,)), (259, 3, (8 if codec == "deflate" else 1,)), (273, 4, (8,)), (277, 3, (1,)), (278, 4, (rows,)), (279, 4, (len(body),)), (339, 3, (3,)), (33550, 12, (cell, cell, 0.0)), (33922, 12, (0.0, 0.0, 0.0, lon, lat + rows * cell, 0.0))]
    if void is not None:
        entries.append((42113, 2, (str(void).encode() + b"\0",)))
    start = 8 + len(body) + len(body) % 2
    heap_at, heap, rows_out = start + 2 + 12 * len(entries) + 4, b"", b""
    for tag, kind, values in entries:
        data = values[0] if kind == 2 else struct.pack(f"<{len(values)}{_TIFF_TYPES[kind]}", *values)
        count = len(data) if kind == 2 else len(values)
        if len(data) > 4:
            rows_out += struct.pack("<HHII", tag, kind, count, heap_at + len(heap))
            heap += data
        else:
            rows_out += struct.pack("<HHI", tag, kind, count) + data.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<I", start) + body + b"\0" * (len(body) % 2) + struct.pack("<H", len(entries)) + rows_out + b"\0\0\0\0" + heap
