"""WARC archives and their index: locally sorted runs, merged by loser trees into global capture histories.

Writing: rows are grouped by payload digest to tell responses from revisits, and every task appends records, each a
gzip member, to archives of bounded size. The index entries of an archive, sorted by (URL key, timestamp, page id),
are one run; the runs are written to the shared folder. Merging: the key space is cut into ranges, every run hands
each range its slice, and a loser tree merges the slices of a range, so that range after range gives the index in
global order; a range has a bounded number of entries, however many captures one URL has, since the page id is part
of the key. Reading: entries are dealt by archive, and each record is read at its offset.

Files are named by the task attempt that wrote them, and only files that a successful task reported are in the index.

Defined results: a null or empty html is an empty payload; a null url has the empty key; a null page id is carried,
never chosen as the response of a group, and revisits one with an id; repeated rows are records of their own (with
equal ids and payloads all are responses); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import parse_qsl, urlencode, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm import common

ARCHIVE_BYTES = 64 << 20
INDEX_ROWS_PER_TASK = 200_000
#: Compressed bytes of records that a task reads back.
READ_BYTES_PER_TASK = 256 << 20
MIN_REVISIT_BYTES = 0
#: Captures without a time of their own are dated by page id, in seconds after this instant.
EPOCH = datetime.datetime(2024, 1, 1)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_GZIP = 31
_INDEX = pa.schema([("url_key", pa.string()), ("ts", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_INDEX_DDL = "url_key string, ts string, page_id long, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """Sort-friendly form: host labels reversed, then path and sorted query, without scheme, www, port 80/443 or fragment."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return url.strip().lower()
    host = re.sub(r"^www\d*\.", "", host)
    labels = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "")
    query = urlencode(sorted(parse_qsl(u.query, keep_blank_values=True)))
    return f"{labels}){(u.path or '/').lower()}" + (f"?{query.lower()}" if query else "")


def timestamp(page_id: int | None) -> str:
    return (EPOCH + datetime.timedelta(seconds=(page_id or 0) % 3_000_000_000)).strftime("%Y%m%d%H%M%S")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP head without the payload, whose length the head still states."""
    ts = timestamp(page_id)
    date = f"{ts[:4]}-{ts[4:6]}-{ts[6:8]}T{ts[8:10]}:{ts[10:12]}:{ts[12:]}Z"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _record_id(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _record_id(refers_to)), ("X-Refers-To-Page-ID", str(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The headers of a record, and of what it captured: payload_bytes, payload (None for a revisit)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *fields = head.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    out: dict = dict(f.split(": ", 1) for f in fields if ": " in f)
    block = rest[: int(out["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = re.search(rb"(?i)^content-length:\s*(\d+)", http, re.M)
    out["payload"] = None if out["WARC-Type"] == "revisit" else payload
    out["payload_bytes"] = int(stated[1]) if stated else len(payload)
    return out


class LoserTree:
    """Merges sorted iterators: an inner node keeps the loser of its match, so a new head replays one path only."""

    def __init__(self, runs: list[Iterable]):
        self.runs = [iter(r) for r in runs]
        self.heads = [self._next(i) for i in range(len(self.runs))]
        k = len(self.runs)
        self.losers = [0] * max(k, 1)
        winners = [0] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self.heads[a] <= self.heads[b] else (b, a)
        self.winner = winners[1] if k > 1 else 0

    def _next(self, i: int):
        """(0, item, run), or the mark of a run that has ended, which loses to every item; ties go by run."""
        for item in self.runs[i]:
            return (0, item, i)
        return (1, (), i)

    def __iter__(self) -> Iterator:
        k = len(self.runs)
        while k and self.heads[self.winner][0] == 0:
            w = self.winner
            yield self.heads[w][1]
            self.heads[w] = self._next(w)
            node = (w + k) // 2
            while node:
                if self.heads[self.losers[node]] < self.heads[w]:
                    w, self.losers[node] = self.losers[node], w
                node //= 2
            self.winner = w


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives below ``folder``; returns the sorted runs of the index."""
    common.ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1("html"))
    long_enough = rows.where(F.octet_length("html") >= min_bytes)
    firsts = common.materialize(long_enough.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first"))
    # By sort-merge at every size: repeated payloads grow with the pages, and one plan costs alike throughout.
    dealt = rows.join(firsts.hint("merge"), "sha", "left").select("page_id", "url", "html", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))

    def run(batches):
        fs, base = common.open_fs(folder)
        fs.create_dir(base, recursive=True)
        sink, name, at, entries = None, "", 0, []

        def put(data: bytes) -> tuple[int, int]:
            nonlocal at
            c = zlib.compressobj(6, zlib.DEFLATED, _GZIP)
            packed = c.compress(data) + c.flush()
            sink.write(packed)
            at += len(packed)
            return at - len(packed), len(packed)

        def close():
            nonlocal sink, at, entries
            sink.close()
            entries.sort(key=lambda e: (e[0], e[1], e[2] is not None, e[2] or 0, e[4]))
            out = pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*entries), _INDEX)], schema=_INDEX)
            sink, at, entries = None, 0, []
            return out

        for b in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                if sink is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    sink = fs.open_output_stream(f"{base}/{name}", compression=None)
                    info = b"software: geoloom\r\nformat: WARC File Format 1.1\r\n"
                    put(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {EPOCH.isoformat()}Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n")
                payload = html.encode("utf-8", "surrogatepass")
                offset, length = put(record(page_id, url, payload, base32_sha1(payload), refers_to))
                entries.append((url_key(url), timestamp(page_id), page_id, name, offset, length))
                if at >= archive_bytes:
                    yield close()
        if sink is not None:
            yield close()

    return common.materialize(dealt.mapInArrow(run, _INDEX_DDL))


def merge_runs(runs: DataFrame, rows_per_task: int = INDEX_ROWS_PER_TASK) -> DataFrame:
    """The index in global order: range ``part``, and ``pos`` in it; every range is a loser-tree merge of run slices."""
    spark = runs.sparkSession
    common.ship(spark)
    parts = common.tasks_for(spark, runs.count(), rows_per_task)
    dealt = runs.repartitionByRange(parts, "url_key", "ts", "page_id", "file", "offset").withColumn("part", F.spark_partition_id())

    def merge(batches):
        slices: dict[str, list] = {}
        part = 0
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            for key, ts, page_id, file, offset, length, part in zip(*cols):
                slices.setdefault(file, []).append((key, ts, page_id is not None, page_id or 0, file, offset, length))
        for rows in slices.values():
            if any(a > b for a, b in zip(rows, rows[1:])):  # a shuffle may hand blocks of a run over in any order
                rows.sort()
        held, pos = [], 0

        def flush():
            keys, ts, has, ids, files, offsets, lengths = zip(*held)
            data = [keys, ts, [i if h else None for i, h in zip(ids, has)], files, offsets, lengths]
            arrays = [pa.array(d, f.type) for d, f in zip(data, _INDEX)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([part] * len(held), pa.int32()), pa.array(range(pos - len(held), pos), pa.int64())], names=[*_INDEX.names, "part", "pos"])

        for row in LoserTree(list(slices.values())):
            held.append(row)
            pos += 1
            if len(held) == 4096:
                yield flush()
                held = []
        if held:
            yield flush()

    return common.materialize(dealt.mapInArrow(merge, f"{_INDEX_DDL}, part int, pos long"))


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """Every record that ``index`` lists, read at its place: page_id, url_key, ts, payload_bytes, payload_digest,
    record_type, refers_to, payload (of responses). The digest of a response is computed from what was read."""
    spark = index.sparkSession
    common.ship(spark)
    n = common.tasks_for(spark, index.agg(F.sum("length")).first()[0] or 0, READ_BYTES_PER_TASK)
    dealt = index.select("file", "offset", "length", "url_key", "ts").repartition(n, "file").sortWithinPartitions("file", "offset")

    def read(batches):
        fs, base = common.open_fs(folder)
        file, name = None, None
        for b in batches:
            out: list[tuple] = []
            for at, offset, length, key, ts in zip(*(c.to_pylist() for c in b.columns)):
                if at != name:
                    if file is not None:
                        file.close()
                    file, name = fs.open_input_file(f"{base}/{at}"), at
                file.seek(offset)
                r = parse_record(zlib.decompress(file.read(length), _GZIP))
                digest = r["WARC-Payload-Digest"].removeprefix("sha1:") if r["payload"] is None else base32_sha1(r["payload"])
                page_id, refers = r["X-Page-ID"], r.get("X-Refers-To-Page-ID")
                out.append((int(page_id) if page_id else None, key, ts, r["payload_bytes"], digest, r["WARC-Type"], int(refers) if refers else None, r["payload"]))
            if out:
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["page_id", "url_key", "ts", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
        if file is not None:
            file.close()

    return dealt.mapInArrow(read, "page_id long, url_key string, ts string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive_and_read(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write ``pages`` as archives, merge the index runs, and read every record back through the merged index."""
    folder = folder or common.shared_dir(pages.sparkSession)
    return read_archives(merge_runs(write_archives(pages, folder, min_bytes)), folder)
