"""Token-ID output: one wavelet matrix per shard, in one compressed file with rank, select and access.

A wavelet matrix stores a sequence of ids as bit-planes, the highest bit first; after each plane the ids are parted
stably into those with bit 0 and those with bit 1. Each plane is cut into blocks of ``BLOCK_BITS`` bits, compressed on
their own, with the number of ones before each block: any access, count or look-up touches a few blocks only.

File: MAGIC, the sections (blocks of the planes, directories, ids and ends of the documents), a JSON footer with
the place of each section, the footer's length (4 bytes, little-endian), MAGIC.

Writing: documents are range-sorted by id, encoded, and appended to shards of ``SHARD_TOKENS`` ids; each task writes
files under names of its own and reports them, and only files that a successful task reported are read. The number
of ids before each shard is a running sum over the shards, of which there is one for millions of ids.

Defined results: a null or empty text is its end id alone; null ids come first; rows with equal ids keep an order of
their own (by a hash of the text); very long texts span one shard, which then is larger; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm import common

MAGIC = b"GLWAVE01"
BLOCK_BITS = 1 << 16
SHARD_TOKENS = 1 << 20
END_ID = 2
#: Characters of text that a task encodes, and rows of the list of shards that a task sums.
CHARS_PER_TASK, MANIFEST_ROWS = 128 << 20, 1_000_000
#: Distinct words whose ids a worker keeps before it starts afresh.
CACHE_WORDS = 1_200_000


class _Numbers(dict):
    """Numbers words as they are first looked up, and lists the new ones."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        self[word] = n = len(self)
        return n


class Encoder:
    """Ids of whole texts by the tokenizers library; ids of words seen before come from a cache.

    A byte-level tokenizer without a normalizer splits a text at each space that stands between two characters that
    are not white space, with the space at the front of what follows. So such words encode alike wherever they are.
    Texts with any other space or with the content of an added token (which is one id, as the file says), and other
    kinds of tokenizers, are encoded whole.
    """

    _OTHER_SPACE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        added = spec.get("added_tokens") or []
        # Words of different texts are learned side by side: an added token with a space could arise between them.
        self.by_word = self.by_word and not any(re.search(r"\s", a["content"]) for a in added)
        self._added = re.compile("|".join(re.escape(a["content"]) for a in added)) if added else None
        vocab = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of a token: a character of its name for each
        for piece, i in vocab.items():
            self.width[i] = len(piece)
        self.bits = max(1, int(max(vocab.values())).bit_length())
        self._reset()

    def _reset(self) -> None:
        self.known = _Numbers()
        self.starts, self.lens = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _regular(self, text: str) -> bool:
        """Whether every space stands between characters that are not white space, and no added token occurs."""
        return not (self._added and self._added.search(text) or "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " " or self._OTHER_SPACE.search(text))

    def _learn(self) -> None:
        """Ids of the words numbered since the last call, in the order of their numbers."""
        words, self.known.fresh = self.known.fresh, []
        n = len(self.known) - len(words)
        groups = [words[i : i + 256] for i in range(0, len(words), 256)]
        for group, ids in zip(groups, self._whole(["".join([f" {w}" for w in g]) for g in groups])):
            ends = np.cumsum([len(w.encode()) + 1 for w in group])
            sums = np.cumsum(self.width[ids])
            cuts = np.searchsorted(sums, ends)
            if len(sums) == 0 or not np.array_equal(sums[np.minimum(cuts, len(sums) - 1)], ends):
                pieces = self._whole([f" {w}" for w in group])
                ids, cuts = np.concatenate(pieces), np.cumsum([len(p) for p in pieces]) - 1
            first = np.concatenate([[0], cuts[:-1] + 1])
            while n + len(group) > len(self.starts):
                self.starts, self.lens = np.concatenate([self.starts, self.starts]), np.concatenate([self.lens, self.lens])
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, self.flat])
            self.flat[self.used : self.used + len(ids)] = ids
            self.starts[n : n + len(group)] = first + self.used
            self.lens[n : n + len(group)] = cuts + 1 - first
            self.used += len(ids)
            n += len(group)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = [i for i, t in enumerate(texts) if self.by_word and t and self._regular(t)]
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        fast = set(plain)
        other = [i for i in range(len(texts)) if i not in fast and texts[i]]
        for i, ids in zip(other, self._whole([texts[i] for i in other])):
            out[i] = ids
        if not plain:
            return out
        words = [texts[i].split(" ") for i in plain]
        heads = self._whole([w[0] for w in words])
        if len(self.known) > CACHE_WORDS:
            self._reset()
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(w[1:] for w in words)), np.int64, sum(map(len, words)) - len(words))
        self._learn()
        lens = self.lens[at]
        ends = np.cumsum(lens)
        flat = self.flat[np.repeat(self.starts[at] - ends + lens, lens) + np.arange(ends[-1] if len(ends) else 0)]
        word_at = id_at = 0
        for i, w, head in zip(plain, words, heads):
            upto = word_at + len(w) - 1
            end = int(ends[upto - 1]) if upto else 0
            out[i] = np.concatenate([head, flat[id_at:end]])
            word_at, id_at = upto, end
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def build(ids: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[int]]:
    """The packed bit-planes of ``ids``, the highest first, and the zeros of each."""
    a = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    planes, zeros = [], []
    for level in range(bits - 1, -1, -1):
        one = (a & a.dtype.type(1 << level)).astype(bool)
        planes.append(np.packbits(one, bitorder="little"))
        low = a[np.flatnonzero(~one)]  # numbers rather than flags: no branch for each id
        zeros.append(len(low))
        a = np.concatenate([low, a[np.flatnonzero(one)]])
    return planes, zeros


def write_shard(sink, docs: np.ndarray, valid: np.ndarray, ends: np.ndarray, ids: np.ndarray, bits: int) -> None:
    """One shard file: ``docs`` (long) with ``valid`` flags, the end of each document in ``ids``."""
    place, footer = 0, {"n": len(ids), "bits": bits, "docs": len(docs), "planes": []}
    pack = zstandard.ZstdCompressor(level=1).compress

    def put(data: bytes) -> list[int]:
        nonlocal place
        sink.write(data)
        place += len(data)
        return [place - len(data), len(data)]

    put(MAGIC)
    planes, zeros = build(ids, bits)
    step = BLOCK_BITS // 8
    for plane, zero in zip(planes, zeros):
        blocks, ones = [], []
        for i in range(0, len(plane), step):
            raw = plane[i : i + step]
            blocks.append(put(pack(raw.tobytes())))
            ones.append(int(np.bitwise_count(raw).sum()))
        before = np.concatenate([[0], np.cumsum(np.array(ones, np.int64))])
        footer["planes"].append({"zeros": zero, "blocks": put(np.array(blocks, "<i8").tobytes()), "ones": put(before.astype("<i8").tobytes())})
    footer |= {"doc_ids": put(pack(docs.astype("<i8").tobytes())), "valid": put(np.packbits(valid).tobytes()), "ends": put(pack(ends.astype("<i8").tobytes()))}
    data = json.dumps(footer).encode()
    sink.write(data + struct.pack("<I", len(data)) + MAGIC)


class Shard:
    """A shard file opened for random access: ``source`` is a seekable binary file."""

    def __init__(self, source):
        self.file = source
        self.file.seek(0, 2)
        size = self.file.tell()
        self.file.seek(size - 12)
        tail = self.file.read(12)
        if tail[4:] != MAGIC:
            raise ValueError("not a wavelet shard")
        length = struct.unpack("<I", tail[:4])[0]
        self.meta = json.loads(self._read(size - 12 - length, length))
        self.n, self.bits = self.meta["n"], self.meta["bits"]
        self.dirs = [(np.frombuffer(self._read(*p["blocks"]), "<i8").reshape(-1, 2), np.frombuffer(self._read(*p["ones"]), "<i8"), p["zeros"]) for p in self.meta["planes"]]
        unpack = zstandard.ZstdDecompressor().decompress
        self._unpack = unpack
        self.doc_ids = np.frombuffer(unpack(self._read(*self.meta["doc_ids"])), "<i8")
        self.valid = np.unpackbits(np.frombuffer(self._read(*self.meta["valid"]), np.uint8), count=len(self.doc_ids)).astype(bool)
        self.ends = np.frombuffer(unpack(self._read(*self.meta["ends"])), "<i8")
        self._block = lru_cache(maxsize=256)(self._load)

    def _read(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        return self.file.read(length)

    def _load(self, level: int, block: int) -> np.ndarray:
        return np.unpackbits(np.frombuffer(self._unpack(self._read(*map(int, self.dirs[level][0][block]))), np.uint8), bitorder="little")

    def _bit(self, level: int, i: int) -> int:
        return int(self._block(level, i // BLOCK_BITS)[i % BLOCK_BITS])

    def _ones(self, level: int, i: int) -> int:
        """Ones before position ``i`` of a plane."""
        block, rest = divmod(i, BLOCK_BITS)
        return int(self.dirs[level][1][block]) + (int(self._block(level, block)[:rest].sum()) if rest else 0)

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the ``k``-th (from 0) ``bit`` of a plane."""
        ones = self.dirs[level][1]
        before = ones if bit else np.arange(len(ones)) * BLOCK_BITS - ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        block = min(block, len(ones) - 2)
        return block * BLOCK_BITS + int(np.flatnonzero(self._block(level, block) == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            bit = self._bit(level, i)
            ones = self._ones(level, i)
            i = self.dirs[level][2] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token < 0 or token >> self.bits:
            return 0, 0
        for level in range(self.bits):
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = (self.dirs[level][2] + a, self.dirs[level][2] + b) if token >> (self.bits - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of ``token`` in [lo, hi)."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def select(self, token: int, k: int) -> int:
        """Position of the ``k``-th (from 0) occurrence of ``token``."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            i = self._select(level, bit, i - self.dirs[level][2] if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids at once: the planes are undone from the lowest bit up."""
        a = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            packed = b"".join(self._unpack(self._read(*map(int, b))) for b in self.dirs[level][0])
            one = np.unpackbits(np.frombuffer(packed, np.uint8), count=self.n, bitorder="little").view(bool)
            zero = self.dirs[level][2]
            out = np.empty_like(a)
            out[np.flatnonzero(~one)] = a[:zero]
            out[np.flatnonzero(one)] = a[zero:] | a.dtype.type(1 << (self.bits - 1 - level))
            a = out
        return a


def write_shards(df: DataFrame, tokenizer: str, folder: str, text: str = "text", doc_id: str = "doc_id", end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode ``df`` and write shards below ``folder``; returns the manifest: path, n_docs, n_tokens, start (ids before)."""
    spark = df.sparkSession
    common.ship(spark)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    size = rows.agg(F.sum(F.length("text") + 8)).first()[0] or 0
    parts = common.tasks_for(spark, size, CHARS_PER_TASK)
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("part", F.spark_partition_id())

    def run(batches):
        enc = encoder(tokenizer)
        fs, base = common.open_fs(folder)
        fs.create_dir(base, recursive=True)
        docs, ids, held, seq = [], [], 0, 0

        def flush(part: int):
            nonlocal docs, ids, held, seq
            path = f"{base}/{part:06d}-{seq:06d}-{uuid.uuid4().hex}.wav"
            lens = np.array([len(x) for x in ids], np.int64)
            flat = np.concatenate(ids)
            with fs.open_output_stream(path, compression=None) as sink:
                write_shard(sink, np.array([d or 0 for d in docs], np.int64), np.array([d is not None for d in docs], bool), np.cumsum(lens), flat, enc.bits)
            row = {"part": [part], "seq": [seq], "path": [f"{folder}/{path.rsplit('/', 1)[1]}"], "n_docs": [len(docs)], "n_tokens": [len(flat)]}
            docs, ids, held, seq = [], [], 0, seq + 1
            return pa.record_batch(row, schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        part = 0
        for b in batches:
            if not b.num_rows:
                continue
            part = b.column(2)[0].as_py()
            for d, x in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist())):
                docs.append(d)
                ids.append(np.append(x, np.uint32(end_id)))
                held += len(ids[-1])
                if held >= shard_tokens:
                    yield flush(part)
        if docs:
            yield flush(part)

    manifest = common.materialize(ranged.mapInArrow(run, "part int, seq int, path string, n_docs long, n_tokens long"))
    starts = common.prefix_sum(manifest, [F.col("part"), F.col("seq")], "n_tokens", "start", 1 + manifest.count() // MANIFEST_ROWS)
    return common.materialize(starts.select("path", "n_docs", "n_tokens", "start"))


def read_shards(manifest: DataFrame) -> DataFrame:
    """One row per document of the shard files: doc_id, start, n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    common.ship(spark)

    def run(batches):
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, where = common.open_fs(path)
                with fs.open_input_file(where) as f:
                    shard = Shard(f)
                    data = shard.decode().astype("<u4").tobytes()
                    ends = shard.ends
                    starts = np.concatenate([[0], ends[:-1]])
                    crc = [zlib.crc32(data[4 * a : 4 * z]) for a, z in zip(starts.tolist(), ends.tolist())]
                    cols = [pa.array(shard.doc_ids.astype(np.int64), pa.int64(), mask=~shard.valid), pa.array(starts + start, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = manifest.select("path", "start").repartition(common.tasks_for(spark, manifest.count(), 8), "path")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(df: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", end_id: int = END_ID, folder: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write ``df`` as shards and describe every document as read back from them."""
    folder = folder or common.shared_dir(df.sparkSession)
    return read_shards(write_shards(df, tokenizer, folder, text, doc_id, end_id, shard_tokens))
