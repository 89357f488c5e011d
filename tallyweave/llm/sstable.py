"""Token ids in sorted-string-table shards.

A shard is one file::

    data blocks | sparse index | Bloom filter | footer

A data block holds entries in key order; each has the length of the prefix that its key
shares with the entry before (0 at the block's start), the rest of the key, and the ids as
16- or 32-bit little-endian integers.  The index has, for each block, its first key, place,
length, CRC and numbers of entries and ids.  The footer is of fixed size, so a reader finds
a key with three reads: footer, index with filter, and the one block (or the few, where a
key repeats) that binary search names.

The key of a document is its ``doc_id`` as eight big-endian bytes with the sign bit
flipped, so keys sort as the ids do; a null id has the empty key and sorts first.  Repeated
ids are all stored, in any order.  Null texts are stored as the end id
alone.  A long text is one entry, larger than a block.  An empty table writes no shard and
reads back empty.  Further columns are ignored.

Writing encodes the texts where they are and shuffles their ids, once, by ranges of (key, hash
of the row), whose bounds come from a sample of the keys; a key that many rows repeat spans
several ranges.  Each task streams its ranges to files of its own, block by block, and begins
a new one when the last holds ``shard`` bytes of data or ``shard_docs`` documents.  A lost task
leaves files that no manifest names.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyweave.llm import bpe, storage
from tallyweave.llm.textnum import mix

BLOCK = 32 << 10
#: Bytes of data blocks, and documents, from which on a shard is full: bound a reader's task
#: and the keys and index that a writer holds.
SHARD, SHARD_DOCS = 256 << 20, 1 << 20
#: Documents of a range, ranges at most (beyond them ranges grow), and keys sampled for each.
RANGE_DOCS, RANGES, SAMPLED = 10_000, 10_000, 30
#: Bytes of neighbouring blocks that a full scan reads at once.
READ = 8 << 20
MAGIC = b"TWSSTBL1"
_FOOT = struct.Struct("<QIQIQQB7x8s")
_ENTRY = struct.Struct("<QIIIQ")
_U = np.uint64
_BITS_A_KEY, _PROBES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: memoryview, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        c = b[at]
        at += 1
        n |= (c & 127) << shift
        if c < 128:
            return n, at
        shift += 7


def _bloom_places(keys: list[bytes], bits: int) -> np.ndarray:
    h = mix(np.array([int.from_bytes(k, "big") + len(k) & 0xFFFFFFFFFFFFFFFF for k in keys], _U))
    step = mix(h) | _U(1)
    return ((h[:, None] + step[:, None] * np.arange(_PROBES, dtype=_U)) % _U(bits)).astype(np.int64)


class Writer:
    """Writes one shard; keys must come in order."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.block, self.index, self.keys = bytearray(), [], []
        self.last, self.n, self.ids = b"", 0, 0
        self.entries = self.total = 0

    def add(self, key: bytes, value: bytes) -> None:
        """``value``: ids of ``width`` bytes each."""
        if not self.n:
            self.first = key
        same = 0
        if self.n:
            for a, b in zip(self.last, key):
                if a != b:
                    break
                same += 1
        count = len(value) // self.width
        self.block += _varint(same) + _varint(len(key) - same) + _varint(count) + key[same:] + value
        self.last = key
        self.n += 1
        self.ids += count
        self.keys.append(key)
        if len(self.block) >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.n:
            self.index.append((self.first, self.at, len(self.block), zlib.crc32(self.block), self.n, self.ids))
            self.out.write(bytes(self.block))
            self.at += len(self.block)
            self.entries += self.n
            self.total += self.ids
            self.block, self.n, self.ids = bytearray(), 0, 0

    def finish(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + _ENTRY.pack(*x) for k, *x in self.index)
        bits = max(64, _BITS_A_KEY * len(self.keys))
        table = np.zeros(bits, bool)
        for k in range(0, len(self.keys), 65536):
            table[_bloom_places(self.keys[k : k + 65536], bits).reshape(-1)] = True
        bloom = struct.pack("<Q", bits) + np.packbits(table).tobytes()
        self.out.write(index + bloom + _FOOT.pack(self.at, len(index), self.at + len(index), len(bloom), self.entries, self.total, self.width, MAGIC))


class Shard:
    """Reads one shard."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        foot = file.read_at(_FOOT.size, size - _FOOT.size)
        index_at, index_len, bloom_at, bloom_len, self.entries, self.total, self.width, magic = _FOOT.unpack(foot)
        if magic != MAGIC:
            raise ValueError("not a shard")
        tail = file.read_at(bloom_at + bloom_len - index_at, index_at)
        self.index, at, raw = [], 0, memoryview(tail)
        while at < index_len:
            n, at = _read_varint(raw, at)
            self.index.append((bytes(raw[at : at + n]), *_ENTRY.unpack_from(raw, at + n)))
            at += n + _ENTRY.size
        self.firsts = [x[0] for x in self.index]
        (self.bits,) = struct.unpack_from("<Q", tail, index_len)
        self.bloom = np.frombuffer(tail, np.uint8, offset=index_len + 8)

    def _entries(self, block: memoryview, told: tuple) -> Iterator[tuple[bytes, bytes]]:
        if zlib.crc32(block) != told[3]:
            raise ValueError(f"a block at {told[1]} is damaged")
        at, key = 0, b""
        for _ in range(told[4]):
            same, at = _read_varint(block, at)
            rest, at = _read_varint(block, at)
            count, at = _read_varint(block, at)
            key = key[:same] + bytes(block[at : at + rest])
            at += rest
            value = bytes(block[at : at + count * self.width])
            at += count * self.width
            yield key, bpe.widen(value, self.width)

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        """(key, ids) of all entries in order."""
        k = 0
        while k < len(self.index):
            n, size = k, 0
            while n < len(self.index) and (n == k or size + self.index[n][2] <= READ):
                size += self.index[n][2]
                n += 1
            raw, base = memoryview(self.file.read_at(size, self.index[k][1])), self.index[k][1]
            for told in self.index[k:n]:
                yield from self._entries(raw[told[1] - base : told[1] - base + told[2]], told)
            k = n

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each entry of a document, by filter and binary search; none: []."""
        key = key_of(doc_id)
        p = _bloom_places([key], self.bits)[0]
        if not ((self.bloom[p >> 3] >> (7 - (p & 7))) & 1).all():
            return []
        k, out = max(0, bisect.bisect_left(self.firsts, key) - 1), []
        while k < len(self.index) and self.firsts[k] <= key:
            told = self.index[k]
            out += [np.frombuffer(v, "<u4") for x, v in self._entries(memoryview(self.file.read_at(told[2], told[1])), told) if x == key]
            k += 1
        return out


def open_shard(uri: str) -> Shard:
    fs, path = storage.open_fs(uri)
    return Shard(fs.open_input_file(path))


MANIFEST = "shard long, file string, first_id long, last_id long, n_docs long, n_tokens long"


def write(docs: DataFrame, folder: str, vocabulary: str, end: int = 0, width: int = 2, shard: int = SHARD, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write shards in ascending order of doc_id; returns their
    manifest.  An id that needs more than ``width`` bytes (2 or 4) is an error."""

    storage.small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string"), F.monotonically_increasing_id()).alias("tie"), F.col("text").cast("string").alias("text"))
    bounds = docs.sparkSession.sparkContext.broadcast(_bounds(rows))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [_place(*x) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            part = pa.array([bisect.bisect_right(bounds.value, x) for x in keys], pa.int64())
            yield pa.RecordBatch.from_arrays([part, b.column(0), b.column(1), pa.array([bpe.narrow(raw, width) for _, raw in bpe.encoded(b.column(2), vocabulary, end)], pa.binary())], ["part", "doc_id", "tie", "ids"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = part = None
        n = 0

        def row() -> pa.RecordBatch:
            writer.finish()
            out.close()
            return pa.RecordBatch.from_pydict({"shard": [(part << 32) + n], "file": [f"{folder}/{name}"], "first_id": pa.array([first], pa.int64()), "last_id": pa.array([last], pa.int64()), "n_docs": [writer.entries], "n_tokens": [writer.total]})

        for b in batches:
            values = b.column(2)
            for k, (own, doc_id) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if writer is not None and (own != part or writer.at + len(writer.block) >= shard or len(writer.keys) >= shard_docs):
                    yield row()
                    writer, n = None, n + 1
                if writer is None:
                    name, out = storage.write_stream(folder, "shard")
                    writer, first, part = Writer(out, width), doc_id, own
                writer.add(key_of(doc_id), values[k].as_py())
                last = doc_id
        if writer is not None:
            yield row()

    encoded = rows.mapInArrow(encode, "part long, doc_id long, tie long, ids binary").repartitionById(len(bounds.value) + 1, F.col("part").cast("int"))
    ordered = encoded.sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "tie").select("part", "doc_id", "ids")
    return storage.kept(ordered.mapInArrow(shards, MANIFEST), "manifest")


def _place(doc_id: int | None, tie: int) -> tuple[bool, int, int]:
    return doc_id is not None, doc_id or 0, tie


def _bounds(rows: DataFrame) -> list[tuple[bool, int, int]]:
    """Where ranges of about RANGE_DOCS of ``rows`` (doc_id, tie) begin, but for the first."""
    total = rows.count()
    ranges = min(RANGES, -(-total // RANGE_DOCS))
    if ranges <= 1:
        return []
    share = min(1.0, ranges * SAMPLED / total)
    some = sorted(_place(*r) for r in rows.select("doc_id", "tie").sample(share, 7).collect())  # about RANGES * SAMPLED at most
    return sorted({some[k * len(some) // ranges] for k in range(1, ranges)}) if some else []


def read(manifest: DataFrame) -> DataFrame:
    """All documents of the shards: doc_id, start (ids of all documents before it), n_tokens, ids (32-bit little-endian)."""
    n = manifest.count()
    before = F.coalesce(F.sum("n_tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    plan = manifest.select("shard", "file", before.alias("base")).repartitionByRange(max(1, n), "shard").select("file", "base")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for b in batches:
            for file, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows, size = [], 0
                for key, ids in open_shard(file).scan():
                    rows.append((id_of(key), start, len(ids) // 4, ids))
                    start += len(ids) // 4
                    size += len(ids)
                    if size > READ:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return plan.mapInArrow(load, "doc_id long, start long, n_tokens long, ids binary")
