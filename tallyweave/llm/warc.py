"""WARC archives with an index written first.

Writing gives each page one WARC/1.1 record, a gzip member of its own, and an index row
with the record's file, offset, length, URL and payload digest.  Reading starts from index
rows, any selection of them: they are sorted by file and offset, neighbouring records are
coalesced into byte ranges of bounded length, and each range is read once.

Of records with equal payloads of at least ``SHARED_FROM`` bytes, the one of largest
page_id is a ``response``, the others are ``revisit`` records that refer to it and carry no
payload; smaller payloads are always responses.

A null html is an empty payload; a null or empty url leaves the target out of the header.
Rows that repeat the largest page_id of a payload are all responses.  A null page_id is
never referred to: such a row is a response unless a row with an id has its payload.
Control characters and spaces of a url are percent-encoded in the header and kept in the
index.  A long page is compressed as one record, one page at a time.  Empty tables write
nothing and read back empty; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import storage

SHARED_FROM = 1000
DATE = "2024-01-01T00:00:00Z"
#: Records closer than GAP bytes are read together, up to RANGE bytes at once.
GAP, RANGE = 64 << 10, 8 << 20
#: Digests of shared payloads that are broadcast at most (about 40 bytes each).
BROADCAST_ROWS = 500_000
#: Records of one read task.
RECORDS = 20_000

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
INDEX = "page_id long, url string, payload_digest string, record_type string, file string, offset long, length long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _safe(url: str) -> str:
    return "".join(f"%{b:02X}" if b <= 32 or b == 127 else chr(b) for b in url.encode()) if any(c <= " " or c == "\x7f" for c in url) or not url.isascii() else url


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member; ``digest`` is the SHA-1 of the payload."""
    again = refers_to is not None
    block = _HTTP if again else _HTTP + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if again else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {_safe(url)}"] if url else []),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"] if again else []),
        *([f"X-Page: {page_id}"] if page_id is not None else []),
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode("latin1", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> tuple:
    """A record's row in the order of RECORD, without its url."""
    raw = zlib.decompress(member, 31)
    end = raw.index(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in raw[:end].decode("latin1").split("\r\n")[1:])
    block = raw[end + 4 : end + 4 + int(head["Content-Length"])]
    page = int(head["X-Page"]) if "X-Page" in head else None
    told = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:"))
    size = int(head["X-Payload-Length"])
    if head["WARC-Type"] == "revisit":
        return page, "revisit", int(head["X-Refers-To-Page"]), None, size, told.hex()
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    if hashlib.sha1(payload).digest() != told or len(payload) != size:
        raise ValueError(f"record of page {page} is damaged")
    return page, "response", None, payload, size, told.hex()


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write archives of ``pages`` (page_id, url, html) to ``folder``; returns the index."""
    storage.small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("html")))
    large = F.octet_length("html") >= SHARED_FROM
    shared = storage.kept(rows.where(large & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "shared")
    few = shared.count() <= BROADCAST_ROWS
    told = rows.join(F.broadcast(shared) if few else shared, "digest", "left").select("page_id", "url", "html", "digest", F.when(large & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at = None, 0
        for b in batches:
            index = []
            for page, url, html, digest, refers in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    name, out = storage.write_stream(folder, "pages", ".warc.gz")
                data = record(page, url, html.encode(), digest, refers)
                out.write(data)
                index.append((page, url, digest.hex(), "response" if refers is None else "revisit", f"{folder}/{name}", at, len(data)))
                at += len(data)
            if index:
                types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index), types)], [f.split()[0] for f in INDEX.split(", ")])
        if out is not None:
            out.close()

    return storage.kept(told.mapInArrow(archive, INDEX), "index", files=storage.SCAN_FILES)


def ranges(spans: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[int]]]:
    """Coalesce sorted (offset, length) spans of one file: offset, length and the spans' numbers."""
    k = 0
    while k < len(spans):
        start, end, own = spans[k][0], sum(spans[k]), [k]
        while k + 1 < len(spans) and spans[k + 1][0] - end <= GAP and sum(spans[k + 1]) - start <= RANGE:
            k += 1
            end = max(end, sum(spans[k]))
            own.append(k)
        yield start, end - start, own
        k += 1


def read(index: DataFrame) -> DataFrame:
    """The records that ``index`` selects, with their payloads (null for revisits)."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORD.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
        name = file = None
        for b in batches:
            cols = {n: b.column(n).to_pylist() for n in ("file", "offset", "length", "url")}
            k = 0
            while k < len(b):
                end = k
                while end < len(b) and cols["file"][end] == cols["file"][k]:
                    end += 1
                if name != cols["file"][k]:
                    name = cols["file"][k]
                    fs, path = storage.open_fs(name)
                    file = fs.open_input_file(path)
                spans = list(zip(cols["offset"][k:end], cols["length"][k:end]))
                for start, size, own in ranges(spans):
                    raw, rows = file.read_at(size, start), []
                    for x in own:
                        at, n = spans[x]
                        page, *rest = parse(raw[at - start : at - start + n])
                        rows.append((page, cols["url"][k + x], *rest))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                k = end

    n = max(1, -(-index.count() // RECORDS))
    n = max(n, index.sparkSession.sparkContext.defaultParallelism)
    return index.select("file", "offset", "length", "url").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(fetch, RECORD)
