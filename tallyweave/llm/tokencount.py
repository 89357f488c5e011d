"""Token counts of flat token files by a separator scan.

A flat token file is nothing but ids, one after another, as 16- or 32-bit little-endian
integers; an end-of-document id closes each document, and there is no index.  Files are
read in blocks of a fixed number of ids that know nothing of documents.  A vector search
finds the end ids of a block; a prefix scan over the blocks of a file, on one small row
each, gives every block the number of documents that ended before it and the place of the
last end, so documents that cross blocks are put together without reading any id twice.

Ids after a file's last end make one more document, with ``ended`` false.  An empty file
has no document, and an empty table writes no file.  Null texts count as empty; null ids are
returned as they are, and repeated rows are written and counted as often as they come.  A
long text is encoded whole and its ids are scanned in blocks.  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyweave.llm import bpe, storage

#: Ids of a block.
BLOCK = 1 << 22
#: Tasks of a scan at most; each takes many blocks beyond it.
TASKS = 20_000


def write_flat(docs: DataFrame, folder: str, vocabulary: str, end: int, width: int = 2) -> tuple[DataFrame, DataFrame]:
    """Encode ``docs`` (doc_id, text) to flat files, one for each task, without a shuffle.

    ``end`` must be an id that no text encodes to; a text that does, or an id that needs more
    than ``width`` bytes, is an error.  Returns the files (file, n_ids), which
    are what a scan needs, and the order in which documents were written (file, ordinal,
    doc_id), which a scan does not use.
    """

    def dump(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, written = None, 0, 0
        for b in batches:
            if not len(b):
                continue
            if out is None:
                name, out = storage.write_stream(folder, "flat")
            for _, raw in bpe.encoded(b.column(1), vocabulary, end):
                if (np.frombuffer(raw[:-4], "<u4") == end).any():
                    raise ValueError(f"a text holds the end id {end}")
                out.write(bpe.narrow(raw, width))
                n += len(raw) // 4
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([written], pa.int64()), pa.array([b.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([n], pa.int64())], ["file", "first", "doc_ids", "n_ids"])
            written += len(b)
        if out is not None:
            out.close()

    storage.small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    told = storage.kept(docs.mapInArrow(dump, "file string, first long, doc_ids array<long>, n_ids long"), "flat", files=storage.SCAN_FILES)
    files = told.groupBy("file").agg(F.max("n_ids").alias("n_ids"))
    order = told.select("file", "first", F.posexplode("doc_ids").alias("k", "doc_id")).select("file", (F.col("first") + F.col("k")).alias("ordinal"), "doc_id")
    return files, order


def count_tokens(files: DataFrame, end: int, width: int = 2, block: int | None = None) -> DataFrame:
    """(file, ordinal, start, n_ids, ended) of each document of ``files`` (file, n_ids); n_ids has the end id."""
    block = block or BLOCK
    n = files.agg(F.sum(F.ceil(F.col("n_ids") / block))).first()[0] or 1
    ranges = files.where("n_ids > 0").select("file", "n_ids", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_ids") - 1) / block))).alias("block"))
    ranges = ranges.repartitionByRange(max(1, min(int(n), TASKS)), "file", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, last = [], {}
            for file, size, k in zip(*(c.to_pylist() for c in b.columns)):
                if file not in last:
                    fs, path = storage.open_fs(file)
                    last = {file: fs.open_input_file(path)}
                lo = k * block
                raw = last[file].read_at(min(block, size - lo) * width, lo * width)
                found = np.flatnonzero(np.frombuffer(raw, f"<u{width}") == end) + lo
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([size], pa.int64()), pa.array([k], pa.int64()), pa.array([found], pa.list_(pa.int64()))], ["file", "size", "block", "ends"])

    scan = storage.kept(ranges.mapInArrow(search, "file string, size long, block long, ends array<long>"), "scan", files=storage.SCAN_FILES)
    told = scan.select("file", "size", "block", F.size("ends").alias("n"), F.array_max("ends").alias("last"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carry = told.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("done"), (F.coalesce(F.max("last").over(before), F.lit(-1)) + 1).alias("open"))
    each = scan.where(F.size("ends") > 0).join(carry, ["file", "block"]).select("file", "done", F.posexplode(F.transform("ends", lambda e, i: F.struct(F.when(i == 0, F.col("open")).otherwise(F.element_at("ends", F.greatest(i, F.lit(1))) + 1).alias("start"), e.alias("end")))).alias("k", "d"))
    ended = each.select("file", (F.col("done") + F.col("k")).alias("ordinal"), F.col("d.start").alias("start"), (F.col("d.end") - F.col("d.start") + 1).alias("n_ids"), F.lit(True).alias("ended"))
    tail = told.groupBy("file").agg(F.max("size").alias("size"), F.sum("n").alias("ordinal"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start")).where("start < size")
    return ended.unionByName(tail.select("file", "ordinal", "start", (F.col("size") - F.col("start")).alias("n_ids"), F.lit(False).alias("ended")))
