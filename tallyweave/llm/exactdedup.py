"""Exact dedup of an incoming batch against an immutable snapshot.

Texts are equal when they are the same after each run of ``[\\x20\\x09-\\x0D]`` is replaced
by one space; a null text counts as empty.

A snapshot holds, for each distinct text, its SHA-256, the smallest id and the number of
rows.  Its digests are dealt by hash into buckets of bounded size, and each bucket has a
static binary-fuse filter.  An incoming batch is first grouped on its own (its duplicates
never meet the snapshot), then its digests are screened by the filter of their bucket;
only positives are joined with the exact bucket, and equal digests are confirmed on the
bytes of both texts.

``dedup`` applies this to one table: rows up to the median id are the snapshot, the others
the incoming batch, so the snapshot's ids are the smaller ones and stay.

Null ids are grouped too, as part of the incoming batch: a group that has a non-null id
keeps that row, one of null ids only keeps all of its rows.  (A batch group of null ids is
matched with the snapshot by SHA-256 alone, as its bytes cannot be looked up by id.)  Rows
that repeat both id and text are all returned with the same ``keep_id``.  A long text is
normalised and hashed whole, one at a time.  Further columns are ignored.  An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import fuse, storage
from tallyweave.llm.textnum import text_buffers

#: Digests of a bucket: bounds the filter (about 1.1 bytes each) and the groups that a task screens.
BUCKET = 1 << 16
#: Ids that are broadcast at most (8 bytes each); beyond it they are shuffled.
BROADCAST_IDS = 1_000_000

_WS = b" \t\n\x0b\x0c\r"


def normalised(text: bytes) -> bytes:
    out = b" ".join(text.split())
    if not out:
        return b" " if text else b""
    return (b" " if text[0] in _WS else b"") + out + (b" " if text[-1] in _WS else b"")


def _norms(col: pa.Array) -> Iterator[bytes]:
    buf, offs = text_buffers(col)
    raw = memoryview(buf)
    offs = offs.tolist()
    for a, b in zip(offs, offs[1:]):
        yield normalised(bytes(raw[a:b]))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([hashlib.sha256(t).digest() for t in _norms(b.column(1))], pa.binary())], ["doc_id", "digest"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([hashlib.sha256(t).digest() for t in _norms(b.column(1))], pa.binary())], ["doc_id", "text", "digest"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_norms(b.column(1)), pa.binary())], ["doc_id", "norm"])


def _keys(col: pa.ChunkedArray) -> np.ndarray:
    return np.array([int.from_bytes(x[8:16], "little") for x in col.to_pylist()], np.uint64)


def _build(group: pa.Table) -> pa.Table:
    return pa.table({"bucket": group["bucket"][:1], "filter": pa.array([fuse.build(_keys(group["digest"]))], pa.binary())})


def _screen(incoming: pa.Table, filters: pa.Table) -> pa.Table:
    out = incoming.select(["digest", "keep_new", "n_new"])
    if not len(filters) or not len(out):
        return out[:0]
    return out.filter(pa.array(fuse.probe(filters["filter"][0].as_py(), _keys(out["digest"]))))


def distinct(prints: DataFrame, keep: str, n: str) -> DataFrame:
    """The distinct digests of a batch, with the smallest id and the number of rows."""
    return prints.groupBy("digest").agg(F.min("doc_id").alias(keep), F.count("*").alias(n))


def snapshot_filters(snapshot: DataFrame, buckets: int) -> DataFrame:
    """(bucket, filter) of a snapshot's digests."""
    return snapshot.select(_bucket(buckets), "digest").groupBy("bucket").applyInArrow(_build, "bucket long, filter binary")


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).alias("bucket")


def against(snapshot: DataFrame, filters: DataFrame, batch: DataFrame, buckets: int, docs: DataFrame) -> DataFrame:
    """The digests of ``batch`` (digest, keep_new, n_new) whose text is in ``snapshot`` (digest, keep_old, n_old)."""
    positive = batch.select(_bucket(buckets), "digest", "keep_new", "n_new").groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(_screen, "digest binary, keep_new long, n_new long")
    pairs = storage.kept(positive.join(snapshot, "digest"), "positives")
    ids = storage.kept(pairs.select(F.explode(F.array("keep_old", "keep_new")).alias("doc_id")).where("doc_id is not null").distinct(), "ids", files=storage.LINK_FILES)
    few = ids.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").mapInArrow(_texts, "doc_id long, norm binary")
    # sha2 of the bytes tells repeated ids with different texts apart.
    texts = storage.kept(texts.withColumn("digest", F.unhex(F.sha2("norm", 256))).dropDuplicates(["doc_id", "digest"]), "bytes")
    old = texts.select("digest", F.col("doc_id").alias("keep_old"), F.col("norm").alias("norm_old"))
    new = texts.select("digest", F.col("doc_id").alias("keep_new"), F.col("norm").alias("norm_new"))
    same = pairs.join(old, ["digest", "keep_old"]).join(new, ["digest", "keep_new"]).where("norm_old = norm_new").select("digest", "keep_old", "n_old", "keep_new", "n_new")
    # A row without an id cannot be looked up again: its SHA-256 has to do.
    lost = pairs.where("keep_old is null or keep_new is null").select("digest", "keep_old", "n_old", "keep_new", "n_new")
    out = storage.kept(same.unionByName(lost), "confirmed")
    storage.drop(texts, pairs, ids)
    return out


def dedup(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    return storage.settled(docs.sparkSession, lambda: _judged(docs), "groups").withColumn("text_sha256", F.lower(F.hex("text_sha256")))


def _judged(docs: DataFrame) -> DataFrame:
    """dedup with the bytes of the SHA-256."""
    storage.small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    middle = docs.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    late = F.coalesce(F.col("doc_id") > F.lit(middle), F.lit(True)) if middle is not None else F.lit(False)
    prints = storage.kept(docs.mapInArrow(_digests, "doc_id long, digest binary").withColumn("late", late), "prints", files=storage.SCAN_FILES)

    snapshot = storage.kept(distinct(prints.where("not late"), "keep_old", "n_old"), "snapshot")
    batch = storage.kept(distinct(prints.where("late"), "keep_new", "n_new"), "batch")
    buckets = max(1, -(-max(snapshot.count(), batch.count()) // BUCKET))
    found = against(snapshot, snapshot_filters(snapshot, buckets), batch, buckets, docs)

    both = found.select("digest", "keep_old", F.col("n_new").alias("more"), F.col("n_old").alias("less"))
    old = snapshot.join(both.select("digest", "more"), "digest", "left").select("digest", F.lit(False).alias("late"), F.col("keep_old").alias("keep_id"), (F.col("n_old") + F.coalesce("more", F.lit(0))).alias("group_size"))
    new = batch.join(both.select("digest", "keep_old", "less"), "digest", "left").select("digest", F.lit(True).alias("late"), F.coalesce("keep_old", "keep_new").alias("keep_id"), (F.col("n_new") + F.coalesce("less", F.lit(0))).alias("group_size"))
    groups = old.unionByName(new)
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return prints.join(groups, ["digest", "late"]).select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without the documents whose text an earlier id has."""
    with storage.scratch(docs.sparkSession):
        judged = _judged(docs).select("doc_id", F.col("text_sha256").alias("digest"), "kept")
        return storage.without(docs, judged, lambda t: t.mapInArrow(_digested, "doc_id long, text string, digest binary"), BROADCAST_IDS)
