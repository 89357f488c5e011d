"""Tables and plain files in the folder that all executors share.

``spark.checkpoint.dir`` of the session names that folder.  Only a session in
local mode, where one machine is the whole cluster, may leave it unset.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_root: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """URI of the shared folder: the session's own setting, else a temporary one in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_root:
        _own_root.append(tempfile.mkdtemp(prefix="tallyweave-"))
        atexit.register(shutil.rmtree, _own_root[0], ignore_errors=True)
    return f"file://{_own_root[0]}"


def fresh(spark: SparkSession, tag: str) -> str:
    """URI of a new folder, not made yet."""
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


def folder(spark: SparkSession, tag: str) -> str:
    """:func:`fresh`, deleted at the end of the innermost scratch."""
    path = fresh(spark, tag)
    for made in _open[-1:]:
        made.append(path)
    return path


#: Rows and bytes of an Arrow batch: a worker and its JVM each hold a batch or two of whole
#: texts, and a longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1_000, 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by rows and by bytes; all that read texts call it.

    Plans are made when they run, long after an operator has returned its DataFrame, so the
    settings stay.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


#: What :func:`kept` wrote in each open :func:`scratch`.
_open: list[list[str]] = []


#: Files of a kept table for each core of the cluster, at most: of bare ids and links, of other
#: tables, and of what a pass over texts makes.  Thousands of tiny files cost more than tasks
#: that write several partitions one after another.
LINK_FILES, FILES, SCAN_FILES = 2, 8, 16


def kept(df: DataFrame, tag: str, lasting: bool = False, files: int | None = FILES) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and outlives executors.

    A ``lasting`` table outlives the innermost scratch.  Partitions are put together, without
    a shuffle, into at most ``files`` tasks a core; None: as many tasks as partitions.
    """
    path = fresh(df.sparkSession, tag)
    for made in _open[:-1][-1:] if lasting else _open[-1:]:
        made.append(path)
    (df if files is None else df.coalesce(files * df.sparkSession.sparkContext.defaultParallelism)).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables kept inside of it but for lasting ones."""
    made: list[str] = []
    _open.append(made)
    try:
        yield
    finally:
        _open.pop()
        for path in made:
            remove(spark, path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], tag: str, files: int | None = FILES) -> DataFrame:
    """What ``make`` returns, written; the tables that it kept on its way are deleted."""
    with scratch(spark):
        return kept(make(), tag, lasting=True, files=files)


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until ``df`` has no column of it."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def without(docs: DataFrame, judged: DataFrame, digested, broadcast_ids: int) -> DataFrame:
    """The rows of ``docs``, all columns, without those that ``judged`` (doc_id, digest, kept) does not keep.

    Most go by id alone.  An id of which one text stays and another goes is told by its
    texts, whose digests ``digested`` makes: (doc_id, text) to (doc_id, text, digest).
    Nothing but ``docs`` and lasting tables is read once this has returned.
    """
    name, told = unused(docs, "gone"), unused(docs, "gone_text")
    ids = judged.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("some"), F.bool_and("kept").alias("every"))
    gone = kept(ids.where("not every").select(F.col("doc_id").alias(name), F.col("some").alias("some")), "gone", lasting=True, files=LINK_FILES)
    mixed = gone.where("some").select(F.col(name).alias("doc_id"))
    whole = gone.where("not some").select(name)
    small = gone.count() <= broadcast_ids
    near = F.broadcast if small else lambda df: df
    out = docs.join(near(whole), F.col("doc_id") == F.col(name), "left_anti")
    if mixed.isEmpty():
        return out
    bad = judged.where("not kept").join(near(mixed), "doc_id", "left_semi").select("doc_id", "digest").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(near(mixed), "doc_id", "left_semi")
    pairs = kept(digested(texts).join(bad, ["doc_id", "digest"], "left_semi").select(F.col("doc_id").alias(name), F.col("text").alias(told)).distinct(), "gone", lasting=True, files=LINK_FILES)
    return out.join(pairs, (F.col("doc_id") == F.col(name)) & F.col("text").eqNullSafe(F.col(told)), "left_anti")


def drop(*tables: DataFrame) -> None:
    """Delete what :func:`kept` wrote, once no later plan reads it."""
    for t in tables:
        remove(t.sparkSession, t.kept_at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, for plain files that executors write and read."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def write_stream(folder: str, name: str, suffix: str = ""):
    """Open a new file for a task.  The name is unique for each attempt, so a retried
    task never writes over, and an index never names, a file of a lost attempt."""
    fs, path = open_fs(folder)
    fs.create_dir(path, recursive=True)
    name = f"{name}-{uuid.uuid4().hex}{suffix}"
    return name, fs.open_output_stream(f"{path}/{name}", compression=None)
