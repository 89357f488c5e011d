"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but
the last return the columns of ``documents``.  Rows of null text are empty documents.
Rows that repeat an id with another text are told apart by their texts.  Rows of a null id
cannot be named, so both dedup stages leave them in; rows that repeat id and text stay or go
together.  An empty table goes through all stages as one, and further columns of documents are
kept up to the last stage, whatever their names.  Texts of any length are read whole.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import decontam, exactdedup, neardup, packing, quality, storage
from tallyweave.llm.queries import vocabulary


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below its threshold go."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document of smallest id stays."""
    return exactdedup.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document of smallest id stays."""
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bestfit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents left, each with its place in a training sequence."""
    pieces = packing.pieces(docs, vocabulary())
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _bounded(stage: Stage) -> Stage:
    """The stage, with Arrow batches of bounded size."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        storage.small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", _bounded(quality_classifier)),
    ("exact_dedup", _bounded(exact_dedup)),
    ("minhash_neardup", _bounded(near_dedup)),
    ("decontamination", _bounded(decontamination)),
    ("bestfit_packing", _bounded(bestfit_packing)),
]

#: A trained network is not expressible in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what a stage keeps is written once and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, storage.settled(spark, functools.partial(stage, spark, docs, sf_dir), name, files=storage.SCAN_FILES)
        if hasattr(before, "kept_at"):
            storage.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
