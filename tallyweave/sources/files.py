"""JSON-lines sources and sinks, and lines of server-sent events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave import schema
from tallyweave.functions import usage


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines of a file, or of all *.jsonl of a folder: (value)."""
    reader = spark.read.option("pathGlobFilter", "*.jsonl") if not path.endswith(".jsonl") else spark.read
    return reader.text(path).where(F.trim("value") != "")


def read_recorded(spark: SparkSession, path: str) -> DataFrame:
    """Recorded calls (ts, session, request, response), the last two as JSON text."""
    return read_lines(spark, path).select(F.from_json("value", schema.RECORDED).alias("r")).select("r.*")


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation tasks of a JSON-lines file."""
    return read_lines(spark, path).select(F.from_json("value", schema.TASK).alias("t")).select("t.*")


def write_tasks(tasks: DataFrame, path: str) -> None:
    """One task a line, without empty fields."""
    tasks.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def split_sessions(rows: DataFrame, path: str) -> int:
    """Write recorded rows to a folder for each session; returns how many there are."""
    rows.write.mode("overwrite").partitionBy("session").json(path)
    return rows.agg(F.count_distinct("session")).first()[0]


def record(rows: DataFrame, path: str) -> None:
    """Append recorded calls (ts, session, request, response) to the folders of their sessions."""
    rows.write.mode("append").partitionBy("session").json(path)


def event_lines(lines: DataFrame) -> DataFrame:
    """Server-sent events from lines (stream_id, seq, line): (stream_id, seq, kind, type, data).

    kind is blank, comment, event, done, json or raw (data that is no JSON, passed through).
    """
    line = F.col("line")
    data = F.trim(F.substring(line, 6, 2**30))
    js = F.try_parse_json(data).isNotNull()
    kind = F.when(F.trim(line) == "", "blank").when(F.startswith(line, F.lit(":")), "comment").when(F.startswith(line, F.lit("event:")), "event").when(~F.startswith(line, F.lit("data:")), "other").when(data == "[DONE]", "done").when(js, "json").otherwise("raw")
    return lines.select("stream_id", "seq", kind.alias("kind"), F.when(kind == "json", F.get_json_object(data, "$.type")).alias("type"), F.when(kind.isin("json", "raw"), data).alias("data"))


def estimate_rows(compressed: DataFrame) -> DataFrame:
    """Metrics rows of compressed requests (session, tokens_in, tokens_out, stream, audit)."""
    stages = F.transform("audit", lambda a: F.struct(a["name"].alias("name"), a["before"].alias("before"), a["after"].alias("after"), usage.saved(a["before"], a["after"]).alias("saved"), a["note"].alias("note")))
    return compressed.select(F.lit("estimate").alias("kind"), F.current_timestamp().alias("ts"), "session", "tokens_in", "tokens_out", usage.saved(F.col("tokens_in"), F.col("tokens_out")).alias("saved"), usage.saved_pct(F.col("tokens_in"), F.col("tokens_out")).alias("saved_pct"), F.col("stream").alias("streaming"), stages.alias("stages"))


def usage_rows(calls: DataFrame) -> DataFrame:
    """Metrics rows of calls (session, usage, estimated_input) as the service counted them."""
    u = usage.parsed(F.col("usage"))
    return calls.select(F.lit("ground_truth").alias("kind"), F.current_timestamp().alias("ts"), "session", u.alias("usage"), usage.total_input(u).alias("total_input"), F.bround(usage.cost(u), 6).alias("cost_usd"), F.col("estimated_input").alias("estimated_compressed_input"))


def write_metrics(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


STATE = "session string, created_at double, updated_at double, legend array<struct<alias:string,original:string>>, checkpoint_text string, checkpoint_covers int, checkpoint_hash string, seen map<string,long>"


#: Snapshots that are left beside the newest, for readers that have one of them open.
OLD_STATES = 2


def _versions(spark: SparkSession, path: str) -> tuple:
    """The file system, its Path, and the numbers of the whole snapshots below ``path``."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(hadoop(path))] if fs.exists(hadoop(path)) else []
    return fs, hadoop, sorted(int(x[1:]) for x in names if x[:1] == "v" and x[1:].isdigit())


def save_state(states: DataFrame, path: str) -> None:
    """Write a snapshot of session states as the next version below ``path``.

    A version gets its name by one rename once it is whole and is never written again, so
    at any moment the highest one is whole; ``OLD_STATES`` older ones stay for open readers.
    For one writer at a time: the rename of a second one for the same number is an error.
    """
    fs, hadoop, held = _versions(states.sparkSession, path)
    new = f"{path}/writing-{uuid.uuid4().hex}"
    states.write.parquet(new)
    number = held[-1] + 1 if held else 1
    if fs.exists(hadoop(f"{path}/v{number}")) or not fs.rename(hadoop(new), hadoop(f"{path}/v{number}")):
        raise FileExistsError(f"{path}/v{number} was written meanwhile")
    for n in held[: max(0, len(held) - OLD_STATES)]:
        fs.delete(hadoop(f"{path}/v{n}"), True)


def load_state(spark: SparkSession, path: str) -> DataFrame:
    """The newest snapshot below ``path`` with the columns of ``STATE``: unknown ones are
    dropped, missing ones are null, and without a snapshot it is empty."""
    held = _versions(spark, path)[2]
    return spark.read.schema(STATE).parquet(f"{path}/v{held[-1]}") if held else spark.createDataFrame([], STATE)
