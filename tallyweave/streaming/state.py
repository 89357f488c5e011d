"""Keyed session state and event streams in Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyweave.functions import usage
from tallyweave.operators.stages import expand_event

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: With a time to live, state needs this mode; a query then ends only when it is stopped.
TTL_MODE = "processingTime"

SESSION_OUT = "session string, turns long, seen long, repeats long, checkpoint_hits long"


class SessionState(StatefulProcessor):
    """Counts a session's turns, its distinct and repeated contents, and turns whose folded
    prefix is unchanged.  ``ttl_ms`` drops the state of sessions that long without a turn."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = {"ttlDurationMs": self.ttl_ms} if self.ttl_ms else {}
        self.totals = handle.getValueState("totals", "turns long, repeats long, hits long, hash string", **ttl)
        self.seen = handle.getMapState("seen", "hash string", "n long", **ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        turns, repeats, hits, last = self.totals.get() if self.totals.exists() else (0, 0, 0, None)
        for batch in rows:
            for h, prefix in zip(batch["hash"], batch["prefix_hash"]):
                n = self.seen.getValue((h,))[0] if self.seen.containsKey((h,)) else 0
                self.seen.updateValue((h,), (n + 1,))
                repeats += n > 0
                prefix = None if pd.isna(prefix) else prefix
                hits += prefix is not None and prefix == last
                last = prefix or last
                turns += 1
        self.totals.update((int(turns), int(repeats), int(hits), last))
        distinct = sum(1 for _ in self.seen.keys())
        yield pd.DataFrame({"session": [key[0]], "turns": [turns], "seen": [distinct], "repeats": [repeats], "checkpoint_hits": [hits]})

    def close(self) -> None:
        pass


def session_state(turns: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """A row for each session and batch of a stream of turns (session, hash, prefix_hash).

    Needs the RocksDB state store (``ROCKSDB``).
    """
    return turns.groupBy("session").transformWithStateInPandas(SessionState(ttl_ms), SESSION_OUT, "update", TTL_MODE if ttl_ms else "none")


def live_usage(events: DataFrame) -> DataFrame:
    """Usage of streams as events (stream_id, seq, type, data) arrive; update or complete mode."""
    return usage.stream_usage(events)


def expanded(events: DataFrame, legends: DataFrame) -> DataFrame:
    """Events (stream_id, session, seq, type, data) with aliases expanded, given a table (session, legend).

    Legends are a static side: sessions without one pass unchanged.
    """
    e = events.join(legends, "session", "left")
    return e.withColumn("data", F.when(F.col("legend").isNull(), F.col("data")).otherwise(expand_event(F.col("type"), F.col("data"), F.col("legend")))).drop("legend")


def assistant_text(events: DataFrame) -> DataFrame:
    """(stream_id, text): the text deltas of a stream put together in order."""
    t = F.when(F.get_json_object("data", "$.delta.type") == "text_delta", F.get_json_object("data", "$.delta.text"))
    d = events.where("type = 'content_block_delta'").select("stream_id", "seq", t.alias("t")).where("t is not null")
    return d.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "t"))), lambda x: x["t"]), "").alias("text"))
