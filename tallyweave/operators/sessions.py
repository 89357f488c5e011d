"""Batch views of session state: eviction, content counters, checkpoint memo and cache simulation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyweave.functions import text


def evict(sessions: DataFrame, now: Column, ttl_seconds: float, most: int) -> DataFrame:
    """Sessions (session, updated_at) that stay: none older than the limit, and the latest ``most``.

    The latest are found by each task's own latest and a merge of these, so nothing is
    gathered but ``most`` rows of a task.
    """
    alive = sessions.where(F.col("updated_at") >= now - F.make_dt_interval(secs=F.lit(ttl_seconds)))
    return alive.orderBy(F.desc("updated_at"), "session").limit(most)


def seen_hashes(texts: DataFrame, *keys: str) -> DataFrame:
    """How often each content was seen: (keys, hash, n) of texts (keys, text)."""
    return texts.groupBy(*keys, text.content_hash(F.col("text")).alias("hash")).agg(F.count("*").alias("n"))


def memo_hits(prefixes: DataFrame) -> DataFrame:
    """Whether a turn's folded prefix (session, turn, hash) is that of the turn before, so its summary can stay."""
    w = W.partitionBy("session").orderBy("turn")
    return prefixes.withColumn("hit", F.coalesce(F.col("hash") == F.lag("hash").over(w), F.lit(False)))


def mock_usage(calls: DataFrame) -> DataFrame:
    """Usage that a simulated service reports for calls (seq, first_text, tokens, breakpoint, needle).

    From the second call with the same first message on, a request with breakpoints reads
    six tenths of its tokens from the cache.  The answer is the needle, unless the request
    is very small and its size divisible by seven.
    """
    sig = F.substring(F.sha1("first_text"), 1, 10)
    first = calls.groupBy(sig.alias("_sig")).agg(F.min("seq").alias("_first"))  # combines before it shuffles
    calls = calls.withColumn("_sig", sig).join(first, "_sig").drop("_sig")
    again = F.col("seq") > F.col("_first")
    cached = F.when(F.col("breakpoint") & again, F.floor(F.col("tokens") * 6 / 10)).otherwise(0).cast("long")
    lost = (F.col("tokens") < 60) & (F.col("tokens") % 7 == 0)
    answer = F.when(F.col("needle").isNull(), "Done.").when(lost, "").otherwise(F.concat(F.lit("Answer: "), F.col("needle"), F.lit(".")))
    out = calls.withColumn("cache_read_input_tokens", cached).withColumn("answer", answer).drop("_first")
    return out.withColumn("input_tokens", F.greatest(F.lit(1), F.col("tokens") - F.col("cache_read_input_tokens"))).withColumn("cache_creation_input_tokens", F.lit(0).cast("long")).withColumn("output_tokens", F.greatest(F.lit(1), F.floor(F.length("answer") / 4)).cast("long"))
