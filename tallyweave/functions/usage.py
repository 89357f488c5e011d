"""Usage and cost of calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Dollars a million tokens, and what cached input costs of that.
INPUT_PRICE, OUTPUT_PRICE = 3.00, 15.00
WRITE_RATE, READ_RATE = 1.25, 0.10

FIELDS = ("input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "output_tokens")


def parsed(usage: Column) -> Column:
    """A usage struct whose missing fields are 0."""
    return F.struct(*(F.coalesce(usage[f], F.lit(0)).cast("long").alias(f) for f in FIELDS))


def total_input(u: Column) -> Column:
    return u["input_tokens"] + u["cache_creation_input_tokens"] + u["cache_read_input_tokens"]


def cost(u: Column, input_price: float = INPUT_PRICE, output_price: float = OUTPUT_PRICE) -> Column:
    """Dollars."""
    i, o = F.lit(input_price / 1e6), F.lit(output_price / 1e6)
    return u["input_tokens"] * i + u["cache_creation_input_tokens"] * i * WRITE_RATE + u["cache_read_input_tokens"] * i * READ_RATE + u["output_tokens"] * o


def saved(before: Column, after: Column) -> Column:
    return F.greatest(F.lit(0), before - after)


def saved_pct(before: Column, after: Column) -> Column:
    """In tenths of a percent, half to even as the decimal value is written; 0 of nothing."""
    return F.coalesce(F.bround(F.try_divide(saved(before, after), before) * 100.0, 1), F.lit(0.0))


def stream_usage(events: DataFrame) -> DataFrame:
    """Usage by stream_id of events (stream_id, seq, type, data).

    message_start sets all four fields; the last message_delta that names output_tokens sets
    those, and null counts as 0.
    """
    last = lambda kind, path, also=F.lit(True): F.max_by(F.get_json_object("data", path), F.when((F.col("type") == kind) & also, F.col("seq")))
    start = {f: last("message_start", f"$.message.usage.{f}") for f in FIELDS}
    delta = F.get_json_object("data", "$.usage").contains('"output_tokens"')
    has = F.count_if((F.col("type") == "message_delta") & delta) > 0
    out = events.groupBy("stream_id").agg(*(start[f].alias(f) for f in FIELDS[:3]), F.when(has, last("message_delta", "$.usage.output_tokens", delta)).otherwise(start[FIELDS[3]]).alias(FIELDS[3]))
    return out.select("stream_id", *(F.coalesce(F.col(f).cast("long"), F.lit(0)).alias(f) for f in FIELDS))
