"""Requests from JSON text and from turn tables, in the nested form of ``schema.REQUEST``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave import schema

_RAW = "struct<model:string,stream:boolean,system:string,tools:array<string>,metadata:string,messages:array<struct<role:string,content:string>>>"
_LISTS = "struct<system:array<struct<text:string,cache_control:string>>,tools:array<struct<cache_control:string>>,x:string>"
_BLOCK = "struct<type:string,text:string,tool_use_id:string,input:string,content:string,cache_control:string>"


def block(kind: str, text: Column, cache: Column | None = None) -> Column:
    """A block that only has text."""
    return F.struct(F.lit(kind).alias("type"), text.alias("text"), F.lit(None).cast("string").alias("tool_use_id"), F.lit(None).cast("string").alias("input"), F.lit(None).cast(f"array<{schema.PART}>").alias("parts"), F.lit(None).cast("boolean").alias("result_is_string"), (F.lit(None).cast("string") if cache is None else cache).alias("cache_control"))


def _truthy(cache: Column) -> Column:
    """cache_control as it counts: null, false, 0 and empty values are none."""
    return F.when(~cache.isin("", "{}", "[]", "false", "0", '""', "null"), cache)


def _blocks(raw: Column) -> Column:
    """The blocks of a list of content in JSON text.

    A bare string among them has type __str__; one that is itself the text of an object is
    taken for a block.
    """

    def one(item: Column) -> Column:
        b = F.from_json(item, _BLOCK)
        parts = F.from_json(b["content"], f"array<{schema.PART}>")
        listed = F.coalesce(F.startswith(F.ltrim(b["content"]), F.lit("[")) & F.forall(parts, lambda p: p.isNotNull()), F.lit(False))
        result = F.when(listed, parts).when(b["content"].isNotNull(), F.array(F.struct(F.lit("text").alias("type"), b["content"].alias("text"))))
        is_result = b["type"] == "tool_result"
        whole = F.struct(b["type"].alias("type"), b["text"].alias("text"), b["tool_use_id"].alias("tool_use_id"), b["input"].alias("input"), F.when(is_result, result).alias("parts"), F.when(is_result, ~listed).alias("result_is_string"), _truthy(b["cache_control"]).alias("cache_control"))
        return F.when(F.startswith(F.ltrim(item), F.lit("{")), whole).otherwise(block("__str__", item))

    return F.transform(F.from_json(raw, "array<string>"), one)


def from_json(rows: DataFrame, value: str = "value", session: str = "session", request_id: str = "request_id") -> tuple[DataFrame, DataFrame]:
    """Requests of JSON bodies, and the rows whose body is no JSON object.

    Content, system text and tool results may be a string or a list; the parsed form tells
    which, so a string that looks like a list stays a string.  Messages with null content
    have an empty list.
    """
    good = F.try_parse_json(F.col(value)).isNotNull() & F.startswith(F.ltrim(F.col(value)), F.lit("{"))
    raw, lists = F.from_json(F.col(value), _RAW), F.from_json(F.col(value), _LISTS)
    kinds = F.expr(f"transform(try_variant_get(try_parse_json(`{value}`), '$.messages', 'array<struct<content:variant>>'), m -> schema_of_variant(m.content))")
    p = rows.where(good).select(F.col(session).alias("session"), F.col(request_id).alias("request_id"), raw.alias("r"), lists.alias("l"), kinds.alias("k"))
    null_text = F.lit(None).cast("string")
    system = F.when(F.col("l.system").isNotNull(), F.transform("l.system", lambda s: F.struct(s["text"].alias("text"), _truthy(s["cache_control"]).alias("cache_control")))).when(F.col("r.system").isNotNull(), F.array(F.struct(F.col("r.system").alias("text"), null_text.alias("cache_control"))))
    tools = F.transform("r.tools", lambda t, i: F.struct(t.alias("spec"), _truthy(F.get(F.col("l.tools"), i)["cache_control"]).alias("cache_control")))

    def message(m: Column, i: Column) -> Column:
        listed = F.startswith(F.get(F.col("k"), i), F.lit("ARRAY"))
        empty = F.lit(None).cast(f"array<{schema.BLOCK}>")
        content = F.when(listed, _blocks(m["content"])).when(m["content"].isNotNull(), F.array(block("text", m["content"]))).otherwise(F.coalesce(empty, F.array().cast(f"array<{schema.BLOCK}>")))
        return F.struct(m["role"].alias("role"), content.alias("content"))

    out = p.select("session", "request_id", system.alias("system"), tools.alias("tools"), F.coalesce(F.transform("r.messages", message), F.array().cast(f"array<{schema.MESSAGE}>")).alias("messages"), F.col("r.metadata").alias("metadata"), F.col("r.model").alias("model"), F.coalesce("r.stream", F.lit(False)).alias("stream"))
    return out, rows.where(~F.coalesce(good, F.lit(False)))


def from_turns(turns: DataFrame) -> DataFrame:
    """One request for each conversation of turns (conv_id, turn, role, text), system turns apart."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))))
    g = turns.where("conv_id is not null").groupBy("conv_id").agg(ordered.alias("t"))
    said = F.transform(F.filter("t", lambda t: t["role"] != "system"), lambda t: F.struct(t["role"].alias("role"), F.array(block("text", t["text"])).alias("content")))
    system = F.transform(F.filter("t", lambda t: t["role"] == "system"), lambda t: F.struct(t["text"].alias("text"), F.lit(None).cast("string").alias("cache_control")))
    return g.select(F.col("conv_id").cast("string").alias("session"), F.col("conv_id").cast("string").alias("request_id"), F.when(F.size(system) > 0, system).alias("system"), F.lit(None).cast(schema.TOOLS).alias("tools"), said.alias("messages"), F.lit(None).cast("string").alias("metadata"), F.lit("any").alias("model"), F.lit(False).alias("stream"))
