"""Texts and token counts of nested requests, all inside one row: nothing here shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.text import count_tokens, fingerprint


def result_text(b: Column) -> Column:
    """Text of a tool result: its string, or its text parts line by line."""
    return F.array_join(F.transform(F.filter(b["parts"], lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))), "\n")


def block_text(b: Column) -> Column:
    """What counts of a block; other kinds are empty."""
    flat = F.array_join(F.transform(b["parts"], lambda p: F.when(p["type"] == "text", F.coalesce(p["text"], F.lit(""))).otherwise(F.lit(""))), "\n")
    return F.when(b["type"].isin("text", "__str__"), F.coalesce(b["text"], F.lit(""))).when(b["type"] == "tool_result", F.coalesce(flat, F.lit(""))).when(b["type"] == "tool_use", F.coalesce(b["input"], F.lit("{}"))).otherwise(F.lit(""))


def content_text(content: Column) -> Column:
    return F.array_join(F.transform(content, block_text), "\n")


def only_text(content: Column) -> Column:
    """The text blocks alone, line by line."""
    return F.array_join(F.transform(F.filter(content, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "\n")


def system_text(system: Column) -> Column:
    return F.array_join(F.transform(system, lambda s: F.coalesce(s["text"], F.lit(""))), "\n")


def tools_text(tools: Column) -> Column:
    """The tools as JSON text, with the marks that the breakpoint stage adds."""
    spec = lambda t: F.when(t["cache_control"].isNotNull() & ~t["spec"].contains('"cache_control"'), F.concat(F.regexp_replace(t["spec"], r"\}\s*$", ""), F.lit(', "cache_control": '), t["cache_control"], F.lit("}"))).otherwise(t["spec"])
    return F.when(F.size(tools) > 0, F.concat(F.lit("["), F.array_join(F.transform(tools, spec), ", "), F.lit("]")))


def request_tokens(messages: Column | str = "messages", system: Column | str = "system", tools: Column | str = "tools") -> Column:
    """Tokens of system blocks, of messages and of tools."""
    messages, system, tools = (F.col(c) if isinstance(c, str) else c for c in (messages, system, tools))
    zero = F.lit(0).cast("long")
    said = F.aggregate(messages, zero, lambda s, m: s + count_tokens(content_text(m["content"])))
    told = F.aggregate(F.coalesce(system, F.array().cast("array<struct<text:string,cache_control:string>>")), zero, lambda s, b: s + count_tokens(b["text"]))
    return said + told + count_tokens(tools_text(tools))


def result_tokens(messages: Column | str = "messages") -> Column:
    """Tokens of tool results alone."""
    messages = F.col(messages) if isinstance(messages, str) else messages
    zero = F.lit(0).cast("long")
    return F.aggregate(messages, zero, lambda s, m: s + F.aggregate(F.filter(m["content"], lambda b: b["type"] == "tool_result"), zero, lambda t, b: t + count_tokens(result_text(b))))


def tool_heavy(messages: Column, share: float = 0.30) -> Column:
    """Whether more than ``share`` of the messages hold a tool result, or name one in bare text."""
    has = lambda m: F.exists(m["content"], lambda b: b["type"] == "tool_result") | ((F.size(m["content"]) == 1) & F.exists(m["content"], lambda b: (b["type"] == "text") & b["text"].contains("[tool_result]")))
    n = F.size(messages)
    return F.coalesce(F.try_divide(F.size(F.filter(messages, has)), n) > share, F.lit(False))


def has_breakpoints(system: Column, tools: Column, messages: Column) -> Column:
    """Whether the client has set cache_control anywhere."""
    held = lambda xs: F.coalesce(F.exists(xs, lambda x: x["cache_control"].isNotNull()), F.lit(False))
    return held(system) | held(tools) | F.coalesce(F.exists(messages, lambda m: F.exists(m["content"], lambda b: b["cache_control"].isNotNull())), F.lit(False))


def without_cache_control(requests: DataFrame) -> DataFrame:
    """Requests without any cache_control."""
    none = F.lit(None).cast("string")
    clear = lambda xs: F.transform(xs, lambda x: x.withField("cache_control", none))
    return requests.withColumns({"system": clear(F.col("system")), "tools": clear(F.col("tools")), "messages": F.transform("messages", lambda m: m.withField("content", clear(m["content"])))})


def text_blocks(requests: DataFrame, skip_last: int = 0, results: bool = True) -> DataFrame:
    """Non-blank texts and tool results as rows: session, request_id, mi, bi, role, source_type, text."""
    m = requests.select("session", "request_id", F.size("messages").alias("n"), F.posexplode("messages").alias("mi", "m")).where(F.col("mi") < F.col("n") - skip_last)
    b = m.select("session", "request_id", "mi", F.col("m.role").alias("role"), F.posexplode("m.content").alias("bi", "b"))
    kinds = ["text", "tool_result"] if results else ["text"]
    text = F.when(F.col("b.type") == "text", F.coalesce("b.text", F.lit(""))).otherwise(result_text(F.col("b")))
    return b.where(F.col("b.type").isin(kinds)).select("session", "request_id", "mi", "bi", "role", F.col("b.type").alias("source_type"), text.alias("text")).where(F.regexp_like("text", F.lit(r"(?U)\S")))


def last_user_text(messages: Column) -> Column:
    """The text blocks of the last user message, or null without one."""
    users = F.filter(messages, lambda m: m["role"] == "user")
    return only_text(F.try_element_at(users, F.lit(-1))["content"])


def allowed_headers(headers: Column, names: list[str]) -> Column:
    """The entries of a map whose names, in any case, are in ``names``."""
    return F.map_filter(headers, lambda k, v: F.lower(k).isin([n.lower() for n in names]))


def fingerprints(requests: DataFrame) -> DataFrame:
    return requests.select("session", "request_id", fingerprint(F.when(F.size("system") > 0, system_text(F.col("system"))), F.transform("messages", lambda m: content_text(m["content"]))).alias("fingerprint"))
