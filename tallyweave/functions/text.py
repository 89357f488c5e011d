"""Text functions as Column expressions: all run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The default token counter: words, and marks one by one.  The same in Java's regexes and in RE2.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
#: White space as str.strip() and \s have it in Python.
_EDGE = r"(?U)^\s+|\s+$"


_counter: list[Callable[[Column], Column]] = []


def use_counter(counter: Callable[[Column], Column] | None) -> None:
    """Count tokens by another function of a text Column from now on, everywhere; None: by the default.

    Tokens are counted inside array functions too, where Spark takes built-in functions but
    no Python or Arrow ones.
    """
    _counter[:] = [counter] if counter else []


def count_tokens(text: Column) -> Column:
    """Tokens of a text; null and empty have none."""
    n = _counter[0](text) if _counter else F.regexp_count(text, F.lit(TOKEN))
    return F.coalesce(n, F.lit(0)).cast("long")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, _EDGE, "")


def content_hash(text: Column, n: int = 12) -> Column:
    return F.substring(F.sha1(text), 1, n)


def sentences(text: Column) -> Column:
    """Split after . ! ? before white space, and at line ends; stripped, none empty."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])(?U:\s+)|\n+"), stripped), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n\n"), stripped), lambda s: s != "")


def fenced(text: Column) -> Column:
    """The first fenced (plain, diff or patch) block, else the whole text."""
    return F.when(F.regexp_count(text, F.lit("(?s)```(?:diff|patch)?\n.*?```")) > 0, F.regexp_extract(text, "(?s)```(?:diff|patch)?\n(.*?)```", 1)).otherwise(text)


NEEDLE = r"NEEDLE=([\p{L}\p{N}_]+)"


def needle(text: Column) -> Column:
    """The word after the first NEEDLE=, or null."""
    return F.nullif(F.regexp_extract(text, NEEDLE, 1), F.lit(""))


def first_needle(texts: Column) -> Column:
    """Of an array of texts in order: the first needle."""
    return F.get(F.filter(F.transform(texts, needle), lambda x: x.isNotNull()), 0)


def alias_name(i: Column) -> Column:
    return F.concat(F.lit("@a"), i.cast("string"))


def entry_cost(alias: Column, original: Column) -> Column:
    return count_tokens(F.concat(alias, F.lit(" = "), original, F.lit("\n")))


def per_use_saving(alias: Column, original: Column) -> Column:
    return count_tokens(original) - count_tokens(alias)


def _longest_first(pairs: Column, by: str) -> Column:
    """Array of (alias, original), longest ``by`` first, in the given order among equals."""
    held = F.transform(pairs, lambda p, i: F.struct((-F.length(p[by])).alias("k"), i.alias("i"), p["alias"].alias("alias"), p["original"].alias("original")))
    return F.array_sort(held)


def substitute(text: Column, legend: Column) -> Column:
    """Replace originals by their aliases, longest original first."""
    return F.aggregate(_longest_first(legend, "original"), text, lambda t, p: F.replace(t, p["original"], p["alias"]))


def expand(text: Column, legend: Column) -> Column:
    """Replace aliases by their originals, longest alias first, so @a10 goes before @a1."""
    return F.aggregate(_longest_first(legend, "alias"), text, lambda t, p: F.replace(t, p["alias"], p["original"]))


def starts_with_any(text: Column, prefixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.startswith(text, F.lit(p)) for p in prefixes))


def fingerprint(system: Column, texts: Column) -> Column:
    """A conversation's id from its system text and first three messages; without system text it is two quotes."""
    anchor = F.array_join(F.transform(F.slice(texts, 1, 3), lambda t: F.substring(t, 1, 1000)), "||")
    return F.substring(F.sha2(F.concat(F.substring(F.coalesce(system, F.lit('""')), 1, 2000), F.lit("|||"), anchor), 256), 1, 24)
