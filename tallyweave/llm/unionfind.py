"""Connected components of a table of links, by union-find.

Each task first joins the links it holds with a union-find forest of its own and gives on
one link a node.  The forests are then merged with alternating large-star and small-star
steps on aggregations that combine before they shuffle.  No node's links are gathered in
one place, and nothing but a count and a checksum of a step goes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import storage


def forest(links: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Each node but the roots, with the smallest node that it is connected with."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := up.get(x, x)) != x:
            up[x] = x = up.get(p, p)
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(up)}


#: Links that a task joins at once: bounds its memory, whatever its share is.
LINKS_AT_ONCE = 2_000_000


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(held: list) -> pa.RecordBatch:
        f = forest((a, b) for x, y in held for a, b in zip(x, y))
        return pa.RecordBatch.from_arrays([pa.array(list(f), pa.int64()), pa.array(list(f.values()), pa.int64())], ["v", "u"])

    held, n = [], 0
    for b in batches:
        held.append((b.column(0).to_pylist(), b.column(1).to_pylist()))
        n += len(b)
        if n >= LINKS_AT_ONCE:
            yield out(held)
            held, n = [], 0
    if held:
        yield out(held)


def components(links: DataFrame) -> DataFrame:
    """(node, component: the smallest node reachable) for each node of ``links`` (a, b), both long.

    Null ends are ignored, and so are links of a node with itself.  An empty table gives an
    empty one.
    """
    e = storage.kept(links.where("a is not null and b is not null and a <> b").select("a", "b").mapInArrow(_local, "v long, u long"), "star", files=storage.LINK_FILES)
    last = None
    while True:
        # e holds links v -> u with u < v.  Large star: each neighbour above v goes to the least neighbour of v.
        both = e.select("v", "u").union(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("m", "v").alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        # Small star: the neighbours below v, and v, go to the least of them.
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("x")).select("x.v", "x.u").where("v <> u").distinct()
        before, e = e, storage.kept(small, "star", files=storage.LINK_FILES)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        storage.drop(before)
        if now == last:
            return e.select(F.col("v").alias("node"), F.col("u").alias("component")).union(e.select("u", "u").distinct())
        last = now
