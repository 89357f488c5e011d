"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item is found in a document when at least 75 of 100 of the item's distinct
five-word shingles are in the document, wherever they stand and however long the document
is.  (An item of fewer words is one shingle of its own width; one without words is never
found.)

Plain MinHash compares sets of like size; a short item in a long document needs
*containment*.  Items are therefore partitioned by the size of their sets, up to 1, 2, 4, 8,
... shingles, and each partition has a sketch size k and a threshold of its own (see
``partition``).  An item's sketch is its k shingles of least hash; the share of them that a
document's shingles hold estimates the containment.  A document that holds 75 of 100 of an
item can lack but a quarter of it, so at least ``need`` of its k sketch values are in the
document: candidates are the pairs that reach that threshold, no match is missed, and a
passage or two that an item shares with many documents makes no candidate.  Candidates are
then verified by exact containment of the full sets.

The documents are read once and nothing of them is shuffled.  The items' sketches are
broadcast in blocks of at most ``BLOCK_BYTES`` of item text; more items take more blocks.

Null and empty texts match nothing.  Null ids are returned as they are.  Repeated rows of
either side give repeated pairs.  A long text is read a slice at a time and searched as one.
An empty table on either side gives no pair, and without items all documents are clean.
Further columns are ignored by ``leaks`` and kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import storage
from tallyweave.llm.textnum import SHINGLE, mix, shingles, word_batches

PERCENT = 75
#: Text of the items that are broadcast together.
BLOCK_BYTES = 32 << 20

_U = np.uint64
_BITS = 20


def partition(n: int) -> tuple[int, int]:
    """Sketch size k and least number of hits of the items of ``n`` shingles.

    In the partition of sizes up to ``most``, a match lacks at most a quarter of an item's
    shingles, so k is that and ``need`` more, an eighth of the largest size.  Smaller items
    of the partition lack fewer, so they reach the threshold all the more.
    """
    most = 1 << (n - 1).bit_length()
    need = max(1, most // 8)
    return most - -(-PERCENT * most // 100) + need, need


class Sketches:
    """The searchable form of one block of items."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.ids, self.sets, self.width = [], [], []
        if items:
            for row, end, h, at in word_batches(pa.array([t for _, t in items], pa.large_string())):
                for i, a, b in zip(range(row, end), at[:-1].tolist(), at[1:].tolist()):
                    if b > a:
                        self.ids.append(items[i][0])
                        self.width.append(min(SHINGLE, b - a))
                        self.sets.append(np.unique(shingles(h[a:b], self.width[-1])))
        self.need = np.array([partition(len(s))[1] for s in self.sets], np.int64)
        #: By width: sketch values in order, the item of each, and a bit table that screens probes.
        self.index: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for width in set(self.width):
            own = [k for k, w in enumerate(self.width) if w == width]
            least = [s[np.argsort(mix(s))[: partition(len(s))[0]]] for s in (self.sets[k] for k in own)]
            value, item = np.concatenate(least), np.repeat(own, [len(x) for x in least])
            order = np.lexsort((item, value))
            bit = np.zeros(1 << _BITS, bool)
            bit[(value >> _U(64 - _BITS)).astype(np.int64)] = True
            self.index[width] = value[order], item[order], bit

    def _candidates(self, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
        """(row, item's number) of the pairs whose sketch hits reach the item's threshold."""
        for width, (value, item, bit) in self.index.items():
            g = shingles(h, width)
            pos = np.flatnonzero(bit[(g >> _U(64 - _BITS)).astype(np.int64)])
            first = np.searchsorted(value, g[pos], "left")
            hit = value[np.minimum(first, len(value) - 1)] == g[pos]
            pos, first = pos[hit], first[hit]
            doc = np.searchsorted(at, pos, "right") - 1
            whole = pos + width <= at[doc + 1]
            # Each value counts once a document; then all items that have it in their sketch.
            doc, first = np.divmod(np.unique(doc[whole] * len(value) + first[whole]), len(value))
            n = np.searchsorted(value, value[first], "right") - first
            entry = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            pair, hits = np.unique(np.repeat(doc, n) * len(self.ids) + item[entry], return_counts=True)
            d, k = np.divmod(pair, len(self.ids))
            enough = hits >= self.need[k]
            yield from zip(d[enough].tolist(), k[enough].tolist())

    def find(self, col: pa.Array) -> Iterator[tuple[int, int, int]]:
        """(row, item's number, shingles shared) for each item found in each text of a column."""
        for row, _, h, at in word_batches(col):
            hits = self._candidates(h, at)
            sets: dict[tuple[int, int], np.ndarray] = {}
            for d, k in sorted(hits):
                key = d, self.width[k]
                if key not in sets:
                    sets = {x: s for x, s in sets.items() if x[0] == d} | {key: np.unique(shingles(h[at[d] : at[d + 1]], self.width[k]))}
                both = int(np.isin(self.sets[k], sets[key], assume_unique=True).sum())
                if 100 * both >= PERCENT * len(self.sets[k]):
                    yield row + d, k, both


def blocks(items: DataFrame) -> Iterator[Sketches]:
    """The items (item_id, text), a block of bounded size at a time."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES) or 1
    for k in range(n):
        own = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield Sketches([(r[0], r[1]) for r in own.toLocalIterator()])


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) for each item found in each document."""
    sc = docs.sparkSession.sparkContext
    storage.small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for sketches in blocks(items):
        shared = sc.broadcast(sketches)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            s = shared.value
            for b in batches:
                found = list(s.find(b.column(1)))
                n = [len(s.sets[k]) for _, k, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array([r for r, _, _ in found], pa.int64())),
                        pa.array([s.ids[k] for _, k, _ in found], pa.int64()),
                        pa.array([c for _, _, c in found], pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array([c / m for (_, _, c), m in zip(found, n)], pa.float64()),
                    ],
                    ["doc_id", "item_id", "n_shared", "n_item", "containment"],
                )

        part = docs.mapInArrow(search, "doc_id long, item_id long, n_shared long, n_item long, containment double")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, in whose ``text`` no item is found."""
    sc = docs.sparkSession.sparkContext
    storage.small_batches(docs.sparkSession)
    at = docs.columns.index("text")
    for sketches in blocks(items):
        shared = sc.broadcast(sketches)

        def passed(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                text = b.column(at)
                keep = np.ones(len(b), bool)
                keep[[r for r, _, _ in shared.value.find(text if pa.types.is_string(text.type) or pa.types.is_large_string(text.type) else pc.cast(text, pa.string()))]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(passed, docs.schema)
    return docs
