"""Best-fit packing with Martello-Toth dominance reduction.

Documents are cut into pieces of at most ``CAPACITY`` ids; pieces are packed into as few
sequences of that many ids as can be found.

Lengths are integers of a small range, so the whole instance is its histogram: at most
``CAPACITY`` counts, whatever the corpus.  The driver solves that:

1. *Reduction.*  Sets of pieces that provably dominate every other set for one of their
   pieces are fixed, many at a time: a full piece, two that fill a sequence, a piece with
   the largest partner when no two others fit beside it, or when at most two do and the
   partner is at least as long as the best two.  This repeats until nothing changes.
2. *Best fit.*  What is left goes, longest first, to the open sequence with the least room
   that takes it.  Sequences that are filled alike are moved as one group, so the work
   follows the number of lengths, not of pieces.

The answer is a small table of intervals of ranks within a length.  Pieces are ranked
within their length without a single large group: pieces are numbered when they are written,
each length is dealt by a hash of that number into as many parts as its count asks for (at
most ``PARTS``), and parts get their first rank from the counts before them.  The order within
a part is that of the numbers, so a task that runs again gives the same ranks.

Null texts count as empty and hold the end id alone.  A long text is encoded whole; its pieces
are packed one by one.  Repeated rows are packed as often as they come.  A null doc_id is
packed as any other.  An empty table gives an empty result.  Further columns of documents are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyweave.llm import bpe, storage

CAPACITY = 2048
#: Pieces of one length that are ranked together, and parts of a length at most; beyond them
#: parts grow.
PART, PARTS = 500, 1 << 16

#: A kind of sequence: how many there are of it, and (length, copies) in order.
Kind = tuple[int, list[tuple[int, int]]]


def reduction(count: list[int], c: int) -> list[Kind]:
    """Fix dominating sets; takes them out of ``count`` (pieces by length)."""
    fixed: list[Kind] = []

    def fix(n: int, *lengths: int) -> None:
        for w in lengths:
            count[w] -= n
        kind: list[tuple[int, int]] = []
        for w in lengths:
            kind = kind[:-1] + [(w, kind[-1][1] + 1)] if kind and kind[-1][0] == w else [*kind, (w, 1)]
        fixed.append((n, kind))

    changed = True
    while changed:
        changed = False
        if count[c]:
            fix(count[c], c)
            changed = True
        for w in range((c + 1) // 2, c):
            n = count[w] // 2 if 2 * w == c else min(count[w], count[c - w])
            if n:
                fix(n, w, c - w)
                changed = True
        for w in range(c - 1, 0, -1):
            while count[w]:
                room = c - w
                count[w] -= 1  # the others
                least: list[int] = []
                for x in range(1, c + 1):
                    if count[x]:
                        least += [x] * min(count[x], 3 - len(least))
                        if len(least) == 3 or x > room:
                            break
                partner = next((x for x in range(room, 0, -1) if count[x]), 0)
                alone = not partner
                one = partner and (len(least) < 2 or least[0] + least[1] > room)
                two = partner and not one and (len(least) < 3 or sum(least) > room) and _best_two(count, room) <= partner
                count[w] += 1
                if alone:
                    fix(count[w], w)
                elif one or two:
                    fix(count[w] // 2 if partner == w else min(count[w], count[partner]), w, partner)
                else:
                    break
                changed = True
            if count[w] and len(least) == 3 and sum(least) <= c - w:
                break  # shorter pieces leave still more room
    return fixed


def _best_two(count: list[int], room: int) -> int:
    """The largest sum of two pieces that is at most ``room``."""
    best, x = 0, 1
    sizes = [w for w in range(1, min(room, len(count) - 1) + 1) if count[w]]
    y = len(sizes) - 1
    x = 0
    while x <= y:
        s = sizes[x] + sizes[y]
        if s > room or (x == y and count[sizes[x]] < 2):
            y -= 1
        else:
            best = max(best, s)
            x += 1
    return best


def best_fit(count: list[int], c: int) -> list[Kind]:
    """Best-fit decreasing of all pieces in ``count``, alike sequences as one."""
    open_: list[list[Kind]] = [[] for _ in range(c + 1)]
    for w in range(c, 0, -1):
        n, room = count[w], w
        while n:
            while room <= c and not open_[room]:
                room += 1
            if room > c:
                k = c // w
                if n // k:
                    open_[c - k * w].append((n // k, [(w, k)]))
                if n % k:
                    open_[c - n % k * w].append((1, [(w, n % k)]))
                break
            m, held = open_[room].pop()
            k = room // w
            full = min(m, n // k)
            if full:
                open_[room - k * w].append((full, [*held, (w, k)]))
            n -= full * k
            m -= full
            if n and m:
                open_[room - n * w].append((1, [*held, (w, n)]))
                n, m = 0, m - 1
            if m:
                open_[room].append((m, held))
    return [kind for group in open_ for kind in group]


def solve(count: list[int], c: int = CAPACITY) -> list[Kind]:
    count = list(count)
    fixed = reduction(count, c)
    return fixed + best_fit(count, c)


def slots(kinds: list[Kind]) -> np.ndarray:
    """Rows of (length, first rank, sequences, first sequence, offset), by length and rank."""
    rows, used, seq = [], {}, 0
    for n, held in kinds:
        at = 0
        for w, k in held:
            rows.append((w, used.get(w, 0), n, seq, at))
            used[w] = used.get(w, 0) + n * k
            at += w * k
        seq += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, vocabulary: str, end: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids (32-bit little-endian) of all documents (doc_id, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "piece", "start", "length", "ids"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        for b in batches:
            ids, rows, size = b.column(0).to_pylist(), [], 0
            for k, raw in bpe.encoded(b.column(1), vocabulary, end):
                n = len(raw) // 4
                start, piece = 0, 0
                while start < n:
                    length = n % capacity or capacity if not piece else capacity
                    rows.append((ids[k], piece, start, length, raw[4 * start : 4 * (start + length)]))
                    start, piece = start + length, piece + 1
                size += len(raw)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    storage.small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items`` (a column ``length`` from 1 to ``capacity``, and any others) with sequence_id
    and offset; columns of these two names are replaced."""
    items = items.drop("sequence_id", "offset")
    part, first, number, row, rank = (storage.unused(items, x) for x in ("part", "first", "number", "row", "rank"))
    names = items.columns
    items = storage.kept(items.withColumn(number, F.monotonically_increasing_id()), "pieces", files=storage.SCAN_FILES)
    count = [0] * (capacity + 1)
    for r in items.groupBy("length").count().collect():  # at most ``capacity`` rows
        count[r[0]] = r[1]
    table = slots(solve(count, capacity))
    key = (table[:, 0] << 44) + table[:, 1]
    shared = items.sparkSession.sparkContext.broadcast((key, table))

    parts = F.element_at(F.array(*[F.lit(min(PARTS, max(1, -(-n // PART)))) for n in count[1:]]), F.col("length").cast("int"))
    dealt = items.withColumn(part, F.pmod(F.xxhash64(number), parts))
    before = F.sum("count").over(W.partitionBy("length").orderBy(part).rowsBetween(W.unboundedPreceding, -1))
    starts = dealt.groupBy("length", part).count().select("length", part, F.coalesce(before, F.lit(0)).alias(first))
    rows = dealt.withColumn(row, F.row_number().over(W.partitionBy("length", part).orderBy(number)))
    ranked = rows.join(starts, ["length", part]).select(*names, (F.col(first) + F.col(row) - 1).alias(rank))
    n = len(names)
    at = names.index("length")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, table = shared.value
        for b in batches:
            w, rank = b.column(at).to_numpy(), b.column(n).to_numpy()
            t = table[np.searchsorted(key, (w << 44) + rank, "right") - 1]
            q = rank - t[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(t[:, 3] + q % t[:, 2]), pa.array(t[:, 4] + w * (q // t[:, 2]))], [*b.schema.names[:n], "sequence_id", "offset"])

    schema = items.select(*names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    return ranked.mapInArrow(place, schema)
