"""MinHash near-dedup: SuperMinHash signatures, banding, verification, union-find grouping.

Documents are linked when the Jaccard similarity of their sets of five-word shingles is at
least 0.75; each connected component of links is a group, and the smallest ``doc_id`` of a
group stays.

Steps, with what each of them moves:

1. One pass over the texts gives each document its set size, a 128-bit digest of its whole
   set, and 32 band keys made from a SuperMinHash signature of 128 values.  Nothing but
   these few hundred bytes a document is kept.
2. Documents with equal sets collapse to the one of smallest id (an aggregation that
   combines before it shuffles, so a group of copies of any size costs one row a task).
3. Band keys are grouped.  Each bucket of two or more links its members to its smallest
   member only, never in all pairs; these pairs are verified on full sets.
4. Groups are found.  Only where members of one bucket lie in different groups, the members
   outside of the pivot's group are verified against the rest of that bucket, in blocks of
   bounded size, so no link that a bucket shows is lost.  Then groups are found again.

Nulls, empty texts and texts without words have an empty set and are linked with nothing.
Rows that repeat a ``doc_id`` are all returned; each takes the component of its own set, so
one id on two texts can be in two components, one kept and one not.  Rows with a null
``doc_id`` take no part in links and get a null component.  A long text is read a slice at a
time; its set of shingles, eight bytes each, is held whole.  An empty table gives an empty
result.  Further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import storage
from tallyweave.llm.textnum import mix, shingle_sets, word_batches
from tallyweave.llm.unionfind import components

SIGNATURE = 128
BANDS = 32
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Ids of documents to verify that are broadcast at most, with their digests (32 bytes each);
#: beyond it they are shuffled.
BROADCAST_IDS = 250_000

_U = np.uint64


def superminhash(sets: list[np.ndarray], m: int = SIGNATURE) -> np.ndarray:
    """SuperMinHash signatures (a row for each non-empty set of 64-bit hashes).

    Each element draws, in step j, a rank j + r with r uniform in [0, 1) and the j-th place
    of its own random permutation of the m places (a Fisher-Yates shuffle, grown by one
    swap a step); a place keeps the least rank.  A set stops as soon as all of its places
    hold ranks below j + 1, since later steps only bring larger ones.  All sets that are
    not done yet take a step together.
    """
    n = len(sets)
    sig = np.full((n, m), np.inf)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    seed = mix(np.concatenate(sets)) if n else np.zeros(0, _U)
    perm = None
    for j in range(m):
        draw = mix(seed + _U((2 * j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        rank = (draw >> _U(11)).astype(np.float64) * 2.0**-53
        k = j + (mix(draw) % _U(m - j)).astype(np.int64)
        if j == 0:
            place = k
        else:
            e = np.arange(len(seed))
            place = perm[e, k].astype(np.int64)
            perm[e, k] = perm[:, j]
        np.minimum.at(sig.reshape(-1), owner * m + place, rank + j)
        open_ = (sig >= j + 1).any(1)[owner]
        if not open_.any():
            break
        if j == 0:
            first, seed, owner = k[open_], seed[open_], owner[open_]
            perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.int32), (len(seed), 1))
            e = np.arange(len(seed))
            perm[e, first] = perm[:, 0]
        else:
            seed, owner, perm = seed[open_], owner[open_], perm[open_]
    return sig


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each band of each signature; keys of different bands differ."""
    n, m = sig.shape
    v = mix(np.ascontiguousarray(sig).view(_U)).reshape(n, bands, m // bands)
    out = np.zeros((n, bands), _U) + np.arange(1, bands + 1, dtype=_U) * _U(0xA24BAED4963EE407)
    for i in range(v.shape[2]):
        out = mix(out ^ v[:, :, i]) + _U(i)
    return out.view(np.int64)


_SKETCH = "doc_id long, n_shingles long, digest binary, bands array<long>"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for row, end, h, at in word_batches(batch.column(1)):
            sets = list(shingle_sets(h, at))
            full = [s for s in sets if len(s)]
            keys = iter(band_keys(superminhash(full)).tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(row, end - row),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) for s in sets], pa.binary()),
                    pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "digest", "bands"],
            )


def _digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s, digest_size=16).digest() if len(s) else None


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, h, at in word_batches(batch.column(1)):
            yield pa.RecordBatch.from_arrays([*(c.slice(row, end - row) for c in batch.columns), pa.array([_digest(s) for s in shingle_sets(h, at)], pa.binary())], ["doc_id", "text", "digest"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for row, end, h, at in word_batches(batch.column(1)):
            sets = list(shingle_sets(h, at))
            yield pa.RecordBatch.from_arrays([ids.slice(row, end - row), pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "digest", "set"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets are similar enough."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            both = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x))
            keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    x = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("x"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("set").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_linked, "a long, b long")


def _across(group: pa.Table) -> pa.Table:
    """Links between the outsiders and the members of one block, as many as join their groups.

    Groups that a link has joined count as one from then on, so there are fewer links than
    groups, however many pairs are alike.
    """
    side, rep = group["outside"].to_numpy(), group["rep"].to_numpy()
    sets = [np.frombuffer(x.as_buffer(), _U) for x in group["set"]]
    size = np.array([len(s) for s in sets])
    of = np.unique(group["comp"].to_numpy(), return_inverse=True)[1]
    out = np.flatnonzero(side)
    links: list[tuple[int, int]] = []
    if len(out):
        value = np.concatenate([sets[k] for k in out])
        order = np.argsort(value, kind="stable")
        value, owner = value[order], np.repeat(np.arange(len(out)), size[out])[order]
        for k in np.flatnonzero(~side):
            if (of[out] == of[k]).all():
                continue
            lo, hi = np.searchsorted(value, sets[k], "left"), np.searchsorted(value, sets[k], "right")
            n = hi - lo
            at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(out))
            alike = out[(100 * both >= PERCENT * (size[out] + size[k] - both)) & (of[out] != of[k])]
            for x in alike[np.unique(of[alike], return_index=True)[1]].tolist():
                links.append((min(int(rep[k]), int(rep[x])), max(int(rep[k]), int(rep[x]))))
                of[of == of[x]] = of[k]
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


#: Shingles of the outsiders, and of the members, that one block compares: bound a task's memory.
OUTSIDE, INSIDE = 1 << 19, 1 << 21
#: Rows of outsiders that one block compares at most, and of members at least.
OUT_ROWS, IN_ROWS = 1 << 13, 1 << 9


def _torn_links(of: DataFrame, sets: DataFrame) -> DataFrame:
    """Links across groups in torn buckets.

    ``of`` (home, rep, n, comp) has the members of the torn buckets whose smallest member
    is in the group ``home``.  Those of other groups, the outsiders, are compared with all
    members.  Both sides are dealt into blocks of bounded size; a block compares each of
    its members with all of its outsiders at once, through an index of the outsiders'
    shingles, so neither pairs nor whole groups are ever gathered.
    """
    outside = F.col("comp") != F.col("home")
    total = of.groupBy("home").agg(F.sum(F.when(outside, F.col("n")).otherwise(0)).alias("n_out"), F.count_if(outside).alias("rows_out"), F.sum("n").alias("n_in"), F.count("*").alias("rows_in"))
    parts = F.ceil(F.greatest(F.col("n_out") / OUTSIDE, F.col("rows_out") / OUT_ROWS))
    # A block has no fewer members than outsiders, so copies of the outsiders no more than double the rows.
    least = F.greatest(F.least("rows_out", F.lit(OUT_ROWS)), F.lit(IN_ROWS))
    blocks = F.ceil(F.greatest(F.col("n_in") / INSIDE, F.col("rows_in") / least))
    total = total.select("home", F.greatest(parts, F.lit(1)).alias("parts"), F.greatest(blocks, F.lit(1)).alias("blocks"))
    dealt = of.join(total, "home").withColumn("outside", outside).withColumn("hash", F.xxhash64("rep"))
    part, block = F.pmod("hash", "parts"), F.pmod("hash", "blocks")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    out = dealt.where("outside").select("home", part.alias("part"), every("blocks").alias("block"), "rep", "comp", "outside")
    ins = dealt.select("home", every("parts").alias("part"), block.alias("block"), "rep", "comp", F.lit(False).alias("outside"))
    both = out.unionByName(ins).join(sets.withColumnRenamed("doc_id", "rep"), "rep")
    return both.groupBy("home", "part", "block").applyInArrow(_across, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    return storage.settled(docs.sparkSession, lambda: _grouped(docs).drop("digest"), "groups")


def _grouped(docs: DataFrame) -> DataFrame:
    """near_duplicates with the digest of each row's set."""
    storage.small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = storage.kept(docs.mapInArrow(_sketch, _SKETCH), "sketch", files=storage.SCAN_FILES)

    # Equal sets stand as one: all rows of a digest have the same band keys.
    reps = sketch.where("doc_id is not null and digest is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n"))
    reps = storage.kept(reps.withColumn("rep", F.monotonically_increasing_id()), "reps")
    # A set is known by its smallest id, or by a number where one id stands for several sets.
    several = not reps.groupBy("id").count().where("count > 1").isEmpty()
    if not several:
        reps = reps.withColumn("rep", F.col("id"))
    member = reps.select("rep", "n", F.explode("bands").alias("key"))
    shared = member.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).where("pivot < last").select("key", "pivot")
    bucket = storage.kept(member.join(shared, "key"), "buckets")

    fits = lambda p, q: 100 * F.least(p, q) >= PERCENT * F.greatest(p, q)
    size = reps.select("rep", F.col("n").alias("n_pivot"))
    first = bucket.where("rep <> pivot").select("pivot", "rep", "n").distinct().join(size.withColumnRenamed("rep", "pivot"), "pivot").where(fits(F.col("n"), F.col("n_pivot"))).select(F.col("pivot").alias("a"), F.col("rep").alias("b"))
    first = storage.kept(first, "pairs", files=storage.LINK_FILES)

    wanted = storage.kept(bucket.select("rep").distinct().join(reps.select("rep", F.col("id").alias("doc_id"), "digest"), "rep"), "wanted", files=storage.LINK_FILES)
    small = wanted.count() <= BROADCAST_IDS
    near = F.broadcast if small else lambda df: df
    # A repeated doc_id may come with several texts: the digest says which row is meant.
    texts = docs.join(near(wanted.select("doc_id")), "doc_id", "left_semi")
    sets = texts.mapInArrow(_sets, "doc_id long, digest binary, set binary")
    sets = storage.kept(sets.join(near(wanted), ["doc_id", "digest"]).select(F.col("rep").alias("doc_id"), "set"), "sets")
    sets_one = sets.dropDuplicates(["doc_id"]) if sets.count() != wanted.count() else sets

    links = storage.kept(_verified(first, sets_one), "links")
    comp = components(links)

    # Buckets whose members are in more than one group: the rest of their links.
    of = bucket.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).select("key", "pivot", "rep", "n", "comp")
    torn = of.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min(F.when(F.col("rep") == F.col("pivot"), F.col("comp"))).alias("home")).where("c0 < c1").select("key", "home")
    of = storage.kept(of.join(torn, "key").groupBy("home", "rep").agg(F.first("n").alias("n"), F.first("comp").alias("comp")), "torn", files=storage.LINK_FILES)
    more = storage.kept(_torn_links(of, sets_one), "links")
    comp = storage.kept(components(links.unionByName(more)), "components", files=storage.LINK_FILES)
    if several:
        least = comp.join(reps.select("rep", "id"), F.col("node") == F.col("rep")).groupBy("component").agg(F.min("id").alias("least"))
        comp = storage.kept(comp.join(least, "component").select("node", F.col("least").alias("component")), "components", files=storage.LINK_FILES)
    storage.drop(sets, bucket, of, wanted, first, links, more)

    # Every row takes the component of the row that stands for its set.  Empty sets, which
    # may be many, stand for themselves and are not shuffled.
    by_set = reps.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "id").alias("by_set"))
    some = sketch.where("digest is not null").join(by_set, "digest", "left")
    rows = some.unionByName(sketch.where("digest is null").withColumn("by_set", F.lit(None).cast("long")))
    out = rows.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("by_set", "doc_id")))
    return out.select("doc_id", "digest", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without the documents that near_duplicates drops."""
    with storage.scratch(docs.sparkSession):
        return storage.without(docs, _grouped(docs), lambda t: t.mapInArrow(_digested, "doc_id long, text string, digest binary"), BROADCAST_IDS)
