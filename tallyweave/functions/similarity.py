"""Hashed bags of words and letters, their cosines, and thresholds over these.

A text's vector counts, in 256 places, its lower-cased words and marks and its three-letter
windows in original case; an item's place is its MD5 modulo 256, the digest's last byte.
Vectors stay integers, so sums do not depend on their order, and a cosine is the dot product
over the root of the product of the squared norms, rounded to nine places.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyweave.functions.text import TOKEN

PLACES = 256
BINS = 100
#: Where there is nothing to separate.
DEFAULT_THRESHOLD = 0.93
#: The centre of the first bin.
FIRST_CENTRE = 0.5 / BINS


def grams(text: Column) -> Column:
    """Words and marks of the lower-cased text, and all windows of three characters."""
    return F.concat(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.regexp_extract_all(text, F.lit("(?s)(?=(...))."), F.lit(1)))


def place(gram: Column) -> Column:
    return F.conv(F.substring(F.md5(gram), 31, 2), 16, 10).cast("int")


def buckets(items: DataFrame, *keys: str) -> DataFrame:
    """(keys, bucket, n) of items (keys, text): equal grams are counted before they are hashed."""
    one = items.select(*keys, F.explode(grams(F.col("text"))).alias("gram")).groupBy(*keys, "gram").count()
    return one.groupBy(*keys, place(F.col("gram")).alias("bucket")).agg(F.sum("count").alias("n"))


_GRAM = re.compile(r"\w+|[^\w\s]")


@lru_cache(1 << 17)
def _place(gram: str) -> int:
    return hashlib.md5(gram.encode()).digest()[15]


def vector(text: str) -> np.ndarray:
    """The vector of one text, for use inside Arrow functions."""
    v = np.zeros(PLACES, np.int64)
    for g in _GRAM.findall(text.lower()):
        v[_place(g)] += 1
    for k in range(len(text) - 2):
        v[_place(text[k : k + 3])] += 1
    return v


def cosines(vectors: np.ndarray) -> np.ndarray:
    """All pairs' cosines; 0 with a text that has no grams."""
    dot = (vectors.astype(np.float64) @ vectors.T.astype(np.float64))
    n = np.diagonal(dot)
    norm = np.sqrt(n[:, None] * n[None, :])
    return np.round(np.minimum(np.divide(dot, norm, out=np.zeros_like(dot), where=norm > 0), 1.0), 9)


def _all_pairs(texts: pd.Series) -> pd.Series:
    out = []
    for ts in texts:
        cos = cosines(np.stack([vector(t or "") for t in ts]))
        out.append([{"i": i, "j": j, "cos": float(cos[i, j])} for i in range(len(ts)) for j in range(i + 1, len(ts))])
    return pd.Series(out)


def pair_cosines(items: DataFrame, group: str, order: str) -> DataFrame:
    """(group, i, j, cos) for i before j in each group of items (group, order, text).

    A group is a session, which is a row of bounded size here as everywhere: pairs grow with
    the number of sessions, not with its square.  One Arrow call compares all pairs of a
    session; pairs without a shared bucket have cosine 0.
    """
    row = items.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t")))).alias("x"))
    pairs = row.withColumn("p", F.pandas_udf(_all_pairs, "array<struct<i:int,j:int,cos:double>>")(F.transform("x", lambda e: e["t"]))).select(group, "x", F.explode("p").alias("p"))
    return pairs.select(group, F.get("x", F.col("p.i"))["o"].alias("i"), F.get("x", F.col("p.j"))["o"].alias("j"), F.col("p.cos").alias("cos"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays; arrays of different lengths are an error."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    same = F.when(F.size(a) == F.size(b), dot(a, b)).otherwise(F.raise_error("arrays of different lengths"))
    return F.coalesce(F.try_divide(same, F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))


def histogram(pairs: DataFrame, *keys: str) -> DataFrame:
    """(keys, bin, n): cosines by hundredths of [0, 1], the last bin closed; others are left out."""
    inside = pairs.where("cos >= 0 and cos <= 1")
    return inside.groupBy(*keys, F.least(F.floor(F.col("cos") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def otsu(pairs: DataFrame, *keys: str, one_bin: float = DEFAULT_THRESHOLD) -> DataFrame:
    """(keys, pairs, threshold) by Otsu's method over the histogram.

    The centre of the first bin after which the variance between the two classes is largest;
    the default for fewer than three pairs, ``one_bin`` where all are in one bin.
    """
    h = histogram(pairs, *keys)
    bins = h.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("bin")).join(h, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    centre = (F.col("bin") + 0.5) / BINS
    every, upto = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("bin")
    w = bins.withColumn("c", centre).withColumn("total", F.sum("n").over(every)).withColumn("mass", F.sum(F.col("n") * F.col("c")).over(every)).withColumn("n0", F.sum("n").over(upto)).withColumn("m0", F.sum(F.col("n") * F.col("c")).over(upto))
    over = lambda a, b: F.try_divide(a, b)
    n1 = F.col("total") - F.col("n0")
    between = F.round(over(F.col("n0"), F.col("total")) * over(n1, F.col("total")) * F.pow(over(F.col("m0"), F.col("n0")) - over(F.col("mass") - F.col("m0"), n1), 2), 12)
    split = w.withColumn("var", F.when((F.col("n0") > 0) & (F.col("n0") < F.col("total")), between))
    best = split.groupBy(*keys).agg(F.first("total").alias("pairs"), F.max_by("c", F.when(F.col("var").isNotNull(), F.struct("var", -F.col("bin")))).alias("t"))
    return best.select(*keys, "pairs", F.when(F.col("pairs") < 3, F.lit(DEFAULT_THRESHOLD)).otherwise(F.coalesce("t", F.lit(one_bin))).alias("threshold"))


def otsu_of(values: np.ndarray, one_bin: float = DEFAULT_THRESHOLD) -> float:
    """The same over one group's cosines, for use inside Arrow functions."""
    values = values[(values >= 0) & (values <= 1)]
    if len(values) < 3:
        return DEFAULT_THRESHOLD
    n = np.bincount(np.minimum(np.floor(values * BINS), BINS - 1).astype(int), minlength=BINS).astype(float)
    c = (np.arange(BINS) + 0.5) / BINS
    n0, m0 = np.cumsum(n), np.cumsum(n * c)
    n1 = n0[-1] - n0
    ok = (n0 > 0) & (n1 > 0)
    if not ok.any():
        return one_bin
    with np.errstate(invalid="ignore", divide="ignore"):
        var = np.where(ok, np.round(n0 / n0[-1] * (n1 / n0[-1]) * (m0 / n0 - (m0[-1] - m0) / n1) ** 2, 12), -1)
    return float(c[int(var.argmax())])


def dynamic_threshold(base: Column, tokens: Column, limit: int = 180_000, lexical: bool = True) -> Column:
    """Lowered as a request fills its context, capped for lexical vectors, within [0.80, 0.97]."""
    t = base - 0.13 * F.greatest(F.lit(0.0), (tokens / F.lit(float(limit)) - 0.5) * 2.0)
    return F.least(F.greatest(F.least(t, F.lit(0.90)) if lexical else t, F.lit(0.80)), F.lit(0.97))


#: Query vectors that are broadcast together.
QUERY_BLOCK = 4096


def top_cosines(vectors: DataFrame, k: int, query: Column, block: int | None = None) -> DataFrame:
    """(vec_id, other, cos, rank): the k nearest of each row that ``query`` selects, against all rows.

    ``vectors`` (vec_id, embedding).  Queries are broadcast a block of bounded size at a
    time; each task keeps the k best of its rows for each query, so what is shuffled is k
    rows for each query and task.  Null and zero vectors are near to nothing.
    """
    block = block or QUERY_BLOCK
    sc = vectors.sparkSession.sparkContext
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = rows.where(query)
    n = max(1, -(-asked.count() // block))
    out = None
    for b in range(n):
        own = asked if n == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == b)
        got = own.collect()
        q = np.array([r[1] for r in got], float).reshape(len(got), -1)
        size = np.linalg.norm(q, axis=1)
        shared = sc.broadcast((np.array([r[0] for r in got]), np.divide(q, size[:, None], out=np.zeros_like(q), where=size[:, None] > 0)))

        def near(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best: tuple | None = None
            for batch in batches:
                if not len(batch) or not len(ids):
                    continue
                other = batch.column(0).to_numpy()
                x = np.array(batch.column(1).to_pylist(), float)
                norm = np.linalg.norm(x, axis=1)
                x = np.divide(x, norm[:, None], out=np.zeros_like(x), where=norm[:, None] > 0)
                cos = np.round(q @ x.T, 9)
                cos[ids[:, None] == other[None, :]] = -np.inf
                o = np.broadcast_to(other, cos.shape)
                if best is not None:
                    cos, o = np.concatenate([best[0], cos], 1), np.concatenate([best[1], o], 1)
                keep = np.lexsort((o, -cos), axis=1)[:, :k]
                best = np.take_along_axis(cos, keep, 1), np.take_along_axis(o, keep, 1)
            if best is not None:
                ok = np.isfinite(best[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, ok.sum(1))), pa.array(best[1][ok]), pa.array(best[0][ok])], ["vec_id", "other", "cos"])

        part = rows.mapInArrow(near, "vec_id long, other long, cos double")
        out = part if out is None else out.unionByName(part)
    w = W.partitionBy("vec_id").orderBy(F.desc("cos"), "other")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
