"""Language ID by word-first back-off.

A word is a letter and the letters and combining marks that follow it.  A known word counts
with its log frequency in each language.  An unseen word falls back to
its characters: at each of its places the longest known n-gram, from ``LONGEST`` letters
down to one, gives its log frequencies, and the word counts with their mean.  A text's
score is the softmax of the sums over its words.

Counts come from a bounded, seeded sample of labelled texts, ``SAMPLE`` of each language at
most, so the model is small whatever the corpus is; words need ``WORDS_FROM`` occurrences
in it to be known.  Every text is then scored in full, long ones ``AT_ONCE`` words at a time.

Null texts and texts without a letter are ``und`` with score 0, and so is every text when
there is nothing to learn from.  Languages that score alike go by name, the first one wins.
Empty tables give empty results.  Repeated rows are scored as often as they come.  Further
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyweave.llm import storage

#: Labelled texts of each language that are learnt from at most.
SAMPLE = 500
WORDS_FROM = 2
LONGEST = 4
#: Words beside the known ones whose scores a worker keeps, and the longest that it keeps.
CACHE, CACHE_CHARS = 200_000, 40
#: Words that are looked up at once, fewer than CACHE.
AT_ONCE = 100_000
#: Words of a text from which on its score is not made surer by more of them.
SURE = 40

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _grams(word: str) -> Iterator[str]:
    w = f" {word} "
    for n in range(1, LONGEST + 1):
        for k in range(len(w) - n + 1):
            yield w[k : k + n]


class Model:
    def __init__(self, langs: list[str], known: dict[str, int], grams: dict[str, int], vectors: np.ndarray):
        self.langs, self.known, self.grams = langs, known, grams
        self.row = dict(known)
        self.vectors = np.zeros((len(vectors) + CACHE, len(langs)), np.float32)
        self.vectors[: len(vectors)] = vectors
        self.first = self.used = len(vectors)

    @staticmethod
    def fit(counts: list[tuple[str, str, str, int]]) -> tuple:
        """From (lang, kind, item, n): the arguments of a model.  kind: 'w' or 'g'."""
        langs = sorted({x[0] for x in counts})
        at = {x: k for k, x in enumerate(langs)}
        tables: list[dict[str, np.ndarray]] = [{}, {}]
        for lang, kind, item, n in counts:
            t = tables[kind == "g"]
            if item not in t:
                t[item] = np.zeros(len(langs))
            t[item][at[lang]] += n
        vectors, rows = [], ({}, {})
        for t, row in zip(tables, rows):
            # n-grams of one length share a total, as words do.
            sizes: dict[int, np.ndarray] = {}
            length = (lambda x: len(x)) if t is tables[1] else (lambda x: 0)
            for item, c in t.items():
                sizes[length(item)] = sizes.get(length(item), 0) + c
            for item, c in t.items():
                if t is tables[0] and c.sum() < WORDS_FROM:
                    continue
                p = np.log((c + 0.1) / (sizes[length(item)] + 0.1 * len(t)))
                row[item] = len(vectors)
                vectors.append(p - p.mean())
        return langs, rows[0], rows[1], np.array(vectors, np.float32).reshape(len(vectors), len(langs))

    def _unseen(self, word: str) -> np.ndarray:
        w, found = f" {word} ", []
        for k in range(len(w)):
            for n in range(min(LONGEST, len(w) - k), 0, -1):
                g = self.grams.get(w[k : k + n])
                if g is not None:
                    found.append(g)
                    break
        return self.vectors[found].mean(0) if found else np.zeros(len(self.langs), np.float32)

    def _rows(self, ws: list[str]) -> np.ndarray:
        """The rows of at most AT_ONCE words; those of unseen words are made, each once."""
        rows = np.fromiter(map(self.row.get, ws, repeat(-1)), np.int64, len(ws))
        lost = np.flatnonzero(rows < 0).tolist()
        if lost and self.used + len(lost) > len(self.vectors):  # begin anew
            self.row, self.used = dict(self.known), self.first
            return self._rows(ws)
        now: dict[str, int] = {}
        for k in lost:
            w = ws[k]
            r = now.get(w)
            if r is None:
                r = now[w] = self.used
                self.vectors[r] = self._unseen(w)
                self.used += 1
            rows[k] = r
        self.row.update((w, r) for w, r in now.items() if len(w) <= CACHE_CHARS)
        return rows

    def totals(self, texts: list[list[str]]) -> np.ndarray:
        """The sum of the words' vectors of each text."""
        out = np.zeros((len(texts), len(self.langs)))
        ws = [w for t in texts for w in t]
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        for k in range(0, len(ws), AT_ONCE):
            v, own = self.vectors[self._rows(ws[k : k + AT_ONCE])], owner[k : k + AT_ONCE]
            for j in range(len(self.langs)):
                out[:, j] += np.bincount(own, v[:, j], len(texts))
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        own = [words(t) if t else [] for t in texts]
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        n = np.array([len(ws) for ws in own])
        t = self.totals(own) * np.minimum(1.0, SURE / np.maximum(n, 1))[:, None]
        p = np.exp(t - t.max(1, keepdims=True))
        best = p.argmax(1)
        sure = p[np.arange(len(p)), best] / p.sum(1)
        return [(self.langs[k], x) if some else ("und", 0.0) for k, x, some in zip(best.tolist(), sure.tolist(), (n > 0).tolist())]


_models: dict[str, Model] = {}


def held(fold: int = 4, rest: int = 2):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % fold == rest, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            w = Counter(words(text or ""))
            g: Counter = Counter()
            for word, n in w.items():
                for x in _grams(word):
                    g[x] += n
            if w:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(w) + len(g))), pa.array(["w"] * len(w) + ["g"] * len(g)), pa.array([*w, *g]), pa.array([*w.values(), *g.values()], pa.int64())], ["lang", "kind", "item", "n"])


def fit(train: DataFrame) -> tuple:
    """Model arguments from a sample of ``train`` (doc_id, text, lang)."""
    named = train.where("lang is not null and text is not null")
    # Few rows of a language are ranked: those below a share of the hashes that holds about 4 * SAMPLE.
    sizes = named.groupBy("lang").count().collect()  # a row for each language, as the model has
    share = {r["lang"]: 4.0 * SAMPLE / r["count"] for r in sizes}
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    low = u / F.lit(float(1 << 40)) < F.element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col("lang")) if share else F.lit(False)
    rank = F.row_number().over(W.partitionBy("lang").orderBy(u, "doc_id"))
    pick = named.select("doc_id", "lang").where(low).withColumn("_r", rank).where(F.col("_r") <= SAMPLE).select("doc_id", "lang").distinct()
    sample = named.select("doc_id", "lang", "text").join(F.broadcast(pick), ["doc_id", "lang"]).select("lang", "text")
    counts = sample.mapInArrow(_count, "lang string, kind string, item string, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    # Words that come once say less than their n-grams do.
    common = counts.withColumn("all", F.sum("n").over(W.partitionBy("kind", "item"))).where(F.col("all") >= F.when(F.col("kind") == "w", WORDS_FROM).otherwise(1)).drop("all").toArrow()
    return Model.fit(list(zip(*(common[c].to_pylist() for c in ("lang", "kind", "item", "n")))))


def identify(docs: DataFrame, fold: int = 4, rest: int = 2) -> DataFrame:
    """Learn from documents (doc_id, text, lang) whose crc32(doc_id as text) mod ``fold`` is
    not ``rest``, and predict all: doc_id, held_out, lang_pred, score."""
    storage.small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), held(fold, rest).alias("held_out"))
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.where("not held_out")))
    key = f"{id(model)}-{model._jbroadcast.id()}"

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _models:
            _models.clear()
            _models[key] = Model(*model.value)
        m = _models[key]
        for b in batches:
            found = [x for k in range(0, len(b), 128) for x in m.predict(b.column(2).slice(k, 128).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
