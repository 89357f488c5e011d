"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into blocks of ``BLOCK`` bytes; two neighbouring blocks are a chunk,
so chunks overlap by half and cover the whole text, however long it is.  Bytes are embedded,
``FILTERS`` learned filters of ``WIDTH`` bytes run over them, and each filter is max-pooled
over each chunk.  To these come how full the chunk is and how many different four-byte
sequences it has.  The latter stays because filters, which see eight bytes at a time, cannot
tell repetition: without it, the held-out part of ``check_s`` lost 0.5% of its good documents
and kept 2.4% of the bad ones, with it none.  A hidden layer turns a chunk into ``HIDDEN``
values, and their maximum and mean over all chunks give one probability.

The network is fitted on the driver to at most ``SAMPLE`` labelled texts of each label,
taken in the order of a hash of their ids, weighted to the labels' shares; of these, texts
beyond ``SAMPLE_BYTES`` of a label together, or longer than ``SAMPLE_LONGEST``, are not learnt
from.  All texts are scored in one pass without a shuffle, in slices of bounded size; a text
longer than a slice goes through slice by slice.

Null and empty texts are one empty chunk, and an empty table gives an empty result.  Without labels of both kinds every score is the
share of label 1 (0.5 without any).  Documents with several labels count once, with the
smallest, and of several texts of an id the smallest is learnt from.  Repeated rows are scored as often as they come; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyweave.llm import storage
from tallyweave.llm.textnum import text_buffers

#: Labelled texts of each label that are learnt from at most.
SAMPLE = 1500
#: Bytes of the texts of a label that are learnt from at most, and of the longest of them.
SAMPLE_BYTES, SAMPLE_LONGEST = 32 << 20, 1 << 20
EPOCHS = 10
THRESHOLD = 0.3

EMBED, WIDTH, STRIDE, FILTERS, HIDDEN = 6, 8, 2, 24, 12
BLOCK = 256
#: Bytes that go through the filters at once.
SLICE = 1 << 17


def _blocks(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts laid out in whole blocks with at least WIDTH zero bytes after each, and block offsets."""
    size = np.diff(offs)
    n = (size + WIDTH + BLOCK - 1) // BLOCK
    at = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(int(at[-1]) * BLOCK + WIDTH, np.uint8)
    if len(buf):
        out[np.arange(len(buf)) + np.repeat(at[:-1] * BLOCK - offs[:-1], size)] = buf
    return out, at


def _variety(x: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """For each block, which of 256 buckets its four-byte sequences fall into, and how full it is."""
    n = blocks * BLOCK
    quad = x[:n].astype(np.uint32)
    for k in (1, 2, 3):
        quad |= x[k : n + k].astype(np.uint32) << np.uint32(8 * k)
    h = (quad * np.uint32(2654435761)) >> np.uint32(24)
    seen = np.zeros(n, bool)
    real = x[:n] > 0
    seen[((np.arange(n) & ~(BLOCK - 1)) + h)[real]] = True
    return seen.reshape(blocks, BLOCK), real.reshape(blocks, BLOCK).mean(1, dtype=np.float32)


class Net:
    NAMES = ("emb", "conv", "bias", "w1", "b1", "w2", "b2")

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        draw = lambda scale, *shape: (r.normal(size=shape) * scale).astype(np.float32)
        self.emb = draw(0.5, 256, EMBED)
        self.emb[0] = 0
        self.conv = draw((WIDTH * EMBED) ** -0.5, WIDTH * EMBED, FILTERS)
        self.bias = np.zeros(FILTERS, np.float32)
        self.w1, self.b1 = draw(0.3, FILTERS + 2, HIDDEN), np.zeros(HIDDEN, np.float32)
        self.w2, self.b2 = draw(0.3, 2 * HIDDEN), np.zeros(1, np.float32)

    def _parts(self, x: np.ndarray, at: np.ndarray, where: bool = False) -> list:
        """``pooled`` of all blocks, a slice at a time."""
        blocks, step = int(at[-1]), SLICE // BLOCK
        last = np.zeros(blocks, bool)
        last[at[1:] - 1] = True
        return [self.pooled(x[k * BLOCK : min(k + step, blocks) * BLOCK + WIDTH], last[k : k + step], where) for k in range(0, blocks, step)]

    def pooled(self, x: np.ndarray, last: np.ndarray, where: bool = False):
        """Each filter's maximum over each block, and its place if asked for.

        ``last`` marks the blocks that end a text.  Windows that reach beyond such a block
        begin after the text's own zero bytes, so they hold nothing of it: they count as
        the zeros that they would be without the next text.
        """
        blocks = len(last)
        e = self.emb[x]
        per = BLOCK // STRIDE
        patches = np.lib.stride_tricks.as_strided(e, (blocks * per, WIDTH * EMBED), (STRIDE * EMBED * 4, 4), writeable=False)
        y = (np.ascontiguousarray(patches) @ self.conv).reshape(blocks, per, FILTERS)
        y[last, per - (WIDTH - 1) // STRIDE :] = 0
        if not where:
            return y.max(1), None
        at = y.argmax(1)
        return np.take_along_axis(y, at[:, None], 1)[:, 0], at

    @staticmethod
    def chunks(block: np.ndarray, at: np.ndarray, join) -> tuple[np.ndarray, np.ndarray]:
        """Values of chunks from those of their two blocks; a text of one block is one chunk."""
        n = np.maximum(np.diff(at) - 1, 1)
        offs = np.concatenate([[0], np.cumsum(n)])
        first = np.arange(offs[-1]) + np.repeat(at[:-1] - offs[:-1], n)
        second = np.minimum(first + 1, np.repeat(at[1:], n) - 1)
        return join(block[first], block[second]), offs

    def features(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top = np.concatenate([p[0] for p in self._parts(x, at)])
        act, offs = self.chunks(np.maximum(top + self.bias, 0), at, np.maximum)
        return np.concatenate([act, self.aside(x, at)], 1), offs

    @classmethod
    def aside(cls, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        seen, full = _variety(x, int(at[-1]))
        either, _ = cls.chunks(seen, at, np.logical_or)
        full, _ = cls.chunks(full, at, lambda a, b: (a + b) / 2)
        return cls.scaled(either, full)

    @staticmethod
    def scaled(either: np.ndarray, full: np.ndarray) -> np.ndarray:
        return np.stack([4 * np.minimum(either.mean(1, dtype=np.float32) / np.maximum(full, 1 / BLOCK), 1.5) - 2, full], 1).astype(np.float32)

    def head(self, f: np.ndarray, offs: np.ndarray):
        z = f @ self.w1 + self.b1
        h = np.maximum(z, 0)
        most = np.maximum.reduceat(h, offs[:-1])
        mean = np.add.reduceat(h, offs[:-1]) / np.diff(offs)[:, None]
        d = np.concatenate([most, mean], 1)
        return self.probability(d), (h, d)

    def probability(self, d: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(d @ self.w2 + self.b2, -30, 30)))

    def score_long(self, text: np.ndarray) -> float:
        """The probability of one text of several blocks, a slice at a time.  A slice hands its
        last block on to the next one, where it is the first half of a chunk."""
        blocks = (len(text) + WIDTH + BLOCK - 1) // BLOCK
        most, total, held = np.zeros(HIDDEN, np.float32), np.zeros(HIDDEN), None
        for k in range(0, blocks, SLICE // BLOCK):
            n = min(SLICE // BLOCK, blocks - k)
            x, last = np.zeros(n * BLOCK + WIDTH, np.uint8), np.zeros(n, bool)
            own = text[k * BLOCK : (k + n) * BLOCK + WIDTH]
            x[: len(own)], last[-1] = own, k + n == blocks
            now = (np.maximum(self.pooled(x, last)[0] + self.bias, 0), *_variety(x, n))
            if held is not None:
                now = tuple(np.concatenate([a, b]) for a, b in zip(held, now))
            held = tuple(v[-1:] for v in now)
            if len(now[0]) > 1:
                act, seen, full = now
                f = np.concatenate([np.maximum(act[:-1], act[1:]), self.scaled(seen[:-1] | seen[1:], (full[:-1] + full[1:]) / 2)], 1)
                h = np.maximum(f @ self.w1 + self.b1, 0)
                most, total = np.maximum(most, h.max(0)), total + h.sum(0)
        return float(self.probability(np.concatenate([most, total / (blocks - 1)])[None])[0])

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Probabilities of texts; as many as have SLICE bytes at a time, longer ones alone."""
        out = np.zeros(len(offs) - 1)
        row = 0
        while row < len(out):
            end = max(row + 1, int(np.searchsorted(offs, offs[row] + SLICE, "right")) - 1)
            if offs[end] - offs[row] > SLICE:
                out[row] = self.score_long(buf[offs[row] : offs[end]])
            else:
                x, at = _blocks(buf[offs[row] : offs[end]], offs[row : end + 1] - offs[row])
                out[row:end] = self.head(*self.features(x, at))[0]
            row = end
        return out

    def fit(self, texts: list[bytes], label: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01) -> Net:
        """Adam on the weighted cross entropy.  Max-pooling sends gradients to the winning
        places only, so a step back costs a few patches for each chunk."""
        r = np.random.default_rng(11)
        mean = {n: np.zeros_like(getattr(self, n)) for n in self.NAMES}
        var = {n: np.zeros_like(getattr(self, n)) for n in self.NAMES}
        step, top = 0, rate
        for epoch in range(epochs):
            rate = top * (1 - epoch / epochs)
            order = r.permutation(len(texts))
            for part in np.array_split(order, max(1, len(order) // 32)):
                own = [texts[k] for k in part]
                offs = np.concatenate([[0], np.cumsum([len(t) for t in own])])
                x, at = _blocks(np.frombuffer(b"".join(own), np.uint8), offs)
                grad = self._gradient(x, at, label[part], weight[part])
                step += 1
                for n in self.NAMES:
                    mean[n] += 0.1 * (grad[n] - mean[n])
                    var[n] += 0.001 * (grad[n] ** 2 - var[n])
                    setattr(self, n, (getattr(self, n) - rate * (mean[n] / (1 - 0.9**step)) / (np.sqrt(var[n] / (1 - 0.999**step)) + 1e-7)).astype(np.float32))
                self.emb[0] = 0
        return self

    def _gradient(self, x: np.ndarray, at: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        blocks = int(at[-1])
        parts = self._parts(x, at, True)
        top, place = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        place = place * STRIDE + np.arange(blocks)[:, None] * BLOCK
        n = np.maximum(np.diff(at) - 1, 1)
        offs = np.concatenate([[0], np.cumsum(n)])
        first = np.arange(offs[-1]) + np.repeat(at[:-1] - offs[:-1], n)
        second = np.minimum(first + 1, np.repeat(at[1:], n) - 1)
        left = top[first] >= top[second]
        win = np.where(left, top[first], top[second]) + self.bias
        f = np.concatenate([np.maximum(win, 0), self.aside(x, at)], 1)
        p, (h, d) = self.head(f, offs)
        dz = (weight * (p - label) / weight.sum()).astype(np.float32)
        g = {"w2": d.T @ dz, "b2": dz.sum(keepdims=True)}
        dd = dz[:, None] * self.w2
        doc = np.repeat(np.arange(len(n)), n)
        best = np.maximum.reduceat(h, offs[:-1])
        dh = (dd[:, HIDDEN:] / n[:, None])[doc] + np.where(h == best[doc], dd[:, :HIDDEN][doc], 0)
        dh = np.where(h > 0, dh, 0)
        g["w1"], g["b1"] = f.T @ dh, dh.sum(0)
        df = (dh @ self.w1.T)[:, :FILTERS] * (win > 0)
        g["bias"] = df.sum(0)
        src = np.where(left, place[first], place[second])
        g["conv"], g["emb"] = np.zeros_like(self.conv), np.zeros_like(self.emb)
        for j in range(WIDTH):
            byte = x[src + j]
            e = self.emb[byte]
            one = slice(j * EMBED, (j + 1) * EMBED)
            g["conv"][one] = np.einsum("cfe,cf->ef", e, df, optimize=True)
            back = df[:, :, None] * self.conv[one].T[None]
            for k in range(EMBED):
                g["emb"][:, k] += np.bincount(byte.reshape(-1), back[:, :, k].reshape(-1), minlength=256)
        return g


class Constant:
    """Stands for a network where there is nothing to tell apart."""

    def __init__(self, p: float):
        self.p = p

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return np.full(len(offs) - 1, self.p)


def held(fold: int = 5):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % fold == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, fold: int = 5) -> Net | Constant:
    """Fit to documents (doc_id, text) with a label (doc_id, quality 0 or 1), without held-out ids."""
    told = labels.where("doc_id is not null and quality in (0, 1)").where(~held(fold)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    share = {r[0]: r[1] for r in told.groupBy("quality").count().collect()}
    if len(share) < 2:
        return Constant(float(next(iter(share), 0.5)))
    storage.small_batches(docs.sparkSession)
    pick = [told.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for q in (0, 1)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= SAMPLE_LONGEST)
    rows = rows.join(F.broadcast(pick[0].unionByName(pick[1])), "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("text").alias("text"))
    upto = F.sum(F.octet_length("text")).over(W.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id"))  # at most SAMPLE rows each
    rows = rows.withColumn("upto", upto).where(F.col("upto") <= SAMPLE_BYTES).drop("upto").toArrow()
    if not len(rows):
        return Constant(share[1] / (share[0] + share[1]))
    order = pc.sort_indices(rows["doc_id"])
    rows = rows.take(order)
    label = rows["quality"].to_numpy().astype(np.float32)
    seen = {q: max(1, int((label == q).sum())) for q in (0, 1)}
    weight = np.where(label == 1, share[1] / seen[1], share[0] / seen[0]).astype(np.float32)
    return Net().fit([t.encode() for t in rows["text"].to_pylist()], label, weight / weight.mean())


def score(docs: DataFrame, net: Net | Constant, fold: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted of all documents (doc_id, text)."""
    storage.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = shared.value.score(*text_buffers(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held(fold).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, net: Net | Constant) -> DataFrame:
    """The rows of ``docs``, all columns, that the network does not reject."""
    storage.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index("text")

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.score(*text_buffers(b.column(at))) >= THRESHOLD))

    return docs.mapInArrow(passed, docs.schema)
