"""LM scoring with a log-frequency Bloom filter (after Talbot and Osborne, 2007).

A bigram model with unigram back-off is learnt from the training documents:

    p(w | h) = (v(h, w) + MU * p(w)) / (s(h) + MU),   p(w) = (v(w) + 0.1) / (S + 0.1 (V + 1))

where v is a count as the filter gives it back (bigrams that occur once are held too), s(h)
is the sum of v(h, w) over w, and S that of v(w).  So both distributions sum to one over the
V words of training and the unknown word, but for what false hits of the filter add.  A
context that never occurs leaves the unigram model.

Counts of unigrams and bigrams live in one Bloom filter, with the s(h).  A count c is
quantised to q = 1 + floor(log2 c), and the n-gram is stored q times, with 1 to q beside its
key; a reader probes 1, 2, ... until a probe fails.  For s(h), which must come back exactly,
the bits below the highest are events as well, each stored if it is set, and events take more
probes.  The filter has a region for each kind and bucket of n-grams, sized by what it holds,
so every bucket builds its region alone.

A filter of at most ``SEGMENT`` bytes is broadcast, and all is scored in one pass.  A larger
one is not gathered anywhere: texts are written in slices, the distinct n-grams of a slice are
sent to the tasks that hold their regions, and their counts come back to the slice.  That is
one exchange, of n-grams and never of texts, however large the filter is.

Counting moves packed, sorted arrays of 64-bit keys, one row for each task and bucket; no
bucket has a hot key, as bigrams are dealt by both of their words.  All training documents
are counted in full.

Apart from the model, ``base_score`` uses exact counts: those of the most frequent words
(at most ``EXACT`` of them) are broadcast, and only the other words' occurrences are joined
with their counts.

Words are known by 64-bit hashes, contexts by 36 bits of them and a word after a context by
28; equal hashes are taken as equal words.  Null texts count as empty and hold the end
alone; a null doc_id counts as training.  A long text is read and hashed a slice at a time
and scored as one.  Repeated rows are counted and scored as often as they come.  Without
training documents N and V are 0 and every token is unknown.  An empty table gives an empty
result.  Further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import storage
from tallyweave.llm.textnum import mix, word_batches

MU = 8.0
UNI, BI, CONTEXT = 0, 1, 2
#: Probes of an event by kind; the filter takes probes / ln 2 bits for one.
PROBES = (6, 6, 10)
#: Bytes of a filter that is broadcast, and of the regions that a task holds otherwise.
SEGMENT, SHARD = 96 << 20, 1 << 20
#: Bytes of texts that ask a dealt filter together; a longer text asks alone.
SLICE = 4 << 20
#: Words whose exact counts are broadcast (16 bytes each).
EXACT = 1 << 20
#: Text bytes that one bucket of counts stands for, and tokens that a task sorts at once.
BUCKET_BYTES = 16 << 20
FLUSH = 3_000_000

_U = np.uint64
END, START = _U(0x1B56C4E9A3D0F217), _U(0x6A09E667F3BCC909)


def tokens(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and ends of a batch of word_batches, the token before each, and row offsets."""
    n = len(at) - 1
    offs = at + np.arange(n + 1)
    out = np.empty(len(h) + n, _U)
    ends = offs[1:] - 1
    word = np.ones(len(out), bool)
    word[ends] = False
    out[word], out[ends] = h, END
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[offs[:-1]] = START
    return out, before, offs


def context_key(before: np.ndarray) -> np.ndarray:
    return before >> _U(28)


def bigram_key(tok: np.ndarray, before: np.ndarray) -> np.ndarray:
    return context_key(before) << _U(28) | mix(tok ^ (before * _U(0xD6E8FEB86659FD93))) >> _U(36)


def bucket_of(kind: int, key: np.ndarray, bits: int) -> np.ndarray:
    """Any kind's keys are dealt evenly, however frequent one word is."""
    return (mix(key + _U(kind)) & _U((1 << bits) - 1)).astype(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """64-bit numbers as eight planes of bytes: the upper ones of small numbers compress to nothing."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplaned(b: bytes | memoryview | pa.Buffer) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).reshape(-1).view("<u8")


def _gaps(key: np.ndarray) -> bytes:
    """Sorted keys as planes of their differences."""
    return _planes(np.diff(key, prepend=_U(0)))


def _ungapped(b: bytes | memoryview | pa.Buffer) -> np.ndarray:
    return np.cumsum(_unplaned(b), dtype=_U)


def _bytes(key: np.ndarray, count: np.ndarray) -> tuple[bytes, bytes]:
    """Keys that came once need no count; the others follow them.  Both are sorted."""
    single = count == 1
    return _gaps(key[single]) + _gaps(key[~single]), _planes(count[~single])


def _packed(kind: int, key: np.ndarray, count: np.ndarray, bits: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Sorted keys and their counts by bucket."""
    b = bucket_of(kind, key, bits)
    for k, one in _split(b):
        yield k, kind, *_bytes(key[one], count[one])


def _split(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part's number, in order, and where its elements are."""
    order = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0]) if len(part) else np.zeros(0, int)
    for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(part)]):
        yield int(part[order[a]]), order[a:z]


def _unpacked(keys: bytes | pa.Buffer, counts: bytes | pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    raw, many = memoryview(keys), _unplaned(counts)
    cut = len(raw) - 8 * len(many)
    return np.concatenate([_ungapped(raw[:cut]), _ungapped(raw[cut:])]), np.concatenate([np.ones(cut // 8, np.uint64), many])


def _summed(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
    return key[first], np.add.reduceat(count[order], first) if len(first) else np.zeros(0, np.uint64)


_PACKED = "bucket int, kind int, keys binary, counts binary"


def _rows(rows: list, names: list[str] = ["bucket", "kind", "keys", "counts"]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32(), pa.int32(), pa.binary(), pa.binary()])], names)


def _merge(group: pa.Table) -> pa.Table:
    kind, bucket = group["kind"][0].as_py(), group["bucket"][0].as_py()
    parts = [_unpacked(k.as_buffer(), c.as_buffer()) for k, c in zip(group["keys"], group["counts"])]
    key, count = _summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
    keys, counts = _bytes(key, count)
    return pa.table({"bucket": pa.array([bucket], pa.int32()), "kind": pa.array([kind], pa.int32()), "keys": pa.array([keys], pa.binary()), "counts": pa.array([counts], pa.binary())})


def level(count: np.ndarray) -> np.ndarray:
    """1 + floor(log2 c) of counts from 1."""
    return np.frexp(count.astype(np.float64))[1].astype(np.int64)


#: The count that a level stands for: the middle of 2**(q-1) .. 2**q - 1; 0 for level 0.
VALUE = np.array([0.0, 1.0, *(((1 << q - 1) + (1 << q) - 1) / 2 for q in range(2, 64))])
#: Event of a bit beside those of levels.
BIT = 64


def _steps(key: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Where an event's probes begin, and how far they go on."""
    h = mix(key + _U(q * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return h, mix(h) | _U(1)


def _place(h: np.ndarray, step: np.ndarray, probe: int, bits: np.ndarray | np.uint64) -> np.ndarray:
    """A probe's bit among ``bits``, fewer than 2**32."""
    return (((h + step * _U(probe)) >> _U(32)) * bits >> _U(32)).astype(np.int64)


def _events(kind: int, key: np.ndarray, count: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Event numbers and the keys that have them.  Numbers of contexts, from 2, are stored less 1."""
    count = count - _U(1) if kind == CONTEXT else count
    q = level(count)
    for k in range(1, int(q.max(initial=0)) + 1):
        yield k, key[q >= k]
        if kind == CONTEXT:
            yield BIT + k - 1, key[(q > k) & (count >> _U(k - 1) & _U(1) > 0)]


def region(kind: int, key: np.ndarray, count: np.ndarray) -> bytes:
    """The part of the filter that holds these n-grams."""
    events = sum(len(part) for _, part in _events(kind, key, count))
    bits = -(-int(events * PROBES[kind] / np.log(2) + 64) // 64) * 64
    out = np.zeros(bits, bool)
    for event, part in _events(kind, key, count):
        for at in range(0, len(part), 1 << 18):
            h, step = _steps(part[at : at + (1 << 18)], event)
            for probe in range(PROBES[kind]):
                out[_place(h, step, probe, _U(bits))] = True
    return np.packbits(out).tobytes()


class Filter:
    """Regions by kind and bucket, of the ``span`` buckets from ``base`` on."""

    def __init__(self, bits: int, regions: dict[tuple[int, int], bytes], base: int = 0, span: int | None = None):
        self.bits, self.base = bits, base
        span = 1 << bits if span is None else span
        self.start = np.zeros((3, span), np.int64)
        self.size = np.zeros((3, span), _U)
        at = 0
        for (kind, bucket), data in regions.items():
            self.start[kind, bucket - base], self.size[kind, bucket - base] = at * 8, len(data) * 8
            at += len(data)
        self.data = np.frombuffer(b"".join(regions.values()), np.uint8)

    def _held(self, kind: int, event: int, key: np.ndarray, at: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of ``at``, the places of the keys that have an event, as far as the filter knows."""
        h, step = _steps(key[at], event)
        own, first = size[at], start[at]
        for probe in range(PROBES[kind]):  # most absent keys fail the first ones
            p = _place(h, step, probe, own) + first
            hit = (self.data[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 > 0
            at, h, step, own, first = (x[hit] for x in (at, h, step, own, first))
        return at

    def read(self, kind: int, key: np.ndarray) -> np.ndarray:
        """The level of each key, by probes for 1, 2, ... until one fails; of a context, its number."""
        b = bucket_of(kind, key, self.bits) - self.base
        start, size = self.start[kind, b], self.size[kind, b]
        out = np.zeros(len(key), np.uint64 if kind == CONTEXT else np.uint8)
        alive = np.flatnonzero(size)
        q = 0
        while len(alive) and q < BIT - 1:
            q += 1
            alive = self._held(kind, q, key, alive, start, size)
            out[alive] = q
        if kind == CONTEXT:
            top, out = out.astype(np.int64), (_U(1) << np.maximum(out, _U(1)) - _U(1)) * (out > 0)
            for i in range(int(top.max(initial=0)) - 1):
                out[self._held(kind, BIT + i, key, np.flatnonzero(top > i + 1), start, size)] |= _U(1) << _U(i)
            out += out > 0
        return out


def keys(kind: int, tok: np.ndarray, before: np.ndarray) -> np.ndarray:
    return tok if kind == UNI else context_key(before) if kind == CONTEXT else bigram_key(tok, before)


class Model:
    """The two distributions, given what the filter says.  V and S: types and filter values of unigrams."""

    def __init__(self, types: int, value: float):
        self.total = value + 0.1 * (types + 1)

    def probability(self, uni: np.ndarray, bi: np.ndarray, context: np.ndarray) -> np.ndarray:
        """p(w | h) from the levels of w and of (h, w), and the number of h, which is 2 s(h)."""
        p = (VALUE[uni] + 0.1) / self.total
        return (np.where(context > 0, VALUE[bi], 0.0) + MU * p) / (context / 2 + MU)


def _is_held(mod: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == 0, F.lit(False))


def counts(train: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Exact counts of the texts' words and bigrams, packed by kind and bucket, those of their
    contexts, and the bits of a bucket number.  A context's number is 2 s(h), the filter values of its bigrams added up."""
    size = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(3, (size // BUCKET_BYTES).bit_length())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uni, bi, n = [], [], 0
        for b in batches:
            for _, _, h, at in word_batches(b.column(0)):
                tok, before, _ = tokens(h, at)
                uni.append(tok)
                bi.append(bigram_key(tok, before))
                n += len(tok)
                if n >= FLUSH:
                    yield from flush(uni, bi)
                    uni, bi, n = [], [], 0
        if n:
            yield from flush(uni, bi)

    def flush(uni: list, bi: list) -> Iterator[pa.RecordBatch]:
        for kind, held in ((UNI, uni), (BI, bi)):
            key = np.concatenate(held)
            held.clear()
            key.sort()
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            c = np.diff(first, append=len(key)).astype(np.uint32)
            key = key[first]
            del first
            for row in _packed(kind, key, c, bits):
                yield _rows([row])

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, c in zip(*b.columns):
                key, c = _unpacked(k.as_buffer(), c.as_buffer())
                for row in _packed(CONTEXT, *_summed(key >> _U(28), (2 * VALUE[level(c)]).astype(np.uint64)), bits):
                    yield _rows([row])

    merged = storage.kept(train.select("text").mapInArrow(count, _PACKED).groupBy("kind", "bucket").applyInArrow(_merge, _PACKED), "ngrams")
    ctx = merged.where(F.col("kind") == BI).select("keys", "counts").mapInArrow(contexts, _PACKED).groupBy("kind", "bucket").applyInArrow(_merge, _PACKED)
    return merged, storage.kept(ctx, "contexts"), bits


def _unigrams(ngrams: DataFrame, keep) -> DataFrame:
    """(key, c) rows of the unigrams whose counts pass ``keep``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                key, c = _unpacked(k, c)
                ok = keep(c)
                yield pa.RecordBatch.from_arrays([pa.array(key[ok].view(np.int64)), pa.array(c[ok].view(np.int64))], ["key", "c"])

    return ngrams.where(F.col("kind") == UNI).select("keys", "counts").mapInArrow(rows, "key long, c long")


def _totals(ngrams: DataFrame) -> dict[int, tuple[int, int, float]]:
    """Unigram types, tokens and filter values by level: at most 64 rows."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = _unpacked(k, c)[1]
                q = level(c)
                for k in np.unique(q).tolist():
                    yield pa.RecordBatch.from_pydict({"q": pa.array([k], pa.int32()), "types": pa.array([int((q == k).sum())]), "tokens": pa.array([int(c[q == k].sum())])})

    rows = ngrams.where(F.col("kind") == UNI).select("keys", "counts").mapInArrow(tell, "q int, types long, tokens long").groupBy("q").agg(F.sum("types"), F.sum("tokens")).collect()
    return {q: (types, n, types * float(VALUE[q])) for q, types, n in rows}


def _regions(ngrams: DataFrame) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, kind, k, c in zip(*b.columns):
                if len(k.as_buffer()):
                    yield _rows([(bucket, kind, region(kind.as_py(), *_unpacked(k.as_buffer(), c.as_buffer())), b"")])

    return ngrams.select("bucket", "kind", "keys", "counts").mapInArrow(build, _PACKED).select("kind", "bucket", F.col("keys").alias("region"), F.length("keys").alias("size"))


def _probed(f: Filter, tok: np.ndarray, before: np.ndarray) -> list[np.ndarray]:
    """What the filter says of the word, its bigram and its context, for each token."""
    out = []
    for kind in (UNI, CONTEXT):
        one, at = np.unique(keys(kind, tok, before), return_inverse=True)
        out.append(f.read(kind, one)[at])
    ask = np.flatnonzero(out[1])  # a context without bigrams needs no probe for them
    bi = np.zeros(len(tok), np.uint8)
    bi[ask] = f.read(BI, keys(BI, tok[ask], before[ask]))
    return [out[0], bi, out[1]]


#: Keys that are looked up at once in a dealt filter.
KEYS = 200_000


def _gathered(rows: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Neighbouring rows of one kind together, about KEYS keys at a time."""
    last, held, n = 0, [], 0
    for kind, key in rows:
        if held and (kind != last or n >= KEYS):
            yield last, held
            held, n = [], 0
        last, n = kind, n + len(key)
        held.append(key)
    if held:
        yield last, held


def _dealt(rows: DataFrame, regions: DataFrame, bits: int, shards: int, result, out_schema: str) -> DataFrame:
    """Scores by a filter that is dealt out: ``rows`` (doc_id, held_out, text) in slices, each
    slice's distinct n-grams to the shards of the filter that hold them, and the answers back."""
    shift = max(0, bits - (shards - 1).bit_length())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, at, held, out = uuid.uuid4().int >> 66, 0, [], None  # numbers that no other task takes

        def row() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                for x in held:
                    w.write_batch(x)
            data = sink.getvalue()
            out.write(data)
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (n, f"{folder}/{name}", at, len(data))], ["slice", "file", "at", "size"])

        for b in batches:
            if out is None:
                name, out = storage.write_stream(folder, "slices")
            if held and sum(x.nbytes for x in held) + b.nbytes > SLICE:
                yield (one := row())
                n, at, held = n + 1, at + one["size"][0].as_py(), []
            if len(b):
                held.append(b)
        if held:
            yield row()
        if out is not None:
            out.close()

    def rows_of(file: str, at: int, size: int) -> pa.Table:
        fs, path = storage.open_fs(file)
        with fs.open_input_file(path) as f:
            return pa.ipc.open_stream(f.read_at(size, at)).read_all().combine_chunks()

    def asked(texts: pa.ChunkedArray) -> tuple:
        """Tokens and offsets of a slice; and by kind, distinct keys in order of shard, and where tokens find theirs."""
        parts = [tokens(h, at) for _, _, h, at in word_batches(texts)]
        sizes = np.concatenate([np.diff(o) for _, _, o in parts])
        tok, before = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        out = []
        for kind in (UNI, BI, CONTEXT):
            one, at = np.unique(keys(kind, tok, before), return_inverse=True)
            shard = bucket_of(kind, one, bits) >> shift
            order = np.argsort(shard, kind="stable")
            place = np.empty(len(one), np.int64)
            place[order] = np.arange(len(one))
            out.append((one[order], shard[order], place[at]))
        return tok, np.r_[0, np.cumsum(sizes)], out

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, *place in zip(*(c.to_pylist() for c in b.columns)):
                for kind, (key, shard, _) in enumerate(asked(rows_of(*place)["text"])[2]):
                    held = [(k, n, kind, _gaps(key[at])) for k, at in _split(shard)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), [pa.int64(), pa.int64(), pa.int32(), pa.binary()])], ["shard", "slice", "kind", "keys"])

    def answer(asked: pa.Table, own: pa.Table) -> pa.Table:
        asked = asked.sort_by("kind")
        out = asked.select(["shard", "slice", "kind"])
        if not len(asked):
            return out.append_column("answers", pa.array([], pa.binary()))
        base = asked["shard"][0].as_py() << shift
        f = Filter(bits, {(k, b): r for k, b, r in zip(*(own[c].to_pylist() for c in ("kind", "bucket", "region")))}, base, 1 << shift)
        said: list[bytes] = []
        for kind, part in _gathered(zip(asked["kind"].to_pylist(), (_ungapped(x.as_buffer()) for x in asked["keys"]))):
            got = f.read(kind, np.concatenate(part))
            for x in np.split(got, np.cumsum([len(x) for x in part])[:-1]):
                said.append(_planes(x) if kind == CONTEXT else x.tobytes())
        return out.append_column("answers", pa.array(said, pa.binary()))

    def add_up(own: pa.Table, said: pa.Table) -> pa.Table:
        mine = rows_of(*(own[c][0].as_py() for c in ("file", "at", "size")))
        tok, offs, wanted = asked(mine["text"])
        told = {(kind, k): x.as_buffer() for kind, k, x in zip(said["kind"].to_pylist(), said["shard"].to_pylist(), said["answers"])}
        read = []
        for kind, (_, shard, place) in enumerate(wanted):
            parts = [_unplaned(told[kind, k]) if kind == CONTEXT else np.frombuffer(told[kind, k], np.uint8) for k, _ in _split(shard)]
            read.append(np.concatenate(parts)[place])
        return pa.Table.from_batches([result(mine["doc_id"].chunk(0), mine["held_out"].chunk(0), tok, offs, read)])

    folder = storage.folder(rows.sparkSession, "slices")
    slices = storage.kept(rows.mapInArrow(cut, "slice long, file string, at long, size long"), "slices", files=storage.SCAN_FILES)
    tasks = max(-(-slices.count() // 8), rows.sparkSession.sparkContext.defaultParallelism)
    asks = slices.repartitionByRange(tasks, "slice").mapInArrow(ask, "shard long, slice long, kind int, keys binary")
    held = regions.select(F.shiftright(F.col("bucket").cast("long"), shift).alias("shard"), "kind", "bucket", "region")
    said = asks.groupBy("shard").cogroup(held.groupBy("shard")).applyInArrow(answer, "shard long, slice long, kind int, answers binary")
    return slices.groupBy("slice").cogroup(said.groupBy("slice")).applyInArrow(add_up, out_schema)


def score(docs: DataFrame, fold: int = 10) -> DataFrame:
    """Learn from the documents (doc_id, text) whose crc32(doc_id as text) mod ``fold`` is
    not 0, and score all: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return storage.settled(docs.sparkSession, lambda: _score(docs, fold), "scores")


def _score(docs: DataFrame, fold: int) -> DataFrame:
    storage.small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ngrams, contexts, bits = counts(docs.where(~_is_held(fold)))
    told = _totals(ngrams)
    v, n, s = (sum(x[k] for x in told.values()) for k in range(3))
    d_base = n + 0.1 * (v + 1)

    least, types = 64, 0  # exact counts of the levels from ``least`` on are broadcast
    while least > 1 and types + told.get(least - 1, (0,))[0] <= EXACT:
        least -= 1
        types += told.get(least, (0,))[0]
    floor = 1 << (least - 1)
    regions = storage.kept(_regions(ngrams.unionByName(contexts)), "regions")
    unigrams = storage.kept(ngrams.where(F.col("kind") == UNI), "unigrams")
    storage.drop(ngrams, contexts)
    top = _unigrams(unigrams, lambda c: c >= floor).toArrow()
    key, c = top["key"].to_numpy().view(_U), top["c"].to_numpy()
    order = np.argsort(key)
    exact = sc.broadcast((key[order], c[order]))
    del top, key, c, order

    model = Model(v, s)

    def result(ids: pa.Array, held: pa.Array, tok: np.ndarray, offs: np.ndarray, read: list[np.ndarray]) -> pa.RecordBatch:
        key, c = exact.value
        p = model.probability(*read)
        one, at = np.unique(tok, return_inverse=True)
        k = np.minimum(np.searchsorted(key, one), max(len(key) - 1, 0))
        hit = key[k] == one if len(key) else np.zeros(len(one), bool)
        known = hit[at]
        base = np.where(hit, np.log10(((c[k] if len(key) else 0) + 0.1) / d_base), 0.0)[at]
        rare = tok[~known].view(np.int64)
        total = lambda x: np.add.reduceat(x, offs[:-1]) if len(offs) > 1 else np.zeros(0)  # noqa: E731  every row has a token
        n_known = total(known.astype(np.int64))
        roffs = np.concatenate([[0], np.cumsum(np.diff(offs) - n_known)]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [ids, held, pa.array(np.diff(offs), pa.int64()), pa.array(n_known, pa.int64()), pa.array(total(base), pa.float64()), pa.array(total(np.log10(p)), pa.float64()), pa.ListArray.from_arrays(pa.array(roffs), pa.array(rare))],
            ["doc_id", "held_out", "n_tokens", "n_top", "base_top", "score", "rare"],
        )

    out_schema = "doc_id long, held_out boolean, n_tokens long, n_top long, base_top double, score double, rare array<long>"
    rows = docs.select("doc_id", _is_held(fold).alias("held_out"), "text")
    size = regions.agg(F.sum("size")).first()[0] or 0
    if size <= SEGMENT:
        shared = sc.broadcast(Filter(bits, {(r[0], r[1]): r[2] for r in regions.select("kind", "bucket", "region").toLocalIterator()}))

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row, end, h, at in word_batches(b.column(2)):
                    tok, before, offs = tokens(h, at)
                    yield result(b.column(0).slice(row, end - row), b.column(1).slice(row, end - row), tok, offs, _probed(shared.value, tok, before))

        scored = rows.mapInArrow(whole, out_schema)
    else:
        scored = _dealt(rows, regions, bits, -(-size // SHARD), result, out_schema)

    scored = storage.kept(scored.withColumn("row", F.monotonically_increasing_id()), "scored", files=storage.SCAN_FILES)
    few = _unigrams(unigrams, lambda c: c < floor)
    rare = scored.select("row", F.explode("rare").alias("key")).join(few, "key", "left").groupBy("row").agg(F.sum(F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(float(d_base)))).alias("base_rare"), F.count("c").alias("n_rare"))
    out = scored.drop("rare").join(rare, "row", "left")
    zero = lambda x: F.coalesce(x, F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_top") + zero("n_rare")).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), (F.col("base_top") + zero("base_rare")).alias("base_score"), "score")
