"""Each operator against brute force, and on awkward rows."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyweave.llm import bpe, decontam, exactdedup, fuse, langid, lmscore, neardup, packing, quality, queries, sstable, storage, textnum, tokencount, unionfind, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def words(t):
    return WORD.findall(low(t))


def shingles(t, n=5):
    w = words(t)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def sentence(r, n, voc=400):
    return " ".join(f"w{r.randrange(voc)}" for _ in range(n))


def corpus(seed=3):
    """Documents with exact and near copies, benchmark passages, junk, nulls and repeated rows."""
    r = random.Random(seed)
    out = []
    for k in range(120):
        out.append((k, sentence(r, r.choice([1, 3, 5, 30, 90])), "en" if k % 2 else "fr"))
    base = sentence(r, 60)
    for k in range(120, 150):
        w = base.split()
        for _ in range(r.randrange(4)):
            w[r.randrange(60)] = f"x{r.randrange(99)}"
        out.append((k, " ".join(w), "en"))
    out += [(k, f"  Same\ttext \n{'again ' * 30}" if k % 2 else f" Same text {'again  ' * 30}", "en") for k in range(150, 160)]
    out += [(160, None, None), (161, "", "en"), (162, " \n\t", None), (163, "日本語 テスト", "fr"), (164, "A" * 70_000, "en"), (165, sentence(r, 30_000), "fr"), (None, "no id at all", "en"), (None, None, None), (12, out[12][1], "fr"), (13, out[13][1], "en")]
    return out


DOC = "doc_id long, text string, lang string, source string, n_chars long, key long, bucket int, length long, digest binary, row long, kept boolean, rep long, set binary, late boolean, `__gone` long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, None if i == 3 else "src", None, 1, 2, 3, b"x", 4, None, 5, b"y", True, 6) for i, t, g in rows], DOC)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus()).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


# -- words as numbers ---------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("aAbB é日\x0b\x1c \t\n\r\x85\xa0")), max_size=40)), max_size=8), st.sampled_from([3, 17, 1 << 20]))
def test_word_numbers_tell_words_apart(texts, size):
    was, textnum.SLICE = textnum.SLICE, size
    try:
        seen = {}
        got = []
        for _, _, h, at in textnum.word_batches(pa.array(texts, pa.string())):
            got += [h[a:b].tolist() for a, b in zip(at, at[1:])]
        want = [words(t) for t in texts]
        assert [len(x) for x in got] == [len(x) for x in want]
        for x, y in zip(sum(got, []), sum(want, [])):
            assert seen.setdefault(y, x) == x
        assert len(set(seen.values())) == len(seen)
    finally:
        textnum.SLICE = was


def test_sliced_columns_and_sets():
    col = pa.array(["zz", None, "a b c d e a b c d e f", "a b", ""]).slice(1)
    sets = [s for _, _, h, at in textnum.word_batches(col) for s in textnum.shingle_sets(h, at)]
    assert [len(s) for s in sets] == [0, 6, 1, 0]


# -- near and exact copies --------------------------------------------------------------------


def brute_groups(rows):
    s = {i: shingles(t) for i, t, _ in rows if i is not None}
    links = [(a, b) for a in s for b in s if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b])]
    f = unionfind.forest(links)
    return {i: (len(s[i]), f.get(i, i)) for i in s}


def test_near_duplicates(spark, docs, none):
    rows = corpus()
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    want = brute_groups(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
        else:
            assert r.component_id is None
    assert neardup.near_duplicates(none).count() == 0
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, *_ in rows if i is None or want[i][1] == i)


def test_links_across_groups_of_a_bucket(spark, monkeypatch):
    """A chain whose ends are no link: its middle must join what the pivot does not reach."""
    r = random.Random(1)
    w = sentence(r, 100, 10_000).split()
    rows = []
    for k in range(40):
        x = list(w)
        for m in range(k):
            x[(m * 7) % 100 if m % 5 == 0 else 50] = f"y{m}" if m % 5 == 0 else x[50]
        rows.append((k, " ".join(x), "en"))
    want = brute_groups(rows)
    monkeypatch.setattr(neardup, "OUTSIDE", 200)
    monkeypatch.setattr(neardup, "INSIDE", 300)
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: v[1] for k, v in want.items()}


def test_a_block_gives_fewer_links_than_groups():
    """2,000 x 2,000 rows, all alike and each a group of its own."""
    own = np.random.default_rng(0).integers(0, 1 << 63, 40, dtype=np.uint64)
    sets = [np.sort(np.r_[own, np.uint64(k)]).tobytes() for k in range(4000)]
    block = pa.table({"outside": [k % 2 == 1 for k in range(4000)], "rep": list(range(4000)), "comp": list(range(4000)), "set": pa.array(sets, pa.binary())})
    links = neardup._across(block).to_pylist()
    assert len(links) == 3999 and len(set(unionfind.forest((x["a"], x["b"]) for x in links).values())) == 1


def test_words_of_one_pattern_stay_apart(spark):
    """Thue-Morse words collide under any polynomial modulo a power of two."""
    t = "a"
    for _ in range(11):
        t += t.translate(str.maketrans("ab", "ba"))
    other = t.translate(str.maketrans("ab", "ba"))
    for n in (8, 9, 16, 64, 65, 128, 2048):
        (_, _, h, _), *_ = textnum.word_batches(pa.array([f"{t[:n]} {other[:n]} {t[:n].upper()}"]))
        assert h[0] != h[1] and h[0] == h[2]
    docs = frame(spark, [(1, t, "en"), (2, other, "en")])
    assert {r.component_id for r in neardup.near_duplicates(docs).collect()} == {1, 2}
    assert [r.doc_id for r in decontam.leaks(docs, spark.createDataFrame([(0, t)], "item_id long, text string")).collect()] == [1]
    got = {r.doc_id: r.n_known for r in lmscore.score(frame(spark, [(1, t, "en"), *((k, other, "en") for k in range(2, 40) if zlib.crc32(str(k).encode()) % 10 == 0)])).collect()}
    assert got.pop(1) == 2 and set(got.values()) == {1}


def test_tables_on_the_way_are_deleted(spark, docs):
    root = storage.shared_root(spark).removeprefix("file://")
    held = lambda: {x.rsplit("-", 1)[0] for x in set(os.listdir(root)) - before}
    for make, want in ((neardup.near_duplicates, {"groups"}), (exactdedup.dedup, {"groups"}), (neardup.keep_one, {"gone"}), (exactdedup.keep_one, {"gone"})):
        before = set(os.listdir(root))
        out = make(docs)
        assert held() == want
        assert out.count() > 0
    before = set(os.listdir(root))
    storage.settled(spark, lambda: neardup.keep_one(docs), "left")
    assert held() == {"left"}


def test_signatures_estimate_similarity():
    r = np.random.default_rng(0)
    for n in (3, 40, 3000):
        a = r.integers(0, 1 << 63, n, dtype=np.uint64)
        b = a.copy()
        b[: max(1, n // 4)] = r.integers(0, 1 << 63, max(1, n // 4), dtype=np.uint64)
        s = neardup.superminhash([a, b, a])
        j = (n - max(1, n // 4)) / (n + max(1, n // 4))
        assert (s[0] == s[2]).all() and np.isfinite(s).all() and abs((s[0] == s[1]).mean() - j) < 0.15
        assert len(set((s[0] % 1).round(12))) > min(n, 100) // 2


def test_components(spark):
    e = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 1), (20, 21), (5, 5), (None, 3)]
    got = dict(unionfind.components(spark.createDataFrame(e, "a long, b long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20}
    line = [(k, k + 1) for k in range(60)]
    random.Random(2).shuffle(line)
    got = dict(unionfind.components(spark.createDataFrame(line, "a long, b long").repartition(4)).collect())
    assert set(got.values()) == {0} and len(got) == 61
    assert unionfind.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 5, 100, 5000])
def test_fuse_filters(n):
    k = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64)
    f = fuse.build(np.concatenate([k, k]))
    assert fuse.probe(f, k).all()
    assert fuse.probe(f, np.random.default_rng(n + 1).integers(0, 1 << 63, 20_000, dtype=np.uint64)).mean() < 0.008
    assert n < 1000 or len(f) < 1.5 * n


def test_exact_dedup(spark, docs, none):
    rows = corpus()
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t, _ in rows]
    by = defaultdict(list)
    for i, t in norm:
        by[t].append(i)
    want = Counter((i, min((x for x in by[t] if x is not None), default=None), len(by[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm)
    got = exactdedup.dedup(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert all(r.kept == (r.keep_id is None or r.doc_id == r.keep_id) for r in got)
    assert exactdedup.dedup(none).count() == 0
    assert exactdedup.dedup(frame(spark, [(None, "a", None), (None, "a", None)])).where("kept").count() == 2
    kept = exactdedup.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect() if r.doc_id is not None} == {k[1] for k in want if k[1] is not None}


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \t\n\x0b\x0c\r\x1c\xa0ab日")), max_size=30))
def test_normalised(t):
    assert exactdedup.normalised(t.encode()) == re.sub(r"[\x20\x09-\x0D]+", " ", t).encode()


# -- decontamination ---------------------------------------------------------------------------------


def test_decontamination(spark, docs, none, monkeypatch):
    rows = corpus()
    r = random.Random(9)
    long = rows[165][1].split()
    items = [(0, " ".join(long[5000:5040])), (1, rows[60][1]), (2, "again again again"), (3, ""), (4, None), (5, sentence(r, 40)), (6, " ".join(long[100:130] + [f"z{k}" for k in range(8)])), (7, " ".join(long[200:230] + [f"z{k}" for k in range(20)])), (7, rows[60][1]), (8, rows[2][1].upper())]
    want = Counter()
    for i, t, _ in rows:
        for j, b in items:
            s = shingles(b)
            if s and 100 * len(both := s & shingles(t, len(next(iter(s))) if len(words(b)) < 5 else 5)) >= 75 * len(s):
                want[(i, j, len(both), len(s))] += 1
    ben = spark.createDataFrame(items, "item_id long, text string")
    assert any(k[1] == 6 for k in want) and not any(k[1] == 7 and k[0] == 165 for k in want)
    for size in (32 << 20, 600):
        monkeypatch.setattr(decontam, "BLOCK_BYTES", size)
        got = decontam.leaks(docs, ben).collect()
        assert Counter((x.doc_id, x.item_id, x.n_shared, x.n_item) for x in got) == want
        assert all(x.containment == x.n_shared / x.n_item for x in got)
        clean = decontam.clean(docs, ben)
        assert clean.columns == docs.columns
        dirty = {(i, t) for i, t, _ in rows if any(k[0] == i for k in want)}
        assert clean.count() == sum((i, t) not in dirty for i, t, _ in rows if i is not None) + 2
    assert decontam.leaks(none, ben).count() == 0 and decontam.leaks(docs, ben.limit(0)).count() == 0 and decontam.clean(docs, ben.limit(0)).count() == len(rows)


def test_sketch_thresholds_miss_nothing_and_screen():
    """Of an item of any size: the least that a match holds reaches the threshold; one shared passage does not."""
    r = np.random.default_rng(3)
    for n in [*range(1, 70), 200, 1000]:
        k, need = decontam.partition(n)
        assert k <= n and k - n // 4 >= need >= 1
        words_ = [f"w{x}" for x in r.integers(0, 1 << 40, n + 4)]
        s = decontam.Sketches([(7, " ".join(words_))])
        item, text = s.sets[0], pa.array([" ".join(words_)])
        assert list(s.find(text)) == [(0, 0, n)]
        least = item[np.argsort(textnum.mix(item))][n // 4 :]  # lacks a quarter of the item, all of it in the sketch
        assert np.isin(s.index[5][0], least).sum() >= need
    (_, _, h, at), *_ = textnum.word_batches(pa.array([" ".join(words_[:120]), " ".join(words_[300:])]))
    assert list(s._candidates(h, at)) == [(1, 0)]


# -- tokens, files and packing ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return queries.vocabulary()


@pytest.fixture(scope="module")
def exact(vocabulary):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_chunks_encode_as_whole_texts(vocabulary, exact):
    enc = bpe.encoder(vocabulary)
    r = random.Random(4)
    parts = [" ", " ", "  ", "\n", "\r\n", "\t", "\xa0", "　", "\x1c", "a", "Zb", "é", "日", "ª", "1", ",", ".", "!", "%%", "'s", "'", "-", "<|endoftext|>", "word"]
    for _ in range(4000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == exact(t), repr(t)
    was, bpe.CACHE = bpe.CACHE, 5
    try:
        e = bpe.Encoder(vocabulary)
        assert all(np.frombuffer(e.encode(t), "<u4").tolist() == exact(t) for _, t, _ in corpus() if t)
    finally:
        bpe.CACHE = was


def test_strings_of_special_tokens(vocabulary, exact):
    enc = bpe.encoder(vocabulary)
    assert np.frombuffer(enc.encode("a <|endoftext|> b"), "<u4").tolist() == exact("a <|endoftext|> b") == [64, 220, 50256, 275]
    assert max(exact(f"x{enc.added}")) < queries.NO_ID


def test_ids_beyond_sixteen_bits():
    ids = np.array([1, 70_000], "<u4").tobytes()
    assert bpe.widen(bpe.narrow(ids, 4), 4) == ids and bpe.widen(bpe.narrow(ids[:4], 2), 2) == ids[:4]
    with pytest.raises(ValueError, match="70000"):
        bpe.narrow(ids, 2)


def by_order(rows):
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))


@pytest.mark.parametrize("limits", [{}, {"shard": 1000}, {"shard_docs": 10}])
def test_sstable_round_trip(spark, docs, none, vocabulary, exact, limits):
    shards = sstable.write(docs, storage.fresh(spark, "t"), vocabulary, **limits)
    got = sstable.read(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("crc"), "ids").collect()
    rows = corpus()
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == Counter((i, tuple(exact(t) + [0])) for i, t, _ in rows)
    got.sort(key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at and r.crc == zlib.crc32(r.ids) and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    assert [r.doc_id for r in got] == [i for i, *_ in by_order(rows)]
    files = [r.file for r in shards.orderBy("shard").collect()]
    told = shards.collect()
    assert all(r.n_docs <= 10 for r in told) if "shard_docs" in limits else len(files) >= (4 if limits else 1)
    assert sorted(shards.columns) == sorted(x.split()[0] for x in sstable.MANIFEST.split(", "))
    found = {i: [x.tolist() for f in files for x in sstable.open_shard(f).get(i)] for i in (None, 7, 12, 165, 5000, -3)}
    assert found[7] == [exact(rows[7][1]) + [0]] and len(found[12]) == 2 and len(found[None]) == 2 and found[5000] == found[-3] == []
    assert sstable.read(sstable.write(none, storage.fresh(spark, "t"), vocabulary)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(-(1 << 63), (1 << 63) - 1), st.lists(st.integers(0, 65535), max_size=50)), max_size=60), st.sampled_from([2, 4]), st.sampled_from([1, 64, 1 << 15]))
def test_shards_of_any_keys(tmp_path_factory, entries, width, block):
    was, sstable.BLOCK = sstable.BLOCK, block
    try:
        entries.sort(key=lambda e: e[0])
        folder = tmp_path_factory.mktemp("sst")
        name, out = storage.write_stream(f"file://{folder}", "x")
        w = sstable.Writer(out, width)
        for k, ids in entries:
            w.add(sstable.key_of(k), bpe.narrow(np.array(ids, "<u4").tobytes(), width))
        w.finish()
        out.close()
        s = sstable.open_shard(f"file://{folder}/{name}")
        assert [(sstable.id_of(k), np.frombuffer(v, "<u4").tolist()) for k, v in s.scan()] == entries
        for k, _ in entries[:5]:
            assert [x.tolist() for x in s.get(k)] == [v for i, v in entries if i == k]
    finally:
        sstable.BLOCK = was


def test_token_counts(spark, docs, none, vocabulary, exact):
    odd = [(900, "a <|endoftext|> b", "en"), (901, "<|endoftext|>" * 3, "en")]
    files, order = tokencount.write_flat(docs.union(frame(spark, odd)), storage.fresh(spark, "t"), vocabulary, queries.NO_ID)
    want = Counter((i, len(exact(t)) + 1) for i, t, _ in corpus() + odd)
    for block in (4000, None):
        got = order.join(tokencount.count_tokens(files, queries.NO_ID, block=block), ["file", "ordinal"]).collect()
        assert Counter((r.doc_id, r.n_ids) for r in got) == want and all(r.ended for r in got)
    files, order = tokencount.write_flat(none, storage.fresh(spark, "t"), vocabulary, queries.NO_ID)
    assert tokencount.count_tokens(files, queries.NO_ID).count() == 0 and order.count() == 0
    with pytest.raises(Exception, match="holds the end id 50256"):
        tokencount.write_flat(frame(spark, odd), storage.fresh(spark, "t"), vocabulary, 50256)


@pytest.mark.parametrize("width", [2, 4])
def test_separator_scan_stitches_blocks(spark, tmp_path, width):
    r = np.random.default_rng(5)
    rows, want = [], []
    for k in range(4):
        ids = r.integers(0, 6, 500 * k)
        if k == 2:
            ids[ids == 0] = 1  # no end at all
        if k == 3:
            ids[-1] = 0
        (tmp_path / str(k)).write_bytes(ids.astype(f"<u{width}").tobytes())
        rows.append((f"file://{tmp_path}/{k}", len(ids)))
        start = 0
        for n, end in enumerate([*np.flatnonzero(ids == 0).tolist(), None]):
            stop = len(ids) if end is None else end + 1
            if start < stop:
                want.append((rows[-1][0], n, start, stop - start, end is not None))
            start = stop
    got = tokencount.count_tokens(spark.createDataFrame(rows, "file string, n_ids long"), 0, width, 64).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_packing(spark, docs, none, vocabulary, exact):
    out = packing.pack(packing.pieces(docs, vocabulary)).collect()
    ids = Counter()
    seqs = defaultdict(list)
    for r in out:
        assert r.length == len(r.ids) // 4 <= 2048 and (r.length == 2048 or r.piece == 0)
        seqs[r.sequence_id].append((r.offset, r.length))
    for v in seqs.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 2048
    for i, t, _ in corpus():
        ids[i] += len(exact(t)) + 1
    assert sum(ids.values()) == sum(r.length for r in out) and len(seqs) == -(-sum(ids.values()) // 2048)
    for r in out:
        if r.doc_id == 165:
            assert np.frombuffer(r.ids, "<u4").tolist() == (exact(corpus()[165][1]) + [0])[r.start : r.start + r.length]
    assert packing.pack(packing.pieces(none, vocabulary)).count() == 0


def test_ranks_do_not_depend_on_the_order_of_a_run(spark, monkeypatch):
    """Equal rows in many parts; a second look at the plan, with other partitions, gives the same places."""
    monkeypatch.setattr(packing, "PART", 7)
    rows = [(k % 5, k % 3 + 1, "x") for k in range(500)]
    items = spark.createDataFrame(rows, "doc_id long, length int, part string").repartition(4)
    out = packing.pack(items, 10)
    first = Counter(map(tuple, out.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert Counter(map(tuple, out.select("*").collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert max(first.values()) == 1 or len({(r[-2], r[-1]) for r in first}) == 500
    assert Counter(r[:3] for r in first.elements()) == Counter(rows)


def optimum(items, c):
    """The fewest sequences, by exhaustive search."""
    best = [len(items)]

    def go(k, room):
        if len(room) >= best[0]:
            return
        if k == len(items):
            best[0] = len(room)
            return
        for x in range(len(room)):
            if room[x] >= items[k] and room[x] not in room[:x]:
                go(k + 1, [*room[:x], room[x] - items[k], *room[x + 1 :]])
        go(k + 1, [*room, c - items[k]])

    go(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=8))
def test_reduction_keeps_the_optimum(items):
    c = 12
    count = [0] * (c + 1)
    for w in items:
        count[w] += 1
    left = list(count)
    fixed = packing.reduction(left, c)
    rest = [w for w in range(c, 0, -1) for _ in range(left[w])]
    assert all(sum(w * k for w, k in held) <= c for _, held in fixed)
    assert sum(n for n, _ in fixed) + optimum(rest, c) == optimum(sorted(items, reverse=True), c)
    kinds = packing.solve(count, c)
    got = [0] * (c + 1)
    for n, held in kinds:
        assert n > 0 and sum(w * k for w, k in held) <= c
        for w, k in held:
            got[w] += n * k
    assert got == count


# -- archives ---------------------------------------------------------------------------------------------


def test_warc(spark):
    big = "x" * 1200 + "é"
    rows = [(1, "http://a/1", big), (2, "http://a/2 b\r\nX: 1", big), (3, None, big), (3, "", big), (4, "u", "small"), (5, "u", "small"), (6, "ü", None), (7, "v", ""), (None, "w", big), (8, "z", "y" * 999), (9, "z", "y" * 999), (None, "q", "n" * 2000), (10, "h", "日" * 50_000)]
    pages = spark.createDataFrame([(*r, "clash", 1, "f") for r in rows], "page_id long, url string, html string, digest string, length int, file string").repartition(2)
    index = warc.write(pages, storage.fresh(spark, "w"))
    got = warc.read(index).collect()
    assert len(got) == len(rows)

    def want(i, h):
        p = (h or "").encode()
        same = [x for x, _, y in rows if (y or "") == (h or "") and x is not None]
        again = len(p) >= 1000 and same and i != max(same)
        return i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", max(same) if again else None, None if again else p

    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload)) if r.payload else (r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else b"") for r in got) == Counter(want(i, h) for i, _, h in rows)
    assert Counter(r.url for r in got) == Counter(u for _, u, _ in rows)
    some = warc.read(index.where("page_id in (2, 10)")).collect()
    assert sorted(r.page_id for r in some) == [2, 10]
    empty = pages.limit(0)
    assert warc.read(warc.write(empty, storage.fresh(spark, "w"))).count() == 0


def test_ranges_are_coalesced(monkeypatch):
    monkeypatch.setattr(warc, "GAP", 5)
    monkeypatch.setattr(warc, "RANGE", 50)
    assert list(warc.ranges([(0, 10), (10, 10), (24, 6), (40, 30), (71, 60)])) == [(0, 30, [0, 1, 2]), (40, 30, [3]), (71, 60, [4])]


def test_warc_records_can_be_read_by_others(spark):
    raw = zlib.decompress(warc.record(5, "http://x/", b"<p>hi</p>", hashlib.sha1(b"<p>hi</p>").digest(), None), 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    n = int(re.search(rb"Content-Length: (\d+)", head)[1])
    assert head.startswith(b"WARC/1.1\r\n") and rest[n:] == b"\r\n\r\n" and rest[:n].endswith(b"<p>hi</p>")


# -- models -------------------------------------------------------------------------------------------------


def test_one_id_on_two_texts(spark):
    r = random.Random(8)
    a, b, c, d = (sentence(r, 60) for _ in range(4))
    close = a.rsplit(" ", 1)[0] + " other"
    rows = [(1, a, "en"), (2, close, "en"), (2, b, "en"), (3, b, "fr"), (4, c, "en"), (5, a, "en"), (5, d, "en"), (None, b, "en"), (6, None, "en"), (6, c, "en")]
    docs = frame(spark, rows).repartition(3)
    got = Counter((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in neardup.near_duplicates(docs).collect())
    assert got == Counter([(1, 56, 1, True), (2, 56, 1, False), (2, 56, 2, True), (3, 56, 2, False), (4, 56, 4, True), (5, 56, 1, False), (5, 56, 5, True), (None, 56, None, None), (6, 0, 6, True), (6, 56, 4, False)])
    left = lambda f: Counter((x.doc_id, x.text) for x in f(docs).collect())
    assert left(neardup.keep_one) == Counter([(1, a), (2, b), (4, c), (5, d), (None, b), (6, None)])
    exact = left(exactdedup.keep_one)
    assert {k: n for k, n in exact.items() if k[0] is not None} == {(1, a): 1, (2, close): 1, (2, b): 1, (4, c): 1, (5, d): 1, (6, None): 1}


def test_lm_scores(spark, docs, none, monkeypatch):
    rows = corpus()
    toks = [(i, [*words(t), None]) for i, t, _ in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t in toks if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    d = n + 0.1 * (v + 1)
    want = Counter((i, held(i), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.1) / d) for w in t), 4)) for i, t in toks)
    runs = []
    for segment, shard, exact in ((96 << 20, 1 << 22, 1 << 20), (1200, 5000, 40)):
        monkeypatch.setattr(lmscore, "SEGMENT", segment)
        monkeypatch.setattr(lmscore, "SHARD", shard)
        monkeypatch.setattr(lmscore, "EXACT", exact)
        got = lmscore.score(docs).collect()
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)
        runs.append(sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, round(r.score, 9)) for r in got))
    assert runs[0] == runs[1]
    assert lmscore.score(none).count() == 0
    only = lmscore.score(frame(spark, [(i, "a b", "en") for i in range(300) if held(i)])).collect()
    assert {(r.n_known, r.train_tokens) for r in only} == {(0, 0)}


def test_lm_by_brute_force(spark, monkeypatch):
    r = random.Random(5)
    rows = [(k, sentence(r, 40, 300), "en") for k in range(200)]
    docs = frame(spark, rows)
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    toks = [(i, [0, *words(t), None]) for i, t, _ in rows]
    uni = Counter(w for i, t in toks if not held(i) for w in t[1:])
    bi = Counter(p for i, t in toks if not held(i) for p in zip(t, t[1:]))
    assert sum(c == 1 for c in bi.values()) > len(bi) / 2
    def value(c):  # the middle of the counts of a level
        q = c.bit_length()
        return (2 ** (q - 1) + 2**q - 1) / 2 if c else 0.0

    of = Counter()
    for (h, _), c in bi.items():
        of[h] += value(c)
    ngrams, contexts, bits = lmscore.counts(docs.where(F.crc32(F.col("doc_id").cast("string")) % 10 != 0))
    held_rows = [(x.kind, x.bucket, *lmscore._unpacked(x["keys"], x["counts"])) for x in ngrams.unionByName(contexts).collect()]
    for kind, want in ((lmscore.UNI, uni.values()), (lmscore.BI, bi.values()), (lmscore.CONTEXT, [2 * x for x in of.values()])):
        assert Counter(n for k, _, _, c in held_rows if k == kind for n in c.tolist()) == Counter(want)

    # p(. | h) sums to one over all words and the unknown one, for every context, without false hits.
    s, v = sum(map(value, uni.values())), len(uni)
    monkeypatch.setattr(lmscore, "PROBES", (40, 40, 40))
    f = lmscore.Filter(bits, {(k, b): lmscore.region(k, key, c) for k, b, key, c in held_rows})
    every = np.concatenate([key for k, _, key, _ in held_rows if k == lmscore.UNI])
    every = np.r_[every, np.uint64(12345)]
    m = lmscore.Model(v, s)
    for h in np.r_[every, lmscore.START]:
        p = m.probability(*lmscore._probed(f, every, np.full(len(every), h)))
        assert (p > 0).all() and abs(p.sum() - 1) < 1e-6
    monkeypatch.undo()

    # Scores as by the formula, but for what the filter's false hits add.
    p = lambda h, w: (value(bi[h, w]) + lmscore.MU * (value(uni[w]) + 0.1) / (s + 0.1 * (v + 1))) / (of[h] + lmscore.MU)
    want = {i: sum(math.log10(p(*x)) for x in zip(t, t[1:])) for i, t in toks}
    for size in (96 << 20, 1):
        monkeypatch.setattr(lmscore, "SEGMENT", size)
        monkeypatch.setattr(lmscore, "SHARD", max(size, 1 << 14))
        off = sorted(x.score - want[x.doc_id] for x in lmscore.score(docs).collect())
        assert sum(abs(x) < 1e-6 for x in off) > len(off) / 10 and off[0] > -4 and off[-1] < 4 and off[len(off) // 2] / 41 < 0.02


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, (1 << 64) - 1), st.integers(1, 3) | st.integers(1, (1 << 63) - 1)), max_size=40))
def test_packed_counts_come_back(pairs):
    pairs = dict(pairs)
    key = np.array(sorted(pairs), np.uint64)
    got = lmscore._unpacked(*lmscore._bytes(key, np.array([pairs[k] for k in key.tolist()], np.uint64)))
    assert dict(zip(*(x.tolist() for x in got))) == pairs


def test_filter_gives_counts_back():
    r = np.random.default_rng(1)
    key = r.integers(0, 1 << 63, 4000, dtype=np.uint64)
    count = (2.0 ** r.uniform(0, 20, 4000)).astype(np.uint64)
    b = lmscore.bucket_of(lmscore.BI, key, 2)
    f = lmscore.Filter(2, {(lmscore.BI, k): lmscore.region(lmscore.BI, key[b == k], count[b == k]) for k in range(4)})
    got = f.read(lmscore.BI, key)
    assert (got >= lmscore.level(count)).all() and (got == lmscore.level(count)).mean() > 0.97
    assert (f.read(lmscore.BI, r.integers(0, 1 << 63, 4000, dtype=np.uint64)) > 0).mean() < 0.04
    assert (f.read(lmscore.UNI, key) == 0).all()
    assert lmscore.level(np.array([1, 2, 3, 4, 7, 8])).tolist() == [1, 2, 2, 3, 3, 4]
    b, count = lmscore.bucket_of(lmscore.CONTEXT, key, 2), count + np.uint64(1)
    exact = lmscore.Filter(2, {(lmscore.CONTEXT, k): lmscore.region(lmscore.CONTEXT, key[b == k], count[b == k]) for k in range(1, 4)}, 1, 3)
    # Numbers of up to 21 bits: at most that many probes of events that are not held.
    assert (exact.read(lmscore.CONTEXT, key[b > 0]) == count[b > 0]).mean() > 1 - 21 * 2.0 ** -lmscore.PROBES[lmscore.CONTEXT]


def test_language_id(spark, docs, none):
    en = "the cat and the dog were in the house of that man with this hat".split()
    fr = "le chat et la chienne sont dans une maison des hommes avec ce chapeau".split()
    r = random.Random(2)
    rows = [(k, " ".join(r.choice(en if k % 2 else fr) for _ in range(12)), "en" if k % 2 else "fr") for k in range(120)]
    rows += [(500, None, "en"), (501, "123 --", "fr"), (502, "maisonette chapeaux", None), (503, "", "en"), (504, "ᚠᚢᚦ", "en")]
    got = {x.doc_id: x for x in langid.identify(frame(spark, rows)).collect()}
    assert all(got[k].lang_pred == g for k, t, g in rows[:120])
    assert {got[k].lang_pred for k in (500, 501, 503)} == {"und"} and got[502].lang_pred == "fr"
    assert all(0 <= x.score <= 1 for x in got.values())
    assert all(x.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, x in got.items())
    assert len(langid.identify(docs).collect()) == len(corpus()) and langid.identify(none).count() == 0
    assert {x.lang_pred for x in langid.identify(frame(spark, [(1, "word", None)])).collect()} == {"und"}


def test_unseen_words_fall_back_to_shorter_grams():
    m = langid.Model(*langid.Model.fit([("a", "w", "foo", 5), ("b", "w", "bar", 5), *(("a", "g", g, 5) for g in langid._grams("foo")), *(("b", "g", g, 5) for g in langid._grams("bar"))]))
    got = m.predict(["foo", "fooo xfo", "arb", "zzz", None, "7"])
    assert [g for g, _ in got] == ["a", "a", "b", "a", "und", "und"] and got[3][1] == 0.5
    assert langid.words("हिन्दी में, É2x ½ a\u0301b") == ["हिन्दी", "में", "é", "x", "a\u0301b"]


def naive_language(rows, sample):
    """The model of its docstring, with plain dictionaries and one word at a time."""
    count, total, types = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang in sample:
        for w in langid.words(text):
            for kind, x in (("word", w), *((len(g), g) for g in langid._grams(w))):
                count[kind, x][lang] += 1
    count = {k: c for k, c in count.items() if k[0] != "word" or sum(c.values()) >= langid.WORDS_FROM}
    n_words, n_grams = sum(k[0] == "word" for k in count), sum(k[0] != "word" for k in count)
    for (kind, _), c in count.items():
        total[kind].update(c)
    langs = sorted({g for _, g in sample})

    def logs(kind, x):
        c = count.get((kind, x))
        if c is None:
            return None
        p = [math.log((c[g] + 0.1) / (total[kind][g] + 0.1 * (n_words if kind == "word" else n_grams))) for g in langs]
        return [v - sum(p) / len(p) for v in p]

    def word(w):
        v = logs("word", w)
        if v is None:
            w = f" {w} "
            found = [next((y for n in range(min(4, len(w) - k), 0, -1) if (y := logs(n, w[k : k + n]))), None) for k in range(len(w))]
            found = [y for y in found if y]
            v = [sum(c) / len(found) for c in zip(*found)] if found else [0.0] * len(langs)
        return v

    for text in rows:
        ws = langid.words(text or "")
        if not ws:
            yield "und", 0.0
            continue
        t = [sum(c) * min(1.0, langid.SURE / len(ws)) for c in zip(*map(word, ws))]
        e = [math.exp(x - max(t)) for x in t]
        yield langs[e.index(max(e))], max(e) / sum(e)


@pytest.mark.parametrize("cache", [200_000, 30])
def test_language_id_by_brute_force(monkeypatch, cache):
    import pyarrow.parquet as pq

    monkeypatch.setattr(langid, "CACHE", cache)
    monkeypatch.setattr(langid, "AT_ONCE", 20 if cache == 30 else langid.AT_ONCE)
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    held = lambda r: zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2
    learnt = [(r["text"], r["lang"]) for r in table if not held(r) and r["text"] and r["lang"]]
    counts = Counter()
    for text, lang in learnt:
        for w in langid.words(text):
            counts[lang, "w", w] += 1
            counts.update((lang, "g", g) for g in langid._grams(w))
    sums = Counter()
    for (_, kind, x), n in counts.items():
        sums[kind, x] += n
    common = [(*k, n) for k, n in counts.items() if k[1] == "g" or sums["w", k[2]] >= langid.WORDS_FROM]
    texts = [r["text"] for r in table] + [None, "", "7 8", "日本", "zq" * 50]
    got = langid.Model(*langid.Model.fit(common)).predict(texts)
    for (a, x), (b, y) in zip(got, naive_language(texts, learnt), strict=True):
        assert abs(x - y) < 1e-3 and (a == b or abs(x - 1 / len({g for _, g in learnt})) < 0.05)


def test_language_query_by_brute_force(spark):
    """op9 on the smallest tables, whose languages have fewer texts than the sample takes."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    learnt = [(r.text, r.lang) for r in table if not held(r.doc_id) and r.text is not None and r.lang is not None]
    assert max(Counter(g for _, g in learnt).values()) <= langid.SAMPLE
    want = {r.doc_id: x for r, x in zip(table, naive_language([r.text for r in table], learnt))}
    for r in queries.op9_language_id(spark, "/root/testdata/sf0.001").collect():
        assert r.lang_pred == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 1e-3 and r.held_out == held(r.doc_id)


def junk(r, k):
    t = sentence(r, r.randint(20, 200), 3000)
    return t.upper().replace(" ", "!! ") if k % 2 else " | ".join(t.split())


def test_quality(spark, docs, none):
    r = random.Random(6)
    rows = [(k, junk(r, k // 3) if k % 3 == 0 else sentence(r, r.randint(20, 400), 3000).capitalize() + ".", "en") for k in range(300)]
    d = frame(spark, rows)
    labels = spark.createDataFrame([(k, 0 if k % 3 == 0 else 1, 0) for k in range(300)] + [(None, 1, 0), (4, None, 0), (9999, 1, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")
    net = quality.train(d, labels)
    got = {x.doc_id: x for x in quality.score(d, net).collect()}
    held = [k for k in got if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k].held_out == (k in held) and got[k].predicted == (got[k].score >= 0.3) for k in got)
    assert np.mean([got[k].predicted == (k % 3 != 0) for k in held]) > 0.95
    kept = quality.keep_good(d, net)
    assert kept.columns == d.columns and {x.doc_id for x in kept.collect()} == {k for k in got if got[k].predicted}
    x = quality.score(docs, net).collect()
    assert len(x) == len(corpus()) and all(0 <= y.score <= 1 for y in x)
    assert len({y.score for y in x if y.doc_id in (160, 161)}) == 1
    assert quality.score(none, net).count() == 0
    assert quality.train(none, labels).score(np.zeros(0, np.uint8), np.array([0, 0])).tolist() != [] and quality.train(d, labels.where("quality = 1")).p == 1.0 and quality.train(d, labels.limit(0)).p == 0.5


def test_scores_do_not_depend_on_slices(monkeypatch):
    net = quality.Net()
    r = random.Random(8)
    texts = [sentence(r, n, 50).encode() for n in (0, 1, 40, 3000, 2, 800)]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    buf = np.frombuffer(b"".join(texts), np.uint8)
    a = net.score(buf, offs)
    monkeypatch.setattr(quality, "SLICE", 1024)
    assert np.allclose(a, net.score(buf, offs), atol=1e-5)
    assert np.allclose(a, [net.score(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts], atol=1e-5)


def naive_quality(net, text):
    """The network of its docstring, one chunk, window and byte at a time."""
    B, S, W = quality.BLOCK, quality.STRIDE, quality.WIDTH
    n = -(-(len(text) + W) // B)
    t = list(text) + [0] * ((n + 2) * B - len(text))
    hidden = []
    for c in range(max(n - 1, 1)):
        lo, hi = c * B, min(c + 2, n) * B
        top = np.max([sum(net.emb[t[k + j]].astype(float) @ net.conv[j * quality.EMBED : (j + 1) * quality.EMBED] for j in range(W)) for k in range(lo, hi, S)], 0)
        seen = {((t[k] | t[k + 1] << 8 | t[k + 2] << 16 | t[k + 3] << 24) * 2654435761 & 0xFFFFFFFF) >> 24 for k in range(lo, hi) if t[k]}
        full = sum(x > 0 for x in t[lo:hi]) / (hi - lo)
        f = np.r_[np.maximum(top + net.bias, 0), 4 * min(len(seen) / 256 / max(full, 1 / B), 1.5) - 2, full]
        hidden.append(np.maximum(f @ net.w1 + net.b1, 0))
    z = np.r_[np.max(hidden, 0), np.mean(hidden, 0)] @ net.w2 + net.b2[0]
    return 1 / (1 + math.exp(-z))


def test_scores_by_brute_force(spark, monkeypatch):
    r = random.Random(12)
    net = quality.Net(5)
    net.bias = np.linspace(-0.5, 0.5, quality.FILTERS).astype(np.float32)
    texts = ["", "a", "é\0日", "x" * 248, "x" * 249, "ab" * 700, *(sentence(r, n, 60) for n in (20, 60, 140, 400)), None]
    want = [naive_quality(net, (t or "").encode()) for t in texts]
    assert max(want) - min(want) > 0.01
    rows = quality.score(frame(spark, [(k, t, "en") for k, t in enumerate(texts)]), net).collect()
    for slices in (quality.SLICE, 512, 1024):
        monkeypatch.setattr(quality, "SLICE", slices)
        assert np.allclose(net.score(*textnum.text_buffers(pa.array(texts))), want, atol=1e-4)
    assert np.allclose([x.score for x in sorted(rows)], want, atol=1e-4)


def test_long_texts_take_bounded_memory():
    import resource

    text = np.frombuffer(("lorem ipsum " * (30 << 20))[: 30 << 20].encode(), np.uint8)
    net = quality.Net(5)
    net.score(text[: 1 << 20], np.array([0, 1 << 20]))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    net.score(text, np.array([0, len(text)]))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200 << 10


def test_gradient():
    r = random.Random(1)
    net = quality.Net(3)
    texts = [sentence(r, n, 30).encode() for n in (30, 200, 90)]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    x, at = quality._blocks(np.frombuffer(b"".join(texts), np.uint8), offs)
    y, w = np.array([1, 0, 1], np.float32), np.array([1, 2, 1], np.float32)
    g = net._gradient(x, at, y, w)

    def loss():
        p, _ = net.head(*net.features(x, at))
        return float(-(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / w.sum())

    for name, k in (("w2", (3,)), ("w1", (2, 1)), ("b1", (4,)), ("bias", (5,)), ("conv", (10, 3)), ("emb", (ord("w"), 2))):
        v = getattr(net, name)
        was, step = v[k], 2e-3
        v[k] = was + step
        up = loss()
        v[k] = was - step
        down = loss()
        v[k] = was
        assert abs((up - down) / (2 * step) - g[name][k]) < 0.05 * max(0.02, abs(g[name][k])) + 2e-3, name
