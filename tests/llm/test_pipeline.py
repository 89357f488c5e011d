"""The pipeline's stages against brute force, one after another."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyweave.llm import quality

from .test_operators import brute_groups, corpus, sentence, shingles  # noqa: F401


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    import random

    folder = str(tmp_path_factory.mktemp("sf"))
    rows = corpus()
    r = random.Random(11)
    rows += [(1000 + k, sentence(r, 60, 3000).upper().replace(" ", "!! "), "en") for k in range(40)]
    item = sentence(r, 30, 3000)
    rows += [(2000, sentence(r, 50) + " " + item + " " + sentence(r, 40), "en")]
    spark.createDataFrame([(*x, "src", len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 1000), 0) for i, *_ in rows if i is not None], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item), (1, sentence(r, 30, 3000)), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.collect()
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
    # 1: what the classifier scores too low goes.
    first = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = quality.train(first, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = {r.doc_id for r in quality.score(first, net).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept["quality_classifier"]} == good and sum(r.doc_id is not None and r.doc_id >= 1000 for r in kept["quality_classifier"]) < 10
    # 6: one of each text.
    import re

    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    least = {}
    for r in kept["quality_classifier"]:
        if r.doc_id is not None:
            least[norm(r.text)] = min(least.get(norm(r.text), r.doc_id), r.doc_id)
    want = Counter(r.doc_id for r in kept["quality_classifier"] if r.doc_id is None or least[norm(r.text)] == r.doc_id)
    assert Counter(r.doc_id for r in kept["exact_dedup"]) == want
    # 8: one of each group.
    group = brute_groups([(r.doc_id, r.text, None) for r in kept["exact_dedup"]])
    assert Counter(r.doc_id for r in kept["minhash_neardup"]) == Counter(r.doc_id for r in kept["exact_dedup"] if r.doc_id is None or group[r.doc_id][1] == r.doc_id)
    # 5: nothing of the benchmark.
    items = [shingles(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if shingles(r.text)]
    leak = lambda t: any(100 * len(s & shingles(t)) >= 75 * len(s) for s in items)
    assert Counter(r.doc_id for r in kept["decontamination"]) == Counter(r.doc_id for r in kept["minhash_neardup"] if not leak(r.text))
    assert 2000 not in {r.doc_id for r in kept["decontamination"]} and len(before) > len(kept["decontamination"])
    # 3: all of it, packed; and run() gives the same.
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    key = lambda rows: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(packed) == key(whole) and {r.doc_id for r in packed} == {r.doc_id for r in kept["decontamination"]}
    room = defaultdict(int)
    for r in packed:
        room[r.sequence_id] += r.length
    assert max(room.values()) <= 2048 and len(room) == int(np.ceil(sum(room.values()) / 2048))


def test_stages_take_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
