"""Pairs of arms, hooks, failures, snapshots and small sinks; the two queries without SQL by plain Python."""

import json
import math
import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave import catalogue, schema
from tallyweave.config import Alias, Checkpoint, Config, Dedup, Eigencontext, StateMachine, Tier
from tallyweave.functions import text, usage
from tallyweave.operators import blocks, evaluate, stages
from tallyweave.plans import pipeline
from tallyweave.sources import files
from tallyweave.streaming import state
from tests.test_stages import BOILER, requests, talk, texts

SF = "/root/testdata/sf0.001"


def test_arms_are_paired_by_key(spark):
    b = spark.createDataFrame([("x", "t1", 0, 10), ("x", "t1", 1, 20), ("x", "t2", 0, 30), ("x", "t3", 0, 1), ("x", "t3", 0, 2), ("x", None, 0, 7)], "config string, task string, turn int, input int")
    c = spark.createDataFrame([("x", "t2", 0, 3), ("x", "t1", 0, 1), ("x", "t4", 0, 9), ("x", "t3", 0, 5), ("x", None, 0, 7)], "config string, task string, turn int, input int")
    pairs, rest = evaluate.paired(b, c, "config", "task", "turn")
    assert pairs.columns == ["config", "task", "turn", "baseline_input", "compressed_input"]
    assert sorted(map(tuple, pairs.collect())) == [("x", "t1", 0, 10, 1), ("x", "t2", 0, 30, 3)]
    got = Counter(map(tuple, rest.collect()))
    assert got == Counter([("x", "t1", 1, "baseline", 1), ("x", "t3", 0, "baseline", 2), ("x", "t3", 0, "compressed", 1), ("x", "t4", 0, "compressed", 1), ("x", None, 0, "baseline", 1), ("x", None, 0, "compressed", 1)])
    empty, none = evaluate.paired(b.limit(0), c.limit(0), "config", "task", "turn")
    assert empty.count() == none.count() == 0
    assert pairs.withColumn("saved", evaluate.saved_pct(F.col("baseline_input"), F.col("compressed_input"))).agg(F.max("saved")).first()[0] == 90.0


def test_another_counter_counts_everywhere(spark):
    good, _ = requests(spark, {"system": "ab cd", "messages": [{"role": "user", "content": "one two three"}]})
    text.use_counter(lambda t: F.length(t))
    try:
        assert good.select(blocks.request_tokens()).first()[0] == 5 + 13
        assert spark.range(1).select(text.entry_cost(F.lit("@a1"), F.lit("long")), text.count_tokens(F.lit(None).cast("string"))).first()[0:2] == (11, 0)
    finally:
        text.use_counter(None)
    assert good.select(blocks.request_tokens()).first()[0] == 5


def test_a_request_that_the_provider_fails_on_passes_unchanged(spark):
    def picky(ts):
        if any("poison" in t for t in ts):
            raise ValueError("no vector for this")
        return np.array([[len(t), t.count("e") + 1, 1] for t in ts])

    ref = "<<REF>> " + BOILER * 6
    good, _ = requests(spark, talk(BOILER * 4, BOILER * 4, ref, "a", "b"), talk(BOILER * 4 + "poison", BOILER * 4, "<<REF>> poison. " + BOILER * 6, "a", "b"))
    cfg = Dedup(protect_last=2, min_block_tokens=20)
    out = {r.session: r for r in stages.dedup(good, cfg, F.lit(True), picky).collect()}
    assert out["0"].audit[0].note.startswith("dropped") and texts(out["0"])[1] == [cfg.stub_text]
    assert out["1"].audit[0].note == stages.FAILED and texts(out["1"])[1] == [BOILER * 4] and out["1"].audit[0].after == out["1"].audit[0].before
    out = {r.session: r for r in stages.eigencontext(good, Eigencontext(True, 0.7, "<<REF>>", 1), F.lit(True), picky).collect()}
    assert out["0"].audit[0].after < out["0"].audit[0].before and out["1"].audit[0].note == stages.FAILED and out["1"].audit[0].after == out["1"].audit[0].before
    assert stages.embedding_mode(None) == "hash" and stages.embedding_mode(picky) == "picky"
    rows = {r.session: r for r in pipeline.compress(good.drop("audit"), Config(tier=Tier(1, 2), dedup=cfg, eigencontext=Eigencontext(True, 0.7, "<<REF>>", 1)), embed=picky).collect()}
    assert [a.note for a in rows["1"].audit if a.name in ("semantic_dedup", "eigencontext")] == [stages.FAILED] * 2 and rows["0"].tokens_out < rows["1"].tokens_out


# Floors of each stage alone, in tokens, and of all of them together.

PATH = "/srv/projects/alpha/services/billing/src/handlers/invoice_export_for_partners.py"


def shrunk(before, after):
    return 1 - after / before


def test_dedup_alone(spark):
    body = talk(*[x for k in range(6) for x in (f"Question {k}: " + BOILER * 3, f"Reply {k}. " + BOILER * 2)])
    good, _ = requests(spark, body)
    a = stages.dedup(good, Dedup(protect_last=2, min_block_tokens=20), F.lit(True)).first().audit[0]
    assert shrunk(a.before, a.after) >= 0.35


def test_alias_alone(spark):
    good, _ = requests(spark, talk(f"{PATH} " * 10 + "are what we look at", f"one more: {PATH}"))
    a = stages.alias(good, Alias(True, min_occurrences=4, protect_last=0), F.lit(True)).first().audit[0]
    assert shrunk(a.before, a.after) >= 0.15


def test_checkpoint_alone(spark):
    good, _ = requests(spark, talk(*[x for k in range(10) for x in (f"{k} " + BOILER * 4, f"{k} " + BOILER * 2)], "and now?"))
    a = stages.checkpoint(good, Checkpoint(trigger_tokens=500, keep_recent=4, summary_tokens=300), F.lit(True)).first().audit[0]
    assert shrunk(a.before, a.after) >= 0.40


ALL = Config(tier=Tier(50, 100), checkpoint=Checkpoint(trigger_tokens=800, keep_recent=6, summary_tokens=150), dedup=Dedup(protect_last=2, min_block_tokens=20), eigencontext=Eigencontext(True, 0.7, "<<REF>>", 1), alias=Alias(True, min_occurrences=4, protect_last=0), state_machine=StateMachine(True))


def test_all_six_stages_and_every_tier(spark):
    talked = [x for k in range(8) for x in (f"{k}: " + BOILER * 4, f"{k}: " + BOILER * 2)]
    full = talk(*talked, "<<REF>> " + "Every invoice goes to the ledger as a signed file at six. " * 5 + "My cat sleeps. " + "Every invoice goes to the ledger as a signed file at six. " * 4, "Understood.", f"See {PATH} and {PATH} and {PATH}", f"Yes, {PATH}", "What now?")
    full |= {"system": "Be brief.", "tools": [{"name": "t", "description": "d"}], "metadata": {"_fsm": {"current": "a", "states": {"a": {"go": "b"}, "b": {}}}, "user": "u"}}
    tool = {"messages": [{"role": "user", "content": [{"type": "tool_result", "content": BOILER * 8}]}, {"role": "assistant", "content": f"{PATH} " * 8}, {"role": "user", "content": [{"type": "tool_result", "content": BOILER * 8}]}, {"role": "assistant", "content": "ok"}, {"role": "user", "content": "go"}]}
    short = talk(BOILER * 4, "fine", "go")
    good, _ = requests(spark, full, tool, short, talk("hi"))
    rows = {r.session: r for r in pipeline.compress(good.drop("audit"), ALL).collect()}
    assert [rows[k].tier for k in "0123"] == ["full", "tool", "short", "tiny"]
    assert [a.name for a in rows["0"].audit] == ["state_machine", "checkpoint_compression", "semantic_dedup", "eigencontext", "alias_substitution", "cache_breakpoints"]
    assert [a.name for a in rows["1"].audit] == ["checkpoint_compression", "semantic_dedup", "cache_breakpoints"]
    assert all([a.name for a in rows[k].audit] == ["cache_breakpoints"] for k in "23")
    notes = {a.name: a for a in rows["0"].audit}
    assert notes["state_machine"].note == "injected table" and notes["checkpoint_compression"].note.startswith("folded ") and notes["eigencontext"].after < notes["eigencontext"].before
    assert notes["alias_substitution"].note == "aliased 1" and notes["cache_breakpoints"].note == "breakpoints: 3"
    assert shrunk(rows["0"].tokens_in, rows["0"].tokens_out) >= 0.40 and texts(rows["0"])[-1] == ["What now?"]
    assert all(a.after <= a.before for a in rows["1"].audit) and rows["1"].tokens_out < rows["1"].tokens_in
    undone = text.expand(F.lit(" ".join(t for m in texts(rows["0"]) for t in m if t)), F.lit([]).cast(stages.LEGEND_TYPE))
    assert PATH in spark.range(1).select(undone).first()[0]
    one = {r.config: r for r in pipeline.ablations(good.drop("audit"), ALL).where("session = '0'").collect()}
    for name, cfg in (("full", ALL), ("no checkpoint", ALL.only(checkpoint=False)), ("no dedup", ALL.only(dedup=False)), ("no breakpoints", ALL.only(breakpoints=False))):
        assert one[name].tokens_out == pipeline.compress(good.drop("audit"), cfg).where("session = '0'").first().tokens_out


# What a plain loop says.


def naive_cosines(ts):
    vs = []
    for t in ts:
        grams = re.findall(r"\w+|[^\w\s]", t.lower()) + [t[k : k + 3] for k in range(len(t) - 2)]
        vs.append(Counter(__import__("hashlib").md5(g.encode()).digest()[15] for g in grams))
    dot = lambda a, b: sum(n * b[k] for k, n in a.items())
    return [[round(min(1.0, dot(a, b) / math.sqrt(dot(a, a) * dot(b, b))), 9) if a and b else 0.0 for b in vs] for a in vs]


def naive_cover(ts, share):
    cos, n, out = naive_cosines(ts), len(ts), []
    covered = [0.0] * n
    while len(out) < n:
        gains = [(-1 if k in out else round(sum(max(c, x) for c, x in zip(covered, cos[k])) - sum(covered), 9)) for k in range(n)]
        k = gains.index(max(gains))
        if gains[k] <= 0:
            break
        out.append(k)
        covered = [max(c, x) for c, x in zip(covered, cos[k])]
        if sum(covered) >= share * n:
            break
    return sorted(out)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_eigen_cover_by_plain_loop(spark):
    said = {(r.session, r.mi): r.s for r in catalogue.messages(spark, SF).select(F.col("session").cast("string").alias("session"), "mi", text.sentences(F.coalesce("text", F.lit(""))).alias("s")).collect()}
    got = {(r.session, r.mi): (r.sentences, list(r.kept)) for r in catalogue.QUERIES["eigen_cover"](spark, SF).collect()}
    assert got == {k: (len(s), naive_cover(s, 0.70)) for k, s in said.items() if len(s) >= 4} and got


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_thinned_texts_by_plain_loop(spark):
    said = {(r.session, r.mi): (r.text, r.s) for r in catalogue.messages(spark, SF).select(F.col("session").cast("string").alias("session"), "mi", "text", text.sentences(F.coalesce("text", F.lit(""))).alias("s")).collect()}
    token = re.compile(r"\w+|[^\w\s]")
    got = {(r.session, r.mi): tuple(r)[2:] for r in catalogue.QUERIES["eigencontext_apply"](spark, SF).collect()}
    thin = 0
    for k, (t, s) in said.items():
        if k in got:
            whole = "<<REF>> " + t
            want = "<<REF>> " + " ".join(s[i] for i in naive_cover(s, 0.70)) if len(s) >= 4 else whole
            thin += want != whole
            assert got[k] == (len(token.findall(whole)) + 2, len(token.findall(want)) + 2, want)
    assert thin and len(got) == sum(t is not None for t, _ in said.values())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_replay_by_one_request_at_a_time(spark):
    whole = catalogue.conversations(spark, SF)
    want = Counter()
    sums = {}
    for r in whole.select("session", F.size("messages").alias("n"), F.transform("messages", lambda m: m["role"]).alias("roles")).collect():
        for turn in (k for k, role in enumerate(r.roles) if role == "user"):
            want[turn] += 1
    sent = [whole.withColumn("messages", F.slice("messages", 1, k + 1)).where(F.element_at("messages", -1)["role"] == "user").where(F.size("messages") == k + 1).withColumn("turn", F.lit(k)) for k in sorted(want)[:4]]
    for k, part in zip(sorted(want)[:4], sent):
        rows = pipeline.compress(part.drop("turn"), catalogue.CONFIG).select("tokens_in", "tokens_out").collect()
        sums[k] = (len(rows), sum(r.tokens_in for r in rows), sum(r.tokens_out for r in rows))
    got = {r.turn: (r.n, r.baseline_input, r.compressed_input) for r in catalogue.QUERIES["replay_savings"](spark, SF).collect()}
    assert {k: v[0] for k, v in got.items()} == dict(want) and {k: got[k] for k in sums} == sums


# Sinks, sources and small functions.


def test_task_files(spark, tmp_path):
    t = spark.createDataFrame([("a", "s", None, 5, None, [("q", ("contains", "x", None, None), True, None), ("r", None, None, None)]), ("b", None, None, None, ("exact", "y", None, None), [])], schema.TASK)
    files.write_tasks(t, str(tmp_path / "t.jsonl"))
    lines = [json.loads(x) for f in (tmp_path / "t.jsonl").glob("part-*") for x in f.read_text().splitlines()]
    assert {x["id"]: set(x) for x in lines} == {"a": {"id", "system", "max_tokens", "turns"}, "b": {"id", "check", "turns"}}
    back = {r.id: r for r in files.read_tasks(spark, str(tmp_path / "t.jsonl")).collect()}
    assert back["a"].turns[0].check.value == "x" and back["a"].turns[1].check is None and back["b"].check.type == "exact" and back["b"].turns == []


def test_recorded_calls_are_appended(spark, tmp_path):
    row = lambda s, k: spark.createDataFrame([(float(k), s, '{"a":1}', "{}")], schema.RECORDED)
    for s, k in (("x", 1), ("y", 2), ("x", 3)):
        files.record(row(s, k), str(tmp_path / "r"))
    back = spark.read.json(str(tmp_path / "r"))
    assert Counter((r.session, r.ts) for r in back.collect()) == Counter([("x", 1.0), ("y", 2.0), ("x", 3.0)])


def test_cache_marks_are_taken_off(spark):
    mark = {"type": "ephemeral"}
    good, _ = requests(spark, {"system": [{"type": "text", "text": "s", "cache_control": mark}], "tools": [{"name": "t", "cache_control": mark}], "messages": [{"role": "user", "content": [{"type": "text", "text": "a", "cache_control": mark}, {"type": "text", "text": "b"}]}]}, talk("x"))
    has = lambda df: [r[0] for r in df.orderBy("session").select(blocks.has_breakpoints(F.col("system"), F.col("tools"), F.col("messages"))).collect()]
    assert has(good) == [True, False] and has(blocks.without_cache_control(good)) == [False, False]
    assert texts(blocks.without_cache_control(good).orderBy("session").first()) == [["a", "b"]]


def test_fenced_headers_and_overrides(spark):
    one = lambda *c: spark.range(1).select(*c).first()
    said = ["a ```diff\nx\ny\n``` b ```\nz\n```", "```patch\np\n```", "```\nq\n```", "```python\nr\n```", "no fence", ""]
    assert [one(text.fenced(F.lit(x)))[0] for x in said] == ["x\ny\n", "p\n", "q\n", "```python\nr\n```", "no fence", ""]
    assert one(text.first_needle(F.array(F.lit("none"), F.lit("NEEDLE=k1 NEEDLE=k2"), F.lit("NEEDLE=k3"))))[0] == "k1"
    h = F.create_map(F.lit("X-Api-Key"), F.lit("1"), F.lit("Cookie"), F.lit("2"), F.lit("anthropic-version"), F.lit("3"))
    assert one(blocks.allowed_headers(h, ["x-api-key", "Anthropic-Version"]))[0] == {"X-Api-Key": "1", "anthropic-version": "3"}
    kind = "struct<type:string,value:string>"
    t, none = F.struct(F.lit("exact").alias("type"), F.lit("t").alias("value")), F.lit(None).cast(kind)
    assert one(evaluate.overridden(t, none)["value"], evaluate.overridden(t, F.struct(F.lit("exact").alias("type"), F.lit("u").alias("value")))["value"], evaluate.overridden(none, none))[0:3] == ("t", "u", None)


def test_streams_are_expanded(spark, tmp_path):
    delta = lambda t: json.dumps({"type": "content_block_delta", "index": 0, "delta": {"type": "text_delta", "text": t}})
    rows = [("m", "s", 1, "content_block_delta", delta("see @a1, @a10")), ("m", "s", 2, "message_stop", "{}"), ("n", "none", 1, "content_block_delta", delta("@a1")), ("m", "s", 3, "content_block_delta", delta("@a")), ("m", "s", 4, "content_block_delta", delta("1"))]
    kind = "stream_id string, session string, seq long, type string, data string"
    spark.createDataFrame(rows, kind).write.json(str(tmp_path / "in"))
    legends = spark.createDataFrame([("s", [("@a1", "one"), ("@a10", "ten")])], f"session string, legend {stages.LEGEND_TYPE}")
    q = state.expanded(spark.readStream.schema(kind).json(str(tmp_path / "in")), legends).writeStream.format("memory").queryName("expanded").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {(r.stream_id, r.seq): json.loads(r.data).get("delta", {}).get("text") for r in spark.table("expanded").collect()}
    assert got == {("m", 1): "see one, ten", ("m", 2): None, ("n", 1): "@a1", ("m", 3): "@a", ("m", 4): "1"}


def test_state_of_idle_sessions_goes(spark, tmp_path):
    import time

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.ROCKSDB)
    kind = "session string, hash string, prefix_hash string"
    try:
        (tmp_path / "in").mkdir()
        put = lambda k: spark.createDataFrame([("s", "h", None)], kind).coalesce(1).write.json(str(tmp_path / f"in/{k}"))
        src = spark.readStream.schema(kind).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
        q = state.session_state(src, ttl_ms=4000).writeStream.format("memory").queryName("idle").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            wait = lambda n: next((r for _ in range(240) if not time.sleep(0.25) and len(r := spark.table("idle").collect()) >= n), [])
            put(0)
            assert [tuple(r)[1:4] for r in wait(1)] == [(1, 1, 0)]
            time.sleep(5)
            put(1)
            assert [tuple(r)[1:4] for r in wait(2)][1] == (1, 1, 0)  # begun anew
        finally:
            q.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_snapshots_are_whole_at_any_moment(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    snapshot = lambda n: spark.range(n).select(F.col("id").cast("string").alias("session"))
    files.save_state(snapshot(1), path)
    held = files.load_state(spark, path)
    files.save_state(snapshot(2), path)
    assert held.count() == 1 and files.load_state(spark, path).count() == 2
    (tmp_path / "state/writing-lost").mkdir()  # what a writer that died leaves
    for n in (3, 4, 5):
        files.save_state(snapshot(n), path)
    assert files.load_state(spark, path).count() == 5
    assert sorted(x.name for x in (tmp_path / "state").iterdir() if x.name[0] == "v") == ["v3", "v4", "v5"]
    assert usage is not None
