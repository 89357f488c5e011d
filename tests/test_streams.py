"""Streams and sinks."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from tallyweave.functions import usage
from tallyweave.operators import evaluate, mining, sessions
from tallyweave.sources import files
from tallyweave.sources.requests import from_json
from tallyweave.streaming import state

EVENTS = [
    ("s", 1, "message_start", '{"message":{"usage":{"input_tokens":5,"cache_read_input_tokens":7,"output_tokens":1}}}'),
    ("s", 2, "content_block_delta", '{"delta":{"type":"text_delta","text":"Hel"}}'),
    ("s", 3, "content_block_delta", '{"delta":{"type":"text_delta","text":"lo"}}'),
    ("s", 4, "message_delta", '{"usage":{"output_tokens":9}}'),
    ("s", 5, "message_delta", '{"usage":{}}'),
    ("t", 1, "message_start", '{"message":{"usage":{"output_tokens":2}}}'),
    ("n", 1, "message_delta", '{"usage":{"output_tokens":null}}'),
]
SCHEMA = "stream_id string, seq long, type string, data string"


def test_stream_usage_and_text(spark):
    e = spark.createDataFrame(EVENTS, SCHEMA)
    got = {r.stream_id: tuple(r)[1:] for r in usage.stream_usage(e).collect()}
    assert got == {"s": (5, 0, 7, 9), "t": (0, 0, 0, 2), "n": (0, 0, 0, 0)}
    assert [tuple(r) for r in state.assistant_text(e).collect()] == [("s", "Hello")]


def test_live_usage_is_the_batch_result(spark, tmp_path):
    spark.createDataFrame(EVENTS, SCHEMA).write.json(str(tmp_path / "in"))
    q = state.live_usage(spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))).writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = usage.stream_usage(spark.createDataFrame(EVENTS, SCHEMA))
    assert sorted(spark.table("live").collect()) == sorted(want.collect())


def test_keyed_state(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.ROCKSDB)
    try:
        rows = [("s", "h1", None), ("s", "h1", "p"), ("s", "h2", "p"), ("t", "h1", None)]
        spark.createDataFrame(rows, "session string, hash string, prefix_hash string").coalesce(1).write.json(str(tmp_path / "in"))
        src = spark.readStream.schema("session string, hash string, prefix_hash string").json(str(tmp_path / "in"))
        q = state.session_state(src).writeStream.format("memory").queryName("keyed").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(180)
        got = {r.session: tuple(r)[1:] for r in spark.table("keyed").collect()}
        assert got == {"s": (3, 2, 1, 1), "t": (1, 1, 0, 0)}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_event_lines(spark):
    lines = ["", ": c", "event: x", "data: [DONE]", 'data: {"type":"ping"}', "data: {bad", "other"]
    df = spark.createDataFrame([("s", k, x) for k, x in enumerate(lines)], "stream_id string, seq long, line string")
    got = [(r.kind, r.type, r.data) for r in files.event_lines(df).orderBy("seq").collect()]
    assert [g[0] for g in got] == ["blank", "comment", "event", "done", "json", "raw", "other"]
    assert got[4][1:] == ("ping", '{"type":"ping"}') and got[5][2] == "{bad"


def test_recorded_sessions_become_tasks(spark, tmp_path):
    def row(s, ts, *texts):
        return {"ts": ts, "session": s, "request": {"messages": [{"role": "user", "content": [{"type": "text", "text": t, "cache_control": {"type": "x"}}]} for t in texts]}, "response": {"content": []}}

    rows = [row("abcdefghij", 2.0, "a", "find NEEDLE=xyz."), row("abcdefghij", 1.0, "hello"), row("abcdefghij", 3.0, "<system-reminder>no"), row("only", 1.0, "one"), row("short", 1.0, " "), row("short", 2.0, "x")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "r.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    rec = files.read_recorded(spark, str(tmp_path / "in"))
    good, bad = from_json(rec.withColumn("request_id", F.lit("")), "request")
    assert bad.count() == 0
    both = rec.select("session", "ts", F.monotonically_increasing_id().alias("i"))
    joined = from_json(rec.withColumn("session", F.to_json(F.struct("session", "ts"))).withColumn("request_id", F.lit("")), "request")[0]
    msgs = joined.select(F.get_json_object("session", "$.session").alias("session"), F.get_json_object("session", "$.ts").cast("double").alias("ts"), "messages")
    tasks = mining.mine(msgs).collect()
    assert [(t.id, [(x.user, x.check.value if x.check else None) for x in t.turns]) for t in tasks] == [("recorded-abcdefgh", [("hello", None), ("find NEEDLE=xyz.", "xyz")])]
    assert both.count() == 6 and files.split_sessions(rec, str(tmp_path / "split")) == 3
    files.write_tasks(mining.mine(msgs), str(tmp_path / "tasks"))
    assert files.read_lines(spark, str(tmp_path / "split" / "session=only")).count() == 0  # folders hold .json parts
    assert spark.read.json(str(tmp_path / "tasks")).count() == 1


def test_eviction_and_memo(spark):
    s = spark.createDataFrame([("a", 100), ("b", 90), ("c", 10), ("d", 95)], "session string, t int").select("session", F.timestamp_seconds("t").alias("updated_at"))
    got = sessions.evict(s, F.timestamp_seconds(F.lit(100)), 50.0, 2)
    assert {r.session for r in got.collect()} == {"a", "d"}
    p = spark.createDataFrame([("s", 0, "h"), ("s", 1, "h"), ("s", 2, "i"), ("t", 0, "i")], "session string, turn int, hash string")
    assert [r.hit for r in sessions.memo_hits(p).orderBy("session", "turn").collect()] == [False, True, False, False]


def test_scores_and_verdicts(spark):
    c = "struct<type:string,value:string,pattern:string,values:array<string>>"
    rows = [({"type": "contains", "value": "ab"}, "xaby", 1.0), ({"type": "not_contains", "value": "ab"}, "xaby", 0.0), ({"type": "regex", "pattern": "^x.*y$"}, "xaby", 1.0), ({"type": "exact", "value": " q "}, "q\n", 1.0), ({"type": "all_of", "values": ["a", "z"]}, "a", 0.0), ({"type": "odd"}, "a", None), (None, "a", None)]
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], f"check {c}, out string")
    assert [r[0] for r in df.select(evaluate.objective_score(F.col("check"), F.col("out"))).collect()] == [x for *_, x in rows]
    raw = ['{"winner":"A"}', 'ok {"winner": "tie"} x', '{"winner":"Z"}', 'the winner is "b"', "none", "{broken winner \"a\"}"]
    v = spark.createDataFrame([(x,) for x in raw], "raw string")
    assert [r[0] for r in v.select(evaluate.verdict(F.col("raw"))).collect()] == ["A", "tie", "tie", "B", "tie", "A"]


def test_reports(spark):
    p = spark.createDataFrame([("t", 0, 100, 50, 1.0, 0.5), ("t", 1, 0, 0, 1.0, 1.0)], "task string, turn int, baseline_input long, compressed_input long, baseline_cost double, compressed_cost double")
    s = evaluate.savings_report(p)
    r = s.first()
    assert (r.n, r.mean_saved_pct, r.mean_cost_reduction_pct) == (2, 25.0, 25.0)
    assert [tuple(x) for x in evaluate.savings_by_turn(p).collect()] == [(0, 50.0)]
    q = spark.createDataFrame([(1.0, 0.5), (0.0, 1.0), (1.0, 1.0), (None, 1.0)], "baseline_score double, compressed_score double")
    ql = evaluate.quality_report(q)
    x = ql.first()
    assert (x.n, x.wins, x.ties, x.losses) == (3, 1, 1, 1)
    ci = evaluate.bootstrap_ci(q.select((F.col("baseline_score") - F.col("compressed_score")).alias("d")), "d", 400)
    c = ci.first()
    assert c.n == 3 and -1.0 <= c.lo <= c.mean <= c.hi <= 0.5
    assert evaluate.with_decision(ql, ci).first().non_inferior == (c.hi <= 0.03)
    assert evaluate.bootstrap_ci(q.limit(0).select(F.col("baseline_score").alias("d")), "d").first().n == 0
    assert "input saved: 25.0 %" in evaluate.report_lines(s, ql)


def test_bootstrap_of_many_values(spark):
    rng = random.Random(2)
    rows = [(k, 100 + rng.randrange(9000), rng.randrange(100)) for k, n in (("a", 301), (None, 5), ("b", 40)) for _ in range(n)] + [("b", 0, 0)] * 3

    def interval(v, iters):
        v, n, means = sorted(v), len(v), []
        for it in range(iters):
            draws = (int(hashlib.md5(f"{it}:{k // 4}".encode()).hexdigest()[8 * (k % 4) : 8 * (k % 4) + 8], 16) % n for k in range(n))
            means.append(sum(v[p] for p in draws) / n)
        means.sort()
        return [round(x, 6) for x in (sum(v) / n, means[int(0.025 * iters)], means[int(0.975 * iters)])]

    pct = lambda b, c: 100.0 * (b - c) / b if b else 0.0
    p = spark.createDataFrame([(k, n % 3, b, c, 1.0, 0.5) for n, (k, b, c) in enumerate(rows)], "config string, turn int, baseline_input long, compressed_input long, baseline_cost double, compressed_cost double")
    s = evaluate.savings_report(p, "config", iterations=100)
    assert {r.config: [round(x, 6) for x in (r.mean_saved_pct, r.ci_lo, r.ci_hi)] for r in s.collect()} == {k: interval([pct(b, c) for x, b, c in rows if x == k], 100) for k in ("a", "b", None)}
    values = [pct(b, c) for _, b, c in rows] + [7.5] * 400
    assert len(set(values)) > evaluate.MOST_DISTINCT
    ci = evaluate.bootstrap_ci(spark.createDataFrame([(x,) for x in [*values, None]], "d double"), "d", 60).first()
    assert ci.n == len(values) and [round(x, 6) for x in (ci.mean, ci.lo, ci.hi)] == interval(values, 60)
    few = spark.createDataFrame([(float(x % 7),) for x in range(50)], "d double")
    assert [round(x, 9) for x in evaluate.bootstrap_by(few, "d", iterations=50).first()] == [round(x, 9) for x in evaluate.bootstrap_ci(few, "d", 50).first()]
    assert tuple(evaluate.bootstrap_by(few.limit(0), "d", iterations=9).first()) == (0, 0.0, 0.0, 0.0)

    q = spark.createDataFrame([(1.0, 0.5), (0.0, 1.0)], "baseline_score double, compressed_score double")
    loss = evaluate.bootstrap_ci(q.select((F.col("baseline_score") - F.col("compressed_score")).alias("d")), "d", 40)
    text = evaluate.report_lines(evaluate.savings_report(p, iterations=20), evaluate.with_decision(evaluate.quality_report(q), loss), evaluate.savings_by_turn(p))
    assert "95% CI" in text and "margin 0.030: FAIL, quality regressed" in text and "saved by turn: t0:" in text
    assert "no scored turns" in evaluate.report_lines(s.limit(1), evaluate.quality_report(q.limit(0)))


def test_metrics(spark, tmp_path):
    u = spark.createDataFrame([("s", {"input_tokens": 1_000_000, "output_tokens": None, "cache_creation_input_tokens": 0, "cache_read_input_tokens": 100})], "session string, usage struct<input_tokens:long,output_tokens:long,cache_creation_input_tokens:long,cache_read_input_tokens:long>").withColumn("estimated_input", F.lit(1))
    rows = files.usage_rows(u)
    files.write_metrics(rows, str(tmp_path / "m"))
    files.write_metrics(rows, str(tmp_path / "m"))
    back = spark.read.json(str(tmp_path / "m"))
    assert back.count() == 2 and back.first().cost_usd == 3.00003 and back.first().total_input == 1_000_100


def test_state_snapshots(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    assert files.load_state(spark, path).count() == 0
    for n in (1, 2):
        files.save_state(spark.range(n).select(F.col("id").cast("string").alias("session"), F.lit("x").alias("unknown"), F.lit("h").alias("checkpoint_hash")), path)
        got = files.load_state(spark, path).collect()
        assert len(got) == n and got[0].checkpoint_hash == "h" and got[0].legend is None and "unknown" not in got[0]


def test_final_scores_and_prompt(spark):
    s = spark.createDataFrame([("t", 0, 1.0, 0.0), ("t", 1, 0.5, 1.0), ("t", 2, None, 1.0)], "task string, turn int, baseline_score double, compressed_score double")
    assert [tuple(r) for r in evaluate.final_scores(s, "task").collect()] == [("t", 0.5, 1.0)]
    p = spark.range(1).select(evaluate.judge_prompt(F.lit("do it"), F.lit("base"), F.lit("comp"), F.lit(True))).first()[0]
    assert p.index("comp") < p.index("base") and "do it" in p
