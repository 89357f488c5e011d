"""The compression stages on fixtures of our own."""

import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyweave import schema
from tallyweave.config import Alias, Breakpoints, Checkpoint, Config, Dedup, Eigencontext, StateMachine, Tier, coerce, load
from tallyweave.functions import similarity, text
from tallyweave.operators import blocks, stages
from tallyweave.plans import pipeline
from tallyweave.sources.requests import from_json

TOKEN = re.compile(r"\w+|[^\w\s]")
BOILER = "The deployment guide says that every service must be restarted after the configuration changes. "


def requests(spark, *bodies):
    good, bad = from_json(spark.createDataFrame([(str(k), str(k), b if isinstance(b, str) else json.dumps(b)) for k, b in enumerate(bodies)], "session string, request_id string, value string"))
    return good.withColumn("audit", F.array().cast(schema.AUDIT)), bad


def talk(*texts):
    return {"messages": [{"role": "user" if k % 2 == 0 else "assistant", "content": t} for k, t in enumerate(texts)]}


def texts(row):
    return [[b.text for b in m.content] for m in row.messages]




def test_ingest_keeps_what_content_was(spark):
    body = {"system": "s", "messages": [{"role": "user", "content": "[1]"}, {"role": "user", "content": [{"type": "text", "text": "a"}, "bare", {"type": "image"}, {"type": "tool_result", "content": "[2]"}, {"type": "tool_result", "content": [{"type": "text", "text": "p"}, {"type": "image"}, {"type": "text", "text": "q"}]}, {"type": "tool_use", "input": {"z": 1, "a": 2}}]}, {"role": "user"}]}
    good, bad = requests(spark, body, "no json", "[1]", '{"messages": []}')
    rows = {r.session: r for r in good.collect()}
    assert bad.count() == 2 and set(rows) == {"0", "3"}
    m = rows["0"].messages
    assert m[0].content[0].text == "[1]" and m[2].content == []
    assert [b.type for b in m[1].content] == ["text", "__str__", "image", "tool_result", "tool_result", "tool_use"]
    assert m[1].content[3].result_is_string and not m[1].content[4].result_is_string
    flat = good.where("session = '0'").select(blocks.content_text(F.col("messages")[1]["content"])).first()[0]
    assert flat == 'a\nbare\n\n[2]\np\n\nq\n{"z":1,"a":2}'
    assert rows["3"].messages == []


def test_tokens_and_results(spark):
    good, _ = requests(spark, {"system": [{"type": "text", "text": "be kind"}], "tools": [{"name": "t"}], "messages": [{"role": "user", "content": [{"type": "tool_result", "content": "x y z"}, {"type": "text", "text": "hi, you"}]}]})
    r = good.select(blocks.request_tokens().alias("t"), blocks.result_tokens().alias("r"), blocks.tool_heavy(F.col("messages")).alias("h")).first()
    assert (r.t, r.r, r.h) == (2 + 3 + 3 + len(TOKEN.findall('[{"name":"t"}]')), 3, True)


@pytest.mark.parametrize("keep, roles, cut", [(2, "uauau", 3), (2, "uaua", 3), (0, "uau", 3), (9, "auau", 0), (9, "uaua", 1), (2, "auuu", 4), (1, "", 0)])
def test_split_begins_with_an_assistant(spark, keep, roles, cut):
    good, _ = requests(spark, {"messages": [{"role": {"u": "user", "a": "assistant"}[x], "content": "t"} for x in roles]})
    assert good.select(stages.split_at(F.col("messages"), keep)).first()[0] == cut
    if cut == len(roles) and roles:
        assert good.select(stages.split_at(F.col("messages"), keep, True)).first()[0] == cut - 1


def summary(t, target):
    paras = [p.strip() for p in t.split("\n\n") if p.strip()]
    if not paras:
        return t[: 4 * target]
    head = max(1, len(paras) // 4)
    tail = max(head, len(paras) - max(1, len(paras) // 2))
    out, used = [], 0
    for p in paras[:head] + paras[tail:]:
        n = len(TOKEN.findall(p))
        if used + n > target:
            break
        out.append(p)
        used += n
    return "\n\n".join(out)


@pytest.mark.parametrize("t", ["", " \n ", "a b c", "\n\n".join(f"para {k} has words" for k in range(9)), "long " * 30 + "\n\nshort", "a\n\n\n\nb\n\n c "])
def test_summary(spark, t):
    got = spark.createDataFrame([(t,)], "t string").select(stages.extractive_summary(F.col("t"), 12)).first()[0]
    assert got == summary(t, 12)


def test_checkpoint_folds_and_keeps_the_memo(spark):
    body = talk(*[BOILER * 4 if k % 2 == 0 else BOILER * 2 for k in range(20)], "What now?")
    good, _ = requests(spark, body, talk("hi"))
    cfg = Checkpoint(trigger_tokens=500, keep_recent=4, summary_tokens=300)
    out = stages.checkpoint(good, cfg, F.lit(True))
    rows = {r.session: r for r in out.collect()}
    a = rows["0"].audit[0]
    assert a.after <= 0.6 * a.before and texts(rows["0"])[-1] == ["What now?"]
    roles = [m.role for m in rows["0"].messages]
    assert all(x != y for x, y in zip(roles, roles[1:])) and roles[0] == "user"
    assert rows["1"].audit[0].note == "under trigger" and texts(rows["1"]) == [["hi"]]
    again = good.join(out.select("session", "checkpoint_hash", F.lit("kept").alias("checkpoint_text")), "session")
    r = stages.checkpoint(again, cfg, F.lit(True)).where("session = '0'").first()
    assert "kept" in texts(r)[0][0] and "unchanged prefix" in r.audit[0].note


def test_dedup_stubs_later_copies(spark):
    long = BOILER * 3
    body = {"messages": [{"role": "user", "content": "First: " + long}, {"role": "assistant", "content": [{"type": "tool_result", "content": [{"type": "image"}, {"type": "text", "text": long}, {"type": "text", "text": "tail"}]}]}, {"role": "user", "content": [{"type": "tool_result", "content": long}]}, {"role": "assistant", "content": "Numbers 1 2 3 4 5 6 7 8 9 10 differ from all of it, as does this line of other words and more of them to be long enough " * 2}, {"role": "user", "content": long}, {"role": "assistant", "content": "ok"}]}
    good, _ = requests(spark, body, talk("short"))
    cfg = Dedup(protect_last=2, min_block_tokens=20)
    r = {x.session: x for x in stages.dedup(good, cfg, F.lit(True)).collect()}
    m = r["0"].messages
    assert m[0].content[0].text.startswith("First: ")
    assert [p.text for p in m[1].content[0].parts] == [None, cfg.stub_tool, "tail"]
    assert m[2].content[0].parts[0].text == cfg.stub_tool and m[2].content[0].result_is_string
    assert m[3].content[0].text.startswith("Numbers") and m[4].content[0].text == long
    assert r["0"].audit[0].after < r["0"].audit[0].before
    assert r["1"].audit[0].note == "nothing to dedup"


def test_eigencontext_thins_marked_texts(spark):
    t = "<<REF>> " + BOILER * 5 + "The cache is flushed at night. " + BOILER * 4 + "Backups run on Sunday. " + BOILER * 3
    good, _ = requests(spark, talk(t, "ok", "now?", "yes"), talk("<<REF>> One. Two.", "a", "b", "c"))
    r = {x.session: x for x in stages.eigencontext(good, Eigencontext(True, 0.70, "<<REF>>", 2), F.lit(True)).collect()}
    a = r["0"].audit[0]
    assert a.after <= 0.82 * a.before and texts(r["0"])[0][0].startswith("<<REF>> The deployment")
    assert texts(r["1"])[0][0] == "<<REF>> One. Two."


PATH = "/srv/projects/alpha/services/billing/src/handlers/invoice_export.py"


def test_alias_pays_and_expands_back(spark):
    body = talk(*[f"Look at {PATH} and then {PATH}.bak please" for _ in range(6)], "fine")
    good, _ = requests(spark, body, talk("nothing here", "ok"))
    df = stages.alias(good, Alias(True, 4, 20, 24, 0), F.lit(True))
    r = {x.session: x for x in df.collect()}
    a = r["0"].audit[0]
    assert a.after <= 0.85 * a.before and r["0"].legend and r["1"].legend == []
    assert "[ALIAS LEGEND" in texts(r["0"])[0][0] and PATH not in "".join(t for m in texts(r["0"])[1:] for t in m)
    back = df.where("session = '0'").select(F.transform("messages", lambda m: stages.expand_content(m["content"], F.col("legend"))).alias("c")).first().c
    assert [b.text for m in back for b in m][1:] == [m["content"] for m in body["messages"]]
    later = good.where("session = '0'").join(df.select("session", "legend"), "session")
    assert stages.alias(later, Alias(True, 4, 20, 24, 0), F.lit(True)).first().audit[0].note == "no alias candidates"


def test_alias_candidates_as_by_a_loop(spark):
    rng = random.Random(1)
    rows = [None, [], ["a"], ["a", "a"], ["b", "a", "b", "a"]] + [[f"w{rng.randint(0, 30)}" * rng.randint(1, 2) for _ in range(rng.randint(0, 80))] for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, x array<string>")
    for r in df.select("id", stages.alias_candidates(F.col("x"), 2).alias("c")).collect():
        x = rows[r.id]
        if x is None:
            assert r.c is None
            continue
        n = Counter(x)
        want = sorted((s for s in n if n[s] >= 2), key=lambda s: (-len(s) * n[s], x.index(s)))
        assert [tuple(c) for c in r.c] == [(s, n[s]) for s in want]


def test_expansion_takes_longest_alias_first(spark):
    legend = F.array(*(F.struct(F.lit(a).alias("alias"), F.lit(o).alias("original")) for a, o in (("@a1", "one"), ("@a10", "ten"))))
    df = spark.range(1).select(text.expand(F.lit("@a10 @a1 @a2"), legend).alias("x"), text.substitute(F.lit("/api /api/users"), F.array(F.struct(F.lit("@a0").alias("alias"), F.lit("/api").alias("original")), F.struct(F.lit("@a1").alias("alias"), F.lit("/api/users").alias("original")))).alias("y"))
    assert tuple(df.first()) == ("ten one @a2", "@a0 @a1")
    d = '{"type":"content_block_delta","index":1,"delta":{"type":"text_delta","text":"see @a1"}}'
    e = spark.createDataFrame([("content_block_delta", d), ("message_stop", "{}"), ("content_block_delta", "junk")], "type string, data string")
    got = [json.loads(r[0])["delta"]["text"] if "delta" in r[0] else r[0] for r in e.select(stages.expand_event(F.col("type"), F.col("data"), legend)).collect()]
    assert got == ["see one", "{}", "junk"]


def test_machine_table_and_breakpoints(spark):
    body = {"system": "s", "tools": [{"name": "a"}, {"name": "b"}], "metadata": {"_fsm": {"current": "x", "states": {"z": {"go": "y", "by": "x"}, "y": {}}}}, "messages": [{"role": "user", "content": "1"}, {"role": "assistant", "content": "2"}, {"role": "user", "content": "3"}]}
    own = {"messages": [{"role": "user", "content": [{"type": "text", "text": "t", "cache_control": {"type": "ephemeral"}}]}]}
    good, _ = requests(spark, body, own)
    df = stages.breakpoints(stages.state_machine(good, F.lit(True)), Breakpoints(), F.lit(True))
    r = {x.session: x for x in df.collect()}
    m = r["0"]
    assert texts(m)[0][0] == "WORKFLOW (compact FSM). current=x\n  z: go->y by->x\n  y: (terminal)" and m.metadata is None
    assert m.system[-1].cache_control and m.tools[-1].cache_control and not m.tools[0].cache_control
    assert [bool(x.content[-1].cache_control) for x in m.messages] == [False, True, False]
    assert m.audit[1].after > m.audit[1].before  # the tool's mark counts
    assert r["1"].audit[1].note == "client has its own" and r["1"].prefix_hash is None
    few = stages.breakpoints(good.where("session = '0'"), Breakpoints(most=1), F.lit(True)).first()
    assert few.system[-1].cache_control and not few.tools[-1].cache_control


def test_pipeline_tiers_and_live_turn(spark):
    long = talk(*[BOILER * 6 for _ in range(12)], "What now?")
    good, _ = requests(spark, long, talk("hi", "ok"), {"messages": []})
    cfg = Config(tier=Tier(50, 100), checkpoint=Checkpoint(trigger_tokens=300, keep_recent=4, summary_tokens=100), alias=Alias(True), state_machine=StateMachine(True))
    rows = {r.session: r for r in pipeline.compress(good.drop("audit"), cfg).collect()}
    assert [rows[k].tier for k in "012"] == ["full", "tiny", "tiny"]
    assert [a.name for a in rows["1"].audit] == ["cache_breakpoints"] and rows["1"].tokens_out == rows["1"].tokens_in
    assert [a.name for a in rows["0"].audit] == ["state_machine", "checkpoint_compression", "semantic_dedup", "alias_substitution", "cache_breakpoints"]
    assert rows["0"].tokens_out < 0.6 * rows["0"].tokens_in and texts(rows["0"])[-1] == ["What now?"]
    assert {r.config for r in pipeline.ablations(good.drop("audit"), cfg).collect()} == {"full", "no checkpoint", "no dedup", "no breakpoints"}


def test_otsu_needs_three_pairs(spark):
    p = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("b", 0.1), ("b", 0.1), ("b", 0.95), ("c", 0.5), ("c", 0.5), ("c", 0.5)], "g string, cos double")
    got = {r.g: round(r.threshold, 3) for r in similarity.otsu(p, "g").collect()}
    assert got["a"] == 0.93 and got["b"] == 0.105 and got["c"] == 0.93


def test_config(tmp_path):
    f = tmp_path / "c.json"
    f.write_text(json.dumps({"max_sessions": 7, "dedup": {"threshold": 0.5, "nonsense": 1}, "other": 2}))
    c = load(str(f), {"TALLYWEAVE_MAX_SESSIONS": "9"})
    assert (c.max_sessions, c.dedup.threshold, c.dedup.protect_last) == (9, 0.5, 4)
    assert load(str(tmp_path / "none"), {}) == Config()
    assert coerce(Dedup, {}) == Dedup()
