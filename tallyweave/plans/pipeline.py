"""All stages in their fixed order, routed by each request's tier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave import schema
from tallyweave.config import Config, Tier
from tallyweave.functions.let import let
from tallyweave.operators import blocks, stages

#: The order is part of the meaning: folding first leaves less to the others.
ORDER = ("state_machine", "checkpoint", "dedup", "eigencontext", "alias", "breakpoints")
#: Stages that understand tool results.
TOOL_SAFE = ("checkpoint", "dedup", "breakpoints")


def tier(tokens: Column, results: Column, cfg: Tier) -> Column:
    """tiny, short, tool or full."""
    return F.when(tokens < cfg.tiny, "tiny").when(tokens < cfg.short, "short").when(F.coalesce(F.try_divide(results, tokens), F.lit(0.0)) > cfg.tool_ratio, "tool").otherwise("full")


def runs(name: str, t: Column) -> Column:
    if name == "breakpoints":
        return F.lit(True)
    return t.isin("tool", "full") if name in TOOL_SAFE else t == "full"


def compress(requests: DataFrame, cfg: Config, off: Column | None = None, embed: stages.Embed | None = None) -> DataFrame:
    """Requests after all stages, with tier, tokens_in, tokens_out and audit.

    The tier is that of the request as it came.  Stages that are off are not part of the
    plan; ``off`` names, for each request, one more that passes it by.  tokens_out is the
    size after the last stage that changes sizes.  Built-in functions give null where they
    cannot give a value, and a request that Python code or the provider ``embed`` fails on
    passes that stage unchanged, with a note in its audit.
    """
    df = let(requests, tokens_in=blocks.request_tokens(), audit=F.array().cast(schema.AUDIT))
    df = let(df, tier=tier(F.col("tokens_in"), blocks.result_tokens(), cfg.tier))
    for name in ORDER:
        section = getattr(cfg, name)
        if not section.enabled:
            continue
        stage, run = getattr(stages, name), runs(name, F.col("tier"))
        run = run if off is None else run & ~off.eqNullSafe(F.lit(name))
        if name == "state_machine":
            df = stage(df, run)
        elif name in ("dedup", "eigencontext"):
            df = stage(df, section, run, embed)
        else:
            df = stage(df, section, run)
    sized = F.filter("audit", lambda a: a["name"] != "cache_breakpoints")
    return let(df, tokens_out=F.coalesce(F.try_element_at(sized, F.lit(-1))["after"], F.col("tokens_in")))


def audit_rows(compressed: DataFrame) -> DataFrame:
    """A row for each stage that ran: session, request_id, step, name, before, after, saved, note."""
    a = compressed.select("session", "request_id", F.posexplode("audit").alias("step", "a"))
    return a.select("session", "request_id", "step", "a.name", "a.before", "a.after", F.greatest(F.lit(0), F.col("a.before") - F.col("a.after")).alias("saved"), "a.note")


def ablations(requests: DataFrame, cfg: Config) -> DataFrame:
    """The pipeline with all stages, and without each of three, under a ``config`` column.

    Requests are read once; each goes through the one plan once for each configuration.
    """
    each = F.array(F.lit("full"), *[F.lit(f"no {x}") for x in ("checkpoint", "dedup", "breakpoints")])
    out = compress(requests.withColumn("config", F.explode(each)), cfg, off=F.replace(F.col("config"), F.lit("no "), F.lit("")))
    return out.select("config", "session", "request_id", "tier", "tokens_in", "tokens_out")


def replay(requests: DataFrame, cfg: Config) -> DataFrame:
    """Each user turn of recorded conversations as it was sent, plain and compressed.

    (session, turn, baseline_input, compressed_input, tier), where a turn's request holds
    the conversation up to it.  Replies are those of the recording, in both arms.
    """
    turns = requests.select("*", F.posexplode("messages").alias("turn", "said")).where("said.role = 'user'")
    sent = turns.drop("said").withColumn("messages", F.slice("messages", F.lit(1), F.col("turn") + 1))
    out = compress(sent, cfg)
    return out.select("session", F.col("turn").cast("long").alias("turn"), F.col("tokens_in").alias("baseline_input"), F.col("tokens_out").alias("compressed_input"), "tier")
