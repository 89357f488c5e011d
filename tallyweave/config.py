"""Settings: frozen sections over defaults, a JSON file over these, the environment over both."""

from __future__ import annotations

import dataclasses
import json
import logging
import os
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

log = logging.getLogger(__name__)
ENV = "TALLYWEAVE_"


# The defaults that results depend on.
@dataclass(frozen=True)
class Dedup:
    enabled: bool = True
    threshold: float = 0.93
    protect_last: int = 4
    min_block_tokens: int = 40
    context_limit: int = 180_000
    lexical: bool = True
    stub_text: str = "[redundant context removed]"
    stub_tool: str = "[duplicate tool result removed]"
    one_bin: float = 0.93


@dataclass(frozen=True)
class Checkpoint:
    enabled: bool = True
    trigger_tokens: int = 12_000
    keep_recent: int = 8
    summary_tokens: int = 600
    min_ratio: float = 2.0
    protect_live_turn: bool = False


@dataclass(frozen=True)
class Breakpoints:
    enabled: bool = True
    most: int = 4


@dataclass(frozen=True)
class Eigencontext:
    enabled: bool = False
    coverage: float = 0.92
    marker: str = "<<REF>>"
    protect_last: int = 4


@dataclass(frozen=True)
class Alias:
    enabled: bool = False
    min_occurrences: int = 8
    min_length: int = 24
    most: int = 24
    protect_last: int = 4
    full_legend: bool = False


@dataclass(frozen=True)
class StateMachine:
    enabled: bool = False


@dataclass(frozen=True)
class Tier:
    tiny: int = 2_000
    short: int = 4_000
    tool_ratio: float = 0.30


@dataclass(frozen=True)
class Config:
    metrics_path: str = "./metrics.jsonl"
    max_sessions: int = 500
    session_ttl_seconds: float = 86_400.0
    dedup: Dedup = field(default_factory=Dedup)
    checkpoint: Checkpoint = field(default_factory=Checkpoint)
    breakpoints: Breakpoints = field(default_factory=Breakpoints)
    eigencontext: Eigencontext = field(default_factory=Eigencontext)
    alias: Alias = field(default_factory=Alias)
    state_machine: StateMachine = field(default_factory=StateMachine)
    tier: Tier = field(default_factory=Tier)

    def only(self, **sections) -> Config:
        """A copy with sections replaced, or switched off with ``name=False``."""
        return dataclasses.replace(self, **{k: dataclasses.replace(getattr(self, k), enabled=v) if isinstance(v, bool) else v for k, v in sections.items()})


def coerce(kind: type, values: dict):
    """A section from a dict: keys that it does not have are named in the log and dropped."""
    known = {f.name: f for f in dataclasses.fields(kind)}
    for k in values.keys() - known.keys():
        log.warning("unknown setting %s.%s", kind.__name__, k)
    out = {}
    for k in values.keys() & known.keys():
        inner = known[k].default_factory if known[k].default_factory is not dataclasses.MISSING else None
        out[k] = coerce(inner, values[k]) if inner is not None and isinstance(values[k], dict) else values[k]
    return kind(**out)


def load(path: str | None = None, env: dict[str, str] | None = None) -> Config:
    """Settings of a JSON file, which may be missing, and of variables like TALLYWEAVE_MAX_SESSIONS."""
    values: dict = {}
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            values = json.load(f)
    cfg = coerce(Config, values)
    env = os.environ if env is None else env
    plain = {f.name: type(getattr(cfg, f.name)) for f in dataclasses.fields(cfg) if not dataclasses.is_dataclass(getattr(cfg, f.name))}
    return dataclasses.replace(cfg, **{k: t(env[ENV + k.upper()]) for k, t in plain.items() if ENV + k.upper() in env})


def session_info(spark: SparkSession) -> dict[str, str]:
    """What a health check would tell: that the session works, and how embeddings are made."""
    return {"ok": str(spark.range(1).count() == 1).lower(), "embeddings": "hash", "spark": spark.version, "master": spark.sparkContext.master}
