"""Evaluation tasks from recorded sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyweave.functions import text
from tallyweave.operators import blocks

# What a user's turn begins with when it is none.
SKIP_PREFIXES = [
    "[SUGGESTION MODE",
    "[Request interrupted",
    "The user stepped away",
    "<system-reminder>",
    "[CONTEXT:",
]


def recorded_turns(rows: DataFrame) -> DataFrame:
    """The user's turn of each recorded request (session, ts, messages): session, ts, user, value.

    It is the text of the last user message; blank ones and those with a skipped prefix are
    left out.  ``value`` is what a check looks for, or null.
    """
    user = rows.select("session", "ts", blocks.last_user_text(F.col("messages")).alias("user"))
    good = F.regexp_like("user", F.lit(r"(?U)\S")) & ~text.starts_with_any(F.col("user"), SKIP_PREFIXES)
    return user.where(good).withColumn("value", text.needle(F.col("user")))


def mine(rows: DataFrame, min_turns: int = 2) -> DataFrame:
    """Tasks (id, session, turns) of the sessions with enough rows and enough turns, in time's order.

    The turns of one task are one row, as in a task file.
    """
    size = rows.groupBy("session").agg(F.count("*").alias("n")).where(F.col("n") >= min_turns).select("session")
    check = F.when(F.col("value").isNotNull(), F.struct(F.lit("contains").alias("type"), F.col("value").alias("value")))
    turns = recorded_turns(rows).join(size, "session", "left_semi").groupBy("session").agg(F.array_sort(F.collect_list(F.struct("ts", "user", check.alias("check")))).alias("t"))
    return turns.where(F.size("t") >= min_turns).select(F.concat(F.lit("recorded-"), F.substring("session", 1, 8)).alias("id"), "session", F.transform("t", lambda t: F.struct(t["user"].alias("user"), t["check"].alias("check"))).alias("turns"))


def turn_rows(tasks: DataFrame) -> DataFrame:
    """(id, session, turn, user, value) of tasks."""
    return tasks.select("id", "session", F.posexplode("turns").alias("turn", "t")).select("id", "session", "turn", "t.user", F.col("t.check.value").alias("value"))


def numbered_turns(turns: DataFrame, *, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """Turns with their place among the messages of their session (mi from 0, n), system turns left out."""
    said = turns.where(F.col("role") != "system")
    return said.select(F.col(session).alias("session"), (F.row_number().over(W.partitionBy(session).orderBy(order)) - 1).cast("long").alias("mi"), F.count("*").over(W.partitionBy(session)).alias("n"), "role", "text")
