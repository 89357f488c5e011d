"""Named values that Catalyst keeps as values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(df: DataFrame, **values: Column) -> DataFrame:
    """Add or replace columns, each computed once.

    A chain of ``withColumn`` is one projection to the optimizer, which puts each expression
    in the place of its name; long chains of array functions then grow without bound.  A
    generator that makes one row of one struct computes the same and is never merged.
    """
    others = [F.col(f"`{c}`") for c in df.columns if c not in values]
    return df.select(*others, F.inline(F.array(F.struct(*(v.alias(k) for k, v in values.items())))))
