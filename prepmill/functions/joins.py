"""Joins of raw rows with small derived tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .roles import col

MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 << 20


def measured(small: DataFrame) -> DataFrame:
    """Compute a derived table once and mark it for broadcast if it is measured to be small.

    The planner cannot know how small a grouped table is, and would shuffle the raw rows
    beside it, possibly all to one key.  Larger tables are returned without a hint, so
    their join shuffles and adaptive execution splits hot keys.
    """
    kept = cut_lineage(small)
    texts = [f.name for f in kept.schema.fields if not isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    width = sum((F.coalesce(F.octet_length(col(c).cast("string")), F.lit(0)) for c in texts), F.lit(0))
    row = kept.agg(F.count(F.lit(1)).alias("n"), F.sum(width.cast("bigint")).alias("b")).first()
    size = (row["b"] or 0) + 16 * len(kept.columns) * row["n"]
    return F.broadcast(kept) if row["n"] <= MAX_BROADCAST_ROWS and size <= MAX_BROADCAST_BYTES else kept


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join in which NULL keys match; the right side's keys are dropped."""
    named = right.select(*[
        col(c).alias(f"_r_{c}") if c in keys else col(c) for c in right.columns
    ])
    cond = reduce(lambda a, b: a & b, [left[f"`{k}`"].eqNullSafe(named[f"`_r_{k}`"]) for k in keys])
    return left.join(named, cond, how).drop(*[f"_r_{k}" for k in keys])
