"""Drop columns that carry no or repeated information; change cells by condition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.roles import as_text, col, numeric_columns, role_of
from .charts import correlation_pairs
from .view import _test, comparison, matching_rows

CORRELATION_LIMIT = 0.95


def constant_columns(df: DataFrame) -> list[str]:
    """Columns with at most one distinct value: one aggregate of minima and maxima."""
    cells = [as_text(df, c) if role_of(df.schema[c].dataType) in ("nested", "other") else col(c) for c in df.columns]
    row = df.agg(
        *[F.coalesce(F.min(x) == F.max(x), F.lit(True)).alias(f"k{i}") for i, x in enumerate(cells)]
    ).first()
    return [c for i, c in enumerate(df.columns) if row[f"k{i}"]]


def drop_constant(df: DataFrame) -> DataFrame:
    return df.drop(*constant_columns(df))


def correlated_columns(df: DataFrame, limit: float = CORRELATION_LIMIT) -> list[str]:
    """Numeric columns whose |r| with any earlier numeric column exceeds ``limit``."""
    names = numeric_columns(df)
    if len(names) < 2:
        return []
    strong = correlation_pairs(df, names).where(F.abs("r") > limit).select("col_b").distinct().collect()
    found = {r["col_b"] for r in strong}
    return [c for c in names if c in found]


def drop_correlated(df: DataFrame, limit: float = CORRELATION_LIMIT) -> DataFrame:
    return df.drop(*correlated_columns(df, limit))


def remove_where(df: DataFrame, column: str, op: str, value=None, other: str | None = None) -> DataFrame:
    """Rows for which the comparison does not hold, missing cells among them.

    For ``!=`` these are the rows whose test ``==`` holds, and that test reaches the file
    scan.  For the others missing cells stay; a file's statistics cannot tell NaN, so only
    tables read with ``nan_as_null=False`` prune files here.
    """
    if op == "!=":
        return matching_rows(df, column, "==", value, other)
    test = _test(df, column, op, value, other)
    return df.where(~test | test.isNull())


def replace_where(
    df: DataFrame, column: str, op: str, replacement, value=None, other: str | None = None
) -> DataFrame:
    """Set ``column`` to ``replacement`` in the rows for which the comparison holds."""
    if replacement is None or replacement == "":
        raise ValueError("a replacement value is needed")
    kind = df.schema[column].dataType
    if role_of(kind) == "numeric" and isinstance(replacement, str):
        raise TypeError(f"{column!r} needs a number")
    new = F.lit(replacement)
    if role_of(kind) != "numeric":
        new = new.cast(kind)
    return df.withColumn(column, F.when(comparison(df, column, op, value, other), new).otherwise(col(column)))
