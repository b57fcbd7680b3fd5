"""Missing-value repair.  Fits are one-row aggregates; filling is a projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import quantile_values
from ..functions.ranges import carry_last
from ..functions.roles import col, require_columns, role_of
from .profile import value_frequencies

NO_MODE = "Unknown"


def drop_missing(df: DataFrame, columns: list[str] | str) -> DataFrame:
    """Rows that have all the named columns."""
    names = [columns] if isinstance(columns, str) else list(columns)
    require_columns(df, names)
    return df.na.drop(subset=names)


def _numeric(df: DataFrame, column: str) -> None:
    require_columns(df, [column])
    if role_of(df.schema[column].dataType) != "numeric":
        raise TypeError(f"{column!r} is not numeric")


def impute_mean(df: DataFrame, column: str) -> DataFrame:
    """Fill with the mean; the column becomes double."""
    _numeric(df, column)
    mean = df.agg(F.avg(col(column)).cast("double")).first()[0]
    return df.withColumn(column, F.coalesce(col(column).cast("double"), F.lit(mean)))


def impute_median(df: DataFrame, column: str) -> DataFrame:
    """Fill with the exact median; the column becomes double."""
    _numeric(df, column)
    middle = quantile_values(df, [column], [0.5])[column][0]
    return df.withColumn(column, F.coalesce(col(column).cast("double"), F.lit(middle).cast("double")))


def most_frequent(df: DataFrame, column: str):
    """Most frequent value, the smallest on ties; None for an all-NULL column.

    Counts are pre-aggregated and cut to one row by top-k, so no task holds all values.
    """
    counts = df.select(col(column).alias("v")).where("v is not null").groupBy("v").count()
    best = counts.orderBy(F.desc("count"), F.asc("v")).limit(1).first()
    return None if best is None else best["v"]


def modes(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """Text mode of several columns from one scan (ties: smallest text)."""
    freq = value_frequencies(df, columns).where("value is not null")
    best = freq.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("m"), "value")).alias("b"))
    found = {r["column"]: r["b"]["value"] for r in best.collect()}
    return {c: found.get(c) for c in columns}


def impute_mode(df: DataFrame, column: str) -> DataFrame:
    """Fill with the most frequent value; an all-NULL text column gets 'Unknown'."""
    require_columns(df, [column])
    value = most_frequent(df, column)
    if value is None:
        if role_of(df.schema[column].dataType) != "categorical":
            return df
        value = NO_MODE
    return df.withColumn(column, F.coalesce(col(column), F.lit(value).cast(df.schema[column].dataType)))


def forward_fill(df: DataFrame, column: str, order_by: str) -> DataFrame:
    """Fill each gap with the nearest earlier value in ``order_by`` order (a unique key)."""
    require_columns(df, [column, order_by])
    return carry_last(df, column, order_by)


def backward_fill(df: DataFrame, column: str, order_by: str) -> DataFrame:
    """Fill each gap with the nearest later value in ``order_by`` order (a unique key)."""
    require_columns(df, [column, order_by])
    return carry_last(df, column, order_by, backward=True)


def impute_constant(df: DataFrame, column: str, value) -> DataFrame:
    """Fill with a constant of the column's type."""
    require_columns(df, [column])
    constant: Column = F.lit(value).cast(df.schema[column].dataType)
    return df.withColumn(column, F.coalesce(col(column), constant))
