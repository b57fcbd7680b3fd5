"""Outlier treatment: fences and limits are fitted once, then applied as literals."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import DIRECT_LIMIT, order_statistics
from ..functions.roles import col
from .profile import iqr_bounds

TAIL = 0.05


def remove_outliers(df: DataFrame, column: str) -> DataFrame:
    """Rows inside the IQR fences (inclusive); rows missing the value go too."""
    low, high = iqr_bounds(df, [column])[column]
    return df.where(col(column).between(F.lit(low).cast("double"), F.lit(high).cast("double")))


def clip(df: DataFrame, column: str, low: float | None, high: float | None) -> DataFrame:
    """Limit a column to [low, high]; NULL stays NULL.  Narrow, so it also fits streams."""
    value = col(column).cast("double")
    limited = F.greatest(F.least(value, F.lit(high).cast("double")), F.lit(low).cast("double"))
    return df.withColumn(column, F.when(value.isNotNull(), limited))


def cap_outliers(df: DataFrame, column: str) -> DataFrame:
    """Limit a column to its IQR fences."""
    return clip(df, column, *iqr_bounds(df, [column])[column])


def winsor_limits(df: DataFrame, column: str, tail: float = TAIL) -> tuple[float | None, float | None]:
    """Values at sorted positions ``int(tail n)`` and ``n - int(tail n) - 1``."""
    values = df.select(F.lit(column).alias("column"), col(column).cast("double").alias("_v")).where("_v is not null")
    size = values.groupBy("column").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    ).first()
    if size is None:
        return None, None
    n = size["_n"]
    k = math.floor(tail * n)
    wanted = df.sparkSession.createDataFrame(
        [(column, r, size["_lo"], size["_hi"], n) for r in sorted({k, n - k - 1})],
        "column string, _r bigint, _lo double, _hi double, _n bigint",
    )
    found = {r["_r"]: r["_value"] for r in order_statistics(values, ["column"], wanted, DIRECT_LIMIT).collect()}
    return found[k], found[n - k - 1]


def winsorize(df: DataFrame, column: str, tail: float = TAIL) -> DataFrame:
    """Pull the ``tail`` share of smallest and largest values to the nearest kept value."""
    return clip(df, column, *winsor_limits(df, column, tail))
