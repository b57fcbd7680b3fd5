"""Target analysis and choice of features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.roles import INTEGRAL, col, columns_by_role, require_columns, role_of
from .charts import correlation_pairs

# Rules of the setup step.
FEW_CLASSES = 10
IMBALANCED_ABOVE = 2.0
MIN_ROWS = 20
MAX_FEATURE_CORRELATION = 0.8
MAX_FEATURES = 20


def analyze_target(df: DataFrame, target: str) -> DataFrame:
    """Problem type: classification for text or few-valued whole numbers, else regression."""
    require_columns(df, [target])
    dtype = df.schema[target].dataType
    few = F.col("n_unique") <= FEW_CLASSES
    if role_of(dtype) == "categorical":
        is_class = F.lit(True)
    elif isinstance(dtype, (*INTEGRAL, T.BooleanType)):
        is_class = few
    else:
        is_class = F.lit(False)
    distinct = df.select(col(target).alias("v")).where("v is not null").distinct()
    return distinct.agg(F.count("v").alias("n_unique")).select(
        F.lit(target).alias("target"), F.lit(dtype.simpleString()).alias("dtype"), "n_unique",
        F.when(is_class, "classification").otherwise("regression").alias("problem_type"),
    )


def problem_type(df: DataFrame, target: str) -> str:
    return analyze_target(df, target).first()["problem_type"]


def class_imbalance(df: DataFrame, target: str) -> DataFrame:
    """Ratio of the largest to the smallest class, and whether it exceeds 2 (ties: smallest value)."""
    counts = df.where(col(target).isNotNull()).groupBy(col(target).cast("string").alias("c")).agg(
        F.count(F.lit(1)).alias("n")
    )
    one = counts.agg(
        F.count("c").alias("n_classes"), F.max("n").alias("majority_count"), F.min("n").alias("minority_count"),
        F.min(F.struct((-F.col("n")).alias("m"), "c")).alias("_big"), F.min(F.struct("n", "c")).alias("_small"),
    )
    several = F.col("n_classes") >= 2
    ratio = F.try_divide(F.col("majority_count"), F.col("minority_count"))
    return one.select(
        "n_classes", F.coalesce(several & (ratio > IMBALANCED_ABOVE), F.lit(False)).alias("is_imbalanced"),
        F.when(several, ratio).alias("ratio"),
        F.when(several, F.col("_big.c")).alias("majority_class"),
        F.when(several, F.col("_small.c")).alias("minority_class"),
        F.when(several, F.col("majority_count")).alias("majority_count"),
        F.when(several, F.col("minority_count")).alias("minority_count"),
    )


def choose_features(
    df: DataFrame, target: str, method: str = "all", manual: list[str] | None = None, n: int = MAX_FEATURES
) -> list[str]:
    """``all`` other columns, a ``manual`` list, or the ``auto`` choice by strength against the target."""
    others = [c for c in df.columns if c != target]
    if method == "all":
        return others
    if method == "manual":
        require_columns(df, manual or [])
        return list(manual or [])
    if method != "auto":
        raise ValueError("method must be all, manual or auto")
    from .features import top_chi_square, top_correlated

    if role_of(df.schema[target].dataType) == "categorical":
        found = top_chi_square(df, target, n=n)
    else:
        found = top_correlated(df, target, n=n)
    return [r["feature"] for r in found.collect()]


def greedy_features(
    df: DataFrame, target: str, limit: float = MAX_FEATURE_CORRELATION, most: int = MAX_FEATURES
) -> list[str]:
    """Numeric columns by |r| with the target, skipping those close to an accepted one; then the rest.

    Only the column-by-column correlation table reaches the driver.
    """
    numeric = columns_by_role(df)["numeric"]
    others = [c for c in df.columns if c not in numeric and c != target]
    if target not in numeric:
        return ([c for c in numeric if c != target] + others)[:most]
    r = {}
    for row in correlation_pairs(df, numeric).collect():
        strength = None if row["r"] is None else abs(row["r"])
        r[row["col_a"], row["col_b"]] = r[row["col_b"], row["col_a"]] = strength

    def by_strength(c):
        s = r[c, target]
        return (s is None, -(s or 0.0), c)

    accepted: list[str] = []
    for c in sorted((c for c in numeric if c != target), key=by_strength):
        near = [r[c, a] for a in accepted]
        if all(x is not None and x < limit for x in near):
            accepted.append(c)
    return (accepted + others)[:most]
