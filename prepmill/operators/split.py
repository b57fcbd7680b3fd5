"""Train/test splits and folds from hashed row keys."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_piece, hash_unit, stratum_counts
from ..functions.roles import require_columns

# The seed and the allowed ranges of the setup step.
SEED = 42
TEST_SHARE = (0.1, 0.4)
FOLDS = (3, 10)


def mark_test(
    df: DataFrame, key: str, test_share: float = 0.2, strata: str | None = None,
    seed: int | str = SEED, out: str = "is_test", exact: bool = True,
) -> DataFrame:
    """Add a flag for the test part.

    ``exact`` gives exactly the rounded-up share (per class: rounded to nearest) with
    two small scans; otherwise a row's own hash decides and nothing is counted.
    """
    require_columns(df, [key] + ([strata] if strata else []))
    if not exact:
        return df.withColumn(out, hash_unit(key, seed) < test_share)
    counts = stratum_counts(df, strata)
    if strata:
        ranks = {s: [math.floor(n * test_share + 0.5)] for s, n in counts.items()}
    else:
        ranks = {s: [math.ceil(round(n * test_share, 9))] for s, n in counts.items()}
    marked = hash_piece(df, key, strata, ranks, seed, "_piece")
    return marked.withColumn(out, F.col("_piece") == 0).drop("_piece")


def train_test(
    df: DataFrame, key: str, test_share: float = 0.2, strata: str | None = None,
    seed: int | str = SEED, exact: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(train, test) parts."""
    low, high = TEST_SHARE
    if not low <= test_share <= high:
        raise ValueError(f"test share must lie in [{low}, {high}]")
    marked = mark_test(df, key, test_share, strata, seed, "_test", exact)
    return marked.where(~F.col("_test")).drop("_test"), marked.where("_test").drop("_test")


def with_folds(
    df: DataFrame, key: str, k: int = 5, strata: str | None = None, seed: int | str = SEED, out: str = "fold"
) -> DataFrame:
    """Add a fold number 0..k-1; fold sizes inside each class differ by at most one."""
    if k < 2:
        raise ValueError("at least two folds are needed")
    counts = stratum_counts(df, strata)
    ranks = {s: [math.floor(n * i / k) for i in range(1, k)] for s, n in counts.items()}
    return hash_piece(df, key, strata, ranks, seed, out)
