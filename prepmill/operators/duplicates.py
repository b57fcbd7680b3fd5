"""Whole-row duplicates.

Copies are grouped by all compared columns with partial counts before the shuffle.
Where every copy must come back, groups that hold a large share of the table are
kept out of a one-key shuffle: their rows find the group size by a map-side lookup
(at most ``HOT_GROUPS`` groups can be that large) and are then spread by a salt.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.roles import col

HOT_GROUPS = 1000
HOT_ROWS = 1_000_000
SALTS = 4096
CHUNK = 1_000_000


def _keys(df: DataFrame, order_by: list[str], exclude: list[str]) -> list[str]:
    return [c for c in df.columns if c not in order_by and c not in exclude]


def group_sizes(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows with their number of copies; NULLs are equal."""
    return df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("_copies"))


def _expand(groups: DataFrame) -> DataFrame:
    """Repeat each row ``_copies`` times, in chunks that are spread before they are unrolled."""
    last = F.ceil(F.col("_copies") / CHUNK).cast("bigint")
    chunks = groups.withColumn("_chunk", F.explode(F.sequence(F.lit(1).cast("bigint"), last)))
    # A fixed number of partitions: chunk rows are tiny, so adaptive merging would undo the spread.
    chunks = chunks.repartition(int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    size = F.least(F.lit(CHUNK).cast("bigint"), F.col("_copies") - (F.col("_chunk") - 1) * CHUNK)
    return chunks.withColumn("_one", F.explode(F.sequence(F.lit(1).cast("bigint"), size))).drop("_chunk", "_one")


def with_copies(
    df: DataFrame, order_by: list[str] = (), exclude: list[str] = (), hot_rows: int | None = None
) -> DataFrame:
    """Every row with ``_copies``, the number of equal rows (order key not compared)."""
    order_by, exclude = list(order_by), list(exclude)
    keys = _keys(df, order_by, exclude)
    groups = group_sizes(df, keys)
    if len(keys) == len(df.columns):
        return _expand(groups)
    hot_rows = max(HOT_ROWS if hot_rows is None else hot_rows, df.count() // HOT_GROUPS)
    repeated = groups.where("_copies > 1")

    def on(right: DataFrame, tag: str):
        named = right.select(*[col(k).alias(f"_{tag}{i}") for i, k in enumerate(keys)],
                             F.col("_copies").alias(f"_{tag}n"))
        cond = reduce(lambda a, b: a & b, [col(k).eqNullSafe(F.col(f"_{tag}{i}")) for i, k in enumerate(keys)])
        return named, cond

    hot, hot_cond = on(repeated.where(F.col("_copies") > hot_rows), "h")
    # At most HOT_GROUPS groups can each hold more than 1/HOT_GROUPS of the rows.
    rows = df.join(F.broadcast(hot), hot_cond, "left")
    spread = F.pmod(F.xxhash64(*[col(c) for c in [*order_by, *exclude]]), F.lit(SALTS)) + 1
    rows = rows.withColumn("_salt", F.when(F.col("_hn").isNotNull(), spread).otherwise(F.lit(0).cast("bigint")))
    cold, cold_cond = on(repeated.where(F.col("_copies") <= hot_rows), "c")
    cold = cold.withColumn("_csalt", F.lit(0).cast("bigint"))
    joined = rows.join(cold, cold_cond & (F.col("_salt") == F.col("_csalt")), "left")
    copies = F.coalesce("_hn", "_cn", F.lit(1)).cast("bigint")
    return joined.select(*[col(c) for c in df.columns], copies.alias("_copies"))


def duplicate_rows(df: DataFrame, order_by: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """All members of groups with more than one copy, sorted by the compared columns."""
    keys = _keys(df, list(order_by), list(exclude))
    found = with_copies(df, order_by, exclude).where("_copies > 1").select(*[col(c) for c in df.columns])
    return found.orderBy(*[col(k) for k in [*keys, *order_by]])


def duplicate_groups(df: DataFrame, order_by: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Distinct repeated rows with ``copies``, most frequent first; rows with NULLs count too."""
    keys = _keys(df, list(order_by), list(exclude))
    found = group_sizes(df, keys).where("_copies > 1").withColumnRenamed("_copies", "copies")
    return found.orderBy(F.desc("copies"), *[col(k) for k in keys])


def remove_all(df: DataFrame, order_by: list[str] = ()) -> DataFrame:
    """Only rows that have no copy."""
    return _one_per_group(df, list(order_by), F.min, singles=True)


def keep_first(df: DataFrame, order_by: list[str] = ()) -> DataFrame:
    """The copy with the smallest order key of each group."""
    return _one_per_group(df, list(order_by), F.min)


def keep_last(df: DataFrame, order_by: list[str] = ()) -> DataFrame:
    """The copy with the largest order key of each group."""
    return _one_per_group(df, list(order_by), F.max)


def _one_per_group(df: DataFrame, order_by: list[str], pick, singles: bool = False) -> DataFrame:
    keys = _keys(df, order_by, [])
    aggs = [F.count(F.lit(1)).alias("_copies")]
    if len(order_by) == 1:
        aggs.append(pick(col(order_by[0])).alias(order_by[0]))
    elif order_by:
        aggs.append(pick(F.struct(*[col(c) for c in order_by])).alias("_kept"))
    groups = df.groupBy(*[col(k) for k in keys]).agg(*aggs)
    if singles:
        groups = groups.where("_copies = 1")
    if len(order_by) > 1:
        groups = groups.select("*", "_kept.*")
    return groups.select(*[col(c) for c in df.columns])


def mark(df: DataFrame, order_by: list[str] = (), out: str = "is_duplicate") -> DataFrame:
    """Add a flag that is true for every member of a repeated group."""
    found = with_copies(df, order_by)
    return found.select(*[col(c) for c in df.columns], (F.col("_copies") > 1).alias(out))
