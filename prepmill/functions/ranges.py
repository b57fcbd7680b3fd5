"""Ordered work without a single-partition window.

Rows are put into value-range buckets of the order key.  A summary with one row
per bucket is scanned in order (it is bounded by ``MAX_BUCKETS``), and the carry
of the earlier buckets is added to a window inside each bucket.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .joins import join_null_safe
from .roles import col

MAX_BUCKETS = 20_000
ROWS_PER_BUCKET = 2_000_000


def order_number(df: DataFrame, key: str) -> Column:
    """Double that never decreases when ``key`` grows (used only to choose buckets)."""
    dtype = df.schema[key].dataType
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(col(key)).cast("double")
    if isinstance(dtype, (T.TimestampNTZType, T.DateType)):
        # From the fields, so a session zone's clock changes cannot reorder zone-free times.
        t = col(key).cast("timestamp_ntz")
        return F.unix_date(t.cast("date")) * 86400.0 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return col(key).cast("double")
    raise ValueError(f"order key {key!r} must be numeric, date or timestamp")


def with_range_bucket(
    df: DataFrame, key: str, buckets: int | None = None, out: str = "_bucket", source: DataFrame | None = None
) -> tuple[DataFrame, int]:
    """Add a bucket number that never decreases with ``key``; return it with the bucket count.

    Limits come from a quantile sketch of ``source`` (``df`` itself when not given): give
    the rows before a grouping to spare computing the grouping twice.
    """
    origin = df if source is None else source
    number = order_number(origin, key)

    def sketch(parts: int):
        marks = F.array(*[F.lit(i / parts) for i in range(1, parts)])
        probe = F.percentile_approx(number, marks, F.lit(max(10_000, 10 * parts)))
        return origin.agg(F.count(F.lit(1)).alias("n"), probe.alias("m")).first()

    if buckets is None:
        buckets = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        row = sketch(buckets)
        wanted = min(MAX_BUCKETS, math.ceil(row["n"] / ROWS_PER_BUCKET))
        if wanted > buckets:
            row = sketch(wanted)
        found = row["m"] or []
    else:
        found = (sketch(buckets)["m"] or []) if buckets > 1 else []
    splits = [-math.inf, *sorted({float(x) for x in found}), math.inf]
    if len(splits) < 3:
        return df.withColumn(out, F.lit(0)), 1
    prepared = df.withColumn("_order_number", order_number(df, key))
    cut = Bucketizer(splits=splits, inputCol="_order_number", outputCol=out, handleInvalid="keep")
    result = cut.transform(prepared).withColumn(out, F.col(out).cast("int")).drop("_order_number")
    return result, len(splits) - 1


def carry_last(df: DataFrame, value: str, key: str, backward: bool = False, buckets: int | None = None) -> DataFrame:
    """Fill NULLs of ``value`` with the nearest earlier (or later) non-NULL in ``key`` order."""
    spark = df.sparkSession
    rows, count = with_range_bucket(df, key, buckets)
    v, k = col(value), col(key)
    pick = F.min_by(v, k) if backward else F.max_by(v, k)
    summary = rows.where(v.isNotNull()).groupBy("_bucket").agg(pick.alias("_edge"))
    every = spark.range(0, count + 1, 1, 1).select(F.col("id").cast("int").alias("_bucket"))
    every = every.join(summary, "_bucket", "left")
    # One row per bucket: at most MAX_BUCKETS rows in this ordered pass.
    sweep = Window.orderBy(F.desc("_bucket") if backward else F.asc("_bucket")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    carry = every.select("_bucket", F.last("_edge", ignorenulls=True).over(sweep).alias("_carry"))
    inside = Window.partitionBy("_bucket").orderBy(k.desc() if backward else k.asc()).rowsBetween(
        Window.unboundedPreceding, 0
    )
    filled = F.coalesce(F.last(v, ignorenulls=True).over(inside), F.col("_carry"))
    joined = rows.join(F.broadcast(carry), "_bucket", "left")
    return joined.withColumn(value, filled).select(*[col(c) for c in df.columns])


def running_sums(
    df: DataFrame,
    key: str,
    sums: dict[str, Column],
    by: list[str] | tuple[str, ...] = (),
    descending: bool = False,
    buckets: int | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """Inclusive running sums in ``key`` order inside each ``by`` group.

    Give rows already grouped to one per (by, key): then no bucket is hot.
    """
    by = list(by)
    rows, _ = with_range_bucket(df, key, buckets, source=source)
    for name, expr in sums.items():
        rows = rows.withColumn(f"_in_{name}", expr)
    order = F.desc("_bucket") if descending else F.asc("_bucket")
    totals = rows.groupBy(*by, "_bucket").agg(*[F.sum(f"_in_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy(*by, F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_bucket", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    # Both sides are partitioned as the window below needs them.
    joined = join_null_safe(rows, offsets, [*by, "_bucket"])
    inside = (
        Window.partitionBy(*by, "_bucket")
        .orderBy(col(key).desc() if descending else col(key).asc())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    out = {n: F.col(f"_o_{n}") + F.sum(f"_in_{n}").over(inside) for n in sums}
    return joined.withColumns(out).drop(
        "_bucket", *[f"_in_{n}" for n in sums], *[f"_o_{n}" for n in sums]
    )


def running_max(df: DataFrame, key: str, value: str, out: str = "before", buckets: int | None = None) -> DataFrame:
    """Add the largest ``value`` of all rows with a smaller ``key`` (keys distinct)."""
    rows, _ = with_range_bucket(df, key, buckets)
    tops = rows.groupBy("_bucket").agg(F.max(col(value)).alias("_top"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_bucket", F.max("_top").over(earlier).alias("_carry"))
    inside = Window.partitionBy("_bucket").orderBy(col(key)).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(F.broadcast(tops), "_bucket")
    return joined.withColumn(out, F.greatest(F.max(col(value)).over(inside), F.col("_carry"))).drop("_bucket", "_carry")


def dense_codes(df: DataFrame, column: str) -> DataFrame:
    """``(value, code)`` with codes 0.. by sorted distinct non-NULL value.

    The distinct values themselves are range-partitioned, numbered where they lie and
    shifted by the counts of earlier partitions (one row per partition), so no task
    holds more than its range, whatever the values have in common.
    """
    values = df.select(col(column).alias("value")).where("value is not null").distinct()
    ordered = values.repartitionByRange("value").sortWithinPartitions("value")
    placed = cut_lineage(ordered.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    joined = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return joined.select("value", (F.col("_o") + inside).alias("code"))
