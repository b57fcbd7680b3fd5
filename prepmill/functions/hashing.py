"""Repeatable randomness: md5 of a seed and a row key.

``rand(seed)`` depends on how rows are partitioned; a hash of the row key does
not, so samples, splits and folds are the same on any cluster size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .roles import col

HASH_BITS = 60
MAX_STRATA = 10_000
ROWS_PER_BUCKET = 1_000_000


def hash_key(keys: list[str] | str, seed: int | str = 42) -> Column:
    """60-bit non-negative hash of the key columns."""
    names = [keys] if isinstance(keys, str) else list(keys)
    text = F.concat_ws(":", F.lit(str(seed)), *[col(k).cast("string") for k in names])
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def hash_unit(keys: list[str] | str, seed: int | str = 42) -> Column:
    """The same hash as a double in [0, 1)."""
    return hash_key(keys, seed).cast("double") / F.lit(float(2**HASH_BITS))


def bucket_bits(rows: int) -> int:
    """Prefix length that leaves about a million rows in one hash bucket."""
    return min(20, max(4, math.ceil(math.log2(max(rows, 1) / ROWS_PER_BUCKET + 1))))


def cuts_at_ranks(hashed: DataFrame, strata: str | None, key: str, targets: DataFrame) -> DataFrame:
    """Exact ``(hash, key)`` cut points at given ranks inside each stratum.

    ``hashed`` has ``_hash``, the unique ``key`` and the stratum; ``targets`` has
    ``_stratum, _target, _rank`` (1-based).  Counts per hash prefix locate the one
    prefix that holds a rank, and only rows of that prefix are ordered, so a class
    holding most of the table is never gathered in one task.
    """
    stratum = col(strata).cast("string") if strata else F.lit("")
    total = hashed.count()
    shift = HASH_BITS - bucket_bits(total)
    rows = hashed.select(
        F.coalesce(stratum, F.lit("\0")).alias("_stratum"),
        F.shiftright("_hash", shift).alias("_bucket"),
        "_hash",
        col(key).alias("_key"),
    )
    counts = rows.groupBy("_stratum", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy("_stratum").orderBy("_bucket")
    spans = counts.withColumn("_upto", F.sum("_n").over(running))
    spans = spans.withColumn("_below", F.col("_upto") - F.col("_n"))
    located = spans.join(F.broadcast(targets), "_stratum").where(
        (F.col("_rank") > F.col("_below")) & (F.col("_rank") <= F.col("_upto"))
    )
    located = located.select(
        "_stratum", "_bucket", "_target", (F.col("_rank") - F.col("_below")).alias("_nth")
    )
    inside = rows.join(F.broadcast(located), ["_stratum", "_bucket"])
    order = Window.partitionBy("_stratum", "_bucket", "_target").orderBy("_hash", "_key")
    ranked = inside.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") == F.col("_nth"))
    return ranked.select(
        "_stratum", "_target", F.col("_hash").alias("_cut_hash"), F.col("_key").alias("_cut_key")
    )


def stratum_counts(df: DataFrame, strata: str | None) -> dict[str, int]:
    """Rows per stratum (as text); refuses more strata than a class column can have."""
    stratum = F.coalesce(col(strata).cast("string"), F.lit("\0")) if strata else F.lit("")
    rows = df.groupBy(stratum.alias("s")).count().limit(MAX_STRATA + 1).collect()
    if len(rows) > MAX_STRATA:
        raise ValueError(f"more than {MAX_STRATA} classes in {strata!r}")
    return {r["s"]: r["count"] for r in rows}


def hash_piece(
    df: DataFrame,
    key: str,
    strata: str | None,
    ranks: dict[str, list[int]],
    seed: int | str = 42,
    out: str = "piece",
) -> DataFrame:
    """Number of rank cuts a row lies behind, as integer column ``out``.

    ``key`` must tell rows apart: rows with equal keys share a hash and stay together.
    With ranks ``[r]`` the first ``r`` rows of a stratum (in hash order) get 0 and
    the rest 1; with ``k - 1`` ranks this gives ``k`` folds.  The assignment itself
    is a map-side lookup in a table of at most ``MAX_STRATA`` x cuts rows.
    """
    spark = df.sparkSession
    hashed = df.withColumn("_hash", hash_key(key, seed))
    rows = [(s, i, int(r)) for s, cuts in ranks.items() for i, r in enumerate(cuts) if r > 0]
    if not rows:
        return df.withColumn(out, F.lit(1))
    targets = spark.createDataFrame(rows, "_stratum string, _target int, _rank bigint")
    found = cuts_at_ranks(hashed, strata, key, targets).collect()
    cuts: dict[str, list] = {s: [None] * len(c) for s, c in ranks.items()}
    for r in found:
        cuts[r["_stratum"]][r["_target"]] = (r["_cut_hash"], r["_cut_key"])
    key_type = df.schema[key].dataType.simpleString()
    lookup = spark.createDataFrame(
        [(s, [c for c in v if c is not None], sum(c is None for c in v)) for s, v in cuts.items()],
        f"_stratum string, _cuts array<struct<h:bigint,k:{key_type}>>, _base int",
    )
    stratum = F.coalesce(col(strata).cast("string"), F.lit("\0")) if strata else F.lit("")
    joined = hashed.withColumn("_stratum", stratum).join(F.broadcast(lookup), "_stratum", "left")
    mine = F.struct(F.col("_hash").alias("h"), col(key).alias("k"))
    piece = F.col("_base") + F.size(F.filter("_cuts", lambda c: c < mine))
    return joined.withColumn(out, piece.cast("int")).drop("_hash", "_stratum", "_cuts", "_base")
