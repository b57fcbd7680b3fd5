"""Jump consistent hashing of stable keys to shards, in DataFrame functions only.

Every row's shard follows from its key and the shard count alone: no ring table, no
state, no lookup.  Appending a shard moves each row with probability 1 / (new count),
and only into the new shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, named, text_of

# Fixed values of the published algorithm: the generator's multiplier, in two 32-bit halves.
MULTIPLIER_HI = 2862933555777941757 >> 32
MULTIPLIER_LO = 2862933555777941757 & 0xFFFFFFFF
MASK = 0xFFFFFFFF
#: Jumps tried in the first pass.  A row needs about ln(shards) of them; the rare rest goes on.
FIRST_JUMPS = 48


def _next_state(hi: Column, lo: Column) -> tuple[Column, Column]:
    """state * MULTIPLIER + 1 modulo 2**64 on 32-bit halves; no product exceeds 2**49."""
    both = F.lit(MASK)
    low = lo.bitwiseAND(F.lit(0xFFFF)) * F.lit(MULTIPLIER_LO) + F.lit(1)
    mid = F.shiftright(lo, 16) * F.lit(MULTIPLIER_LO)
    sum_low = low + F.shiftleft(mid.bitwiseAND(F.lit(0xFFFF)), 16)
    cross = [
        (a.bitwiseAND(F.lit(0xFFFF)) * F.lit(b)).bitwiseAND(both)
        + F.shiftleft(F.shiftright(a, 16) * F.lit(b & 0xFFFF), 16).bitwiseAND(both)
        for a, b in ((hi, MULTIPLIER_LO), (lo, MULTIPLIER_HI))
    ]
    high = (F.shiftright(sum_low, 32) + F.shiftright(mid, 16) + cross[0] + cross[1]).bitwiseAND(both)
    return high, sum_low.bitwiseAND(both)


def _jump(state: Column, shards: int) -> Column:
    hi, lo = _next_state(state["hi"], state["lo"])
    far = F.floor(
        (state["j"] + F.lit(1)).cast("double") * (F.lit(2147483648.0) / (F.shiftright(hi, 1) + F.lit(1)).cast("double"))
    )
    return F.when(
        state["j"] < F.lit(shards),
        F.struct(hi.alias("hi"), lo.alias("lo"), state["j"].alias("b"), far.cast("bigint").alias("j")),
    ).otherwise(state)


def jump_shard(key: Column, shards: int) -> Column:
    """Shard (0-based int) of a 64-bit key; a null key counts as key 0."""
    if shards < 1:
        raise ValueError("shards must be positive")
    # The key takes part as an unsigned number of 64 bits.  The jump reads the state after a step.
    key = F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(MASK)).alias("lo"),
        F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j"),
    )
    first = min(shards, FIRST_JUMPS)
    state = F.aggregate(F.sequence(F.lit(1), F.lit(first)), start, lambda s, _: _jump(s, shards))
    if shards > first:  # each jump raises j by one at least, so `shards` jumps always end it
        state = F.aggregate(
            F.array(state), start,
            lambda _, s: F.when(s["j"] < F.lit(shards), F.aggregate(
                F.sequence(F.lit(first + 1), F.lit(shards)), s, lambda t, _: _jump(t, shards)
            )).otherwise(s),
        )
    return state["b"].cast("int")


def number_within(rows: DataFrame, group: str, order: list[str], slot: str = "slot") -> DataFrame:
    """Add a gapless number from 0 within each group, without one task per group.

    Rows are range-partitioned by (group, order), numbered where they lie, and shifted by
    the counts of earlier partitions.  That table of counts has at most one row for each
    partition and group, so it is broadcast.
    """
    placed = materialise(
        rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
        .withColumn("__at", F.monotonically_increasing_id()),
        "numbered",
    )
    part = F.shiftright(F.col("__at"), 33)
    runs = placed.groupBy(F.col(group).alias("__g"), part.alias("__p")).agg(
        F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n")
    )
    before = Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "__g", "__p", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift")
    )
    same = F.col(group).eqNullSafe(F.col("__g")) & (part == F.col("__p"))
    return placed.join(F.broadcast(runs), same, "left").select(
        *rows.columns, (F.col("__at") + F.col("__shift")).alias(slot)
    )


def assign_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row with its shard, the shard after one more is appended, and a slot.

    Columns: ``id_col``, size (UTF-8 bytes of the text plus 1; null text 1), text_crc32,
    law ("key"), shard, slot (gapless from 0 in each shard, by key), grown_shard.  Only
    key and count decide the shard: repeated keys share a shard, a null key counts as 0,
    equal texts are told apart by their keys alone.  Slots of rows equal in every column
    are interchangeable.  Other columns are ignored; an empty table gives an empty table.
    """
    text = text_of(text_col)
    key = named(docs, id_col)
    rows = docs.select(
        key.alias(id_col),
        (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_shard(key, shards).alias("shard"),
        jump_shard(key, shards + 1).alias("grown_shard"),
    )
    out = number_within(rows, "shard", [id_col, "text_crc32", "size"])
    return out.select(id_col, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
