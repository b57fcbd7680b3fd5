"""Exact linear-interpolation quantiles that stay bounded in memory.

``percentile`` keeps one entry per distinct value in a reducer.  It is used when
the number of distinct values is measured to be small; otherwise order
statistics are found by narrowing value ranges, each round cutting the rows in
play by about 300 times, whatever the skew.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .joins import MAX_BROADCAST_ROWS
from .roles import col

DIRECT_LIMIT = 1_000_000
STEPS = 1000
MAX_ROUNDS = 12


def _distinct_estimate(df: DataFrame, cols: list[str], by: list[str]) -> int:
    exprs = [
        F.approx_count_distinct(F.struct(*[col(b) for b in by], col(c)) if by else col(c)).alias(f"d{i}")
        for i, c in enumerate(cols)
    ]
    return max(v or 0 for v in df.agg(*exprs).first())


def quantiles(
    df: DataFrame,
    cols: list[str],
    probs: list[float],
    by: list[str] | tuple[str, ...] = (),
    direct_limit: int = DIRECT_LIMIT,
) -> DataFrame:
    """Rows ``(by..., column, q)`` with ``q`` the array of quantiles; NULLs are skipped."""
    by = list(by)
    if _distinct_estimate(df, cols, by) <= direct_limit:
        aggs = [
            F.percentile(col(c).cast("double"), F.array(*[F.lit(float(p)) for p in probs])).alias(f"_q{i}")
            for i, c in enumerate(cols)
        ]
        wide = df.groupBy(*[col(b) for b in by]).agg(*aggs) if by else df.agg(*aggs)
        pairs = F.array(
            *[F.struct(F.lit(c).alias("column"), F.col(f"_q{i}").alias("q")) for i, c in enumerate(cols)]
        )
        return wide.select(*[col(b) for b in by], F.inline(pairs))
    long = df.select(
        *[col(b) for b in by],
        F.inline(
            F.array(
                *[F.struct(F.lit(c).alias("column"), col(c).cast("double").alias("_v")) for c in cols]
            )
        ),
    ).where("_v is not null")
    return _by_narrowing(long, [*by, "column"], probs, direct_limit)


def quantile_values(
    df: DataFrame, cols: list[str], probs: list[float], direct_limit: int = DIRECT_LIMIT
) -> dict[str, list[float | None]]:
    """Quantiles of whole columns as Python floats (one row per column reaches the driver)."""
    empty: list[float | None] = [None] * len(probs)
    rows = quantiles(df, cols, probs, direct_limit=direct_limit).collect()
    found = {r["column"]: list(r["q"]) if r["q"] is not None else empty for r in rows}
    return {c: found.get(c, empty) for c in cols}


def _same(left: DataFrame, right: DataFrame, keys: list[str]):
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def order_statistics(rows: DataFrame, keys: list[str], wanted: DataFrame, limit: int) -> DataFrame:
    """Value at 0-based rank ``_r`` of ``_v`` inside each group.

    ``wanted`` holds ``keys, _r`` and the group's ``_lo, _hi, _n``.  The open or
    closed value range that holds each rank is narrowed until few rows are left.
    """
    state = cut_lineage(
        wanted.select(
            *keys, "_r", "_lo", "_hi", F.lit(True).alias("_li"), F.lit(True).alias("_hc"),
            F.lit(0).cast("bigint").alias("_below"), F.col("_n").alias("_inside"),
        )
    )
    n_state = state.count()

    def in_range(state_df):
        renamed = state_df.select(*[F.col(k).alias(f"_s_{k}") for k in keys],
                                  *[c for c in state_df.columns if c not in keys])
        cond = reduce(lambda a, b: a & b, [col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys])
        v = F.col("_v")
        within = ((v > F.col("_lo")) | (F.col("_li") & (v == F.col("_lo")))) & (
            (v < F.col("_hi")) | (F.col("_hc") & (v == F.col("_hi")))
        )
        # One row per group and rank: broadcast unless the groups are many.
        few = F.broadcast(renamed) if n_state <= MAX_BROADCAST_ROWS else renamed
        return rows.join(few, cond).where(within).drop(*[f"_s_{k}" for k in keys])

    for _ in range(MAX_ROUNDS):
        largest = state.where("_lo < _hi").agg(F.max("_inside")).first()[0]
        if largest is None or largest <= limit:
            break
        marks = [i / STEPS for i in range(STEPS + 1)]
        live = state.where("_lo < _hi")
        grid = in_range(live).groupBy(*keys, "_r", "_below", "_inside").agg(
            F.percentile_approx("_v", F.array(*[F.lit(m) for m in marks]), F.lit(20 * STEPS)).alias("_g")
        )
        place = F.floor((F.col("_r") - F.col("_below")) * STEPS / F.col("_inside")).cast("int")
        grid = grid.select(
            *keys, "_r",
            F.element_at("_g", F.greatest(place, F.lit(1))).alias("_t1"),
            F.element_at("_g", F.least(place + 3, F.lit(STEPS + 1))).alias("_t2"),
        )
        g = grid.alias("g")
        s = live.alias("s")
        on = reduce(
            lambda a, b: a & b,
            [F.col(f"s.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys] + [F.col("s._r") == F.col("g._r")],
        )
        live2 = cut_lineage(s.join(g, on).select("s.*", "g._t1", "g._t2"))
        v = F.col("_v")
        tally = in_range(live2).groupBy(
            *keys, "_r", "_lo", "_hi", "_li", "_hc", "_below", "_inside", "_t1", "_t2"
        ).agg(
            F.count_if(v < F.col("_t1")).alias("_a"),
            F.count_if(v <= F.col("_t1")).alias("_b"),
            F.count_if(v < F.col("_t2")).alias("_c"),
            F.count_if(v <= F.col("_t2")).alias("_d"),
        )
        p = F.col("_r") - F.col("_below")
        t1, t2 = F.col("_t1"), F.col("_t2")
        regions = [
            (p < F.col("_a"), "_lo", "_t1", "_li", False, F.lit(0), F.col("_a")),
            (p < F.col("_b"), "_t1", "_t1", True, True, F.col("_a"), F.col("_b") - F.col("_a")),
            (p < F.col("_c"), "_t1", "_t2", False, False, F.col("_b"), F.col("_c") - F.col("_b")),
            (p < F.col("_d"), "_t2", "_t2", True, True, F.col("_c"), F.col("_d") - F.col("_c")),
            (F.lit(True), "_t2", "_hi", False, "_hc", F.col("_d"), F.col("_inside") - F.col("_d")),
        ]
        expr = None
        for cond, lo, hi, li, hc, skip, inside in regions:
            piece = F.struct(
                F.col(lo).alias("lo"), F.col(hi).alias("hi"),
                (F.col(li) if isinstance(li, str) else F.lit(li)).alias("li"),
                (F.col(hc) if isinstance(hc, str) else F.lit(hc)).alias("hc"),
                (F.col("_below") + skip).alias("below"), inside.alias("inside"),
            )
            expr = F.when(cond, piece) if expr is None else expr.when(cond, piece)
        moved = tally.withColumn("_p", expr).select(
            *keys, "_r", F.col("_p.lo").alias("_lo"), F.col("_p.hi").alias("_hi"),
            F.col("_p.li").alias("_li"), F.col("_p.hc").alias("_hc"),
            F.col("_p.below").alias("_below"), F.col("_p.inside").alias("_inside"),
        )
        state = cut_lineage(state.where("_lo >= _hi").unionByName(moved))

    settled = state.where("_lo >= _hi").select(*keys, "_r", F.col("_lo").alias("_value"))
    small = in_range(state.where("_lo < _hi")).groupBy(*keys, "_r", "_below", "_v").agg(
        F.count(F.lit(1)).alias("_c")
    )
    run = Window.partitionBy(*keys, "_r").orderBy("_v")
    small = small.withColumn("_upto", F.col("_below") + F.sum("_c").over(run))
    first_over = small.where(F.col("_r") < F.col("_upto")).groupBy(*keys, "_r").agg(
        F.min("_v").alias("_value")
    )
    return settled.unionByName(first_over)


def _by_narrowing(long: DataFrame, keys: list[str], probs: list[float], limit: int) -> DataFrame:
    sizes = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    spots = F.array(
        *[F.struct(F.lit(i).alias("_i"), (F.lit(float(p)) * (F.col("_n") - 1)).alias("_pos"))
          for i, p in enumerate(probs)]
    )
    spots_df = cut_lineage(sizes.select("*", F.inline(spots)))
    ends = spots_df.select(
        *keys, "_n", "_lo", "_hi",
        F.explode(F.array(F.floor("_pos").cast("bigint"), F.ceil("_pos").cast("bigint"))).alias("_r"),
    ).distinct()
    stats = order_statistics(long, keys, ends, limit)
    s = spots_df.withColumn("_rf", F.floor("_pos").cast("bigint")).withColumn(
        "_rc", F.ceil("_pos").cast("bigint")
    )
    lo = stats.select(*[F.col(k).alias(f"_l_{k}") for k in keys], F.col("_r").alias("_lr"),
                      F.col("_value").alias("_lv"))
    hi = stats.select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.col("_r").alias("_hr"),
                      F.col("_value").alias("_hv"))
    on_lo = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_l_{k}")) for k in keys])
    on_hi = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys])
    joined = s.join(lo, on_lo & (F.col("_rf") == F.col("_lr"))).join(
        hi, on_hi & (F.col("_rc") == F.col("_hr"))
    )
    value = F.col("_lv") + (F.col("_hv") - F.col("_lv")) * (F.col("_pos") - F.col("_rf"))
    gathered = joined.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_i", value.alias("v")))).alias("_all")
    )
    return gathered.select(*keys, F.transform("_all", lambda x: x["v"]).alias("q"))
