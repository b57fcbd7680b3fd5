"""The data behind charts: bins, box figures, counts, points, densities, correlations."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import join_null_safe, measured
from ..functions.quantiles import quantiles
from ..functions.roles import col, numeric_columns, require_columns
from .profile import IQR_FACTOR, percent
from .reshape import pivot
from .view import sample

#: Columns of a block of the correlation sums; tables of up to so many take one pass.
GRAM_COLUMNS = 1024
FLAT = 1e-12
DENSITY_POINTS = 200
DENSITY_CUT = 3.0
#: Distinct values up to which density curves are exact, nodes per bandwidth above it, and a kernel's reach.
EXACT_VALUES = 20_000
DENSITY_STEP = 0.02
KERNEL_REACH = 8.5
TOP_VALUES = 20
SCATTER_POINTS = 5000


def _bin_of(x: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based equal-width bin; the last bin is closed on the right."""
    place = F.floor((x - low) / ((high - low) / bins)).cast("int")
    return F.greatest(F.least(place, F.lit(bins - 1)), F.lit(0))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """``bin, low, high, n`` with empty bins kept.  A constant column is widened by 0.5 each way."""
    return histogram_by(df.withColumn("_all", F.lit(0)), column, "_all", bins).drop("_all")


def histogram_by(df: DataFrame, column: str, by: str, bins: int = 30) -> DataFrame:
    """Histogram inside each group, over the group's own range; rows without a group are left out."""
    values = df.select(col(by).alias("_g"), col(column).cast("double").alias("_x"))
    values = values.where("_g is not null and _x is not null")
    ends = values.groupBy("_g").agg(F.min("_x").alias("_a"), F.max("_x").alias("_z"))
    flat = F.col("_a") == F.col("_z")
    ends = measured(ends.select(
        "_g", F.when(flat, F.col("_a") - 0.5).otherwise(F.col("_a")).alias("_lo"),
        F.when(flat, F.col("_z") + 0.5).otherwise(F.col("_z")).alias("_hi"),
    ))
    placed = values.join(ends, "_g").select(
        "_g", _bin_of(F.col("_x"), F.col("_lo"), F.col("_hi"), bins).alias("bin")
    )
    counts = placed.groupBy("_g", "bin").agg(F.count(F.lit(1)).alias("_n"))
    frame = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("_hi") - F.col("_lo")) / bins
    return frame.join(counts, ["_g", "bin"], "left").select(
        F.col("_g").alias(by), "bin", (F.col("_lo") + width * F.col("bin")).alias("low"),
        (F.col("_lo") + width * (F.col("bin") + 1)).alias("high"),
        F.coalesce("_n", F.lit(0)).cast("bigint").alias("n"),
    )


def _fences(df: DataFrame, column: str, by: str) -> DataFrame:
    """Group, quartiles and fences from the exact group quantiles."""
    q = quantiles(df, [column], [0.25, 0.5, 0.75], by=[by])
    q = q.select(
        col(by).alias("_g"), F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3")
    )
    spread = (F.col("q3") - F.col("q1")) * IQR_FACTOR
    return measured(q.withColumns({"_lower": F.col("q1") - spread, "_upper": F.col("q3") + spread}))


def box_stats_by(df: DataFrame, column: str, by: str) -> DataFrame:
    """Quartiles, whiskers (extreme values inside the fences) and outlier count per group."""
    values = df.select(col(by), col(column)).where(col(by).isNotNull() & col(column).isNotNull())
    fences = _fences(values, column, by)
    x = col(column).cast("double")
    inside = x.between(F.col("_lower"), F.col("_upper"))
    joined = values.join(fences, col(by) == F.col("_g"))
    tallied = joined.groupBy("_g", "q1", "median", "q3").agg(
        F.min(F.when(inside, x)).alias("whisker_low"), F.max(F.when(inside, x)).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"), F.count(F.lit(1)).alias("n"),
    )
    return tallied.select(
        F.col("_g").alias(by), "q1", "median", "q3", "whisker_low", "whisker_high", "outliers", "n"
    )


def box_stats(df: DataFrame, column: str) -> DataFrame:
    """Box figures of a whole column."""
    return box_stats_by(df.withColumn("_all", F.lit(0)), column, "_all").drop("_all")


def box_outliers(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """The points beyond the fences, with the named columns."""
    from .profile import iqr_bounds

    low, high = iqr_bounds(df, [column])[column]
    outside = (col(column) < F.lit(low).cast("double")) | (col(column) > F.lit(high).cast("double"))
    return df.where(outside).select(*[col(c) for c in dict.fromkeys([*keep, column])])


def value_counts(df: DataFrame, column: str, top: int | None = TOP_VALUES) -> DataFrame:
    """Most frequent values, ties by value."""
    counts = df.where(col(column).isNotNull()).groupBy(col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    ordered = counts.orderBy(F.desc("n"), F.asc("value"))
    return ordered.limit(top) if top is not None else ordered


def cross_tab(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """Counts of value pairs, one column per value of ``columns``, gaps 0."""
    counted = df.withColumn("_one", F.lit(1))
    return pivot(counted, [rows], columns, "_one", "count")


def scatter(df: DataFrame, x: str, y: str, key: str, by: str | None = None, n: int = SCATTER_POINTS) -> DataFrame:
    """Points for a scatter picture: a repeatable sample of at most ``n`` complete rows."""
    names = [key, x, y] + ([by] if by else [])
    points = df.select(*[col(c) for c in dict.fromkeys(names)])
    for c in names[1:]:
        points = points.where(col(c).isNotNull())
    return sample(points, n, key)


def scatter_grid(df: DataFrame, x: str, y: str, bins: int = 50, by: str | None = None) -> DataFrame:
    """Scatter of the whole table as counts on an equal-width grid."""
    names = [x, y] + ([by] if by else [])
    rows = df.select(*[col(c) for c in names]).na.drop(subset=names)
    dx, dy = col(x).cast("double"), col(y).cast("double")
    e = rows.agg(F.min(dx).alias("a"), F.max(dx).alias("b"), F.min(dy).alias("c"), F.max(dy).alias("d")).first()

    def cell(value, low, high):
        if low is None or low == high:
            return F.lit(0)
        return _bin_of(value, F.lit(low), F.lit(high), bins)

    keys = [cell(dx, e["a"], e["b"]).alias("x_bin"), cell(dy, e["c"], e["d"]).alias("y_bin")]
    return rows.groupBy(*([col(by)] if by else []), *keys).agg(F.count(F.lit(1)).alias("n"))


def _kernel_sums(nodes: DataFrame, points: int) -> DataFrame:
    """Sums of kernels at the grid points, from weighted places ``_x``; points that no kernel reaches get 0."""
    step = (F.col("_hi") - F.col("_lo")) / (points - 1)
    reach = F.lit(KERNEL_REACH) * F.col("_h")
    first = F.greatest(F.ceil((F.col("_x") - reach - F.col("_lo")) / step), F.lit(0)).cast("int")
    last = F.least(F.floor((F.col("_x") + reach - F.col("_lo")) / step), F.lit(points - 1)).cast("int")
    near = nodes.where(first <= last).withColumn("point", F.explode(F.sequence(first, last)))
    z = (F.col("_lo") + step * F.col("point") - F.col("_x")) / F.col("_h")
    return near.groupBy("_g", "point").agg(F.sum(F.col("_w") * F.exp(-0.5 * z * z)).alias("_k"))


def density_by(
    df: DataFrame, column: str, by: str, points: int = DENSITY_POINTS, fine_bins: int | None = None,
    exact_values: int = EXACT_VALUES,
) -> DataFrame:
    """Gaussian density curve per group: Scott bandwidth, ``points`` grid values, cut 3.

    Values are counted first, and kernels are summed over what is counted, so a row costs
    the same whatever the grid.  Up to ``exact_values`` distinct values (by estimate) are
    counted as they are.  More are dealt to nodes ``DENSITY_STEP`` bandwidths apart, each
    value to its two neighbours by distance, which moves the curve by at most
    DENSITY_STEP ** 2 / 8 of a kernel's height, 5e-5.  A kernel ends after ``KERNEL_REACH``
    bandwidths, below 1e-15 of its height.  ``fine_bins`` counts in that many bins per
    group instead (bin centres replace values).
    """
    values = df.select(col(by).alias("_g"), col(column).cast("double").alias("_x"), F.lit(1.0).alias("_w"))
    values = values.where("_g is not null and _x is not null")
    facts = values.groupBy("_g").agg(
        F.count(F.lit(1)).alias("_n"), F.stddev_samp("_x").alias("_s"),
        F.min("_x").alias("_a"), F.max("_x").alias("_z"), F.approx_count_distinct("_x").alias("_d"),
    )
    facts = facts.where("_n > 1 and _s > 0").withColumn(
        "_h", F.col("_s") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))
    )
    facts = measured(facts.withColumns(
        {"_lo": F.col("_a") - DENSITY_CUT * F.col("_h"), "_hi": F.col("_z") + DENSITY_CUT * F.col("_h")}
    ).drop("_s"))
    joined = values.join(facts, "_g")
    if fine_bins:
        place = _bin_of(F.col("_x"), F.col("_a"), F.col("_z"), fine_bins)
        width = (F.col("_z") - F.col("_a")) / fine_bins
        joined = joined.withColumn("_x", F.col("_a") + width * (place + 0.5))
    elif (facts.agg(F.sum("_d")).first()[0] or 0) > exact_values:
        width = F.col("_h") * DENSITY_STEP
        node = F.floor((F.col("_x") - F.col("_lo")) / width)
        right = (F.col("_x") - F.col("_lo")) / width - node
        both = F.array(
            F.struct(node.alias("node"), (1 - right).alias("w")), F.struct((node + 1).alias("node"), right.alias("w"))
        )
        dealt = joined.select("_g", "_lo", "_h", F.inline(both)).groupBy("_g", "node").agg(F.sum("w").alias("_w"))
        joined = dealt.join(facts, "_g").withColumn("_x", F.col("_lo") + F.col("_h") * DENSITY_STEP * F.col("node"))
    keys = ["_g", "_h", "_lo", "_hi", "_x"]
    nodes = joined.groupBy(*keys).agg(F.sum("_w").alias("_w"))
    grid = facts.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    found = join_null_safe(grid, _kernel_sums(nodes, points), ["_g", "point"], "left")
    at = F.col("_lo") + (F.col("_hi") - F.col("_lo")) / (points - 1) * F.col("point")
    height = F.coalesce("_k", F.lit(0.0)) / (F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi))
    return found.select(F.col("_g").alias(by), "point", at.alias("x"), height.alias("density"))


def density(df: DataFrame, column: str, points: int = DENSITY_POINTS, fine_bins: int | None = None) -> DataFrame:
    """Density curve of a whole column."""
    return density_by(df.withColumn("_all", F.lit(0)), column, "_all", points, fine_bins).drop("_all")


#: What a pair's r is made of: rows that have both, sums and squares of either there, products.
GRAM_SUMS = ("n", "sa", "sb", "qa", "qb", "p")


def _gram(rows: DataFrame, k: int, means: list[float], left: range, right: range) -> DataFrame:
    """(i, j, sums) of column pairs i in ``left`` and j > i in ``right``, from one pass of matrix products.

    Of a batch's centred values X (0 where missing) and its presence M, the products of X,
    X * X and M hold the sums of all pairs; a task adds up its batches and sends one row
    per pair.
    """
    wanted = sorted(set(left) | set(right))
    at = {c: n for n, c in enumerate(wanted)}
    a, b = [at[c] for c in left], [at[c] for c in right]
    shift = np.array([means[c] for c in wanted])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            there = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            x = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            x = np.where(there, x - shift, 0.0)
            m, q = there.astype(np.float64), x * x
            sums = np.stack([
                m[:, a].T @ m[:, b], x[:, a].T @ m[:, b], m[:, a].T @ x[:, b], q[:, a].T @ m[:, b], m[:, a].T @ q[:, b],
                x[:, a].T @ x[:, b],
            ])
            total = sums if total is None else total + sums
        if total is not None:
            i, j = np.meshgrid(np.array(left), np.array(right), indexing="ij")
            keep = i < j
            yield pa.RecordBatch.from_arrays(
                [pa.array(i[keep]), pa.array(j[keep]), *[pa.array(s[keep]) for s in total]], ["i", "j", *GRAM_SUMS]
            )

    schema = "i bigint, j bigint, " + ", ".join(f"{c} double" for c in GRAM_SUMS)
    return rows.select(*[f"x{c}" for c in wanted]).mapInArrow(each, schema)


def correlation_pairs(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson r of every pair of numeric columns (``col_a`` before ``col_b``), pairwise complete.

    A first aggregate finds each column's mean and gaps.  One more pass sums products of
    centred columns, so nothing cancels, as matrix products per task (``GRAM_COLUMNS``
    columns against as many at a time).
    """
    names = numeric_columns(df) if columns is None else columns
    require_columns(df, names)
    k = len(names)
    if k < 2:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, r double")
    raw = df.select(*[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    facts = [e for i in range(k) for e in (f"avg(x{i}) as m{i}", f"min(x{i}) as a{i}", f"max(x{i}) as z{i}")]
    row = raw.selectExpr(*facts).first()
    means = [row[f"m{i}"] or 0.0 for i in range(k)]
    flat = [i for i in range(k) if row[f"a{i}"] == row[f"z{i}"]]
    blocks = [range(s, min(s + GRAM_COLUMNS, k)) for s in range(0, k, GRAM_COLUMNS)]
    parts = [_gram(raw, k, means, a, b) for n, a in enumerate(blocks) for b in blocks[n:]]
    met = reduce(DataFrame.unionByName, parts).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in GRAM_SUMS])
    varied = ~(F.col("i").isin(flat) | F.col("j").isin(flat)) if flat else F.lit(True)
    spread = met.withColumn("varied", varied).selectExpr(
        "i", "j", "varied", "n * p - sa * sb as c", "n * qa as ta", "n * qb as tb", "n * qa - sa * sa as va",
        "n * qb - sb * sb as vb")
    # A spread this small beside the squares is rounding: the column is constant there.
    r = f"""if(varied and va > {FLAT} * ta and vb > {FLAT} * tb,
            greatest(least(c / (sqrt(va) * sqrt(vb)), 1D), -1D), null)"""
    if all(mean is None for mean in (row[f"m{i}"] for i in range(k))):  # no values, so maybe no sums either
        every = df.sparkSession.createDataFrame([(i, j) for i in range(k) for j in range(i + 1, k)], "i bigint, j bigint")
        spread = every.selectExpr("i", "j", "false as varied", "0D as c", "0D as ta", "0D as tb", "0D as va", "0D as vb")
    listed = F.array(*[F.lit(c) for c in names])
    return spread.select(
        F.get(listed, F.col("i").cast("int")).alias("col_a"), F.get(listed, F.col("j").cast("int")).alias("col_b"), F.expr(r).alias("r")
    )


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """All ordered pairs: both directions, and 1 on the diagonal of columns that vary."""
    names = numeric_columns(df) if columns is None else columns
    pairs = correlation_pairs(df, names)
    flipped = pairs.select(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "r")
    own = df.agg(*[F.stddev_pop(col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(names)])
    diagonal = own.select(F.inline(F.array(*[
        F.struct(
            F.lit(c).alias("col_a"), F.lit(c).alias("col_b"),
            F.when(F.col(f"s{i}") > 0, F.lit(1.0)).alias("r"),
        )
        for i, c in enumerate(names)
    ])))
    return pairs.unionByName(flipped).unionByName(diagonal)


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Rows and percent per class; rows without a class are left out."""
    counts = df.where(col(target).isNotNull()).groupBy(col(target).alias("class")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # The total is a scan over one row per class.
    total = df.where(col(target).isNotNull()).count()
    return counts.select("class", "n", percent(F.col("n"), F.lit(total)).alias("pct"))


def pair_plot(df: DataFrame, columns: list[str], bins: int = 20) -> DataFrame:
    """Grid counts of every column pair, and the histogram of each column on the diagonal."""
    require_columns(df, columns)
    ends = df.agg(
        *[F.min(col(c).cast("double")).alias(f"a{i}") for i, c in enumerate(columns)],
        *[F.max(col(c).cast("double")).alias(f"z{i}") for i, c in enumerate(columns)],
    ).first()
    cells = []
    for i, c in enumerate(columns):
        low, high = ends[f"a{i}"], ends[f"z{i}"]
        place = F.lit(0) if low is None or low == high else _bin_of(
            col(c).cast("double"), F.lit(low), F.lit(high), bins)
        cells.append(F.when(col(c).isNotNull(), place).alias(f"b{i}"))
    binned = df.select(*cells)
    panels = F.array(*[
        F.struct(
            F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"b{i}").alias("x_bin"), F.col(f"b{j}").alias("y_bin")
        )
        for i, a in enumerate(columns) for j, b in enumerate(columns) if j >= i
    ])
    long = binned.select(F.inline(panels)).where("x_bin is not null and y_bin is not null")
    return long.groupBy("x", "y", "x_bin", "y_bin").agg(F.count(F.lit(1)).alias("n"))


def target_summary(df: DataFrame, target: str, feature: str) -> DataFrame:
    """Mean, exact median and sample deviation of ``feature`` per value of ``target``."""
    rows = df.select(col(target).alias("target"), col(feature).cast("double").alias("_f")).where("target is not null")
    base = rows.groupBy("target").agg(
        F.count("_f").alias("n"), F.avg("_f").alias("mean"), F.stddev_samp("_f").alias("std")
    )
    middle = quantiles(rows, ["_f"], [0.5], by=["target"]).select(
        F.col("target").alias("_t"), F.col("q")[0].alias("median")
    )
    return base.join(middle, F.col("target") == F.col("_t"), "left").select("target", "n", "mean", "median", "std")
