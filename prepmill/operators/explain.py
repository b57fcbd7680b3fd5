"""What drives a model: importances, dependence curves and additive attributions."""

from __future__ import annotations

import math
import random

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import HASH_BITS, hash_key
from ..functions.quantiles import quantiles
from ..functions.roles import col
from .metrics import classification_metrics, regression_metrics
from .view import sample

# Sizes of the explanation steps.
TOP_FEATURES = 15
TOP_EXPLAINED = 10
REPEATS = 10
GRID_POINTS = 100
GRID_TAILS = (0.05, 0.95)
EXPLAINED_ROWS = 50
BACKGROUND_ROWS = 10
SEED = 42

BLOCK_ROWS = 50_000


def feature_importance(spark, model, names: list[str], top: int | None = TOP_FEATURES) -> DataFrame:
    """Built-in importance per vector slot, largest first."""
    weights = model.importances()
    rows = sorted(zip(names, map(float, weights), strict=True), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows[:top], "feature string, importance double")


def coefficients(spark, model, names: list[str], top: int | None = TOP_FEATURES) -> DataFrame:
    """Coefficients of a linear model by size; the first class's for several classes."""
    core = model.core
    if hasattr(core, "coefficientMatrix") and core.numClasses > 2:
        values = core.coefficientMatrix.toArray()[0]
    else:
        values = core.coefficients.toArray()
    rows = sorted(zip(names, map(float, values), strict=True), key=lambda r: (-abs(r[1]), r[0]))
    return spark.createDataFrame(rows[:top], "feature string, coefficient double")


def output_column(kind: str, target_class: int = 1) -> Column:
    """The number a model is explained by: a class probability or the prediction."""
    return vector_to_array("probability")[target_class] if kind == "classification" else F.col("prediction")


def _vectors(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*[col(c) for c in keep], vector_to_array("features").alias("_a"))


def permutation_importance(
    model, data: DataFrame, names: list[str], key: str, repeats: int = REPEATS, seed: int = SEED,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Mean and population deviation of the score drop when one feature is shuffled.

    Rows are put in random order and each takes the feature value of the next row, the
    last one that of the first.  Blocks are ranges of that order, so the result does not
    depend on ``block_rows``: a block's last row takes the first row of the next block.
    One shuffle per repeat serves all features; the changed copies are made and scored
    map-side, and only sums per feature and repeat leave a task.
    """
    rows = _vectors(data, [key, "_label"])
    bits = max(0, math.ceil(math.log2(max(1, rows.count() / block_rows))))
    shuffled = None
    for r in range(repeats):
        placed = rows.withColumn("_order", hash_key(key, f"{seed}:order{r}"))
        placed = placed.withColumn("_block", F.shiftright("_order", HASH_BITS - bits))
        heads = placed.groupBy("_block").agg(F.min_by("_a", F.struct("_order", col(key))).alias("_head"))
        # One row per block of about ``block_rows`` rows.
        blocks = Window.partitionBy(F.lit(0)).orderBy("_block")
        whole = blocks.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        after = F.coalesce(F.lead("_head").over(blocks), F.first("_head").over(whole))
        placed = placed.join(heads.select("_block", after.alias("_next")), "_block")
        ring = Window.partitionBy("_block").orderBy("_order", col(key))
        donor = F.coalesce(F.lead("_a").over(ring), F.col("_next"))
        part = placed.select("_label", "_a", donor.alias("_d"), F.lit(r).alias("repeat"))
        shuffled = part if shuffled is None else shuffled.unionByName(part)
    spread = shuffled.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))))
    mixed = F.transform("_a", lambda x, i: F.when(i == F.col("_j"), F.get("_d", i)).otherwise(x))
    scored = model.transform(spread.select("_label", "repeat", "_j", array_to_vector(mixed).alias("features")))
    if model.kind == "classification":
        base = classification_metrics(model.transform(data), "_label", "prediction").first()["accuracy"]
        drops = classification_metrics(scored, "_label", "prediction", ["_j", "repeat"]).withColumn("s", F.col("accuracy"))
    else:
        base = regression_metrics(model.transform(data), "_label", "prediction").first()["r2"]
        drops = regression_metrics(scored, "_label", "prediction", ["_j", "repeat"]).withColumn("s", F.col("r2"))
    listed = F.array(*[F.lit(n) for n in names])
    return drops.groupBy("_j").agg(
        F.avg(F.lit(base) - F.col("s")).alias("importance"), F.stddev_pop("s").alias("std")
    ).select(listed[F.col("_j")].alias("feature"), "importance", "std")


def dependence_grid(data: DataFrame, names: list[str], slots: list[int], points: int = GRID_POINTS) -> dict[int, list[float]]:
    """Grid per vector slot: its values when few, else even steps between the 5 % and 95 % quantiles."""
    rows = _vectors(data, []).select(*[F.col("_a")[s].alias(f"s{s}") for s in slots])
    grids: dict[int, list[float]] = {}
    tails = {r["column"]: r["q"] for r in quantiles(rows, [f"s{s}" for s in slots], list(GRID_TAILS)).collect()}
    for s in slots:
        few = [r[0] for r in rows.select(f"s{s}").distinct().limit(points + 1).collect()]
        if len(few) <= points:
            grids[s] = sorted(few)
        else:
            low, high = tails[f"s{s}"]
            grids[s] = [low + (high - low) * i / (points - 1) for i in range(points)]
    return grids


def partial_dependence(
    model, data: DataFrame, names: list[str], features: list[str], points: int = GRID_POINTS, target_class: int = 1,
) -> DataFrame:
    """Mean model output with one feature set to each grid value: ``feature, value, mean_output``.

    Copies are made and scored map-side; tasks send one partial mean per grid value.
    """
    slots = [names.index(f) for f in features]
    grids = dependence_grid(data, names, slots, points)
    marks = F.array(*[
        F.struct(F.lit(s).alias("_j"), F.lit(float(v)).alias("value")) for s in slots for v in grids[s]
    ])
    spread = _vectors(data, []).select("_a", F.inline(marks))
    mixed = F.transform("_a", lambda x, i: F.when(i == F.col("_j"), F.col("value")).otherwise(x))
    scored = model.transform(spread.select("_j", "value", array_to_vector(mixed).alias("features")))
    listed = F.array(*[F.lit(n) for n in names])
    means = scored.groupBy("_j", "value").agg(F.avg(output_column(model.kind, target_class)).alias("mean_output"))
    return means.select(listed[F.col("_j")].alias("feature"), "value", "mean_output")


def linear_attributions(data: DataFrame, names: list[str], weights: list[float], key: str) -> DataFrame:
    """``key, feature, value, attribution`` with attribution ``weight * (x - mean)``."""
    rows = _vectors(data, [key])
    means = rows.agg(*[F.avg(F.col("_a")[i]).alias(f"m{i}") for i in range(len(names))]).first()
    parts = F.array(*[
        F.struct(
            F.lit(n).alias("feature"), F.col("_a")[i].alias("value"),
            (F.lit(float(weights[i])) * (F.col("_a")[i] - F.lit(means[f"m{i}"]))).alias("attribution"),
        )
        for i, n in enumerate(names)
    ])
    return rows.select(col(key), F.inline(parts))


def shapley_values(
    model, data: DataFrame, names: list[str], key: str, rows: int = EXPLAINED_ROWS, background: int = BACKGROUND_ROWS,
    orders: int = 10, target_class: int = 1, seed: int = SEED,
) -> DataFrame:
    """Sampled Shapley values: ``key, feature, value, attribution``.

    Features of a background row are replaced by the explained row's in random orders;
    each step's change of output belongs to the replaced feature.  Per row the values
    add up to its output minus the mean output of the background.
    """
    rng = random.Random(seed)
    width = len(names)
    paths = []
    for _ in range(max(1, orders // 2)):
        path = list(range(width))
        rng.shuffle(path)
        paths += [path, path[::-1]]
    chosen = sample(_vectors(data, [key]), rows, key, seed)
    behind = [r["_a"] for r in sample(_vectors(data, [key]), background, key, f"{seed}:background").collect()]
    grid = chosen.withColumn("_b", F.explode(F.array(*[F.array(*[F.lit(float(x)) for x in b]) for b in behind])))
    grid = grid.withColumn("_o", F.explode(F.array(*[F.array(*[F.lit(i) for i in p]) for p in paths])))
    grid = grid.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(width))))
    taken = F.slice("_o", F.lit(1), F.col("_s"))
    mixed = F.transform(
        "_b", lambda x, i: F.when(F.array_contains(taken, i), F.get("_a", i)).otherwise(x))
    scored = model.transform(grid.select(key, "_a", "_o", "_s", array_to_vector(mixed).alias("features")))
    f = output_column(model.kind, target_class)
    none = F.lit(None).cast("double")
    sides = F.array(
        F.struct(F.get("_o", F.col("_s") - 1).alias("_j"), F.when(F.col("_s") > 0, f).otherwise(none).alias("_d")),
        F.struct(F.get("_o", F.col("_s")).alias("_j"), F.when(F.col("_s") < width, -f).otherwise(none).alias("_d")),
    )
    steps = scored.select(key, "_a", F.inline(sides)).where("_j is not null and _d is not null")
    listed = F.array(*[F.lit(n) for n in names])
    total = float(len(behind) * len(paths))
    summed = steps.groupBy(key, "_j").agg(F.sum("_d").alias("_t"), F.first("_a").alias("_a"))
    return summed.select(
        key, listed[F.col("_j")].alias("feature"), F.get("_a", F.col("_j")).alias("value"),
        (F.col("_t") / F.lit(total)).alias("attribution"),
    )


def attribution_summary(attributions: DataFrame, top: int = TOP_FEATURES) -> DataFrame:
    """Mean absolute attribution per feature, largest first."""
    means = attributions.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("mean_abs"))
    return means.orderBy(F.desc("mean_abs"), "feature").limit(top)


def attribution_breakdown(attributions: DataFrame, key: str, row) -> DataFrame:
    """One row's features by size of attribution."""
    return attributions.where(col(key) == F.lit(row)).orderBy(F.desc(F.abs("attribution")), "feature")


def explain_predictions(importance: DataFrame, data: DataFrame, names: list[str], key: str, top: int = TOP_EXPLAINED) -> DataFrame:
    """For every row the most important features with the row's own values."""
    best = importance.orderBy(F.desc("importance"), "feature").limit(top).collect()
    parts = F.array(*[
        F.struct(
            F.lit(r["feature"]).alias("feature"), F.lit(r["importance"]).alias("importance"),
            F.col("_a")[names.index(r["feature"])].alias("value"),
        )
        for r in best
    ])
    return _vectors(data, [key]).select(col(key), F.inline(parts))
