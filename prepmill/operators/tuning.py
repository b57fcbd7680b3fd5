"""Grid and random search by cross-validation, and probability calibration."""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parallel import run_together
from ..functions.roles import col
from .boosting import BoostedSearch, vector_of
from .compare import fold_scores
from .models import PRESETS, SEED, fit_model
from .staged import staged_predictions

# Parameter grids (an unlimited depth is Spark's largest, a split size s a leaf of s/2).
FOREST_GRID = {"numTrees": [50, 100, 200], "maxDepth": [30, 10, 20], "minInstancesPerNode": [1, 2, 5]}
BOOST_GRID = {"maxIter": [50, 100, 200], "maxDepth": [3, 6, 9], "stepSize": [0.01, 0.1, 0.2]}
GRIDS = {"random_forest": FOREST_GRID, "xgboost": BOOST_GRID, "lightgbm": BOOST_GRID}
RANDOM_DRAWS = 20
FOLDS = 5


def grid_points(grid: dict[str, list]) -> list[dict]:
    """All combinations, in order."""
    return [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]


def random_points(grid: dict[str, list], draws: int = RANDOM_DRAWS, seed: int = SEED) -> list[dict]:
    """Up to ``draws`` different combinations."""
    points = grid_points(grid)
    return random.Random(seed).sample(points, min(draws, len(points)))


#: A searched table is spread over one task for so many rows, as each of many fits reads it.
ROWS_PER_TASK = 50_000
#: Fits run side by side, and on tables of so many tasks, whose forests are larger and fill the cores alone.
SIDE_BY_SIDE = 8
MANY_TASKS, FEW_SIDE_BY_SIDE = 20, 3
#: What a larger fit of a model holds smaller ones of.
STAGED = {"random_forest": ("numTrees", "maxDepth"), "decision_tree": ("maxDepth",)}
BOOST_STAGED = {"maxIter", "maxDepth", "stepSize"}


@dataclass
class SearchResult:
    """The best point (the first of equals), its mean fold score, and all points with their fold scores."""

    best: dict
    score: float
    points: list[tuple[dict, list[float]]]

    def __iter__(self):
        """So that ``best, score = search(...)`` reads the answer."""
        return iter((self.best, self.score))

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per point: its parameters, mean score, and whether it was chosen."""
        names = list(self.points[0][0])
        rows = [(*[float(p[n]) for n in names], float(np.mean(s)), p == self.best) for p, s in self.points]
        return spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names) + ", score double, chosen boolean")


def fold_features(train: DataFrame, prepared: list, whole=None) -> DataFrame:
    """``train`` (with ``fold``) with ``_label`` and, for each fold i, ``features_i`` by a preparation fitted without it.

    ``prepared`` comes from ``training.prepare_folds``; all its members index labels alike.
    ``whole``, the preparation fitted on all rows, adds ``features``.
    """
    first = prepared[0]
    data = first.labelled(train)
    if whole is not None:
        data = whole.preprocessor.model.transform(data).withColumnRenamed("features", "_whole")
    for i, p in enumerate(prepared):
        data = p.preprocessor.model.transform(data).withColumnRenamed("features", f"features_{i}")
    weight = ["_weight"] if first.weights else []
    vectors = [f"features_{i}" for i in range(len(prepared))]
    vectors += [F.col("_whole").alias("features")] if whole is not None else []
    return data.select(col(first.key), "fold", "_label", *weight, *vectors)


def _fold_parts(data: DataFrame, fold: int, weight: str | None, key: str | None) -> tuple[DataFrame, DataFrame]:
    """(training, held-out) rows of a fold with its own features."""
    extra = [c for c in (key, weight) if c]
    rows = data.select("fold", *[col(c) for c in extra], "_label", F.col(vector_of(data, fold)).alias("features"))
    return rows.filter(F.col("fold") != fold).drop("fold"), rows.filter(F.col("fold") == fold).drop("fold")


def _fitted_scores(
    name: str, kind: str, data: DataFrame, classes: int, points: list[dict], fixed: dict, folds: int, weight: str | None,
    key: str | None, sampler=None,
) -> list[list[float]]:
    """Fold scores of each point; points that differ in staged parameters only share one fit a fold."""
    staged = [p for p in STAGED.get(name, ()) if any(p in point for point in points)]
    groups: dict[tuple, list[int]] = {}
    for k, point in enumerate(points):
        groups.setdefault(tuple((p, v) for p, v in point.items() if p not in staged), []).append(k)
    scores: list[list[float]] = [[0.0] * folds for _ in points]

    def one(fold: int, own: tuple, members: list[int]) -> None:
        inner, held = _fold_parts(data, fold, weight, key)
        inner = sampler(inner) if sampler else inner
        largest = {p: max(points[k][p] for k in members) for p in staged}
        fitted = fit_model(name, kind, inner, classes, weight, {**fixed, **dict(own), **largest}, key)
        if staged:
            trees = len(fitted.core.trees) if name == "random_forest" else 1
            stages = [(points[k].get("numTrees", trees), points[k].get("maxDepth", fitted.core.getMaxDepth())) for k in members]
            guesses = staged_predictions(fitted.core, kind == "classification", held, stages)
        else:
            guesses = fitted.transform(held).select(F.lit("0").alias("model"), F.col("_label").alias("label"), "prediction")
        for row in fold_scores(guesses.withColumn("fold", F.lit(fold)), kind).collect():
            scores[members[int(row["model"])]][fold] = float(row["score"] or 0.0)

    run_together(data.sparkSession, [
        lambda f=f, o=o, m=m: one(f, o, m) for o, m in groups.items() for f in range(folds)
    ], FEW_SIDE_BY_SIDE if data.rdd.getNumPartitions() >= MANY_TASKS else SIDE_BY_SIDE)
    return scores


def _boosted_scores(
    name: str, kind: str, data: DataFrame, classes: int, points: list[dict], fixed: dict, folds: int, weight: str | None
) -> list[list[float]]:
    settings = {**PRESETS[name], **fixed}
    shaped = [
        tuple({**settings, **p}[c] for c in ("maxDepth", "stepSize", "maxIter")) for p in points
    ]
    found = BoostedSearch(data, folds, classes if kind == "classification" else 0, weight).run(list(dict.fromkeys(shaped)))
    return [found[s] for s in shaped]


def search(
    name: str, kind: str, data: DataFrame, classes: int, method: str = "grid", grid: dict[str, list] | None = None,
    weight: str | None = None, fixed: dict | None = None, folds: int = FOLDS, draws: int = RANDOM_DRAWS,
    key: str | None = None, sampler: Callable[[DataFrame], DataFrame] | None = None,
) -> SearchResult:
    """Cross-validated scores (weighted F1, or R2 for numbers) of a grid or of random points of it.

    ``data`` has ``_label``, an integer ``fold`` from hashed keys and ``features_i`` of each
    fold i (see ``fold_features``), or one ``features`` for all.  Every point's model is
    built by ``fit_model``, as the final fit's is; forests and trees of all sizes and
    depths come from the largest (``staged``).  Boosted ensembles over rounds, depth and
    step are grown side by side (``boosting``) on 32 bins a feature.  ``sampler`` changes
    the rows that a fold trains on, never those it is scored on; ensembles are then fitted
    one by one.
    """
    grid = GRIDS[name] if grid is None else grid
    points = grid_points(grid) if method == "grid" else random_points(grid, draws)
    fixed = dict(fixed or {})
    tasks = max(1, math.ceil(data.count() / ROWS_PER_TASK))
    boosted = sampler is None and name in PRESETS and set(grid) <= BOOST_STAGED and set(fixed) <= BOOST_STAGED
    if boosted:
        scores = _boosted_scores(name, kind, data, classes, points, fixed, folds, weight)
    else:
        data = (data.coalesce(tasks) if data.rdd.getNumPartitions() > tasks else data).persist()
        try:
            scores = _fitted_scores(name, kind, data, classes, points, fixed, folds, weight, key, sampler)
        finally:
            data.unpersist()
    means = [float(np.mean(s)) for s in scores]
    best = max(range(len(points)), key=lambda i: (means[i], -i))
    return SearchResult(points[best], means[best], list(zip(points, scores, strict=True)))


class Calibration:
    """Maps class probabilities through curves fitted on scores of rows that the model had not seen.

    Two classes have one curve, for the second's probability.  More have one curve each,
    one class against the others, and the results are divided by their sum.
    """

    def __init__(self, models: list, method: str):
        self.models, self.method = models, method

    def _curve(self, df: DataFrame, k: int, slot: int) -> DataFrame:
        """``df`` with ``_v{k}``, the curve's value at the slot's probability."""
        own = df.withColumn("_cal", array_to_vector(F.array(F.col("_raw")[slot])))
        scored = self.models[k].transform(own)
        p = F.col("_p1") if self.method == "isotonic" else vector_to_array("_p1")[1]
        value = F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0)).alias(f"_v{k}")
        return scored.select(*[col(c) for c in df.columns], value)

    def transform(self, df: DataFrame) -> DataFrame:
        kept = [c for c in df.columns if c not in ("probability", "prediction", "rawPrediction")]
        out = df.select(*[col(c) for c in kept], vector_to_array("probability").alias("_raw"))
        if len(self.models) == 1:
            out = self._curve(out, 0, 1)
            p = F.array(1 - F.col("_v0"), F.col("_v0"))
            guess = F.when(F.col("_v0") >= 0.5, 1.0).otherwise(0.0)
            return out.select(*[col(c) for c in kept], array_to_vector(p).alias("probability"), guess.alias("prediction"))
        for k in range(len(self.models)):
            out = self._curve(out, k, k)
        values = F.array(*[F.col(f"_v{k}") for k in range(len(self.models))])
        total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
        # Where every curve says no, the model's own probabilities stay.
        out = out.withColumn("_p", F.when(total > 0, F.transform(values, lambda x: x / total)).otherwise(F.col("_raw")))
        guess = (F.array_position("_p", F.array_max("_p")) - 1).cast("double")
        return out.select(*[col(c) for c in kept], array_to_vector("_p").alias("probability"), guess.alias("prediction"))


def calibrate(held_out: DataFrame, method: str = "isotonic", classes: int = 2) -> Calibration:
    """Fit calibration curves on scored rows that were not trained on (``_label``, ``probability``).

    Isotonic curves pool adjacent violators within ranges of the score first and then
    across them, so no task sorts all rows.
    """
    if method not in ("isotonic", "sigmoid"):
        raise ValueError("method must be isotonic or sigmoid")

    def curve(slot: int):
        goal = F.col("_label") if classes == 2 else F.when(F.col("_label") == float(slot), 1.0).otherwise(0.0)
        rows = held_out.select(goal.alias("_label"), array_to_vector(F.array(vector_to_array("probability")[slot])).alias("_cal"))
        if method == "isotonic":
            return IsotonicRegression(featuresCol="_cal", labelCol="_label", predictionCol="_p1").fit(rows)
        return LogisticRegression(
            featuresCol="_cal", labelCol="_label", probabilityCol="_p1", predictionCol="_pc", rawPredictionCol="_rc"
        ).fit(rows)

    slots = [1] if classes == 2 else list(range(classes))
    return Calibration(run_together(held_out.sparkSession, [lambda s=s: curve(s) for s in slots]), method)
