"""Estimators by name, label indexing, and the models Spark has no class for.

Every fitted model offers ``transform(df)`` and adds ``prediction`` (an index for
classes) and, for classification, ``probability``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    OneVsRest,
    OneVsRestModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import PolynomialExpansion, SQLTransformer, StringIndexerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_unit
from ..functions.parallel import run_together
from ..functions.roles import as_text, col
from ..session import cut_lineage, spread
from .boosting import BINS, bin_edges
from .forests import KNOWN, fit_cells, table_cells
from .kernel import LANDMARKS, LandmarkMap, LinearScore, fit_epsilon

#: Deep trees: rows remember their node, else every pass ships all trees to all tasks and walks them from the root.
DEEP = {"cacheNodeIds": True}
# Model defaults.
SEED = 42
FOREST_TREES = 100
FOREST_DEPTH = 30
TREE_DEPTH = 30
BOOST = {"maxIter": 100, "stepSize": 0.1, "maxDepth": 3}
PRESETS = {
    "gradient_boosting": BOOST,
    "xgboost": {"maxIter": 100, "stepSize": 0.3, "maxDepth": 6},
    "lightgbm": {"maxIter": 100, "stepSize": 0.1, "maxDepth": 5},
    "catboost": {"maxIter": 100, "stepSize": 0.1, "maxDepth": 6},
}
MAX_ITER = 1000
#: Tolerance at which the iterative solver agrees with the normal equations.
EXACT = 1e-12
NEIGHBOURS = 5
BAGS = 10
RFF_SIZE = 128
ADABOOST_ROUNDS = 50

CLASSIFIERS = (
    "logistic", "random_forest", "decision_tree", "gradient_boosting", "xgboost", "lightgbm", "catboost",
    "svm", "knn", "naive_bayes", "balanced_bagging", "adaboost",
)
REGRESSORS = (
    "linear", "ridge", "lasso", "random_forest", "decision_tree", "gradient_boosting", "xgboost", "lightgbm",
    "catboost", "svm", "knn", "polynomial",
)
MAX_CLASSES = 1000
#: The largest matrix that the normal equations are solved for.
MAX_NORMAL_SLOTS = 4096
#: Fits run side by side for the classes of one-vs-rest.
SIDE_BY_SIDE = 8
#: Tables of at least so many rows are fitted on their different rows, with weights, where that leaves
#: at most a quarter of them; a split of these has at least so many.
MERGE_ROWS = 1_000_000
MERGE_SHARE = 0.25
MERGED_SPLIT = 25_000
#: Settings of boosting under which a row with weight n grows the same trees as n rows.
MERGEABLE = {"maxIter", "stepSize", "maxDepth", "seed"}


def class_list(df: DataFrame, target: str) -> list[str]:
    """Sorted class texts; numbers sort as numbers."""
    value = col(target)
    rows = df.where(value.isNotNull()).select(value.alias("v"), as_text(df, target).alias("t")).distinct()
    found = rows.limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"{target!r} has more than {MAX_CLASSES} classes")
    return [r["t"] for r in sorted(found, key=lambda r: r["v"])]


def label_indexer(df: DataFrame, target: str, classes: list[str]) -> PipelineModel:
    """Pipeline that adds ``_label``, the class position, as double."""
    text = SQLTransformer(statement=f"select *, cast(`{target}` as string) as _label_text from __THIS__")
    index = StringIndexerModel.from_labels(classes, "_label_text", "_label", handleInvalid="skip")
    clean = SQLTransformer(statement="select * except (_label_text) from __THIS__")
    return PipelineModel([text, index, clean])


def index_labels(df: DataFrame, target: str, classes: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """``df`` with ``_label`` and the sorted classes; rows without a class are left out."""
    classes = class_list(df, target) if classes is None else classes
    rows = df.where(col(target).isNotNull())
    return label_indexer(rows, target, classes).transform(rows), classes


@dataclass
class FittedModel:
    """A model by name.  ``stages`` transform in turn; ``extra`` holds what they need."""

    name: str
    kind: str
    stages: list[Any]
    classes: list[str] = field(default_factory=list)
    extra: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        for stage in self.stages:
            df = stage.transform(df)
        return df

    @property
    def core(self):
        """The fitted estimator itself (last ``pyspark.ml`` stage)."""
        for stage in reversed(self.stages):
            if isinstance(stage, Model) and not isinstance(stage, PipelineModel):
                return stage
        return self.stages[-1]

    def importances(self) -> np.ndarray:
        """Importance per vector slot; a composite model's is the weighted mean of its members'."""
        return _importances(self.core)


def _importances(model) -> np.ndarray:
    if isinstance(model, FittedModel):
        return model.importances()
    if isinstance(model, MeanOfModels):
        members, weights = model.members, model.weights
    elif isinstance(model, SammeModel):
        members, weights = model.trees, model.alphas
    elif isinstance(model, OneVsRestModel):
        members, weights = model.models, [1.0] * len(model.models)
    else:
        return model.featureImportances.toArray()
    return np.average([_importances(m) for m in members], axis=0, weights=weights if sum(weights) else None)


class ProbabilityFromRaw:
    """Softmax (or logistic for two classes) of ``rawPrediction``, for models without probabilities."""

    def __init__(self, classes: int):
        self.classes = classes

    def transform(self, df: DataFrame) -> DataFrame:
        raw = vector_to_array("rawPrediction")
        df = df.withColumn("_raw", raw).withColumn("_top", F.array_max("_raw"))
        e = F.transform("_raw", lambda x: F.exp(x - F.col("_top")))
        df = df.withColumn("_e", e).withColumn("_sum", F.aggregate("_e", F.lit(0.0), lambda a, x: a + x))
        p = F.transform("_e", lambda x: x / F.col("_sum"))
        return df.withColumn("probability", array_to_vector(p)).drop("_raw", "_top", "_e", "_sum")


def _times(name: str, factor: float) -> Column:
    """Array column with every entry multiplied."""
    return F.transform(name, lambda x: x * F.lit(factor))


class MeanOfModels:
    """Average of member probabilities (classes) or predictions (numbers), optionally weighted."""

    def __init__(self, members: list, kind: str, weights: list[float] | None = None):
        self.members, self.kind = members, kind
        self.weights = weights or [1.0] * len(members)

    def transform(self, df: DataFrame) -> DataFrame:
        names = df.columns
        total = float(sum(self.weights))
        for i, m in enumerate(self.members):
            scored = m.transform(df)
            value = vector_to_array("probability") if self.kind == "classification" else F.col("prediction")
            df = scored.select(*[col(c) for c in df.columns], value.alias(f"_m{i}"))
        if self.kind == "classification":
            parts = [_times(f"_m{i}", w / total) for i, w in enumerate(self.weights)]
            mean = parts[0]
            for p in parts[1:]:
                mean = F.zip_with(mean, p, lambda a, b: a + b)
            df = df.withColumn("_mean", mean)
            best = F.array_position("_mean", F.array_max("_mean")) - 1
            out = df.withColumns({"probability": array_to_vector("_mean"), "prediction": best.cast("double")})
            return out.select(*[col(c) for c in names], "probability", "prediction")
        mean = sum((F.col(f"_m{i}") * F.lit(w / total) for i, w in enumerate(self.weights)), F.lit(0.0))
        return df.withColumn("prediction", mean).select(*[col(c) for c in names], "prediction")


class RandomFourier:
    """Random cosine features of a vector column: an explicit map whose dot product nears an RBF kernel."""

    def __init__(self, slots: int, gamma: float, size: int = RFF_SIZE, out: str = "_rff", seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.weights = rng.normal(0.0, math.sqrt(2.0 * gamma), (size, slots))
        self.shift = rng.uniform(0.0, 2.0 * math.pi, size)
        self.out = out

    def transform(self, df: DataFrame) -> DataFrame:
        weights, shift = self.weights, self.shift
        factor = math.sqrt(2.0 / len(shift))

        @F.pandas_udf("array<double>")
        def cosines(batch: pd.Series) -> pd.Series:
            if not len(batch):
                return pd.Series([], dtype=object)
            x = np.stack(batch.to_numpy())
            return pd.Series(list(factor * np.cos(x @ weights.T + shift)))

        return df.withColumn(self.out, array_to_vector(cosines(vector_to_array("features"))))


class Binned:
    """Vector slots as numbers of bins, between ascending edges that belong to the bin on their left."""

    def __init__(self, edges: list[np.ndarray], out: str = "_binned"):
        self.edges, self.out = edges, out

    @classmethod
    def fit(cls, train: DataFrame) -> Binned:
        """Edges at quantiles of all rows; a slot of at most ``BINS`` different values is cut between all of them."""
        values = train.select(F.posexplode(vector_to_array("features")).alias("s", "v"))
        about = values.groupBy("s").agg(F.approx_count_distinct("v").alias("n")).collect()
        few = [r["s"] for r in about if r["n"] <= 2 * BINS]
        found: dict[int, list[float]] = {}
        # At most a few times BINS values for each of these slots.
        for r in values.where(F.col("s").isin(few)).distinct().collect() if few else []:
            found.setdefault(r["s"], []).append(r["v"])
        edges = [np.zeros(0)] * len(about)
        many = [r["s"] for r in about if len(found.get(r["s"], ())) > BINS or r["s"] not in found]
        for s, cuts in enumerate(bin_edges(train.withColumn("fold", F.lit(-1)), 1, many)[0] if many else []):
            edges[s] = cuts
        for s, seen in found.items():
            if s not in many:
                edges[s] = np.unique(seen)[:-1]
        return cls(edges)

    def transform(self, df: DataFrame) -> DataFrame:
        edges = self.edges

        @F.pandas_udf("array<double>")
        def bins(batch: pd.Series) -> pd.Series:
            if not len(batch):
                return pd.Series([], dtype=object)
            x = np.stack(batch.to_numpy())
            found = [np.searchsorted(e, x[:, s], "left").astype(float) for s, e in enumerate(edges)]
            return pd.Series(list(np.stack(found, axis=1)))

        return df.withColumn(self.out, array_to_vector(bins(vector_to_array("features"))))


def _merged(train: DataFrame, vector: str, weight: str | None, rows: int) -> DataFrame | None:
    """Rows of equal ``vector`` and label as one with their weight (``_merged``); none if they are few or differ.

    Sums over such rows are those over all rows, so a fit that only needs weighted sums is the same.
    """
    if rows < MERGE_ROWS:
        return None
    values = train.select(
        vector_to_array(vector).alias("_x"), "_label", (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"))
    about = values.agg(F.approx_count_distinct(F.xxhash64("_x", "_label")).alias("n")).first()["n"]
    if about > MERGE_SHARE * rows:
        return None
    cells = cut_lineage(values.groupBy("_x", "_label").agg(F.sum("_w").alias("_merged")))
    return spread(cells.select(array_to_vector("_x").alias(vector), "_label", "_merged"), MERGED_SPLIT)


def _for_boosting(train: DataFrame, settings: dict, base: dict, weighted: dict) -> tuple[DataFrame, dict, list]:
    """What boosting is fitted on: merged rows of equal bins if the table is large, with the columns' names and the stage before."""
    rows = train.count() if set(settings) <= MERGEABLE else 0
    if rows >= MERGE_ROWS:
        binned = Binned.fit(train)
        merged = _merged(binned.transform(train), binned.out, weighted.get("weightCol"), rows)
        if merged is not None:
            return merged, {**base, "featuresCol": binned.out, "weightCol": "_merged"}, [binned]
    return train, weighted, []


def _forest_of_cells(train: DataFrame, settings: dict, weighted: dict, classes: int):
    """A forest on the cells of equal bins of a large table; none if it is small or has too many cells."""
    if not set(settings) <= KNOWN or settings["featureSubsetStrategy"] not in ("sqrt", "all") or train.count() < MERGE_ROWS:
        return None
    edges = Binned.fit(train).edges
    cells = table_cells(train, edges, weighted.get("weightCol"), classes)
    return None if cells is None else fit_cells(cells, edges, settings, weighted, train)


class MarginProbability:
    """Class probabilities from margins by a fitted logistic curve (two classes)."""

    def __init__(self, slope: float, intercept: float):
        self.slope, self.intercept = slope, intercept

    def transform(self, df: DataFrame) -> DataFrame:
        margin = vector_to_array("rawPrediction")[1]
        p = 1 / (1 + F.exp(-(margin * F.lit(self.slope) + F.lit(self.intercept))))
        return df.withColumn("probability", array_to_vector(F.array(1 - p, p)))


class Neighbours:
    """k nearest training rows; joins by hashed row identity, so any table can be scored."""

    def __init__(self, train: DataFrame, kind: str, classes: int, k: int = NEIGHBOURS):
        self.train, self.kind, self.classes, self.k = train, kind, classes, k

    def transform(self, df: DataFrame) -> DataFrame:
        from .neighbors import nearest

        # The id is used on two sides of a join, so the rows are fixed by a checkpoint first.
        asked = cut_lineage(df.withColumn("_qid", F.monotonically_increasing_id()))
        queries = asked.select("_qid", vector_to_array("features").alias("_x"))
        near = nearest(queries, self.train, "_qid", "_qid", "_x", self.k, payload=["_label"])
        if self.kind == "regression":
            found = near.groupBy("_qid").agg(F.avg("_label").alias("prediction"))
            return asked.join(found, "_qid").drop("_qid")
        shares = [
            (F.count_if(F.col("_label") == float(i)) / F.count(F.lit(1))).alias(f"_s{i}") for i in range(self.classes)
        ]
        found = near.groupBy("_qid").agg(*shares)
        p = F.array(*[F.col(f"_s{i}") for i in range(self.classes)])
        best = (F.array_position(p, F.array_max(p)) - 1).cast("double")
        scored = asked.join(found, "_qid").withColumns({"probability": array_to_vector(p), "prediction": best})
        return scored.drop("_qid", *[f"_s{i}" for i in range(self.classes)])


class SammeModel:
    """Weighted vote of boosted trees; probabilities are vote shares."""

    def __init__(self, trees: list, alphas: list[float], classes: int):
        self.trees, self.alphas, self.classes = trees, alphas, classes

    def transform(self, df: DataFrame) -> DataFrame:
        names = df.columns
        for i, tree in enumerate(self.trees):
            scored = tree.transform(df)
            df = scored.select(*[col(c) for c in df.columns], F.col("prediction").alias(f"_t{i}"))
        total = sum(self.alphas) or 1.0
        votes = [
            sum((F.when(F.col(f"_t{i}") == float(c), F.lit(a / total)).otherwise(0.0)
                 for i, a in enumerate(self.alphas)), F.lit(0.0))
            for c in range(self.classes)
        ]
        p = F.array(*votes)
        out = df.withColumn("_p", p)
        best = (F.array_position("_p", F.array_max("_p")) - 1).cast("double")
        out = out.withColumns({"probability": array_to_vector("_p"), "prediction": best})
        return out.select(*[col(c) for c in names], "probability", "prediction")


def _argmax_model(stages: list, classes: int) -> list:
    return [*stages, ProbabilityFromRaw(classes)]


def fit_model(
    name: str, kind: str, train: DataFrame, classes: int = 0, weight: str | None = None,
    params: dict | None = None, key: str | None = None, seed: int = SEED,
) -> FittedModel:
    """Fit one model on ``features`` and ``_label``.

    ``weight`` names a row-weight column; ``params`` override the estimator's defaults;
    ``key`` is the row key needed by hashed resampling (balanced bagging).
    """
    params = dict(params or {})
    base = {"featuresCol": "features", "labelCol": "_label"}
    weighted = {**base, **({"weightCol": weight} if weight else {})}
    if kind == "classification":
        return _fit_classifier(name, train, classes, base, weighted, params, key, seed)
    if kind == "regression":
        return _fit_regressor(name, train, base, weighted, params, seed)
    raise ValueError(f"unknown problem type {kind!r}")


def _fit_classifier(name, train, classes, base, weighted, params, key, seed) -> FittedModel:
    def done(stages, **extra):
        return FittedModel(name, "classification", stages, extra=extra)

    if name == "logistic":
        n = train.count()
        strength = params.pop("C", 1.0)
        merged = _merged(train, "features", weighted.get("weightCol"), n)
        if merged is not None:
            train, weighted = merged, {**base, "weightCol": "_merged"}
        model = LogisticRegression(
            **weighted, maxIter=params.pop("maxIter", MAX_ITER), regParam=1.0 / (strength * n),
            elasticNetParam=0.0, standardization=False, **params,
        ).fit(train)
        return done([model])
    if name == "random_forest":
        defaults = {"numTrees": FOREST_TREES, "maxDepth": FOREST_DEPTH, "featureSubsetStrategy": "sqrt", "seed": seed, **DEEP}
        settings = {**defaults, **params}
        return done([_forest_of_cells(train, settings, weighted, classes) or RandomForestClassifier(**weighted, **settings).fit(train)])
    if name == "decision_tree":
        return done([DecisionTreeClassifier(**weighted, **{"maxDepth": TREE_DEPTH, "seed": seed, **params}).fit(train)])
    if name in PRESETS:
        settings = {**PRESETS[name], "seed": seed, **params}
        train, weighted, before = _for_boosting(train, settings, base, weighted)
        if classes <= 2:
            return done([*before, GBTClassifier(**weighted, **settings).fit(train)])
        over = OneVsRest(classifier=GBTClassifier(**settings), rawPredictionCol="rawPrediction", parallelism=SIDE_BY_SIDE, **weighted)
        return done(_argmax_model([*before, over.fit(train)], classes))
    if name == "svm":
        return _fit_svm(train, classes, weighted, params, seed, done)
    if name == "knn":
        rows = cut_lineage(train.select(
            F.monotonically_increasing_id().alias("_qid"), vector_to_array("features").alias("_x"), "_label"))
        return done([Neighbours(rows, "classification", classes, params.get("k", NEIGHBOURS))])
    if name == "naive_bayes":
        return done([NaiveBayes(**weighted, **{"modelType": "gaussian", **params}).fit(train)])
    if name == "balanced_bagging":
        if key is None:
            raise ValueError("balanced bagging needs a row key")
        return done([_fit_bags(train, base, params, key, seed)])
    if name == "adaboost":
        return done([_fit_samme(train, classes, base, params, seed)])
    raise ValueError(f"unknown classifier {name!r}")


def _gamma(train: DataFrame) -> float:
    """1 / (slots * variance of all feature values), from one aggregate."""
    x = F.explode(vector_to_array("features"))
    spread = train.select(x.alias("v")).agg(F.var_pop("v")).first()[0]
    return 1.0 / (_slots(train) * spread) if spread else 1.0


def _slots(train: DataFrame, vector: str = "features") -> int:
    return len(train.select(vector_to_array(vector).alias("a")).first()["a"])


def _solver(train: DataFrame, vector: str = "features") -> str:
    """Normal equations in one pass where the matrix fits the driver, else the iterative solver."""
    return "normal" if _slots(train, vector) <= MAX_NORMAL_SLOTS else "l-bfgs"


def _fit_svm(train, classes, weighted, params, seed, done) -> FittedModel:
    mapped_by = RandomFourier(_slots(train), params.pop("gamma", None) or _gamma(train), params.pop("size", RFF_SIZE), seed=seed)
    mapped = mapped_by.transform(train).persist()
    try:
        settings = {"maxIter": 100, "regParam": 1.0 / (params.pop("C", 1.0) * max(train.count(), 1)), **params}
        svc = LinearSVC(**{**weighted, "featuresCol": "_rff"}, **settings)
        if classes > 2:
            over = OneVsRest(classifier=svc, rawPredictionCol="rawPrediction", parallelism=SIDE_BY_SIDE, **{**weighted, "featuresCol": "_rff"})
            return done(_argmax_model([mapped_by, over.fit(mapped)], classes))
        model = svc.fit(mapped)
        margins = model.transform(mapped).select("_label", F.array(vector_to_array("rawPrediction")[1]).alias("m"))
        curve = LogisticRegression(featuresCol="v", labelCol="_label", maxIter=100).fit(
            margins.select("_label", array_to_vector("m").alias("v")))
        return done([mapped_by, model, MarginProbability(float(curve.coefficients[0]), float(curve.intercept))])
    finally:
        mapped.unpersist()


def _poisson_limits(rate: float) -> list[float]:
    """Cumulative Poisson probabilities of 0, 1, ... draws, until what is left is below double precision."""
    term, total, limits, k = math.exp(-rate), 0.0, [], 0
    while k <= rate or term > 1e-17:
        total += term
        limits.append(total)
        k += 1
        term *= rate / k
    return limits


def _fit_bags(train, base, params, key, seed) -> MeanOfModels:
    """Trees on bootstrap draws in which every class weighs as much as the smallest.

    Each row's number of draws is a Poisson count of its hashed key, with the class's
    rate, used as row weight: a narrow projection instead of a resampled copy per bag.
    """
    bags = params.pop("bags", BAGS)
    counts = {r["_label"]: r["count"] for r in train.groupBy("_label").count().collect()}
    least = min(counts.values())
    limits = F.array(F.lit(1.0))
    for label, n in counts.items():
        limits = F.when(F.col("_label") == label, F.array(*map(F.lit, _poisson_limits(least / n)))).otherwise(limits)

    def fit(i: int):
        # A uniform hash at or above k of the limits stands for k draws.
        drawn = train.withColumn("_u", hash_unit(key, f"{seed}:bag{i}")).withColumn("_limits", limits)
        drawn = drawn.withColumn("_draws", F.size(F.filter("_limits", lambda x: x <= F.col("_u"))).cast("double"))
        settings = {"maxDepth": TREE_DEPTH, "seed": seed + i, **params}
        kept = drawn.where("_draws > 0").select("features", "_label", "_draws")
        return DecisionTreeClassifier(**base, weightCol="_draws", **settings).fit(kept)

    members = run_together(train.sparkSession, [lambda i=i: fit(i) for i in range(bags)])
    return MeanOfModels(members, "classification")


def _fit_samme(train, classes, base, params, seed) -> SammeModel:
    rounds = params.pop("rounds", ADABOOST_ROUNDS)
    settings = {"maxDepth": 1, "seed": seed, **params}
    n = train.count()
    data = cut_lineage(train.select("features", "_label", F.lit(1.0 / n).alias("_w")))
    trees, alphas = [], []
    for i in range(rounds):
        tree = DecisionTreeClassifier(**base, weightCol="_w", **settings).fit(data)
        scored = tree.transform(data).select("features", "_label", "_w", (F.col("prediction") != F.col("_label")).alias("_bad"))
        row = scored.agg((F.sum(F.when(F.col("_bad"), F.col("_w")).otherwise(0.0)) / F.sum("_w")).alias("e")).first()
        error = row["e"]
        if error >= 1.0 - 1.0 / classes:
            break
        alpha = math.log((1.0 - max(error, 1e-10)) / max(error, 1e-10)) + math.log(max(classes - 1, 1))
        trees.append(tree)
        alphas.append(alpha)
        if error <= 1e-10:
            break
        raised = scored.withColumn("_w", F.col("_w") * F.when(F.col("_bad"), F.lit(math.exp(alpha))).otherwise(1.0))
        total = raised.agg(F.sum("_w")).first()[0]
        data = cut_lineage(raised.select("features", "_label", (F.col("_w") / total).alias("_w")))
    if not trees:
        trees, alphas = [tree], [1.0]
    return SammeModel(trees, alphas, classes)


def _fit_regressor(name, train, base, weighted, params, seed) -> FittedModel:
    def done(stages, **extra):
        return FittedModel(name, "regression", stages, extra=extra)

    if name == "linear":
        settings = {"regParam": 0.0, "solver": _solver(train), "maxIter": MAX_ITER, "tol": EXACT, **params}
        return done([LinearRegression(**weighted, **settings).fit(train)])
    if name == "ridge":
        solver = _solver(train)
        # Spark divides an L2 penalty by the label's deviation (population form in the normal
        # equations, sample form in the iterative solver); multiplying undoes it.
        spread = F.stddev_pop("_label") if solver == "normal" else F.stddev_samp("_label")
        row = train.agg(F.count(F.lit(1)).alias("n"), spread.alias("s")).first()
        penalty = params.pop("alpha", 1.0) / row["n"] * (row["s"] or 1.0)
        model = LinearRegression(
            **weighted, regParam=penalty, elasticNetParam=0.0, standardization=False, solver=solver,
            **{"maxIter": MAX_ITER, "tol": EXACT, **params})
        return done([model.fit(train)])
    if name == "lasso":
        settings = {"regParam": params.pop("alpha", 1.0), "elasticNetParam": 1.0, "standardization": False,
                    "maxIter": MAX_ITER, "tol": 1e-9, **params}
        return done([LinearRegression(**weighted, **settings).fit(train)])
    if name == "random_forest":
        defaults = {"numTrees": FOREST_TREES, "maxDepth": FOREST_DEPTH, "featureSubsetStrategy": "all", "seed": seed, **DEEP}
        return done([RandomForestRegressor(**weighted, **{**defaults, **params}).fit(train)])
    if name == "decision_tree":
        return done([DecisionTreeRegressor(**weighted, **{"maxDepth": TREE_DEPTH, "seed": seed, **params}).fit(train)])
    if name in PRESETS:
        return done([GBTRegressor(**weighted, **{**PRESETS[name], "seed": seed, **params}).fit(train)])
    if name == "svm":
        mapped_by = LandmarkMap.fit(train, params.pop("gamma", None) or _gamma(train), params.pop("size", LANDMARKS), seed)
        fitted = fit_epsilon(
            mapped_by.transform(train), mapped_by.out, params.pop("C", 1.0), params.pop("epsilon", 0.1),
            weighted.get("weightCol"))
        return done([mapped_by, LinearScore(*fitted, mapped_by.out)])
    if name == "knn":
        rows = cut_lineage(train.select(
            F.monotonically_increasing_id().alias("_qid"), vector_to_array("features").alias("_x"), "_label"))
        return done([Neighbours(rows, "regression", 0, params.get("k", NEIGHBOURS))])
    if name == "polynomial":
        expand = PolynomialExpansion(degree=params.pop("degree", 2), inputCol="features", outputCol="_poly")
        wide = expand.transform(train)
        model = LinearRegression(
            **{**weighted, "featuresCol": "_poly"}, regParam=0.0, solver=_solver(wide, "_poly"),
            **{"maxIter": MAX_ITER, "tol": EXACT, **params})
        return done([expand, model.fit(wide)])
    raise ValueError(f"unknown regressor {name!r}")


def positive_probability(column: str = "probability") -> Column:
    """Probability of the second class."""
    return vector_to_array(column)[1]
