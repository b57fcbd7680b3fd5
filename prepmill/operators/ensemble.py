"""Voting and stacking."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parallel import run_together
from ..functions.roles import col
from ..session import cut_lineage
from .boosting import vector_of
from .compare import compare_models
from .models import FittedModel, MeanOfModels, fit_model

# Vote weights and the meta learner's forest.
WEIGHTS = (0.1, 2.0)
META_TREES = 50
META = {
    "logistic": ("logistic", "linear", {}),
    "linear": ("logistic", "linear", {}),
    "random_forest": ("random_forest", "random_forest", {"numTrees": META_TREES}),
    "xgboost": ("xgboost", "xgboost", {}),
}


def voting(members: list[FittedModel], weights: list[float] | None = None) -> FittedModel:
    """Soft vote of classifiers or mean of regressors, optionally weighted.

    Members must share one label index, which models of one ``train_models`` call do.
    """
    low, high = WEIGHTS
    if weights is not None:
        if len(weights) != len(members):
            raise ValueError("one weight per member is needed")
        if any(not low <= w <= high for w in weights):
            raise ValueError(f"weights must lie in [{low}, {high}]")
    kind = members[0].kind
    name = "voting" if weights is None else "weighted_voting"
    return FittedModel(name, kind, [MeanOfModels(members, kind, weights)], members[0].classes)


def vote_of(scores: list[Column], weights: list[float] | None = None, threshold: float = 0.5) -> Column:
    """Class 0 or 1 by the (weighted) mean of the members' scores of class 1."""
    weights = weights or [1.0] * len(scores)
    total = sum((s * F.lit(float(w)) for s, w in zip(scores, weights, strict=True)), F.lit(0.0))
    return F.when(total / F.lit(float(sum(weights))) >= threshold, 1).otherwise(0)


def ensemble_table(
    df: DataFrame, members: dict[str, tuple[Column, Column]], label: str = "label",
    weights: list[float] | None = None, name: str = "voting",
) -> DataFrame:
    """Metrics of members and of their vote, one row each, with ``type`` individual or ensemble.

    ``members`` maps a name to its (prediction, score of class 1) columns.  Every row is
    unfolded to one per model map-side and folded again by the metrics' aggregate.
    """
    vote = vote_of([score for _, score in members.values()], weights)
    models = [*[(k, prediction) for k, (prediction, _) in members.items()], (name, vote)]
    rows = df.select(col(label).alias("label"), F.inline(F.array(*[
        F.struct(F.lit(k).alias("model"), p.cast("int").alias("prediction")) for k, p in models
    ])))
    compared = compare_models(rows, "classification").drop("roc_auc")
    return compared.withColumn("type", F.when(F.col("model") == name, "ensemble").otherwise("individual"))


def _meta_parts(kind: str, classes: int) -> list[Column]:
    """What a base model tells the meta learner."""
    if kind == "regression":
        return [F.col("prediction")]
    p = vector_to_array("probability")
    return [p[1]] if classes == 2 else [p[i] for i in range(classes)]


def _with_base_scores(df: DataFrame, bases: list, kind: str, classes: int) -> DataFrame:
    names = df.columns
    slots = []
    for i, base in enumerate(bases):
        scored = base.transform(df)
        made = {f"_b{i}_{j}": e for j, e in enumerate(_meta_parts(kind, classes))}
        df = scored.select(*[col(c) for c in df.columns], *[e.alias(n) for n, e in made.items()])
        slots += list(made)
    meta = array_to_vector(F.array(*[F.col(s) for s in slots]))
    return df.select(*[col(c) for c in names], meta.alias("_meta"))


class StackedModel:
    """Base models whose scores are the features of a meta model."""

    def __init__(self, bases: list, meta: FittedModel, kind: str, classes: int):
        self.bases, self.meta, self.kind, self.classes = bases, meta, kind, classes

    def transform(self, df: DataFrame) -> DataFrame:
        names = df.columns
        scored = _with_base_scores(df, self.bases, self.kind, self.classes)
        swapped = scored.withColumnsRenamed({"features": "_features", "_meta": "features"})
        done = self.meta.transform(swapped).drop("features").withColumnRenamed("_features", "features")
        added = ["prediction"] + (["probability"] if self.kind == "classification" else [])
        return done.select(*[col(c) for c in names], *added)


@contextmanager
def _kept_for_fits(rows: DataFrame, key: str | None) -> Iterator[DataFrame]:
    """Label, ``features`` (and key) of the rows, kept while several models are fitted on them.

    A task that reads a kept table reads its whole rows, so vectors of other folds must not be in it.
    """
    kept = rows.select(*([col(key)] if key else []), "_label", "features").persist()
    try:
        yield kept
    finally:
        kept.unpersist()


def out_of_fold_scores(train: DataFrame, names: list[str], kind: str, classes: int, folds: int,
                       params: dict[str, dict] | None = None, key: str | None = None) -> DataFrame:
    """Training rows with ``_meta``: base scores from models that did not see the row.

    ``train`` has ``_label``, an integer ``fold`` and, for each fold i, ``features_i`` prepared
    without it (``tuning.fold_features``); a ``features`` column alone serves all folds.
    Only what a fold's fits need is kept while they run, so keep narrow rows below ``train``, not its vectors.
    """

    def fold(i: int) -> DataFrame:
        own = vector_of(train, i)
        rows = train.withColumn("features", F.col(own))
        inner, held = rows.where(F.col("fold") != i), rows.where(F.col("fold") == i)
        with _kept_for_fits(inner, key) as kept:
            fitted = [fit_model(n, kind, kept, classes, None, (params or {}).get(n), key) for n in names]
        return _with_base_scores(held, fitted, kind, classes)

    parts = run_together(train.sparkSession, [lambda i=i: fold(i) for i in range(folds)])
    return reduce(DataFrame.unionByName, parts)


def stacking(
    train: DataFrame, names: list[str], kind: str, classes: int, meta: str = "logistic", folds: int = 5,
    params: dict[str, dict] | None = None, key: str | None = None,
) -> FittedModel:
    """Fit a meta learner on out-of-fold base scores, then the bases on all rows (their ``features``)."""
    if meta not in META:
        raise ValueError(f"unknown meta learner {meta!r}")
    # Fits of the meta learner pass over these rows many times; the plan below them holds every base model.
    scored = cut_lineage(out_of_fold_scores(train, names, kind, classes, folds, params, key).select("_label", "_meta"))
    meta_name = META[meta][0 if kind == "classification" else 1]
    learner = fit_model(
        meta_name, kind, scored.withColumnRenamed("_meta", "features"), classes, None, dict(META[meta][2]))
    with _kept_for_fits(train, key) as kept:
        bases = run_together(train.sparkSession, [
            lambda n=n: fit_model(n, kind, kept, classes, None, (params or {}).get(n), key) for n in names
        ])
    return FittedModel("stacking", kind, [StackedModel(bases, learner, kind, classes)])
