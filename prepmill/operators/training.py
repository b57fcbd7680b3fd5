"""Training and comparing several models on one prepared table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parallel import run_together
from ..functions.roles import col, columns_by_role
from ..session import cut_lineage
from .balance import class_weights, resample_prepared
from .compare import fold_scores
from .encoders import target_sums
from .metrics import classification_metrics, ranking_metrics, regression_metrics, roc_auc_weighted
from .models import FittedModel, class_list, fit_model, label_indexer
from .preprocess import Preprocessor, fit_preprocessor
from .split import with_folds
from .target import MIN_ROWS, problem_type
from .tuning import GRIDS, calibrate, fold_features, search

CV_FOLDS = 5


@dataclass
class Prepared:
    """Fitted preparation of a problem: features, label index and their sources."""

    kind: str
    target: str
    key: str
    features: list[str]
    preprocessor: Preprocessor
    classes: list[str] = field(default_factory=list)
    weights: dict[str, float] = field(default_factory=dict)

    def apply(self, df: DataFrame, labelled: bool = True) -> DataFrame:
        """``df`` with ``features`` and, when labelled, ``_label`` (and ``_weight``)."""
        return self.preprocessor.model.transform(self.labelled(df) if labelled else df)

    def labelled(self, df: DataFrame) -> DataFrame:
        """Rows that have the target, with ``_label`` (and ``_weight``)."""
        if self.kind == "classification":
            df = label_indexer(df, self.target, self.classes).transform(df.where(col(self.target).isNotNull()))
        else:
            df = df.where(col(self.target).isNotNull()).withColumn("_label", col(self.target).cast("double"))
        if self.weights:
            by_class = F.array(*[F.lit(self.weights[c]) for c in self.classes])
            df = df.withColumn("_weight", by_class[F.col("_label").cast("int")])
        return df

    def slim(self, df: DataFrame) -> DataFrame:
        """Only what a fit needs: key, label, features (and weight)."""
        extra = ["_weight"] if self.weights else []
        return self.apply(df).select(col(self.key), "_label", "features", *extra)


@dataclass
class ModelResult:
    """One trained model with its test predictions, metrics and fold scores."""

    name: str
    kind: str
    model: FittedModel
    predictions: DataFrame
    metrics: dict[str, float]
    cv_scores: list[float] = field(default_factory=list)
    best_params: dict = field(default_factory=dict)
    tuning_score: float = 0.0
    prepared: Prepared | None = None


def prepare(
    train: DataFrame, features: list[str], target: str, key: str, kind: str | None = None,
    impute: str = "mean", scaling: str = "none", encoding: str = "onehot", use_class_weights: bool = False,
    classes: list[str] | None = None, sums: DataFrame | None = None, without: int | None = None,
    use_positive_weight: bool = False, weights: dict[str, float] | None = None,
) -> Prepared:
    """Fit preprocessing and label indexing on the training part (``classes`` when already known).

    ``sums`` are target sums by category and fold, of which fold ``without`` is left out.
    """
    kind = kind or problem_type(train, target)
    if classes is None:
        classes = class_list(train, target) if kind == "classification" else []
    if weights is None:
        weights = class_weights(train, target) if use_class_weights and classes else {}
        if use_positive_weight:
            if len(classes) != 2:
                raise ValueError("a weight of the positive class needs two classes")
            counts = class_weights(train, target)  # n / (2 * n_c), so their ratio is that of the other class
            weights = {classes[0]: 1.0, classes[1]: counts[classes[1]] / counts[classes[0]]}
    encode_target = target
    source = train
    if encoding == "target" and classes:
        source = label_indexer(train, target, classes).transform(train)
        encode_target = "_label"
    fitted = fit_preprocessor(
        source, features, impute, scaling, encoding, encode_target, classes=len(classes), sums=sums, without=without)
    return Prepared(kind, target, key, features, fitted, classes, weights)


def score_predictions(predictions: DataFrame, prepared: Prepared) -> dict[str, float]:
    """Test metrics of one predictions table."""
    if prepared.kind == "regression":
        return regression_metrics(predictions, "_label", "prediction").first().asDict()
    found = classification_metrics(predictions, "_label", "prediction").first().asDict()
    found |= {"roc_auc": 0.0, "pr_auc": 0.0}
    if "probability" in predictions.columns:
        p = predictions.withColumn("_p", vector_to_array("probability"))
        if len(prepared.classes) == 2:
            found |= ranking_metrics(p.withColumn("_s", F.col("_p")[1]), "_s", "_label", 1.0).first().asDict()
        else:
            names = {f"{float(i)}": f"_s{i}" for i in range(len(prepared.classes))}
            p = p.withColumns({s: F.col("_p")[i] for i, s in enumerate(names.values())})
            found["roc_auc"] = roc_auc_weighted(p, "_label", names).first()["roc_auc"]
    return found


def prepare_folds(prepared: Prepared, train: DataFrame, folds: int) -> list[Prepared]:
    """Preprocessing fitted anew on each fold's training part, to be shared by all models.

    Target means of all folds come from one aggregate by category and fold: each fold's
    are those of all rows without its own part.
    """
    config = prepared.preprocessor.config
    texts = columns_by_role(train.select(*[col(c) for c in prepared.features]))["categorical"]
    sums = None
    if config["encoding"] == "target" and texts:
        sums = target_sums(prepared.labelled(train), texts, "_label", len(prepared.classes), "fold")

    def fold(i: int) -> Prepared:
        return prepare(
            train.where(F.col("fold") != i), prepared.features, prepared.target, prepared.key, prepared.kind,
            config["impute"], config["scaling"], config["encoding"], classes=prepared.classes, sums=sums, without=i,
            weights=prepared.weights)

    return run_together(train.sparkSession, [lambda i=i: fold(i) for i in range(folds)])


def out_of_fold(
    name: str, prepared: list[Prepared], train: DataFrame, params: dict | None = None,
    sampler: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``model, fold, key, label, prediction`` (and ``probability``) for every training row, from models that did not see it.

    ``train`` needs a ``fold`` column; ``prepared`` comes from ``prepare_folds``.
    ``sampler`` changes the rows that a fold's model is fitted on.
    """
    def fold(i: int) -> DataFrame:
        here = prepared[i]
        inner = here.slim(train.where(F.col("fold") != i))
        inner = (sampler(inner) if sampler else inner).persist()
        model = fit_model(
            name, here.kind, inner, len(here.classes), "_weight" if here.weights else None, params, here.key)
        inner.unpersist()
        scored = model.transform(here.slim(train.where(F.col("fold") == i)))
        return scored.select(
            F.lit(name).alias("model"), F.lit(i).alias("fold"), col(here.key), F.col("_label").alias("label"),
            "prediction", *[c for c in ("probability",) if c in scored.columns])

    parts = run_together(train.sparkSession, [lambda i=i: fold(i) for i in range(len(prepared))])
    return reduce(DataFrame.unionByName, parts)


def train_models(
    train: DataFrame, test: DataFrame, features: list[str], target: str, key: str, models: list[str],
    kind: str | None = None, params: dict[str, dict] | None = None, cv_folds: int = CV_FOLDS, tune: str | None = None,
    resample: str | None = None, calibration: str | None = None, **options,
) -> tuple[dict[str, ModelResult], dict[str, str]]:
    """Fit every named model; a model that fails is reported and does not stop the others.

    ``tune`` is ``grid`` or ``random`` for models that have a parameter grid;
    ``cv_folds=0`` skips fold scores.  ``resample`` (see ``balance.resample``) balances the
    classes of whatever part a model is fitted on, in folds and searches too; rows that are
    scored stay as they are.  ``calibration`` (isotonic or sigmoid) maps probabilities by
    curves fitted on the out-of-fold scores.  Options go to ``prepare``.  Returns
    (results, failures).
    """
    if len(train.take(MIN_ROWS)) < MIN_ROWS:
        raise ValueError(f"at least {MIN_ROWS} training rows are needed")
    prepared = prepare(train, features, target, key, kind, **options)
    kind = prepared.kind
    if (resample or calibration) and kind != "classification":
        raise ValueError("resampling and calibration need classes")
    if resample and prepared.weights:
        raise ValueError("balance by resampling or by weights, not both")
    if calibration and not cv_folds:
        raise ValueError("calibration needs folds")
    sampler = (lambda rows: resample_prepared(rows, resample, key)) if resample else None
    weight = "_weight" if prepared.weights else None
    strata = target if kind == "classification" else None
    # The folds and the prepared rows are read by every model; executors that are lost recompute them.
    folded = with_folds(train, key, cv_folds, strata).persist() if cv_folds else train
    ready = prepared.slim(folded if not cv_folds else folded.drop("fold"))
    ready = (sampler(ready) if sampler else ready).persist()
    held = prepared.slim(test).persist()
    per_fold = prepare_folds(prepared, folded, cv_folds) if cv_folds else []
    results, failures, tuning = {}, {}, None
    try:
        for name in models:
            try:
                chosen = dict((params or {}).get(name, {}))
                best, tuned = {}, 0.0
                if tune and name in GRIDS:
                    if tuning is None:  # prepared without each fold, once for all models
                        tuning = fold_features(with_folds(train, key, CV_FOLDS, strata), prepare_folds(
                            prepared, with_folds(train, key, CV_FOLDS, strata), CV_FOLDS))
                    found = search(
                        name, kind, tuning, len(prepared.classes), tune, weight=weight, fixed=chosen, key=key,
                        sampler=sampler)
                    best, tuned = found.best, found.score
                fitted = fit_model(name, kind, ready, len(prepared.classes), weight, {**chosen, **best}, key)
                fitted.classes = prepared.classes
                scores = []
                if cv_folds:
                    oof = out_of_fold(name, per_fold, folded, {**chosen, **best}, sampler)
                    if calibration:
                        oof = cut_lineage(oof)
                        seen = oof.withColumnRenamed("label", "_label")
                        fitted.stages.append(calibrate(seen, calibration, len(prepared.classes)))
                    rows = fold_scores(oof, kind).collect()
                    scores = [r["score"] for r in sorted(rows, key=lambda r: r["fold"])]
                predictions = fitted.transform(held)
                results[name] = ModelResult(
                    name, kind, fitted, predictions, score_predictions(predictions, prepared), scores, best, tuned,
                    prepared)
            except Exception as error:  # one model's failure is a row in the report
                failures[name] = f"{type(error).__name__}: {error}"
    finally:
        folded.unpersist()
        ready.unpersist()
        held.unpersist()
    return results, failures


def failures_table(spark, results: dict[str, ModelResult], failures: dict[str, str]) -> DataFrame:
    """One row per model that was asked for: whether it failed, and why."""
    rows = [(name, False, None) for name in results] + [(name, True, error) for name, error in failures.items()]
    return spark.createDataFrame(rows, "model string, failed boolean, error string")


def results_table(spark, results: dict[str, ModelResult]) -> DataFrame:
    """One row per trained model: metrics, fold mean and deviation, tuning score."""
    rows = []
    names: list[str] = []
    for r in results.values():
        mean = sum(r.cv_scores) / len(r.cv_scores) if r.cv_scores else None
        spread = None
        if r.cv_scores:
            spread = (sum((s - mean) ** 2 for s in r.cv_scores) / len(r.cv_scores)) ** 0.5
        facts = {**r.metrics, "cv_mean": mean, "cv_std": spread, "tuning_score": r.tuning_score}
        names = list(facts)
        rows.append((r.name, *[None if v is None else float(v) for v in facts.values()]))
    schema = "model string" + "".join(f", {n} double" for n in names)
    return spark.createDataFrame(rows, schema)


def long_predictions(results: dict[str, ModelResult]) -> DataFrame:
    """``model, label, prediction`` of all models in one table."""
    out = None
    for r in results.values():
        part = r.predictions.select(F.lit(r.name).alias("model"), F.col("_label").alias("label"), "prediction")
        out = part if out is None else out.unionByName(part)
    return out
