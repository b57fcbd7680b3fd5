"""Tables that compare models, from one long predictions table or from fitted results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .charts import box_stats_by
from .metrics import classification_metrics, ranking_metrics, regression_metrics

DECIMALS = 3


def fold_scores(df: DataFrame, kind: str, label: str = "label", prediction: str = "prediction",
                model: str = "model", fold: str = "fold") -> DataFrame:
    """Weighted F1 (classes) or R2 (numbers) per model and fold of out-of-fold predictions."""
    if kind == "classification":
        scored = classification_metrics(df, label, prediction, [model, fold])
        return scored.select(model, fold, F.col("f1").alias("score"))
    return regression_metrics(df, label, prediction, [model, fold]).select(model, fold, F.col("r2").alias("score"))


def fold_summary(scores: DataFrame, model: str = "model") -> DataFrame:
    """Mean and population deviation of fold scores per model."""
    return scores.groupBy(model).agg(F.avg("score").alias("cv_mean"), F.stddev_pop("score").alias("cv_std"))


def compare_models(
    predictions: DataFrame, kind: str, scores: DataFrame | None = None, score: str | None = None, positive=1,
    tuning: dict[str, float] | None = None, full: bool = False, decimals: int | None = DECIMALS,
    label: str = "label", prediction: str = "prediction", model: str = "model",
) -> DataFrame:
    """One row per model: test metrics, ROC-AUC (with ``full`` also PR-AUC and tuning score), fold mean and deviation.

    Everything is grouped by model, so all models are scored in one pass.
    """
    if kind == "classification":
        table = classification_metrics(predictions, label, prediction, [model])
        if score:
            ranks = ranking_metrics(predictions, score, label, positive, [model])
            table = table.join(ranks if full else ranks.drop("pr_auc"), model, "left")
        else:
            table = table.withColumn("roc_auc", F.lit(0.0))
            table = table.withColumn("pr_auc", F.lit(0.0)) if full else table
    else:
        table = regression_metrics(predictions, label, prediction, [model])
    if scores is not None:
        table = table.join(fold_summary(scores, model), model, "left")
    if full:
        known = list((tuning or {}).items())
        if known:
            listed = predictions.sparkSession.createDataFrame(known, f"{model} string, tuning_score double")
            table = table.join(listed, model, "left").na.fill(0.0, ["tuning_score"])
        else:
            table = table.withColumn("tuning_score", F.lit(0.0))
    if decimals is not None:
        numbers = [f.name for f in table.schema.fields if f.dataType.simpleString() == "double"]
        table = table.withColumns({c: F.round(c, decimals) for c in numbers})
    return table


def best_model(table: DataFrame, kind: str, model: str = "model") -> DataFrame:
    """The row with the highest F1 or R2, ties by name."""
    score = "f1" if kind == "classification" else "r2"
    return table.orderBy(F.desc(score), model).limit(1).select(model, F.col(score).alias("score"))


def fold_boxes(scores: DataFrame, model: str = "model") -> DataFrame:
    """Box figures of fold scores per model."""
    return box_stats_by(scores, "score", model)
