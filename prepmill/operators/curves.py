"""Points of evaluation curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.roles import col
from .charts import histogram, scatter
from .metrics import cumulative_scores


def roc_curve(df: DataFrame, score: str, label: str, positive=1) -> DataFrame:
    """``threshold, fpr, tpr`` at every distinct score, with the (0, 0) start (threshold NULL)."""
    cum = cumulative_scores(df, score, label, positive)
    points = cum.select(
        F.col("score").alias("threshold"), F.try_divide(F.col("cum_n"), F.col("all_n")).alias("fpr"),
        F.try_divide(F.col("cum_p"), F.col("all_p")).alias("tpr"),
    )
    start = df.sparkSession.createDataFrame([(None, 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return points.unionByName(start)


def precision_recall_curve(df: DataFrame, score: str, label: str, positive=1) -> DataFrame:
    """``threshold, precision, recall`` at every distinct score, with the (1, 0) end (threshold NULL)."""
    cum = cumulative_scores(df, score, label, positive)
    points = cum.select(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("cum_p"), F.col("cum_p") + F.col("cum_n")).alias("precision"),
        F.try_divide(F.col("cum_p"), F.col("all_p")).alias("recall"),
    )
    end = df.sparkSession.createDataFrame([(None, 1.0, 0.0)], "threshold double, precision double, recall double")
    return points.unionByName(end)


def predicted_vs_actual(df: DataFrame, label: str, prediction: str, key: str, n: int = 1000) -> DataFrame:
    """A repeatable sample of (actual, predicted) points with the ends of the identity line."""
    y, p = col(label).cast("double"), col(prediction).cast("double")
    ends = df.agg(F.least(F.min(y), F.min(p)).alias("a"), F.greatest(F.max(y), F.max(p)).alias("z")).first()
    points = scatter(df, label, prediction, key, n=n)
    return points.withColumns({"line_low": F.lit(ends["a"]), "line_high": F.lit(ends["z"])})


def residuals(df: DataFrame, label: str, prediction: str, out: str = "residual") -> DataFrame:
    """Add ``label - prediction``."""
    return df.withColumn(out, col(label).cast("double") - col(prediction).cast("double"))


def residual_histogram(df: DataFrame, label: str, prediction: str, bins: int = 30) -> DataFrame:
    return histogram(residuals(df, label, prediction), "residual", bins)
