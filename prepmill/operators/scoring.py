"""Applying models to new tables, and summaries of what they predict."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.roles import col
from .profile import percent

# Right-closed confidence levels, and the range of the decision threshold.
LEVELS = (("Low", 0.6), ("Medium", 0.8), ("High", 1.0))
THRESHOLDS = (0.1, 0.9)


def predicted_columns(scored: DataFrame, classes: list[str], keep: list[str]) -> DataFrame:
    """Kept columns, ``Predicted`` (class text) and ``Prob_<class>`` from ``prediction, probability``."""
    names = F.array(*[F.lit(c) for c in classes])
    out = scored.withColumn("_p", vector_to_array("probability"))
    return out.select(
        *[col(c) for c in keep], names[F.col("prediction").cast("int")].alias("Predicted"),
        *[F.col("_p")[i].alias(f"Prob_{c}") for i, c in enumerate(classes)],
    )


def with_confidence(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``Confidence`` (largest probability) and its ``Confidence_Level``."""
    out = df.withColumn("Confidence", F.greatest(*[col(c) for c in columns]) if len(columns) > 1 else col(columns[0]))
    level = F.when(F.col("Confidence") <= 0, F.lit(None).cast("string"))
    for name, top in LEVELS:
        level = level.when(F.col("Confidence") <= top, name)
    return out.withColumn("Confidence_Level", level)


def apply_threshold(df: DataFrame, probability: str, threshold: float = 0.5, yes=1, no=0, out: str = "Predicted") -> DataFrame:
    """Decide by ``probability >= threshold``."""
    low, high = THRESHOLDS
    if not low <= threshold <= high:
        raise ValueError(f"threshold must lie in [{low}, {high}]")
    return df.withColumn(out, F.when(col(probability) >= threshold, F.lit(yes)).otherwise(F.lit(no)))


def class_summary(df: DataFrame, prediction: str = "Predicted") -> DataFrame:
    """Rows and percent per predicted class."""
    total = df.count()
    counts = df.groupBy(col(prediction).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("class", "n", percent(F.col("n"), F.lit(total)).alias("pct"))


def number_summary(df: DataFrame, prediction: str = "Predicted") -> DataFrame:
    """Mean, sample deviation, minimum and maximum of predictions."""
    p = col(prediction).cast("double")
    return df.agg(F.avg(p).alias("mean"), F.stddev_samp(p).alias("std"), F.min(p).alias("min"), F.max(p).alias("max"))


def level_summary(df: DataFrame) -> DataFrame:
    """Rows per confidence level."""
    return df.groupBy("Confidence_Level").agg(F.count(F.lit(1)).alias("n"))
