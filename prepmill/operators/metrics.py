"""Scores of predictions, as plain aggregations, for one table or per group (model, fold)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import join_null_safe
from ..functions.ranges import running_sums
from ..functions.roles import col
from .reshape import distinct_values

# Fixed value: classes shown in a per-class report.
REPORT_CLASSES = 10


def _zero(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 when the whole is 0."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def class_counts(df: DataFrame, label: str, prediction: str, by: list[str] = ()) -> DataFrame:
    """Per group and class: true rows, predicted rows, hits.

    Pairs of label and prediction are counted first (classes squared rows), so the
    rest of the work does not depend on the table size.
    """
    by = list(by)
    pairs = df.where(col(label).isNotNull()).groupBy(
        *[col(b) for b in by], col(label).alias("_l"), col(prediction).alias("_p")
    ).agg(F.count(F.lit(1)).alias("_c"))
    hit = F.when(F.col("_l").eqNullSafe(F.col("_p")), F.col("_c")).otherwise(F.lit(0))
    zero = F.lit(0).cast("bigint")
    both = F.array(
        F.struct(F.col("_l").alias("class"), F.col("_c").alias("n"), zero.alias("m"), hit.cast("bigint").alias("h")),
        F.struct(F.col("_p").alias("class"), zero.alias("n"), F.col("_c").alias("m"), zero.alias("h")),
    )
    long = pairs.select(*[col(b) for b in by], F.inline(both)).where("class is not null")
    return long.groupBy(*by, "class").agg(
        F.sum("n").alias("support"), F.sum("m").alias("predicted"), F.sum("h").alias("hits")
    )


def _per_class(counts: DataFrame) -> DataFrame:
    return counts.withColumns({
        "precision": _zero(F.col("hits"), F.col("predicted")), "recall": _zero(F.col("hits"), F.col("support")),
        "f1": _zero(F.col("hits") * 2.0, F.col("support") + F.col("predicted")),
    })


def class_report(df: DataFrame, label: str, prediction: str, by: list[str] = ()) -> DataFrame:
    """Precision, recall and F1 per class."""
    report = _per_class(class_counts(df, label, prediction, by))
    return report.select(*by, "class", "precision", "recall", "f1", "support")


def classification_metrics(df: DataFrame, label: str, prediction: str, by: list[str] = ()) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1; a zero division counts as 0."""
    per_class = _per_class(class_counts(df, label, prediction, by))

    def weighted(name):
        return _zero(F.sum(F.col(name) * F.col("support")), F.sum("support"))

    aggs = [
        _zero(F.sum("hits").cast("double"), F.sum("support")).alias("accuracy"),
        weighted("precision").alias("precision"), weighted("recall").alias("recall"), weighted("f1").alias("f1"),
    ]
    return per_class.groupBy(*by).agg(*aggs) if by else per_class.agg(*aggs)


def regression_metrics(df: DataFrame, label: str, prediction: str, by: list[str] = ()) -> DataFrame:
    """MAE, MSE, RMSE and R2 in one aggregate."""
    y, p = col(label).cast("double"), col(prediction).cast("double")
    kept = df.where(y.isNotNull() & p.isNotNull())
    error = y - p
    aggs = [
        F.avg(F.abs(error)).alias("mae"), F.avg(error * error).alias("mse"), F.var_pop(y).alias("_v"),
    ]
    one = kept.groupBy(*by).agg(*aggs) if by else kept.agg(*aggs)
    return one.select(
        *by, "mae", "mse", F.sqrt("mse").alias("rmse"), (1 - F.try_divide(F.col("mse"), F.col("_v"))).alias("r2")
    )


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Counts, one row per true class and one column per class of either side."""
    sides = df.select(F.explode(F.array(col(label).cast("string"), col(prediction).cast("string"))).alias("c"))
    names = distinct_values(sides, "c")
    listed = df.sparkSession.createDataFrame([(n,) for n in names], "label string")
    texts = df.where(col(label).isNotNull()).select(
        col(label).cast("string").alias("label"), col(prediction).cast("string").alias("_p")
    )
    wide = texts.groupBy("label").pivot("_p", names).agg(F.count(F.lit(1)))
    return listed.join(wide, "label", "left").na.fill(0, names)


def _score_counts(df: DataFrame, score: str, label: str, positive, by: list[str]) -> DataFrame:
    """Positives and negatives per distinct score."""
    hit = (col(label) == F.lit(positive)).cast("double")
    rows = df.where(col(score).isNotNull() & col(label).isNotNull())
    return rows.groupBy(*by, col(score).cast("double").alias("score")).agg(
        F.sum(hit).alias("_p"), F.sum(1 - hit).alias("_n")
    )


def cumulative_scores(
    df: DataFrame, score: str, label: str, positive=1, by: list[str] = ()
) -> DataFrame:
    """Per distinct score, from high to low: positives and negatives at it, so far, and in all.

    Ties are grouped before anything is ordered, and the running counts use value
    ranges of the score, so neither a frequent score nor many scores fill one task.
    """
    by = list(by)
    counts = _score_counts(df, score, label, positive, by)
    source = df.select(col(score).cast("double").alias("score"))
    run = running_sums(
        counts, "score", {"cum_p": F.col("_p"), "cum_n": F.col("_n")}, by, descending=True, source=source
    )
    if by:
        totals = counts.groupBy(*by).agg(F.sum("_p").alias("all_p"), F.sum("_n").alias("all_n"))
        return join_null_safe(run, totals, by)
    # One row, read once from the small grouped table.
    row = counts.agg(F.sum("_p").alias("p"), F.sum("_n").alias("n")).first()
    return run.withColumns({"all_p": F.lit(row["p"]).cast("double"), "all_n": F.lit(row["n"]).cast("double")})


def ranking_metrics(df: DataFrame, score: str, label: str, positive=1, by: list[str] = ()) -> DataFrame:
    """ROC-AUC with ties and average precision (step sum) of a binary score; 0 when a side is empty."""
    cum = cumulative_scores(df, score, label, positive, by)
    pairs = F.sum(F.col("_n") * (F.col("cum_p") - F.col("_p") / 2))
    steps = F.sum(F.col("_p") * F.try_divide(F.col("cum_p"), F.col("cum_p") + F.col("cum_n")))
    aggs = [
        _zero(pairs, F.max(F.col("all_p") * F.col("all_n"))).alias("roc_auc"),
        _zero(steps, F.max("all_p")).alias("pr_auc"),
    ]
    return cum.groupBy(*by).agg(*aggs) if by else cum.agg(*aggs)


def roc_auc_weighted(
    df: DataFrame, label: str, scores: dict[str, str], by: list[str] = ()
) -> DataFrame:
    """One-vs-rest ROC-AUC averaged by class size; ``scores`` maps a class to its score column."""
    by = list(by)
    sides = F.array(*[
        F.struct(F.lit(c).alias("class"), col(s).cast("double").alias("_score"),
                 (col(label).cast("string") == c).cast("int").alias("_hit"))
        for c, s in scores.items()
    ])
    long = df.where(col(label).isNotNull()).select(*[col(b) for b in by], F.inline(sides))
    each = ranking_metrics(long, "_score", "_hit", 1, [*by, "class"])
    sizes = long.groupBy(*by, "class").agg(F.sum("_hit").cast("double").alias("_w"))
    joined = each.join(sizes, [*by, "class"])
    aggs = [_zero(F.sum(F.col("roc_auc") * F.col("_w")), F.sum("_w")).alias("roc_auc")]
    return joined.groupBy(*by).agg(*aggs) if by else joined.agg(*aggs)
