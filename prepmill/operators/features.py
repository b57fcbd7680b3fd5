"""Feature construction and selection."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.roles import as_text, col, columns_by_role, numeric_columns, require_columns
from ..functions.stats import pearson
from .charts import correlation_pairs

# Limits of the feature step.
MAX_INTERACTIONS = 10
TOP_FEATURES = 20
MI_BINS = 10
RFE_TREES = 50
SEED = 42


def interactions(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Add ``a_b_interaction = a * b`` for each pair of numeric columns."""
    numeric = numeric_columns(df)
    made = {f"{a}_{b}_interaction": col(a) * col(b) for a, b in pairs if a in numeric and b in numeric}
    return df.withColumns(made) if made else df


def interaction_pairs(
    df: DataFrame, most: int = MAX_INTERACTIONS, by: str = "order", columns: list[str] | None = None
) -> list[tuple[str, str]]:
    """First pairs in column order, or the most correlated ones with ``by="corr"``."""
    names = numeric_columns(df) if columns is None else columns
    if by == "order":
        return [(a, b) for i, a in enumerate(names) for b in names[i + 1:]][:most]
    if by != "corr":
        raise ValueError("by must be order or corr")
    ranked = correlation_pairs(df, names).orderBy(F.desc_nulls_last(F.abs("r")), "col_a", "col_b")
    return [(r["col_a"], r["col_b"]) for r in ranked.limit(most).collect()]


def auto_interactions(
    df: DataFrame, most: int = MAX_INTERACTIONS, by: str = "order", columns: list[str] | None = None
) -> DataFrame:
    """Add products of automatically chosen pairs."""
    return interactions(df, interaction_pairs(df, most, by, columns))


def _others(df: DataFrame, target: str, columns: list[str] | None) -> list[str]:
    names = numeric_columns(df, exclude=[target]) if columns is None else list(columns)
    require_columns(df, [*names, target])
    return names


def _rows(df: DataFrame, names: list[str], exprs, out: str) -> DataFrame:
    """Turn one wide aggregate into rows ``feature, out``."""
    wide = df.agg(*[e.alias(f"v{i}") for i, e in enumerate(exprs)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(f"v{i}").alias(out)) for i, n in enumerate(names)
    ])))


def top_correlated(df: DataFrame, target: str, n: int = TOP_FEATURES, columns: list[str] | None = None) -> DataFrame:
    """Features by |r| with a numeric target, ties by name."""
    names = _others(df, target, columns)
    found = _rows(df, names, [F.abs(pearson(c, target)) for c in names], "abs_r")
    return found.orderBy(F.desc_nulls_last("abs_r"), "feature").limit(n)


def chi_square(df: DataFrame, target: str, columns: list[str] | None = None) -> DataFrame:
    """Chi-square of non-negative features against a class: observed against expected sums per class.

    The table is reduced to one row per class; the rest works on those rows.
    """
    names = _others(df, target, columns)
    rows = df.where(col(target).isNotNull())
    least = rows.agg(*[F.min(col(c)).alias(f"m{i}") for i, c in enumerate(names)]).first()
    negative = [c for i, c in enumerate(names) if least[f"m{i}"] is not None and least[f"m{i}"] < 0]
    if negative:
        raise ValueError(f"negative values in {', '.join(negative)}")
    by_class = rows.groupBy(col(target).alias("_y")).agg(
        F.count(F.lit(1)).cast("double").alias("_c"), *[F.sum(col(c).cast("double")).alias(f"o{i}") for i, c in enumerate(names)]
    )
    total = F.struct(F.sum("_c").alias("n"), *[F.sum(f"o{i}").alias(f"s{i}") for i in range(len(names))])
    facts = by_class.agg(
        total.alias("t"), F.collect_list(F.struct("_c", *[f"o{i}" for i in range(len(names))])).alias("k")
    )

    def statistic(i: int):
        def term(row):
            expected = F.col(f"t.s{i}") * row["_c"] / F.col("t.n")
            return F.when(expected > 0, F.pow(row[f"o{i}"] - expected, 2) / expected).otherwise(F.lit(0.0))

        return F.aggregate("k", F.lit(0.0), lambda acc, row: acc + term(row))

    return facts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), statistic(i).alias("chi2")) for i, c in enumerate(names)
    ])))


def top_chi_square(df: DataFrame, target: str, n: int = TOP_FEATURES, columns: list[str] | None = None) -> DataFrame:
    """The features with the largest chi-square, ties by name."""
    return chi_square(df, target, columns).orderBy(F.desc("chi2"), "feature").limit(n)


def mutual_information(
    df: DataFrame, target: str, columns: list[str] | None = None, bins: int = MI_BINS
) -> DataFrame:
    """Binned mutual information of numeric features with a class, in nats.

    Cells are pre-aggregated per task; after that only feature x bin x class rows remain.
    """
    names = _others(df, target, columns)
    ends = df.agg(
        *[F.min(col(c).cast("double")).alias(f"a{i}") for i, c in enumerate(names)],
        *[F.max(col(c).cast("double")).alias(f"z{i}") for i, c in enumerate(names)],
    ).first()
    cells = []
    for i, c in enumerate(names):
        low, high = ends[f"a{i}"], ends[f"z{i}"]
        x = col(c).cast("double")
        place = F.lit(0) if low is None or low == high else F.least(
            F.floor((x - low) / (high - low) * bins).cast("int"), F.lit(bins - 1))
        cells.append(F.struct(F.lit(c).alias("feature"), F.when(x.isNotNull(), place).alias("v")))
    long = df.where(col(target).isNotNull()).select(as_text(df, target).alias("y"), F.inline(F.array(*cells)))
    joint = long.where("v is not null").groupBy("feature", "v", "y").agg(F.count(F.lit(1)).cast("double").alias("c"))
    of_class = joint.groupBy("feature", "y").agg(F.sum("c").alias("cy"))
    of_bin = joint.groupBy("feature", "v").agg(F.sum("c").alias("cv"))
    of_all = joint.groupBy("feature").agg(F.sum("c").alias("n"))
    full = joint.join(of_class, ["feature", "y"]).join(of_bin, ["feature", "v"]).join(of_all, "feature")
    share = F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("cy") * F.col("cv")))
    return full.groupBy("feature").agg(F.sum(share).alias("mi"))


def top_mutual_information(
    df: DataFrame, target: str, n: int = TOP_FEATURES, columns: list[str] | None = None, bins: int = MI_BINS
) -> DataFrame:
    return mutual_information(df, target, columns, bins).orderBy(F.desc("mi"), "feature").limit(n)


def eliminate_features(
    df: DataFrame, target: str, n: int, columns: list[str] | None = None, step: int = 1, trees: int = RFE_TREES
) -> DataFrame:
    """Recursive elimination: fit a forest, drop the ``step`` weakest, repeat until ``n`` are left.

    Result: ``feature, place, kept``; place 1 for kept features, then in reverse order of removal.
    """
    from .models import index_labels

    names = _others(df, target, columns)
    data, _ = index_labels(df.select(*[col(c) for c in [*names, target]]).na.drop(), target)
    data = data.persist()
    left, dropped = list(names), []
    try:
        while len(left) > max(n, 1):
            vector = VectorAssembler(inputCols=left, outputCol="_features")
            forest = RandomForestClassifier(
                labelCol="_label", featuresCol="_features", numTrees=trees, seed=SEED
            ).fit(vector.transform(data))
            weight = forest.featureImportances.toArray()
            order = sorted(range(len(left)), key=lambda i: (weight[i], left[i]))
            gone = [left[i] for i in order[: min(step, len(left) - n)]]
            dropped.append(gone)
            left = [c for c in left if c not in gone]
    finally:
        data.unpersist()
    rows = [(c, 1, True) for c in left]
    for place, gone in enumerate(reversed(dropped), start=2):
        rows += [(c, place, False) for c in gone]
    return df.sparkSession.createDataFrame(rows, "feature string, place int, kept boolean")


def datetime_parts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Add year, month, day, weekday (1 = Sunday) and hour of each datetime column."""
    names = columns_by_role(df)["datetime"] if columns is None else columns
    made = {}
    for c in names:
        t = col(c)
        made |= {
            f"{c}_year": F.year(t), f"{c}_month": F.month(t), f"{c}_day": F.dayofmonth(t),
            f"{c}_weekday": F.dayofweek(t), f"{c}_hour": F.hour(t),
        }
    return df.withColumns(made) if made else df
