"""Rule-based advice tables: what the measured facts suggest to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.roles import col, columns_by_role
from .charts import correlation_pairs
from .profile import beside, column_stats, constant_facts, duplicate_count, missing_counts, percent

# Thresholds and list lengths of the advice rules.
DROP_ABOVE = 50.0
ADVANCED_ABOVE = 20.0
TOP_MISSING = 5
ADVISED_COLUMNS = 3
STRONG_CORRELATION = 0.7
TOP_PAIRS = 5
HIGH_CARDINALITY = 0.8
LISTED_COLUMNS = 3


def _text(names: list[str]) -> Column:
    return F.lit(", ".join(names[:LISTED_COLUMNS]))


def insight_overview(df: DataFrame) -> DataFrame:
    """Shape, role counts and the first three numeric, categorical and missing columns."""
    roles = columns_by_role(df)
    gaps = missing_counts(df)
    listed = F.slice(F.array_sort(F.collect_list(F.when(
        F.col("missing") > 0, F.struct("position", F.col("column").alias("name"))))), 1, LISTED_COLUMNS)
    one = gaps.agg(F.max("rows").alias("n_rows"), listed.alias("_m"))
    return one.select(
        "n_rows", F.lit(len(df.columns)).alias("n_columns"), F.lit(len(roles["numeric"])).alias("n_numeric"),
        F.lit(len(roles["categorical"])).alias("n_categorical"), _text(roles["numeric"]).alias("numeric_columns"),
        _text(roles["categorical"]).alias("categorical_columns"),
        F.concat_ws(", ", F.transform("_m", lambda s: s["name"])).alias("missing_columns"),
    )


def missing_advice(df: DataFrame) -> DataFrame:
    """Columns with gaps: share, place by count (top 5) and advice for the first three."""
    gaps = missing_counts(df).where("missing > 0")
    share = percent(F.col("missing"), F.col("rows"))
    # One row per column of the table: these ordered passes are bounded by its width.
    by_count = Window.orderBy(F.desc("missing"), F.asc("position"))
    in_order = Window.orderBy("position")
    ranked = gaps.select(
        "column", "missing", share.alias("missing_pct"), F.row_number().over(by_count).alias("place"),
        F.row_number().over(in_order).alias("_nth"),
    )
    advice = (
        F.when(F.col("_nth") > ADVISED_COLUMNS, F.lit(""))
        .when(F.col("missing_pct") > DROP_ABOVE, "drop column")
        .when(F.col("missing_pct") > ADVANCED_ABOVE, "advanced imputation")
        .otherwise("simple imputation")
    )
    kept = ranked.where((F.col("place") <= TOP_MISSING) | (F.col("_nth") <= ADVISED_COLUMNS))
    return kept.select("column", "missing", "missing_pct", "place", advice.alias("advice"))


def strong_pairs(df: DataFrame, limit: float = STRONG_CORRELATION, top: int = TOP_PAIRS) -> DataFrame:
    """The strongest correlated pairs with |r| above ``limit``."""
    strong = correlation_pairs(df).where(F.abs("r") > limit)
    return strong.orderBy(F.desc(F.abs("r")), "col_a", "col_b").limit(top)


def quality_assessment(df: DataFrame, exclude: list[str] | tuple[str, ...] = (), approx: bool = False) -> DataFrame:
    """Issues found, one row each: duplicates, missing, constant, high-cardinality columns.

    Values are counted for categorical columns only.
    """
    categorical = columns_by_role(df)["categorical"]
    stats = constant_facts(df).agg(
        F.count_if(F.col("nulls") > 0).alias("missing_columns"),
        F.count_if("constant").alias("constant_columns"), F.max("rows").alias("_rows"),
    )
    counted = []
    if categorical:
        high = F.col("n_unique") > (F.col("non_null") + F.col("nulls")) * HIGH_CARDINALITY
        values = column_stats(df.select(*[col(c) for c in categorical]), approx)
        counted = [values.agg(F.count_if(high).alias("high_cardinality_columns"))]
    facts = beside(stats, *counted, duplicate_count(df, exclude))
    if not categorical:
        facts = facts.withColumn("high_cardinality_columns", F.lit(0).cast("bigint"))
    names = ["duplicate_rows", "missing_columns", "constant_columns", "high_cardinality_columns"]
    issues = F.array(*[
        F.struct(
            F.lit(n).alias("issue"), F.col(n).alias("n"),
            (percent(F.col(n), F.col("_rows")) if n == "duplicate_rows" else F.lit(None).cast("double")).alias("pct"),
        )
        for n in names
    ])
    return facts.select(F.inline(issues)).where("n > 0")


def preparation_plan(df: DataFrame, exclude: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Ordered preparation steps that the table's facts call for."""
    roles = columns_by_role(df)
    gaps = missing_counts(df).agg(F.count_if(F.col("missing") > 0).alias("gaps"))
    facts = beside(gaps, duplicate_count(df, exclude))
    steps = [
        (1, "handle missing values", F.col("gaps") > 0),
        (2, "remove duplicates", F.col("duplicate_rows") > 0),
        (3, "optimize data types", F.lit(True)),
        (4, "handle outliers", F.lit(len(roles["numeric"]) > 0)),
        (5, "encode categoricals", F.lit(len(roles["categorical"]) > 0)),
        (6, "scale features", F.lit(len(roles["numeric"]) > 1)),
    ]
    rows = F.array(*[
        F.struct(F.lit(i).alias("step"), F.lit(text).alias("action"), needed.alias("needed"))
        for i, text, needed in steps
    ])
    return facts.select(F.inline(rows)).where("needed").select("step", "action")


def generic_summary(df: DataFrame) -> DataFrame:
    """Size, role counts and the number of columns without gaps."""
    roles = columns_by_role(df)
    return missing_counts(df).agg(
        F.max("rows").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"),
        F.lit(len(roles["numeric"])).alias("n_numeric"), F.lit(len(roles["categorical"])).alias("n_categorical"),
        F.count_if(F.col("missing") == 0).alias("complete_columns"),
    )
