"""Profile and quality facts of one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quantiles import quantile_values
from ..functions.roles import FLOATING, INTEGRAL, as_text, col, columns_by_role, role_of
from ..functions.stats import kurt_sample, skew_sample

FEW_VALUES = 10
SAMPLE_SHOWN = 5
IQR_FACTOR = 1.5


def _fixed_rows(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


def dtype_name(dtype: T.DataType) -> str:
    return dtype.simpleString()


def column_roles(df: DataFrame) -> DataFrame:
    """One row per column: position, column, dtype, role (schema only)."""
    rows = [(i, f.name, dtype_name(f.dataType), role_of(f.dataType)) for i, f in enumerate(df.schema.fields)]
    return _fixed_rows(df, rows, "position int, column string, dtype string, role string")


def role_counts(df: DataFrame) -> DataFrame:
    """Number of columns per role; roles without columns are not listed."""
    rows = [(role, len(names)) for role, names in columns_by_role(df).items() if names]
    return _fixed_rows(df, rows, "role string, n_columns int")


def value_frequencies(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, value, n)`` for every distinct value of every column, NULL included.

    One scan: columns are unpivoted as text and pre-aggregated on the map side, so
    a value that fills a column is one row per task before the shuffle.
    """
    names = df.columns if columns is None else columns
    if not names:
        raise ValueError("no columns")
    texts = df.select(*[as_text(df, c).alias(c) for c in names])
    if len(names) == 1:
        long = texts.select(F.lit(names[0]).alias("column"), col(names[0]).alias("value"))
    else:
        long = texts.unpivot([], [col(c) for c in names], "column", "value")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def _width(dtype: T.DataType) -> int | None:
    sizes = {
        T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8,
        T.FloatType: 4, T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8,
    }
    if isinstance(dtype, T.DecimalType):
        return 16 if dtype.precision > 18 else 8
    return sizes.get(type(dtype))


def _logical_bytes(df: DataFrame, name: str) -> Column:
    """Bytes of one cell: fixed width, or the UTF-8 length of its text."""
    width = _width(df.schema[name].dataType)
    if width is not None:
        return F.when(col(name).isNotNull(), F.lit(width)).otherwise(F.lit(0))
    return F.coalesce(F.octet_length(as_text(df, name)), F.lit(0))


def column_footprint(df: DataFrame) -> DataFrame:
    """Logical bytes per column, from one aggregate over the table."""
    sums = [F.sum(_logical_bytes(df, c).cast("bigint")).alias(f"b{i}") for i, c in enumerate(df.columns)]
    wide = df.agg(*sums)
    pairs = [
        F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"b{i}"), F.lit(0)).cast("bigint").alias("bytes"))
        for i, c in enumerate(df.columns)
    ]
    return wide.select(F.inline(F.array(*pairs)))


def column_stats(df: DataFrame, approx: bool = False, columns: list[str] | None = None) -> DataFrame:
    """``column, non_null, nulls, n_unique`` per column.

    Exact counts group the values of all columns of a type at once, with partial counts
    before the shuffle, so a value that fills a column is one row per task.
    ``approx=True`` uses HyperLogLog and shuffles one row per task.
    """
    names = df.columns if columns is None else columns
    if approx:
        aggs = []
        for i, c in enumerate(names):
            aggs += [F.count(col(c)).alias(f"c{i}"), F.approx_count_distinct(as_text(df, c)).alias(f"u{i}")]
        wide = df.agg(F.count(F.lit(1)).alias("rows"), *aggs)
        pairs = [
            F.struct(
                F.lit(c).alias("column"), F.col(f"c{i}").alias("non_null"),
                (F.col("rows") - F.col(f"c{i}")).alias("nulls"), F.col(f"u{i}").alias("n_unique"),
            )
            for i, c in enumerate(names)
        ]
        return wide.select(F.inline(F.array(*pairs)))
    parts = None
    for long in _long_by_type(df, names):
        freq = long.groupBy("_i", "_v").agg(F.count(F.lit(1)).alias("_n"))
        part = freq.groupBy("_i").agg(
            F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col("_n"))), F.lit(0)).alias("non_null"),
            F.coalesce(F.sum(F.when(F.col("_v").isNull(), F.col("_n"))), F.lit(0)).alias("nulls"),
            F.count("_v").alias("n_unique"),
        )
        parts = part if parts is None else parts.unionByName(part)
    listed = _fixed_rows(df, [(str(i), c) for i, c in enumerate(names)], "_i string, column string")
    joined = listed.join(parts, "_i", "left").na.fill(0, ["non_null", "nulls", "n_unique"])
    return joined.select("column", "non_null", "nulls", "n_unique")


def _long_by_type(df: DataFrame, names: list[str]) -> list[DataFrame]:
    """``(_i, _v)`` tables of column number and value, one table per value type.

    Native types keep the grouping keys short; each table scans only its own columns.
    """
    groups: dict[str, list[tuple[int, Column]]] = {}
    for i, name in enumerate(names):
        dtype = df.schema[name].dataType
        value = col(name)
        if isinstance(dtype, INTEGRAL):
            kind, value = "bigint", value.cast("bigint")
        elif isinstance(dtype, FLOATING):
            # Adding zero merges the two signed zeros.
            kind, value = "double", value.cast("double") + F.lit(0.0)
        elif role_of(dtype) in ("nested", "other"):
            kind, value = "string", as_text(df, name)
        else:
            kind = dtype.simpleString()
        groups.setdefault(kind, []).append((i, value))
    out = []
    for columns in groups.values():
        wide = df.select(*[v.alias(str(i)) for i, v in columns])
        if len(columns) == 1:
            only = columns[0][0]
            out.append(wide.select(F.lit(str(only)).alias("_i"), col(str(only)).alias("_v")))
        else:
            out.append(wide.unpivot([], [col(str(i)) for i, _ in columns], "_i", "_v"))
    return out


def missing_counts(df: DataFrame) -> DataFrame:
    """``column, position, missing, rows`` from one aggregate (no distinct counts)."""
    wide = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]
    )
    pairs = [
        F.struct(
            F.lit(c).alias("column"), F.lit(i).alias("position"),
            (F.col("rows") - F.col(f"c{i}")).alias("missing"), F.col("rows").alias("rows"),
        )
        for i, c in enumerate(df.columns)
    ]
    return wide.select(F.inline(F.array(*pairs)))


def percent(part: Column, whole: Column) -> Column:
    """``part / whole * 100``, 0 for an empty whole."""
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))


def overview(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and the share of missing cells in percent."""
    present = sum((F.count(col(c)) for c in df.columns), F.lit(0))
    width = len(df.columns)
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), present.alias("_present"))
    cells = F.col("n_rows") * width
    return one.select(
        "n_rows", F.lit(width).alias("n_columns"), (cells - F.col("_present")).alias("missing_cells"),
        percent(cells - F.col("_present"), cells).alias("missing_pct"),
    )


def duplicate_count(df: DataFrame, exclude: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Rows that repeat an earlier row: total minus distinct (NULLs equal)."""
    keys = [c for c in df.columns if c not in exclude]
    groups = df.groupBy(*[col(c) for c in keys]).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def column_info(df: DataFrame, approx: bool = False) -> DataFrame:
    """Per column: dtype, non-null, nulls, null percent, distinct values."""
    types = column_roles(df).select("column", "dtype")
    stats = column_stats(df, approx)
    return stats.join(types, "column").select(
        "column", "dtype", "non_null", "nulls",
        percent(F.col("nulls"), F.col("non_null") + F.col("nulls")).alias("null_pct"), "n_unique",
    )


def sample_values(df: DataFrame, few: int = FEW_VALUES, shown: int = SAMPLE_SHOWN) -> DataFrame:
    """For categorical columns with at most ``few`` values: the first ``shown`` in sorted order.

    The smallest values are found per column by rank, so a column with many values
    is never gathered into an array.
    """
    names = columns_by_role(df)["categorical"]
    if not names:
        return _fixed_rows(df, [], "column string, sample_values string")
    freq = value_frequencies(df, names).where("value is not null")
    sizes = freq.groupBy("column").agg(F.count("value").alias("_u"))
    order = Window.partitionBy("column").orderBy("value")
    small = freq.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= shown)
    picked = small.groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("_v"))
    listed = _fixed_rows(df, [(c,) for c in names], "column string")
    joined = listed.join(sizes, "column", "left").join(picked, "column", "left")
    text = F.when(F.coalesce("_u", F.lit(0)) <= few, F.coalesce(F.concat_ws(", ", "_v"), F.lit("")))
    return joined.select("column", text.otherwise(F.lit("")).alias("sample_values"))


def constant_facts(df: DataFrame) -> DataFrame:
    """``column, rows, nulls, constant`` from one aggregate of counts, minima and maxima."""
    if not df.columns:
        return _fixed_rows(df, [], "column string, rows bigint, nulls bigint, constant boolean")
    cells = {
        c: as_text(df, c) if role_of(df.schema[c].dataType) in ("nested", "other") else col(c) for c in df.columns
    }
    facts = df.agg(F.count(F.lit(1)).alias("_rows"), *[
        F.struct(F.count(x).alias("n"), F.coalesce(F.min(x) == F.max(x), F.lit(True)).alias("constant")).alias(f"_f{i}")
        for i, x in enumerate(cells.values())
    ])
    parts = F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.col("_rows").alias("rows"), (F.col("_rows") - F.col(f"_f{i}.n")).alias("nulls"),
            F.col(f"_f{i}.constant").alias("constant"),
        )
        for i, c in enumerate(cells)
    ])
    return facts.select(F.inline(parts))


def quality_issues(df: DataFrame, exclude: list[str] | tuple[str, ...] = (), approx: bool = False) -> DataFrame:
    """Duplicate rows (count, percent), columns over half missing, constant columns.

    A column is constant if its smallest and largest values are equal, so no values are
    counted; ``approx`` is kept for callers that pass it to all profile functions.
    """
    stats = constant_facts(df).agg(
        F.count_if(F.col("nulls") > F.col("rows") * 0.5).alias("high_missing_columns"),
        F.count_if("constant").alias("constant_columns"), F.max("rows").alias("_rows"),
    )
    both = beside(stats, duplicate_count(df, exclude))
    return both.select(
        "duplicate_rows", percent(F.col("duplicate_rows"), F.col("_rows")).alias("duplicate_pct"),
        "high_missing_columns", "constant_columns",
    )


def beside(*facts: DataFrame) -> DataFrame:
    """Put one-row tables side by side (a union folded by ``max``; no join)."""
    both = facts[0]
    for other in facts[1:]:
        both = both.unionByName(other, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def describe(df: DataFrame, columns: list[str] | str) -> DataFrame:
    """count, mean, std, min, quartiles, max per numeric column."""
    names = [columns] if isinstance(columns, str) else list(columns)
    found = quantile_values(df, names, [0.25, 0.5, 0.75])
    aggs = []
    for i, c in enumerate(names):
        x = col(c).cast("double")
        aggs += [
            F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
            F.min(x).alias(f"a{i}"), F.max(x).alias(f"z{i}"),
        ]
    wide = df.agg(*aggs)
    rows = []
    for i, c in enumerate(names):
        q1, q2, q3 = (F.lit(v).cast("double") for v in found[c])
        rows.append(
            F.struct(
                F.lit(c).alias("column"), F.col(f"n{i}").alias("count"), F.col(f"m{i}").alias("mean"),
                F.col(f"s{i}").alias("std"), F.col(f"a{i}").alias("min"), q1.alias("p25"),
                q2.alias("p50"), q3.alias("p75"), F.col(f"z{i}").alias("max"),
            )
        )
    return wide.select(F.inline(F.array(*rows)))


def _per_column(df: DataFrame, names: list[str], measure, out: str) -> DataFrame:
    wide = df.agg(*[measure(c).alias(f"v{i}") for i, c in enumerate(names)])
    pairs = [F.struct(F.lit(c).alias("column"), F.col(f"v{i}").alias(out)) for i, c in enumerate(names)]
    return wide.select(F.inline(F.array(*pairs)))


def skewness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Bias-corrected skewness per column."""
    return _per_column(df, columns, skew_sample, "skewness")


def kurtosis(df: DataFrame, columns: list[str]) -> DataFrame:
    """Bias-corrected excess kurtosis per column."""
    return _per_column(df, columns, kurt_sample, "kurtosis")


def missing_report(df: DataFrame) -> DataFrame:
    """Missing count and percent of the columns that miss something."""
    return missing_counts(df).where("missing > 0").select(
        "column", "missing", percent(F.col("missing"), F.col("rows")).alias("missing_pct")
    )


def iqr_bounds(df: DataFrame, columns: list[str], factor: float = IQR_FACTOR) -> dict[str, tuple]:
    """``{column: (lower, upper)}`` fences; (None, None) for a column without values."""
    bounds = {}
    for c, (q1, q3) in quantile_values(df, columns, [0.25, 0.75]).items():
        bounds[c] = (None, None) if q1 is None else (q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))
    return bounds


def outlier_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Outlier count and fences per numeric column; non-numeric columns are skipped."""
    numeric = [c for c in columns if c in columns_by_role(df)["numeric"]]
    if not numeric:
        return _fixed_rows(df, [], "column string, outliers bigint, lower double, upper double")
    bounds = iqr_bounds(df, numeric)
    counts = [
        F.count_if((col(c) < F.lit(lo).cast("double")) | (col(c) > F.lit(hi).cast("double"))).alias(f"n{i}")
        for i, (c, (lo, hi)) in enumerate(bounds.items())
    ]
    rows = [
        F.struct(
            F.lit(c).alias("column"), F.col(f"n{i}").alias("outliers"),
            F.lit(lo).cast("double").alias("lower"), F.lit(hi).cast("double").alias("upper"),
        )
        for i, (c, (lo, hi)) in enumerate(bounds.items())
    ]
    return df.agg(*counts).select(F.inline(F.array(*rows)))


def change_summary(original: DataFrame, current: DataFrame) -> DataFrame:
    """Shape and footprint of both tables, with rows and columns gained or lost."""

    def size(df: DataFrame, tag: str) -> DataFrame:
        cells = sum((F.sum(_logical_bytes(df, c).cast("bigint")) for c in df.columns), F.lit(0))
        return df.agg(
            F.count(F.lit(1)).alias(f"rows_{tag}"), F.coalesce(cells, F.lit(0)).cast("bigint").alias(f"bytes_{tag}")
        )

    before, after = set(original.columns), set(current.columns)
    both = beside(size(original, "before"), size(current, "after"))
    return both.select(
        "rows_before", "rows_after", (F.col("rows_after") - F.col("rows_before")).alias("rows_changed"),
        F.lit(len(before)).alias("columns_before"), F.lit(len(after)).alias("columns_after"),
        "bytes_before", "bytes_after",
        F.lit(", ".join(sorted(after - before))).alias("columns_added"),
        F.lit(", ".join(sorted(before - after))).alias("columns_removed"),
    )


def numeric_domains(df: DataFrame, columns: list[str]) -> DataFrame:
    """Median, minimum and maximum per numeric column (defaults of a scoring form)."""
    med = quantile_values(df, columns, [0.5])
    wide = df.agg(
        *[F.min(col(c).cast("double")).alias(f"a{i}") for i, c in enumerate(columns)],
        *[F.max(col(c).cast("double")).alias(f"z{i}") for i, c in enumerate(columns)],
    )
    rows = [
        F.struct(
            F.lit(c).alias("column"), F.lit(med[c][0]).cast("double").alias("median"),
            F.col(f"a{i}").alias("min"), F.col(f"z{i}").alias("max"),
        )
        for i, c in enumerate(columns)
    ]
    return wide.select(F.inline(F.array(*rows)))


def category_domains(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct non-NULL values per categorical column, as rows."""
    return value_frequencies(df, columns).where("value is not null").select("column", "value")


def dataset_context(df: DataFrame, order_by: list[str], shown: int = 3) -> DataFrame:
    """Per column: dtype, role, missing, table shape, and its values in the first rows."""
    base = column_roles(df).join(missing_counts(df).select("column", "missing", "rows"), "column")
    texts = [as_text(df, c).alias(c) for c in df.columns]
    first = df.orderBy(*[col(k) for k in order_by]).limit(shown)
    first = first.select(*texts, F.monotonically_increasing_id().alias("_i"))
    long = first.unpivot([F.col("_i")], [col(c) for c in df.columns], "column", "value")
    lists = long.groupBy("column").agg(
        F.array_sort(F.collect_list(F.struct("_i", F.coalesce("value", F.lit("")).alias("v")))).alias("_v")
    )
    shownv = F.concat_ws(" | ", F.transform("_v", lambda s: s["v"]))
    return base.join(lists, "column", "left").select(
        "position", "column", "dtype", "role", F.col("rows").alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"), "missing",
        F.coalesce(shownv, F.lit("")).alias("first_values"),
    )
