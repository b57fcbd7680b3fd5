"""Long to wide and wide to long."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.roles import as_text, col, require_columns, role_of

MAX_PIVOT_COLUMNS = 10_000
AGGREGATES = {
    "sum": F.sum, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max, "std": F.stddev_samp,
}


def distinct_values(df: DataFrame, column: str, most: int = MAX_PIVOT_COLUMNS) -> list:
    """Sorted distinct non-NULL values that will become column names; too many raise."""
    found = df.select(col(column).alias("v")).where("v is not null").distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{column!r} has more than {most} values to spread over columns")
    return sorted(r["v"] for r in found)


def pivot(
    df: DataFrame, index: list[str], columns: str, values: str, agg: str = "sum", fill=0,
    pivot_values: list | None = None,
) -> DataFrame:
    """One row per index key, one column per value of ``columns``, gaps filled.

    Rows with a NULL key are left out.  The column list is read first (or given), so
    the table is aggregated once, with partial sums before the shuffle.
    """
    require_columns(df, [*index, columns, values])
    if agg not in AGGREGATES:
        raise ValueError(f"unknown aggregate {agg!r}")
    keyed = df.select(*[col(c) for c in dict.fromkeys([*index, columns, values])])
    for key in [*index, columns]:
        keyed = keyed.where(col(key).isNotNull())
    names = distinct_values(keyed, columns) if pivot_values is None else pivot_values
    wide = keyed.groupBy(*[col(c) for c in index]).pivot(columns, names).agg(AGGREGATES[agg](col(values)))
    made = [
        f.name for f in wide.schema.fields[len(index):] if role_of(f.dataType) == "numeric"
    ]
    return wide.na.fill(fill, made) if fill is not None and made else wide


def unpivot(
    df: DataFrame, id_vars: list[str], value_vars: list[str] | None = None,
    var_name: str = "variable", value_name: str = "value",
) -> DataFrame:
    """One row per id and measured column; mixed types are turned into text, NULLs are kept."""
    measured = [c for c in df.columns if c not in id_vars] if value_vars is None else list(value_vars)
    require_columns(df, [*id_vars, *measured])
    if not measured:
        raise ValueError("no value columns")
    roles = {role_of(df.schema[c].dataType) for c in measured}
    mixed = len(roles) > 1 or roles & {"nested", "other"}
    rows = df.select(
        *[col(c) for c in id_vars],
        *[(as_text(df, c) if mixed else col(c)).alias(f"_m{i}") for i, c in enumerate(measured)],
    )
    if len(measured) == 1:
        return rows.select(
            *[col(c) for c in id_vars], F.lit(measured[0]).alias(var_name), F.col("_m0").alias(value_name)
        )
    pairs = [F.col(f"_m{i}").alias(c) for i, c in enumerate(measured)]
    named = rows.select(*[col(c).alias(f"_id{i}") for i, c in enumerate(id_vars)], *pairs)
    long = named.unpivot(
        [F.col(f"_id{i}") for i in range(len(id_vars))], [col(c) for c in measured], "_var", "_val"
    )
    return long.select(
        *[F.col(f"_id{i}").alias(c) for i, c in enumerate(id_vars)],
        F.col("_var").alias(var_name), F.col("_val").alias(value_name),
    )
