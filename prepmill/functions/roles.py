"""Column roles derived from the schema (no job)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROLES = ("numeric", "categorical", "datetime", "boolean", "nested", "other")
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)


def role_of(dtype: T.DataType) -> str:
    """Role of one Spark type; booleans are not numeric."""
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "categorical"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return "nested"
    return "other"


def columns_by_role(df: DataFrame) -> dict[str, list[str]]:
    """``{role: [columns]}`` in schema order; every role is present."""
    found: dict[str, list[str]] = {role: [] for role in ROLES}
    for field in df.schema.fields:
        found[role_of(field.dataType)].append(field.name)
    return found


def numeric_columns(df: DataFrame, exclude: list[str] | tuple[str, ...] = ()) -> list[str]:
    return [c for c in columns_by_role(df)["numeric"] if c not in exclude]


def require_columns(df: DataFrame, names) -> None:
    """Raise when a named column does not exist (Spark drops and renames silently)."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"unknown columns: {', '.join(missing)}")


def col(name: str) -> Column:
    """Column by exact name, also when the name holds dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_text(df: DataFrame, name: str) -> Column:
    """Text form that keeps equality: signed zeros are merged before the cast."""
    dtype = df.schema[name].dataType
    value = col(name)
    if isinstance(dtype, FLOATING):
        value = value + F.lit(0.0).cast(dtype)
    if role_of(dtype) == "nested":
        return F.to_json(value) if not isinstance(dtype, T.ArrayType) else value.cast("string")
    return value.cast("string")


def nan_to_null(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Replace NaN by NULL in float columns, so NULL is the only missing mark."""
    floats = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, FLOATING) and (names is None or f.name in names)
    ]
    return df.withColumns({c: F.when(~F.isnan(col(c)), col(c)) for c in floats}) if floats else df
