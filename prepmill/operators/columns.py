"""Drop, rename, retype, merge and split columns.  All are narrow projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.joins import measured
from ..functions.ranges import dense_codes
from ..functions.roles import INTEGRAL, as_text, col, require_columns, role_of


def drop(df: DataFrame, columns: list[str]) -> DataFrame:
    require_columns(df, columns)
    return df.drop(*columns)


def rename(df: DataFrame, old: str, new: str) -> DataFrame:
    """Rename one column; an unknown old or an existing new name raises."""
    require_columns(df, [old])
    if new.lower() in (c.lower() for c in df.columns if c != old):
        raise ValueError(f"column {new!r} already exists")
    return df.withColumnRenamed(old, new)


def to_datetime(df: DataFrame, column: str) -> DataFrame:
    """Text to a zone-free timestamp, NULL when it does not parse; numbers are nanoseconds."""
    require_columns(df, [column])
    if role_of(df.schema[column].dataType) == "numeric":
        seconds = (col(column) / 1_000_000_000).cast("decimal(18,6)")
        start = F.lit("1970-01-01").cast("timestamp_ntz")
        return df.withColumn(column, start + F.make_dt_interval(secs=seconds))
    return df.withColumn(column, col(column).try_cast("timestamp_ntz"))


def to_integer(df: DataFrame, column: str, on_fraction: str = "null") -> DataFrame:
    """To bigint, NULL when not a number.  Fractions become NULL, ``raise`` or ``truncate``."""
    require_columns(df, [column])
    if on_fraction not in ("null", "raise", "truncate"):
        raise ValueError("on_fraction must be null, raise or truncate")
    value = col(column)
    if isinstance(df.schema[column].dataType, (*INTEGRAL, T.BooleanType)):
        return df.withColumn(column, value.cast("bigint"))
    number = value.try_cast("double")
    whole = number.try_cast("bigint")
    if on_fraction == "null":
        whole = F.when(number == F.floor(number), whole)
    elif on_fraction == "raise":
        broken = F.raise_error(F.concat(F.lit(f"fraction in {column}: "), number.cast("string")))
        whole = F.when(number != F.floor(number), broken.cast("bigint")).otherwise(whole)
    if role_of(df.schema[column].dataType) == "categorical":
        # Long digits keep full precision when the text is a plain integer.
        whole = F.coalesce(value.try_cast("bigint"), whole) if on_fraction == "truncate" else F.coalesce(
            F.when(value.rlike(r"^\s*[+-]?\d+\s*$"), value.try_cast("bigint")), whole
        )
    return df.withColumn(column, whole)


def to_float(df: DataFrame, column: str) -> DataFrame:
    """To double, NULL when not a number or NaN."""
    require_columns(df, [column])
    number = col(column).try_cast("double")
    return df.withColumn(column, F.when(~F.isnan(number), number))


def to_category(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Code 0.. by sorted distinct value, -1 for NULL, as integer column ``out``.

    The dictionary is broadcast when it is measured to be small; otherwise the join
    shuffles and adaptive execution splits hot values.
    """
    require_columns(df, [column])
    name = out or f"{column}_code"
    codes = measured(dense_codes(df, column).withColumnsRenamed({"value": "_value", "code": "_code"}))
    joined = df.join(codes, col(column) == F.col("_value"), "left")
    return joined.withColumn(name, F.coalesce("_code", F.lit(-1)).cast("bigint")).drop("_value", "_code")


def to_boolean(df: DataFrame, column: str, mode: str = "keep_null") -> DataFrame:
    """Numbers are true unless 0, texts unless empty.  ``mode="truthy"`` makes NULL true."""
    require_columns(df, [column])
    role = role_of(df.schema[column].dataType)
    value = col(column)
    if role == "numeric":
        flag = value != 0
    elif role == "boolean":
        flag = value
    elif role == "categorical":
        flag = value != ""
    else:
        flag = F.when(value.isNotNull(), F.lit(True))
    if mode == "truthy":
        flag = F.coalesce(flag, F.lit(True))
    return df.withColumn(column, flag)


def to_text(df: DataFrame, column: str) -> DataFrame:
    """To string; NULL stays NULL."""
    require_columns(df, [column])
    return df.withColumn(column, col(column).cast("string"))


def merge(df: DataFrame, columns: list[str], out: str, sep: str = " ") -> DataFrame:
    """Join the texts of several columns, skipping NULLs."""
    require_columns(df, columns)
    return df.withColumn(out, F.concat_ws(sep, *[as_text(df, c) for c in columns]))


def split(df: DataFrame, column: str, sep: str, outs: list[str]) -> DataFrame:
    """Cut a text at a literal separator into named columns; the last one keeps the rest."""
    require_columns(df, [column])
    literal = "\\Q" + sep.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    parts = F.split(col(column), literal, len(outs))
    return df.withColumns({name: F.get(parts, i) for i, name in enumerate(outs)})


CASTS = {
    "datetime": to_datetime, "integer": to_integer, "float": to_float, "boolean": to_boolean,
    "text": to_text, "category": to_category,
}


