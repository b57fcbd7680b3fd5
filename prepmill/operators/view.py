"""Looking at rows: sort, slices, samples, projections and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_key, hash_piece
from ..functions.roles import col, require_columns, role_of

TOP_K_ROWS = 100_000
COMPARISONS = (">", "<", ">=", "<=", "==", "!=")


def _order(column: str | None, ascending: bool, keys: list[str], flip: bool = False) -> list[Column]:
    """Sort columns, missing last both ways, ties by the row key.

    ``flip`` gives the exact reverse order.
    """
    out = []
    if column is not None:
        c = col(column)
        if flip:
            out.append(c.desc_nulls_first() if ascending else c.asc_nulls_first())
        else:
            out.append(c.asc_nulls_last() if ascending else c.desc_nulls_last())
    for k in keys:
        out.append(col(k).desc() if flip else col(k).asc())
    return out


def sort(df: DataFrame, column: str, order_by: list[str], ascending: bool = True) -> DataFrame:
    """Whole-table sort: a range shuffle, no single task sees all rows."""
    require_columns(df, [column, *order_by])
    return df.orderBy(*_order(column, ascending, order_by))


def head(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """First ``n`` rows by key (each task keeps only its own top n)."""
    return df.orderBy(*_order(None, True, order_by)).limit(n)


def tail(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """Last ``n`` rows by key, in ascending order."""
    last = df.orderBy(*_order(None, True, order_by, flip=True)).limit(n)
    return last.orderBy(*_order(None, True, order_by))


def sample(df: DataFrame, n: int, key: list[str] | str, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, chosen by a hash of the key: repeatable anywhere.

    A sample to look at is a top-k by hash.  A large one is cut at the exact hash of rank
    ``n`` instead, so that no task has to hold it; both choose the same rows.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if n > TOP_K_ROWS and len(keys) == 1:
        n = min(n, df.count())
        return hash_piece(df, keys[0], None, {"": [n]}, seed, "_piece").where("_piece = 0").drop("_piece")
    ranked = df.withColumn("_h", hash_key(keys, seed))
    return ranked.orderBy("_h", *[col(k) for k in keys]).limit(n).drop("_h")


def view(
    df: DataFrame,
    n: int = 10,
    option: str = "top",
    sort_by: str | None = None,
    ascending: bool = True,
    order_by: list[str] = (),
    seed: int = 42,
) -> DataFrame:
    """Sorted ``top``, ``bottom`` or ``random`` rows, as one top-k plan."""
    if option == "random":
        return sample(df, n, list(order_by), seed)
    if option not in ("top", "bottom"):
        raise ValueError("option must be top, bottom or random")
    forward = _order(sort_by, ascending, list(order_by))
    if option == "top":
        return df.orderBy(*forward).limit(n)
    back = _order(sort_by, ascending, list(order_by), flip=True)
    return df.orderBy(*back).limit(n).orderBy(*forward)


def select(df: DataFrame, columns: list[str]) -> DataFrame:
    require_columns(df, columns)
    return df.select(*[col(c) for c in columns])


def _test(df: DataFrame, column: str, op: str, value, other: str | None) -> Column:
    if op not in COMPARISONS:
        raise ValueError(f"unknown comparison {op!r}")
    require_columns(df, [column] if other is None else [column, other])
    left, left_role = col(column), role_of(df.schema[column].dataType)
    if other is not None:
        right, right_role = col(other), role_of(df.schema[other].dataType)
    else:
        value = as_number(value)
        right = F.lit(value)
        right_role = "categorical" if isinstance(value, str) else "numeric"
        if isinstance(value, bool):
            right_role = "boolean"
        if left_role == "datetime" and isinstance(value, str):
            right, right_role = right.cast(df.schema[column].dataType), "datetime"
    if left_role != right_role:
        raise TypeError(f"cannot compare {left_role} column {column!r} with {right_role}")
    return {
        ">": left > right, "<": left < right, ">=": left >= right,
        "<=": left <= right, "==": left == right, "!=": left != right,
    }[op]


def as_number(value):
    """Text that parses as a number becomes one; anything else is kept."""
    if isinstance(value, str):
        try:
            return float(value)
        except ValueError:
            return value
    return value


def comparison(df: DataFrame, column: str, op: str, value=None, other: str | None = None) -> Column:
    """Boolean mask ``column op value`` or ``column op other``; never NULL.

    Missing cells compare false, except that ``!=`` is true for them.  A constant
    given as text is read as a number when it parses as one.
    """
    return F.coalesce(_test(df, column, op, value, other), F.lit(op == "!="))


def matching_rows(df: DataFrame, column: str, op: str, value=None, other: str | None = None) -> DataFrame:
    """Rows for which the comparison holds."""
    if op == "!=":
        return df.where(comparison(df, column, op, value, other))
    # A filter drops NULL tests by itself, and the bare comparison reaches the file scan.
    return df.where(_test(df, column, op, value, other))
