"""Whole-table writers: one directory of part files, written by the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """CSV with a header and no index column; quotes are doubled so texts with newlines survive."""
    writer = df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
    writer.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)
    return path


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """JSON lines; keys of NULL values are kept."""
    writer = df.write.mode(mode).option("ignoreNullFields", False)
    writer.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)
    return path


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    df.write.mode(mode).parquet(path)
    return path


def write_table(df: DataFrame, path: str, fmt: str, mode: str = "errorifexists") -> str:
    """Write as ``csv``, ``json`` or ``parquet``."""
    writers = {"csv": write_csv, "json": write_json, "parquet": write_parquet}
    if fmt not in writers:
        raise ValueError(f"unsupported format: {fmt}")
    return writers[fmt](df, path, mode)
