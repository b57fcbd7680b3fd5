"""Readers and writers for CSV, JSON and Parquet tables."""

from .readers import check_features, read_csv, read_json, read_parquet, read_table, validate
from .writers import write_csv, write_json, write_parquet, write_table

__all__ = [
    "check_features", "read_csv", "read_json", "read_parquet", "read_table", "validate",
    "write_csv", "write_json", "write_parquet", "write_table",
]
