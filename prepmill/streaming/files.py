"""File streams in and out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.roles import nan_to_null

FORMATS = ("csv", "json", "parquet")


def incoming_files(spark: SparkSession, folder: str, schema, fmt: str = "parquet") -> DataFrame:
    """Files as they arrive in a folder; the schema is fixed up front and NaN becomes NULL."""
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format: {fmt}")
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("quote", '"').option("escape", '"')
    return nan_to_null(reader.load(folder))


def write_stream(
    stream: DataFrame, path: str, work: Callable[[DataFrame], DataFrame], checkpoint: str, fmt: str = "parquet",
) -> StreamingQuery:
    """Apply ``work`` (for instance a loaded model's ``transform``) and append the rows as files.

    Processes what is there and stops; run it again with the same ``checkpoint`` folder to
    go on.  With one checkpoint, each input file is written exactly once.
    """
    writer = work(stream).writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start(path)
