"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_at_exit, scratch_path, ship_package

#: ASCII white space as the contracts write it.
SPACE = r"[\x20\x09-\x0D]+"
#: A key that holds at least one in HOT_SHARE of all rows is hot; so at most HOT_SHARE keys are.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def named(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`")


#: Row groups of written tables of whole texts: a writer holds one in memory.
WIDE_GROUP_BYTES = 32 << 20


def materialise(df: DataFrame, label: str, narrow: bool = False, wide: bool = False) -> DataFrame:
    """Write a table once to the shared folder and read it back.

    This cuts the lineage with files that every executor can read, so a lost executor
    costs only its running tasks, and later steps neither recompute nor reshuffle it.
    With ``narrow`` (tables of a few numbers a row) the last tasks are merged to some for
    each core, so that a small table isn't one tiny file for each shuffle partition; ``wide``
    tables are written in smaller row groups.  The files go when the driver ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = (df.coalesce(4 * spark.sparkContext.defaultParallelism) if narrow else df).write
    (writer.option("parquet.block.size", WIDE_GROUP_BYTES) if wide else writer).parquet(path)
    drop_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def for_python(spark: SparkSession, rows: int = 512) -> None:
    """Prepare a session for Arrow functions of this package.

    Holds Arrow batches to so many rows, as documents may be long, and lets Python workers
    import the package: from its folder where they share it, else as a file Spark ships.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    ship_package(spark)


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Left join of rows with one row per group, safe for groups of any size.

    ``groups`` says in column ``size`` how many rows a group has.  Groups with at least
    1/HOT_SHARE of all rows number at most HOT_SHARE: the hashes of their keys come to the
    driver, and their rows meet them by broadcast.  The rest is shuffled, and no key of
    that shuffle is hot.
    """
    limit = max(1, -(-total // HOT_SHARE))
    mark = F.xxhash64(*[F.col(f"`{k}`") for k in keys])
    hot = [r[0] for r in groups.filter(F.col(size) >= limit).select(mark).distinct().collect()]
    if not hot:
        return rows.join(groups, keys, "left")
    chosen = mark.isin(hot)
    return rows.filter(chosen).join(F.broadcast(groups.filter(chosen)), keys, "left").unionByName(
        rows.filter(~chosen).join(groups.filter(~chosen), keys, "left")
    )


#: Groups joined by broadcast when a count finds no more of them than this (fixed-width rows).
SMALL_GROUPS = 200_000


def join_counted(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Left join of wide rows with materialised groups: broadcast if counted small, else as join_groups."""
    if groups.count() <= SMALL_GROUPS:
        return rows.join(F.broadcast(groups), keys, "left")
    return join_groups(rows, groups, keys, size, total)
