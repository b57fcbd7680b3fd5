"""Session defaults and the shared folder for checkpoints and scratch tables."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "prepmill", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or get) a session with adaptive execution and UTC time.

    Cluster settings (executors, shuffle partitions, checkpoint folder) belong to
    spark-submit; pass extra ``conf`` only for local runs.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="prepmill-"))
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Have a written scratch path deleted when the driver ends."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives executor loss."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a split of a table that a fit reads many times.
SPLIT_ROWS = 250_000


def spread(df: DataFrame, least_rows: int = 0, passes: bool = True) -> DataFrame:
    """Spread the rows of a table as read evenly over at least all cores before an iterative fit.

    A file may come in many splits and have its rows in a few of them, as a row group is
    read by one task; so the rows of each split are counted, which for Parquet takes the
    files' footers.  A table whose splits are as many as the cores, even and of few rows is
    returned unchanged; a large one gets a split for every ``SPLIT_ROWS`` rows.  With
    ``least_rows`` each split gets at least so many rows, so a small table is left as it is.
    Without ``passes`` the table is read a few times only, and even splits may have any rows.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    sizes = df.select(F.spark_partition_id().alias("split")).groupBy("split").count()
    found = sizes.agg(F.max("count").alias("largest"), F.sum("count").alias("n")).first()
    rows, largest = found["n"] or 0, found["largest"] or 0
    if least_rows:
        cores = min(cores, rows // least_rows)
    wanted = max(cores, -(-rows // SPLIT_ROWS), 1)
    if splits >= cores and largest <= 2 * -(-rows // (wanted if passes else max(cores, 1))):
        return df
    return df.repartition(wanted)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package: from its folder where they share it, else as a file Spark ships."""
    context, package = spark.sparkContext, Path(__file__).resolve().parent
    root = str(package.parent)
    paths = [context.environment.get("PYTHONPATH", ""), os.environ.get("PYTHONPATH", "")]
    if root in os.pathsep.join(paths).split(os.pathsep):
        return
    if context.master.startswith("local"):
        context.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, paths[0]) if x)
    elif context.applicationId not in _SHIPPED:
        folder = tempfile.mkdtemp(prefix="prepmill-")  # the driver's own; Spark serves the file
        context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", root, package.name))
        _SHIPPED.add(context.applicationId)
