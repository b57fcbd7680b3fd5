"""Encodings of categories whose fitted state is a table, not literals of a plan.

A ``SideTable`` stage joins a text column with a Parquet table (category, values): codes,
slots of a one-hot vector, or target means.  So the number of categories is bounded by
storage only; the table is broadcast where it was measured to be small, else the join is
shuffled and adaptive execution splits hot categories.  The stage saves and loads with the
pipeline it is part of.
"""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import MAX_BROADCAST_BYTES, MAX_BROADCAST_ROWS
from ..functions.ranges import dense_codes
from ..functions.roles import as_text, col
from ..session import cut_lineage, drop_at_exit, scratch_path

# Smoothing of target means.
SMOOTH_AT = 20
SMOOTH_WIDTH = 10

TABLE = "category string, value array<double>"


class SideTable(Model, MLWritable, MLReadable):
    """Adds one column per value of a category's row; unseen categories get ``unseen``."""

    def __init__(self, column: str = "", fill: str | None = None, outs: list[str] | None = None,
                 unseen: list[float] | None = None, path: str = "", rows: int = 0, size: int = 0):
        super().__init__()
        self.column, self.fill, self.outs, self.unseen = column, fill, list(outs or []), list(unseen or [])
        self.path, self.rows, self.size = path, rows, size

    @classmethod
    def of(cls, table: DataFrame, column: str, fill: str | None, outs: list[str], unseen: list[float]) -> SideTable:
        """Write a table (category, value) to the shared folder and measure it."""
        spark = table.sparkSession
        path = scratch_path(spark, "categories")
        table.select("category", "value").write.parquet(path)
        drop_at_exit(spark, path)
        row = spark.read.schema(TABLE).parquet(path).agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("category").cast("bigint")).alias("b")
        ).first()
        return cls(column, fill, outs, unseen, path, row["n"], (row["b"] or 0) + 16 * (1 + len(outs)) * row["n"])

    @property
    def small(self) -> bool:
        return self.rows <= MAX_BROADCAST_ROWS and self.size <= MAX_BROADCAST_BYTES

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(TABLE).parquet(self.path)

    def _transform(self, df: DataFrame) -> DataFrame:
        key, value = f"_k_{self.outs[0]}", f"_v_{self.outs[0]}"
        found = self.table(df.sparkSession).select(F.col("category").alias(key), F.col("value").alias(value))
        text = as_text(df, self.column)
        text = text if self.fill is None else F.coalesce(text, F.lit(self.fill))
        joined = df.join(F.broadcast(found) if self.small else found, text == F.col(f"`{key}`"), "left")
        made = {o: F.coalesce(F.get(F.col(f"`{value}`"), F.lit(j)), F.lit(float(u)))
                for j, (o, u) in enumerate(zip(self.outs, self.unseen, strict=True))}
        return joined.withColumns(made).drop(key, value)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, stage: SideTable):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        s = self.stage
        facts = {"column": s.column, "fill": s.fill, "outs": s.outs, "unseen": s.unseen, "rows": s.rows, "size": s.size}
        DefaultParamsWriter.saveMetadata(s, path, self.sparkSession, extraMetadata={"side": facts})
        s.table(self.sparkSession).write.parquet(f"{path}/table")


class _Reader(MLReader):
    def load(self, path: str) -> SideTable:
        facts = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = SideTable(path=f"{path}/table", **facts["side"])
        stage._resetUid(facts["uid"])
        return stage


def smoothed(mean: Column, n: Column, prior: Column) -> Column:
    """Category mean pulled to the prior for small categories."""
    weight = 1 / (1 + F.exp(-(n - F.lit(SMOOTH_AT)) / F.lit(float(SMOOTH_WIDTH))))
    return prior * (1 - weight) + mean * weight


def category_codes(df: DataFrame, column: str) -> tuple[DataFrame, int]:
    """(category, code) by sorted text from 0, and how many there are."""
    codes = cut_lineage(dense_codes(df.select(as_text(df, column).alias("c")), "c"))
    return codes.select(F.col("value").alias("category"), "code"), codes.count()


def code_table(codes: DataFrame) -> DataFrame:
    return codes.select("category", F.array(F.col("code").cast("double")).alias("value"))


def slot_table(codes: DataFrame, n: int) -> DataFrame:
    """Slots of a one-hot vector that leaves out the first category: it has the last code, which has no slot."""
    slot = F.when(F.col("code") == 0, n - 1).otherwise(F.col("code") - 1)
    return codes.select("category", F.array(slot.cast("double")).alias("value"))


def target_sums(df: DataFrame, columns: list[str], target: str, classes: int = 0, fold: str | None = None) -> DataFrame:
    """(column, fold, category, n, sums): rows and target sums of all columns from one aggregate.

    With more than two ``classes`` there is a sum of each class's indicator.  Category
    means of all but one fold are differences of these, without another pass over rows.
    """
    y = col(target).cast("double")
    parts = [F.when(y == float(k), 1.0).otherwise(0.0) for k in range(classes)] if classes > 2 else [y]
    each = F.array(*[F.struct(F.lit(c).alias("column"), as_text(df, c).alias("category")) for c in columns])
    number = col(fold).cast("int") if fold else F.lit(0)
    rows = df.where(y.isNotNull()).select(number.alias("fold"), F.inline(each), *[p.alias(f"y{k}") for k, p in enumerate(parts)])
    sums = F.array(*[F.sum(f"y{k}") for k in range(len(parts))])
    return cut_lineage(rows.groupBy("column", "fold", "category").agg(F.count(F.lit(1)).alias("n"), sums.alias("sums")))


def target_table(sums: DataFrame, column: str, fill: str | None, without: int | None = None) -> tuple[DataFrame, list[float]]:
    """(category, value) of smoothed means and the priors, from the sums of all folds but one.

    Missing texts count for the category they are filled with.
    """
    mine = sums.where(F.col("column") == column)
    mine = mine if without is None else mine.where(F.col("fold") != without)
    first = sums.select(F.size("sums")).first()
    slots = first[0] if first else 1
    row = mine.agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(slots)]).first()
    priors = [row[f"s{k}"] / row["n"] if row["n"] else 0.0 for k in range(slots)]
    category = F.coalesce("category", F.lit(fill)) if fill is not None else F.col("category")
    groups = mine.groupBy(category.alias("category")).agg(
        F.sum("n").cast("double").alias("n"), *[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(slots)]
    ).where("category is not null")
    values = [smoothed(F.col(f"s{k}") / F.col("n"), F.col("n"), F.lit(p)) for k, p in enumerate(priors)]
    return groups.select("category", F.array(*values).alias("value")), priors
