"""Table readers.  NaN becomes NULL on load, so NULL is the one missing mark."""

from __future__ import annotations

import csv
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.roles import nan_to_null
from ..operators.view import matching_rows

# The separators that are tried, first ones first among equals.
SEPARATORS = (",", ";", "\t", "|")


def validate(df: DataFrame) -> DataFrame:
    """Return ``df``; raise when it has no columns or no rows."""
    if not df.columns:
        raise ValueError("the table has no columns")
    if df.isEmpty():
        raise ValueError("the table has no rows")
    return df


@dataclass
class CsvKind:
    """How a file is read, and the names in its header."""

    utf8: bool
    breaks: bool
    sep: str
    names: tuple[str, ...] | None

    @property
    def encoding(self) -> str:
        return "UTF-8" if self.utf8 else "ISO-8859-1"


def _csv_kinds(spark: SparkSession, path: str, sep: str | None) -> dict[str, CsvKind]:
    """Each file's encoding, quoted line breaks and separator, from one aggregate over all lines, and their headers.

    A line break inside quotes leaves an odd number of quotes on its line.  Separators are
    counted outside quotes; of those that the file's first line has, the one wins that most
    lines have as often as the first line.  Compressed files are read as Spark reads them.
    """
    line = F.regexp_replace("value", "^\ufeff", "")
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), line.alias("line"),
        # Numbers of lines rise within a split, and a file's first line is in the split that starts it.
        F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id()).alias("at"),
    ).where(F.trim("line") != "")
    bare = F.regexp_replace("line", '"[^"]*("|$)', "")
    counts = [
        F.struct(F.lit(s).alias("sep"), (F.length("bare") - F.length(F.replace("bare", F.lit(s)))).alias("c")) for s in SEPARATORS
    ]
    quotes = F.octet_length("line") - F.octet_length(F.replace("line", F.lit('"')))
    # Sums of numbers and flags alone are kept by hash; a line's text among them would have all lines sorted.
    # So a file's first line is known by its hash here, and its text is looked up afterwards.
    odd = quotes % 2 == 1
    known = lines.select(
        "file", "at", F.is_valid_utf8("value").alias("utf8"), odd.alias("odd"), bare.alias("bare"), F.xxhash64("value").alias("mark"),
    )
    each = known.select("*", F.inline(F.array(*counts))).groupBy("file", "sep", "c").agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.min("utf8").alias("utf8"), F.max("odd").alias("breaks"),
        F.min_by("mark", "at").alias("mark"),
    )
    voted = each.groupBy("file", "sep").agg(
        F.min_by(F.struct("c", "n", "mark"), "first").alias("top"), F.min("utf8").alias("utf8"), F.max("breaks").alias("breaks")
    )
    rank = F.struct(
        (F.col("top.c") > 0).alias("there"), F.when(F.col("top.c") > 0, F.col("top.n")).alias("n"),
        F.when(F.col("top.c") > 0, F.col("top.c")).alias("c"),
        (-F.array_position(F.array(*map(F.lit, SEPARATORS)), F.col("sep"))).alias("order"),
    )
    found = voted.groupBy("file").agg(
        F.max_by("sep", rank).alias("sep"), F.min("utf8").alias("utf8"), F.max("breaks").alias("breaks"),
        F.first("top.mark").alias("mark"),
    )
    rows = found.collect()  # one row per file, as the driver's own file listing has
    marks = spark.createDataFrame([(r["file"], r["mark"]) for r in rows], "file string, mark bigint")
    # Equal lines are one before the first of them is taken: a file may hold its first line many times.
    same = lines.where("at is not null").select(
        "file", "at", F.xxhash64("value").alias("mark"), odd.alias("odd"), F.col("value").cast("binary").alias("head"),
    ).join(F.broadcast(marks), ["file", "mark"])
    heads = same.groupBy("file", "head", "odd").agg(F.min("at").alias("at")).groupBy("file").agg(
        F.min_by(F.struct("head", "odd"), "at").alias("head"))
    first = {r["file"]: r["head"] for r in heads.collect()}
    kinds = {}
    for row in rows:
        kind = CsvKind(row["utf8"], row["breaks"], sep or row["sep"], None)
        head = first[row["file"]]
        if not head["odd"]:  # else the header itself spans lines
            text = bytes(head["head"]).decode("utf-8" if kind.utf8 else "latin-1").removeprefix("\ufeff")
            kind.names = tuple(next(csv.reader([text], delimiter=kind.sep)))
        kinds[unquote(row["file"])] = kind
    return kinds


def _check_names(kinds: dict[str, CsvKind]) -> None:
    """Raise if files disagree on their columns: by position, values would land in others."""
    named = {file: k.names for file, k in kinds.items() if k.names is not None}
    for file, names in named.items():
        first = min(named)
        if names != named[first]:
            raise ValueError(f"columns differ: {first} has {list(named[first])}, {file} has {list(names)}")


def _base(spark: SparkSession, path: str) -> str | None:
    """The folder below which folder names are partition columns; Spark takes no more than one."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folders = [s.getPath().toString() for s in system.globStatus(where) or [] if s.isDirectory()]
    return folders[0] if len(folders) == 1 else None


def _partition_fields(spark: SparkSession, path: str) -> list[T.StructField]:
    """The columns that the folder names below ``path`` give, with the types that all of them together have."""
    return spark.read.text(path).schema.fields[1:]


def _common_schema(schemas: list[T.StructType]) -> T.StructType:
    """The schema that every file group can be read with."""
    ranks = {"int": 0, "bigint": 1, "double": 2}
    fields = []
    for parts in zip(*[s.fields for s in schemas], strict=True):
        kinds = [p.dataType for p in parts]
        names = {k.simpleString() for k in kinds}
        if len(names) == 1:
            best = kinds[0]
        elif names <= set(ranks):
            best = max(kinds, key=lambda k: ranks[k.simpleString()])
        else:
            best = T.StringType()
        fields.append(T.StructField(parts[0].name, best))
    return T.StructType(fields)


def _as_struct(spark: SparkSession, schema) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else spark.createDataFrame([], schema).schema


def _with_folders(schema: T.StructType, folders: list[T.StructField]) -> T.StructType:
    """The schema with the partition columns that it does not name itself."""
    known = {f.name.lower() for f in schema.fields}
    return T.StructType([*schema.fields, *[f for f in folders if f.name.lower() not in known]])


def read_csv(
    spark: SparkSession,
    path: str,
    schema=None,
    sep: str | None = None,
    encoding: str | None = None,
    row_id: str | None = None,
    nan_as_null: bool = True,
    multi_line: bool | None = None,
) -> DataFrame:
    """CSV with a header.

    Separator, encoding and quoted line breaks are decided for each file from all its
    lines, in one scan and a look at their first lines: a file with any byte sequence that is not UTF-8 is Latin-1, and
    only files in which a quoted field spans lines are read by one task each; the others
    are split.  Files of one table may differ in all of these, but not in their columns.
    Give ``sep``, ``encoding`` and ``multi_line`` to save that scan, and ``schema`` to
    save the inference.
    """
    if sep is not None and encoding is not None and multi_line is not None:
        groups = {(encoding, multi_line, sep): None}
    else:
        groups = {}
        kinds = _csv_kinds(spark, path, sep)
        _check_names(kinds)
        for file, kind in kinds.items():
            key = (encoding or kind.encoding, kind.breaks if multi_line is None else multi_line, kind.sep)
            groups.setdefault(key, []).append(file)
        if len(groups) <= 1:  # the path itself keeps partition columns
            groups = {key: None for key in groups} or {("UTF-8", False, sep or SEPARATORS[0]): None}

    def read(key: tuple[str, bool, str], files: list[str] | None, given, base: str | None = None) -> DataFrame:
        reader = spark.read.option("header", True).option("sep", key[2]).option("encoding", key[0])
        reader = reader.option("quote", '"').option("escape", '"').option("multiLine", key[1])
        reader = reader.schema(given) if given is not None else reader.option("inferSchema", True)
        reader = reader.option("basePath", base) if base else reader
        return reader.csv(files or path)

    if len(groups) == 1 and None in groups.values():
        return _finish(read(next(iter(groups)), None, schema), row_id, nan_as_null)
    base, folders = _base(spark, path), _partition_fields(spark, path)
    given = _with_folders(_as_struct(spark, schema), folders) if schema is not None else None
    parts = [read(key, files, given, base) for key, files in groups.items()]
    if schema is None and (folders or len({p.schema.simpleString() for p in parts}) > 1):
        names = {f.name for f in folders}
        own = [T.StructType([f for f in p.schema.fields if f.name not in names]) for p in parts]
        given = _with_folders(_common_schema(own), folders)
        parts = [read(key, files, given, base) for key, files in groups.items()]
    return _finish(reduce(DataFrame.unionByName, parts), row_id, nan_as_null)


def _json_files(spark: SparkSession, path: str) -> dict[bool, list[str]]:
    """Files by (one JSON value spans lines or is an array), from one aggregate over all lines.

    Where one value spans lines, a line that ends with a bracket is never followed by one
    that starts with one, but for a comma between them.  So of n lines at most n + 1 starts
    and ends are brackets, and a file with more holds a record on each line, even if some
    of its lines are broken.
    """
    line = F.trim("value", F.lit(" \t\r\ufeff"))
    lines = spark.read.text(path).select(line.alias("line"), F.col("_metadata.file_path").alias("file")).where("line <> ''")
    starts = lambda *marks: reduce(lambda x, y: x | y, [F.col("line").startswith(m) for m in marks])
    ends = lambda *marks: reduce(lambda x, y: x | y, [F.col("line").endswith(m) for m in marks])
    opens, closes = starts("{", "["), ends("}", "]")
    found = lines.groupBy("file").agg(
        F.count(F.lit(1)).alias("n"), F.sum(opens.cast("long") + closes.cast("long")).alias("brackets"),
        F.min(starts("{") & ends("}")).alias("records"),
    )
    kinds: dict[bool, list[str]] = {}
    for row in found.collect():  # one row per file, as the driver's own file listing has
        kinds.setdefault(not (row["records"] or row["brackets"] > row["n"] + 1), []).append(unquote(row["file"]))
    return kinds


def _widened(a: T.DataType, b: T.DataType, keep: bool = False) -> T.DataType:
    """The type that Spark infers for JSON values of both types; with ``keep`` only fields missing in ``a`` are added."""
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        fields = {f.name: f.dataType for f in a.fields}
        for f in b.fields:
            fields[f.name] = _widened(fields[f.name], f.dataType, keep) if f.name in fields else f.dataType
        return T.StructType([T.StructField(n, fields[n]) for n in sorted(fields)])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(_widened(a.elementType, b.elementType, keep))
    if keep or a == b:
        return a
    kinds = [T.DecimalType(20, 0) if isinstance(k, T.LongType) else k for k in (a, b)]
    if all(isinstance(k, T.DecimalType) for k in kinds):
        scale = max(k.scale for k in kinds)
        digits = max(k.precision - k.scale for k in kinds) + scale
        return T.DecimalType(digits, scale) if digits <= 38 else T.DoubleType()
    numbers = (T.DecimalType, T.DoubleType)
    return T.DoubleType() if all(isinstance(k, numbers) for k in kinds) else T.StringType()


def read_json(
    spark: SparkSession,
    path: str,
    schema=None,
    multi_line: bool | None = None,
    row_id: str | None = None,
    nan_as_null: bool = True,
) -> DataFrame:
    """JSON records: lines, which are split, or arrays, one task per file.

    Unless ``multi_line`` says so, this is decided for each file from all its lines, in
    one scan, and the two kinds of files are read apart.
    """
    kinds = _json_files(spark, path) if multi_line is None else {multi_line: []}

    def read(many: bool, files: list[str] | None = None, given=None, base: str | None = None, **options) -> DataFrame:
        reader = spark.read.options(multiLine=many, **options)
        reader = reader.schema(given) if given is not None else reader
        reader = reader.option("basePath", base) if base else reader
        return reader.json(files or path)

    if len(kinds) <= 1:  # the path itself keeps partition columns
        return _finish(read(next(iter(kinds), False), given=schema), row_id, nan_as_null)
    base, folders = _base(spark, path), _partition_fields(spark, path)
    if schema is None:
        # Fields without a value in one kind of files take their type from the other.
        filled = reduce(_widened, [read(m, f, base=base, dropFieldIfAllNull=True).schema for m, f in kinds.items()])
        whole = reduce(lambda a, b: _widened(a, b, True), [read(m, f, base=base).schema for m, f in kinds.items()], filled)
        names = {f.name for f in folders}
        given = T.StructType([f for f in whole.fields if f.name not in names])
    else:
        given = _as_struct(spark, schema)
    parts = [read(many, files, _with_folders(given, folders), base) for many, files in kinds.items()]
    return _finish(reduce(DataFrame.unionByName, parts), row_id, nan_as_null)


def read_parquet(
    spark: SparkSession, path: str, row_id: str | None = None, nan_as_null: bool = True,
    where: tuple[str, str, object] | None = None,
) -> DataFrame:
    """Parquet, all rows or those for which the comparison ``where`` (column, op, value) holds.

    A float filter on the table as returned cannot reach the file scan, as it must not see
    NaN.  ``where`` is tested twice instead: on the raw column, where it prunes files and
    row groups (NaN counts as largest there, so no row is lost), and on the result, where
    missing cells compare as everywhere.  ``!=`` prunes nothing, as it is true for missing
    cells.  ``nan_as_null=False``, for tables known to hold no NaN, lets any filter through.
    """
    df = spark.read.parquet(path)
    if where is None:
        return _finish(df, row_id, nan_as_null)
    column, op, value = where
    # Row ids are given before rows are left out, so they do not depend on the filter.
    df = _finish(df, row_id, False)
    raw = df if op == "!=" else matching_rows(df, column, op, value)
    return matching_rows(nan_to_null(raw), column, op, value) if nan_as_null else matching_rows(raw, column, op, value)


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """Read by file extension and validate; unknown extensions raise."""
    lower = path.lower().rstrip("/")
    for ending, reader in ((".csv", read_csv), (".json", read_json), (".parquet", read_parquet)):
        if lower.endswith(ending):
            return validate(reader(spark, path, **options))
    raise ValueError(f"unsupported file format: {path}")


def _finish(df: DataFrame, row_id: str | None, nan_as_null: bool) -> DataFrame:
    if row_id:
        df = df.withColumn(row_id, F.monotonically_increasing_id())
    return nan_to_null(df) if nan_as_null else df


def check_features(df: DataFrame, features: list[str]) -> tuple[list[str], list[str]]:
    """(missing, extra) columns of a scoring table; raise when a feature is missing."""
    missing = [f for f in features if f not in df.columns]
    extra = [c for c in df.columns if c not in features]
    if missing:
        raise ValueError(f"missing features: {', '.join(missing)}")
    return missing, extra
