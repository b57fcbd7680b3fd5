"""Imputing, scaling and encoding as fitted, saveable pipeline stages.

Fits of numbers are one-row aggregates, written as literals into ``SQLTransformer``
stages; categories are tables that their stages join (``encoders``).  The fitted pipeline
saves and loads like any other ``pyspark.ml`` pipeline.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.joins import measured
from ..functions.quantiles import quantile_values
from ..functions.ranges import dense_codes
from ..functions.roles import as_text, col, columns_by_role, require_columns, role_of
from .encoders import SideTable, category_codes, code_table, slot_table, smoothed, target_sums, target_table
from .missing import modes, most_frequent

# The code of unseen categories and the text of missing ones.
UNSEEN_CODE = -1
FILL_TEXT = "Unknown"

#: Columns of 0 and 1 that ``one_hot`` adds at most; ``one_hot_vector`` has no such limit.
MAX_ONE_HOT = 5_000
#: Categories whose names are listed in a preparation's slots; the slots of more are numbered.
MAX_NAMED = 5_000
IMPUTERS = ("mean", "median", "most_frequent")
SCALERS = ("standard", "minmax", "robust", "none")
ENCODERS = ("onehot", "ordinal", "target")


def number_sql(value: float) -> str:
    """Double literal for generated SQL."""
    if value is None or math.isnan(value):
        return "cast(null as double)"
    if math.isinf(value):
        return f"double('{'-' if value < 0 else ''}Infinity')"
    return f"{float(value)!r}D"


def name_sql(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def impute_values(df: DataFrame, columns: list[str], strategy: str = "mean") -> dict[str, float | None]:
    """Fill value per numeric column."""
    if strategy not in IMPUTERS:
        raise ValueError(f"unknown strategy {strategy!r}")
    if not columns:
        return {}
    if strategy == "mean":
        row = df.agg(*[F.avg(col(c)).cast("double").alias(f"m{i}") for i, c in enumerate(columns)]).first()
        return {c: row[f"m{i}"] for i, c in enumerate(columns)}
    if strategy == "median":
        return {c: v[0] for c, v in quantile_values(df, columns, [0.5]).items()}
    found = {c: most_frequent(df, c) for c in columns}
    return {c: None if v is None else float(v) for c, v in found.items()}


def impute_numeric(df: DataFrame, columns: list[str], strategy: str = "mean") -> DataFrame:
    fills = impute_values(df, columns, strategy)
    return df.withColumns({c: F.coalesce(col(c).cast("double"), F.lit(v).cast("double")) for c, v in fills.items()})


def impute_categorical(
    df: DataFrame, columns: list[str], strategy: str = "most_frequent", fill: str = FILL_TEXT
) -> DataFrame:
    """Fill with each column's most frequent value, or with a constant."""
    if not columns:
        return df
    found = modes(df, columns) if strategy == "most_frequent" else dict.fromkeys(columns, fill)
    return df.withColumns({c: F.coalesce(col(c), F.lit(fill if v is None else v)) for c, v in found.items()})


def scale_values(df: DataFrame, columns: list[str], method: str = "standard") -> dict[str, tuple[float, float]]:
    """(shift, divisor) per column; a divisor of zero becomes 1."""
    if method not in SCALERS:
        raise ValueError(f"unknown scaler {method!r}")
    if method == "none" or not columns:
        return {c: (0.0, 1.0) for c in columns}
    if method == "robust":
        q = quantile_values(df, columns, [0.25, 0.5, 0.75])
        found = {c: (v[1], None if v[0] is None else v[2] - v[0]) for c, v in q.items()}
    else:
        shift, spread = (F.avg, F.stddev_pop) if method == "standard" else (F.min, None)
        aggs = []
        for i, c in enumerate(columns):
            x = col(c).cast("double")
            wide = spread(x) if spread else F.max(x) - F.min(x)
            # Rounding can leave a tiny deviation on constant input, so the range decides.
            wide = F.when(F.max(x) > F.min(x), wide).otherwise(F.lit(0.0))
            start = F.when(F.max(x) > F.min(x), shift(x)).otherwise(F.min(x))
            aggs += [start.alias(f"a{i}"), wide.alias(f"d{i}")]
        row = df.agg(*aggs).first()
        found = {c: (row[f"a{i}"], row[f"d{i}"]) for i, c in enumerate(columns)}
    return {c: (0.0 if a is None else a, d if d else 1.0) for c, (a, d) in found.items()}


def scale(df: DataFrame, columns: list[str], method: str = "standard") -> DataFrame:
    """Scale numeric columns in place; the fit is one aggregate."""
    fitted = scale_values(df, columns, method)
    return df.withColumns({c: (col(c).cast("double") - F.lit(a)) / F.lit(d) for c, (a, d) in fitted.items()})


def categories(df: DataFrame, columns: list[str], most: int) -> dict[str, list[str]]:
    """Sorted categories per column; more than ``most`` raise, since they become columns."""
    found = {}
    for c in columns:
        values = df.select(as_text(df, c).alias("v")).where("v is not null").distinct().limit(most + 1)
        rows = [r["v"] for r in values.collect()]
        if len(rows) > most:
            raise ValueError(f"{c!r} has more than {most} categories; one_hot_vector has no limit")
        found[c] = sorted(rows, key=lambda v: v.encode())
    return found


def one_hot(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace columns by 0/1 columns ``col_value`` without the first category; unknown gives zeros."""
    found = categories(df, columns, MAX_ONE_HOT)
    made = {}
    for c, values in found.items():
        for v in values[1:]:
            made[f"{c}_{v}"] = F.when(as_text(df, c) == F.lit(v), F.lit(1.0)).otherwise(F.lit(0.0))
    return df.withColumns(made).drop(*columns) if made else df.drop(*columns)


def _one_hot_stages(df: DataFrame, column: str, fill: str | None, index: str, out: str) -> tuple[list, DataFrame, int]:
    """Stages that add ``out``, a sparse one-hot vector without the first category; its codes and their number."""
    codes, n = category_codes(df, column)
    look_up = SideTable.of(slot_table(codes, n), column, fill, [index], [float(max(n - 1, 0))])
    if n < 2:
        return [look_up], codes, n
    every = df.sparkSession.range(n).select(F.col("id").cast("double").alias(index))
    return [look_up, OneHotEncoder(inputCols=[index], outputCols=[out], dropLast=True).fit(every)], codes, n


def one_hot_vector(df: DataFrame, columns: list[str], apply_to: DataFrame | None = None) -> DataFrame:
    """Replace columns by sparse vectors ``col_onehot``, without the first category; unknown gives zeros.

    Any number of categories: they are a joined table, and a vector stores one entry.
    """
    out = df if apply_to is None else apply_to
    for i, c in enumerate(columns):
        stages, _, n = _one_hot_stages(df, c, None, f"_i{i}", f"{c}_onehot")
        if n < 2:
            raise ValueError(f"{c!r} has fewer than two categories")
        out = PipelineModel(stages).transform(out).drop(f"_i{i}")
    return out.drop(*columns)


def ordinal(train: DataFrame, columns: list[str], apply_to: DataFrame | None = None) -> DataFrame:
    """Replace categories by their sorted position in ``train``; unseen and missing give -1.

    Code tables are broadcast when they are measured to be small.
    """
    out = train if apply_to is None else apply_to
    for i, c in enumerate(columns):
        codes = measured(dense_codes(train, c).select(F.col("value").alias(f"_v{i}"), F.col("code").alias(f"_c{i}")))
        joined = out.join(codes, col(c) == F.col(f"_v{i}"), "left")
        coded = F.coalesce(F.col(f"_c{i}"), F.lit(UNSEEN_CODE)).cast("bigint")
        out = joined.withColumn(c, coded).drop(f"_v{i}", f"_c{i}")
    return out


def target_means(df: DataFrame, column: str, target: str) -> DataFrame:
    """``category, n, encoded``: smoothed target mean per category."""
    rows = df.select(as_text(df, column).alias("category"), col(target).cast("double").alias("_t"))
    rows = rows.where("category is not null and _t is not null")
    prior = rows.agg(F.avg("_t")).first()[0]
    groups = rows.groupBy("category").agg(F.avg("_t").alias("_m"), F.count(F.lit(1)).alias("n"))
    value = smoothed(F.col("_m"), F.col("n").cast("double"), F.lit(prior).cast("double"))
    return groups.select("category", "n", value.alias("encoded"))


def target_encode(
    train: DataFrame, columns: list[str], target: str, apply_to: DataFrame | None = None
) -> DataFrame:
    """Replace categories by smoothed target means of ``train``; unseen ones get the global mean."""
    out = train if apply_to is None else apply_to
    prior = train.agg(F.avg(col(target).cast("double"))).first()[0]
    for i, c in enumerate(columns):
        means = target_means(train, c, target)
        table = measured(means.select(F.col("category").alias(f"_k{i}"), F.col("encoded").alias(f"_e{i}")))
        joined = out.join(table, as_text(out, c) == F.col(f"_k{i}"), "left")
        out = joined.withColumn(c, F.coalesce(F.col(f"_e{i}"), F.lit(prior))).drop(f"_k{i}", f"_e{i}")
    return out


@dataclass
class Preprocessor:
    """Fitted preparation: pipeline stages that end in a vector, and the names of its slots."""

    model: PipelineModel
    names: list[str]
    config: dict = field(default_factory=dict)


def _number_sql_of(df: DataFrame, column: str, role: str) -> str:
    """A column as double: seconds for times (those without a zone by their own fields), 0 and 1 for booleans."""
    name = name_sql(column)
    if role != "datetime":
        return f"cast({name} as double)"
    if isinstance(df.schema[column].dataType, T.TimestampType):
        return f"cast(unix_micros({name}) as double) / 1000000D"
    local = f"cast({name} as timestamp_ntz)"
    days = f"cast(unix_date(cast({local} as date)) as double) * 86400D"
    return f"{days} + hour({local}) * 3600 + minute({local}) * 60 + cast(extract(second from {local}) as double)"


def _named_slots(codes: DataFrame, column: str, n: int) -> list[str]:
    """Names of one-hot slots: categories in order, numbers where there are very many."""
    if n > MAX_NAMED:
        return [f"{column}#{j}" for j in range(1, n)]
    found = sorted(codes.where("code > 0").collect(), key=lambda r: r["code"])
    return [f"{column}_{r['category']}" for r in found]


def fit_preprocessor(
    df: DataFrame, features: list[str], impute: str = "mean", scaling: str = "none", encoding: str = "onehot",
    target: str | None = None, out: str = "features", categorical_impute: str = "most_frequent", classes: int = 0,
    sums: DataFrame | None = None, without: int | None = None,
) -> Preprocessor:
    """Fit impute -> scale on numeric and impute -> encode on categorical features, other
    roles (boolean, datetime) passing as numbers, and assemble them to one vector.

    Missing booleans get the more frequent value, missing times the mean.  Categories are
    joined tables (``SideTable``), so there may be any number of them.  Target means have
    one slot, or one for each of more than two ``classes``; ``sums`` (see ``target_sums``)
    spares their pass over the rows, and ``without`` leaves one fold of them out.
    """
    require_columns(df, features)
    if encoding not in ENCODERS:
        raise ValueError(f"unknown encoder {encoding!r}")
    roles = columns_by_role(df.select(*[col(c) for c in features]))
    numeric, texts = roles["numeric"], roles["categorical"]
    if roles["nested"] or roles["other"]:
        raise TypeError(f"cannot use columns {', '.join(roles['nested'] + roles['other'])}")
    if texts and encoding == "target" and target is None:
        raise ValueError("target encoding needs a target")
    made: dict[str, str] = {}
    names: list[str] = []

    fills = impute_values(df, numeric, impute)
    filled = df.withColumns({
        c: F.coalesce(col(c).cast("double"), F.lit(v).cast("double")) for c, v in fills.items()
    }) if numeric else df
    scales = scale_values(filled, numeric, scaling)
    for c in numeric:
        shift, divisor = scales[c]
        value = f"coalesce({_number_sql_of(df, c, 'numeric')}, {number_sql(fills[c] if fills[c] is not None else 0.0)})"
        if scaling != "none":
            value = f"({value} - {number_sql(shift)}) / {number_sql(divisor)}"
        made[f"_f_{c}"] = value
        names.append(c)
    others = {c: _number_sql_of(df, c, role) for role in ("boolean", "datetime") for c in roles[role]}
    if others:
        row = df.selectExpr(*[f"avg({e}) as m{i}" for i, e in enumerate(others.values())]).first()
        for i, (c, e) in enumerate(others.items()):
            mean = row[f"m{i}"] or 0.0
            fill = float(mean > 0.5) if c in roles["boolean"] else mean
            made[f"_f_{c}"] = f"coalesce({e}, {number_sql(fill)})"
            names.append(c)

    numbers = ", ".join(f"{expr} as {name_sql(c)}" for c, expr in made.items())
    stages: list = [SQLTransformer(statement=f"select *, {numbers} from __THIS__")] if numbers else []
    inputs = list(made)
    drop = list(made)
    if texts:
        frequent = modes(df, texts) if categorical_impute == "most_frequent" else {}
        fill = {c: frequent.get(c) or FILL_TEXT for c in texts}
        complete = df.withColumns({c: F.coalesce(col(c), F.lit(fill[c])) for c in texts})
        if encoding == "target" and sums is None:
            sums = target_sums(df, texts, target, classes)
        for c in texts:
            if encoding == "onehot":
                own, codes, n = _one_hot_stages(complete, c, fill[c], f"_i_{c}", f"_f_{c}")
                stages += own
                drop.append(f"_i_{c}")
                if n > 1:
                    inputs.append(f"_f_{c}")
                    drop.append(f"_f_{c}")
                    names += _named_slots(codes, c, n)
                continue
            if encoding == "ordinal":
                codes, _ = category_codes(complete, c)
                outs, state, unseen = [f"_f_{c}"], code_table(codes), [float(UNSEEN_CODE)]
                names.append(c)
            else:
                state, unseen = target_table(sums, c, fill[c], without)
                outs = [f"_f_{c}"] if len(unseen) == 1 else [f"_f_{c}_{k}" for k in range(len(unseen))]
                names += [c] if len(unseen) == 1 else [f"{c}={k}" for k in range(len(unseen))]
            stages.append(SideTable.of(state, c, fill[c], outs, unseen))
            inputs += outs
            drop += outs
    stages.append(VectorAssembler(inputCols=inputs, outputCol=out, handleInvalid="error"))
    cleared = ", ".join(name_sql(c) for c in drop)
    stages.append(SQLTransformer(statement=f"select * except ({cleared}) from __THIS__"))
    config = {"impute": impute, "scaling": scaling, "encoding": encoding, "features": list(features)}
    return Preprocessor(PipelineModel(stages), names, config)


def transformed_preview(df: DataFrame, prepared: Preprocessor, keep: list[str], out: str = "features") -> DataFrame:
    """The assembled vector as named columns beside the kept ones."""
    from pyspark.ml.functions import vector_to_array

    rows = prepared.model.transform(df).withColumn("_a", vector_to_array(F.col(out)))
    return rows.select(*[col(c) for c in keep], *[F.col("_a")[i].alias(n) for i, n in enumerate(prepared.names)])


def numeric_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Numeric form for attribution: datetimes dropped, booleans 0/1, categories coded (-1 missing),
    missing numbers set to the mean and then 0, infinities set to 0."""
    require_columns(df, columns)
    roles = {c: role_of(df.schema[c].dataType) for c in columns}
    out = df.drop(*[c for c in columns if roles[c] == "datetime"])
    texts = [c for c in columns if roles[c] == "categorical"]
    out = ordinal(out, texts) if texts else out
    numbers = [c for c in columns if roles[c] == "numeric"]
    finite = {
        c: F.when(~F.isnan(col(c).cast("double")), col(c).cast("double")) for c in numbers
    }
    out = out.withColumns(finite) if finite else out
    row = out.agg(*[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(numbers)]).first() if numbers else None
    big = F.lit(float("inf"))
    for i, c in enumerate(numbers):
        mean = row[f"m{i}"]
        value = F.coalesce(col(c), F.lit(0.0 if mean is None or math.isnan(mean) else mean))
        out = out.withColumn(c, F.when((value == big) | (value == -big), F.lit(0.0)).otherwise(value))
    for c in columns:
        if roles[c] in ("boolean", "categorical"):
            out = out.withColumn(c, F.coalesce(col(c).cast("double"), F.lit(0.0)))
    return out
