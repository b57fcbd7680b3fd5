"""Class balancing: weights, hashed under- and oversampling, and synthetic minority rows."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_key, hash_piece, hash_unit, stratum_counts
from ..functions.roles import as_text, col, require_columns, role_of
from ..session import cut_lineage
from .neighbors import feature_array, nearest

# Seed and neighbour count of the samplers.
SEED = 42
NEIGHBOURS = 5
#: Copies of a row that one task makes at a time.
COPY_CHUNK = 10_000


def class_weights(df: DataFrame, target: str) -> dict[str, float]:
    """Balanced weights ``n / (k * n_c)`` by class text."""
    counts = {c: n for c, n in stratum_counts(df, target).items() if c != "\0"}
    total = sum(counts.values())
    return {c: total / (len(counts) * n) for c, n in counts.items()}


def with_class_weights(df: DataFrame, target: str, out: str = "weight") -> DataFrame:
    """Add the balanced weight of each row's class (map-side lookup of at most a few thousand classes)."""
    weights = class_weights(df, target)
    lookup = df.sparkSession.createDataFrame(list(weights.items()), f"_class string, {out} double")
    joined = df.join(F.broadcast(lookup), as_text(df, target) == F.col("_class"), "left")
    return joined.drop("_class")


def with_positive_weight(df: DataFrame, target: str, out: str = "weight") -> DataFrame:
    """Weight positives by negatives / positives; labels must be 0 and 1."""
    counts = stratum_counts(df, target)
    if set(counts) - {"0", "1", "\0"} or "1" not in counts:
        raise ValueError("labels must be 0 and 1, with at least one 1")
    ratio = counts.get("0", 0) / counts["1"]
    return df.withColumn(out, F.when(col(target) == 1, F.lit(ratio)).otherwise(F.lit(1.0)))


def undersample(df: DataFrame, target: str, key: str, seed: int | str = SEED) -> DataFrame:
    """As many rows of every class as the smallest class has, chosen by hashed key."""
    rows = df.where(col(target).isNotNull())
    counts = stratum_counts(rows, target)
    least = min(counts.values())
    kept = hash_piece(rows, key, target, {c: [least] for c in counts}, seed, "_piece")
    return kept.where("_piece = 0").drop("_piece")


def _copies(df: DataFrame, target: str, key: str, goal: dict[str, int], seed, out: str) -> DataFrame:
    """Spread ``goal`` extra rows evenly over each class: whole shares, the rest by hash rank."""
    counts = stratum_counts(df, target)
    marked = hash_piece(df, key, target, {c: [goal.get(c, 0) % n] for c, n in counts.items()}, seed, "_piece")
    shares = [
        (c, goal.get(c, 0) // n, 1 if goal.get(c, 0) % n else 0) for c, n in counts.items()
    ]
    lookup = df.sparkSession.createDataFrame(shares, "_class string, _share bigint, _odd int")
    joined = marked.join(F.broadcast(lookup), as_text(df, target) == F.col("_class"))
    extra = F.when((F.col("_piece") == 0) & (F.col("_odd") == 1), 1).otherwise(0)
    return joined.withColumn(out, F.col("_share") + extra).drop("_piece", "_class", "_share", "_odd")


def _repeat(rows: DataFrame, number: Column, first: int, most: int) -> DataFrame:
    """Each row ``number`` times, with ``copy`` from ``first`` on.

    Where a row has more than COPY_CHUNK copies, it is dealt to tasks once for each chunk
    of them, and copied there; no array is longer than the chunk or the count of chunks.
    """
    dealt = rows.withColumn("_n", number).where("_n > 0")
    if most <= COPY_CHUNK:
        start, stop = F.lit(first), F.col("_n") + first - 1
        return dealt.withColumn("copy", F.explode(F.sequence(start.cast("bigint"), stop.cast("bigint")))).drop("_n")
    chunks = F.ceil(F.col("_n") / COPY_CHUNK).cast("bigint")
    dealt = dealt.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1)))
    # Without a key the chunks are dealt in turn, whatever rows they belong to.
    dealt = dealt.repartition(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    start = F.col("_chunk") * COPY_CHUNK + first
    stop = F.least(start + COPY_CHUNK, F.col("_n") + first) - 1
    return dealt.withColumn("copy", F.explode(F.sequence(start, stop))).drop("_n", "_chunk")


def oversample(df: DataFrame, target: str, key: str, seed: int | str = SEED) -> DataFrame:
    """Repeat rows until every class has as many as the largest; ``copy`` numbers the repeats from 0."""
    rows = df.where(col(target).isNotNull())
    counts = stratum_counts(rows, target)
    most = max(counts.values())
    spread = _copies(rows, target, key, {c: most - n for c, n in counts.items()}, seed, "_extra")
    return _repeat(spread, F.col("_extra") + 1, 0, max(-(-most // n) for n in counts.values())).drop("_extra")


def _mix(near: DataFrame, bases: DataFrame, key: str, seed, most: int) -> DataFrame:
    """Synthetic points: base plus a hashed share of the way to a hashed choice of neighbour.

    A base meets its few neighbours before it is repeated, so the copies need no join.
    """
    listed = near.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("place", "neighbor_id", F.col("_x").alias("x")))).alias("_near")
    )
    joined = _repeat(bases.where("_extra > 0").join(listed, key), F.col("_extra"), 1, most)
    chosen = F.pmod(hash_key([key, "copy"], f"{seed}:pick"), F.size("_near")).cast("int")
    joined = joined.withColumn("_pick", F.get("_near", chosen)).withColumn(
        "_u", hash_unit([key, "copy"], f"{seed}:step")
    ).drop("_near")
    return joined.withColumn(
        "_new", F.zip_with("_x", "_pick.x", lambda a, b: a + (b - a) * F.col("_u"))
    )


def _assemble(df: DataFrame, made: DataFrame, target: str, features: list[str], key: str) -> DataFrame:
    real = df.select(
        col(key), F.lit(0).cast("bigint").alias("copy"), F.lit(None).cast(df.schema[key].dataType).alias("neighbor_id"),
        *[col(f).cast("double").alias(f) for f in features], col(target),
    )
    fake = made.select(
        col(key), "copy", F.col("_pick.neighbor_id").alias("neighbor_id"),
        *[F.col("_new")[i].alias(f) for i, f in enumerate(features)], col(target),
    )
    return real.unionByName(fake)


def _prepare(df: DataFrame, target: str, features: list[str], key: str) -> DataFrame:
    require_columns(df, [target, key, *features])
    wrong = [f for f in features if role_of(df.schema[f].dataType) != "numeric"]
    if wrong:
        raise TypeError(f"numeric features are needed, not {', '.join(wrong)}")
    return df.where(col(target).isNotNull()).withColumn("_x", feature_array(features))


def smote(
    df: DataFrame, target: str, features: list[str], key: str, k: int = NEIGHBOURS, seed: int | str = SEED
) -> DataFrame:
    """Raise every class to the majority count with points between a row and one of its k class neighbours.

    Result: ``key, copy, neighbor_id, features..., target``; real rows have copy 0.
    """
    rows = _prepare(df, target, features, key)
    counts = stratum_counts(rows, target)
    most = max(counts.values())
    made = None
    text = as_text(df, target)
    for name, n in sorted(counts.items()):
        if n == most:
            continue
        if n < 2:
            raise ValueError(f"class {name!r} has one row and so no neighbour")
        members = rows.where(text == name)
        bases = _copies(members, target, key, {name: most - n}, seed, "_extra")
        asked = bases.where("_extra > 0")
        near = nearest(asked, members, key, key, "_x", min(k, n - 1), True, ["_x"])
        part = _mix(near, bases, key, seed, -(-(most - n) // n))
        made = part if made is None else made.unionByName(part)
    if made is None:
        return _assemble(rows, rows.limit(0).select("*", F.lit(0).alias("copy"), F.struct(
            col(key).alias("neighbor_id")).alias("_pick"), F.col("_x").alias("_new")), target, features, key)
    return _assemble(rows, made, target, features, key)


def adasyn(
    df: DataFrame, target: str, features: list[str], key: str, k: int = NEIGHBOURS, seed: int | str = SEED
) -> DataFrame:
    """Like ``smote``, but rows with more neighbours of other classes get more synthetic points."""
    rows = _prepare(df, target, features, key)
    counts = stratum_counts(rows, target)
    most = max(counts.values())
    made = None
    text = as_text(df, target)
    classed = rows.withColumn("_class", text)
    for name, n in sorted(counts.items()):
        if n == most:
            continue
        members = classed.where(F.col("_class") == name)
        around = nearest(members, classed, key, key, "_x", k, True, ["_class"])
        # Read twice below (total and allotment); the neighbour search behind it runs once.
        hardness = cut_lineage(
            around.groupBy(key).agg((F.count_if(F.col("_class") != name) / F.count(F.lit(1))).alias("_r")))
        total = hardness.agg(F.sum("_r")).first()[0]
        if not total:
            raise ValueError(f"class {name!r} has no neighbours of other classes")
        allotted = hardness.select(key, F.rint(F.col("_r") / total * (most - n)).cast("bigint").alias("_extra"))
        bases = members.join(allotted, key).drop("_class")
        near = nearest(bases.where("_extra > 0"), members, key, key, "_x", min(k, n - 1), True, ["_x"])
        largest = allotted.agg(F.max("_extra")).first()[0] or 0
        part = _mix(near, bases, key, seed, largest)
        made = part if made is None else made.unionByName(part)
    return _assemble(rows, made, target, features, key)


def tomek_links(df: DataFrame, target: str, features: list[str], key: str) -> DataFrame:
    """Pairs of rows of different classes that are each other's nearest neighbour, by both keys."""
    rows = _prepare(df, target, features, key).withColumn("_class", as_text(df, target))
    near = nearest(rows, rows, key, key, "_x", 1, True, ["_class"])
    own = rows.select(col(key), F.col("_class").alias("_own"))
    linked = near.join(own, key).where(F.col("_class") != F.col("_own")).select(key, "neighbor_id")
    back = linked.select(F.col("neighbor_id").alias(key), F.col(key).alias("neighbor_id"))
    # Semi join on both columns keeps the mutual pairs without listing all pairs.
    return linked.join(back, [key, "neighbor_id"], "left_semi")


def remove_tomek_links(df: DataFrame, target: str, features: list[str], key: str) -> DataFrame:
    """Rows that are in no Tomek link."""
    return df.join(tomek_links(df, target, features, key).select(key), key, "left_anti")


def smote_tomek(
    df: DataFrame, target: str, features: list[str], key: str, k: int = NEIGHBOURS, seed: int | str = SEED
) -> DataFrame:
    """``smote`` followed by removal of both members of every Tomek link."""
    # The synthetic rows are read three times below, so they are written once.
    grown = cut_lineage(
        smote(df, target, features, key, k, seed).withColumn(
            "row_id", F.concat_ws(":", col(key).cast("string"), F.col("copy").cast("string"))
        )
    )
    return remove_tomek_links(grown, target, features, "row_id").drop("row_id")


RESAMPLERS = {"smote": smote, "adasyn": adasyn, "smote_tomek": smote_tomek}


def resample(df: DataFrame, target: str, method: str, features: list[str], key: str) -> DataFrame:
    """One of smote, adasyn, undersample, smote_tomek, oversample."""
    if method == "undersample":
        return undersample(df, target, key)
    if method == "oversample":
        return oversample(df, target, key)
    if method not in RESAMPLERS:
        raise ValueError(f"unknown method {method!r}")
    return RESAMPLERS[method](df, target, features, key)


def resample_prepared(df: DataFrame, method: str, key: str) -> DataFrame:
    """``resample`` for rows prepared for a fit (key, ``_label``, ``features``): only ever the part that is fitted on.

    Copies and synthetic rows get keys of their own (``key:copy``, as text).
    """
    if method == "undersample":
        return undersample(df, "_label", key)
    if method == "oversample":
        grown = oversample(df, "_label", key)
        return grown.withColumn(key, F.concat_ws(":", col(key).cast("string"), F.col("copy").cast("string"))).drop("copy")
    size = len(df.select(vector_to_array("features").alias("a")).first()["a"])
    names = [f"_f{i}" for i in range(size)]
    wide = df.select(col(key), "_label", vector_to_array("features").alias("_a"))
    wide = wide.select(col(key), "_label", *[F.col("_a")[i].alias(n) for i, n in enumerate(names)])
    grown = resample(wide, "_label", method, names, key)
    return grown.select(
        F.concat_ws(":", col(key).cast("string"), F.col("copy").cast("string")).alias(key), "_label",
        array_to_vector(F.array(*names)).alias("features"),
    )


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """Rows per class."""
    return df.groupBy(col(target).alias("class")).agg(F.count(F.lit(1)).alias("n"))
