"""Exact k nearest neighbours as a partitioned join.

Equal points are one: each distinct point keeps its first few rows by id, and a point is
asked for once, however many rows lie there.  A tree over a sample of the points cuts the
space into cells of bounded size.  Every query is answered in its own cell first; the
distance of its last neighbour there is a ball, and only the cells that this ball reaches
are asked in a second round (the rest cannot hold a nearer point), so the answer stays
exact without comparing all pairs.  Within a cell, leaves of points and of queries with
their boxes are compared nearest first, until no box is near enough.  In many dimensions
boxes exclude little: all is compared with all there, by matrix products that only choose
the pairs whose distance is then summed exactly.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.roles import col, require_columns
from ..session import cut_lineage, ship_package

MAX_CELLS = 16_384
ROWS_PER_CELL = 20_000
QUERY_BLOCK = 20_000
#: Points compared with a leaf of queries at a time.
DATA_BLOCK = 8_192
#: Queries of a leaf; a leaf of points has half as many.
SLICE = 256
#: Up to so many dimensions distances are summed for all pairs at once, above it for chosen ones.
FEW_DIMS = 8
#: Cells and blocks of queries are so many times larger in many dimensions, as each query visits most cells.
WIDE_FACTOR = 6
WIDE_BYTES = 64 << 20
#: Sampled points for each cell, and numbers in the sample at most.
SAMPLE, SAMPLE_NUMBERS = 32, 1 << 22
SLACK = 1e-9


def feature_array(columns: list[str]) -> Column:
    """Numeric columns as one array of doubles."""
    return F.array(*[col(c).cast("double") for c in columns])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length, a row each."""
    if not len(column):
        return np.empty((0, 0))
    values = column.combine_chunks()
    values = pa.concat_arrays(values.chunks) if isinstance(values, pa.ChunkedArray) else values
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass
class Cells:
    """A tree of cuts: node i sends ``x[dim] <= at`` left; leaves have dim -1 and a cell's number in ``left``."""

    dim: np.ndarray
    at: np.ndarray
    left: np.ndarray
    right: np.ndarray
    #: What lies in a cell, by cell and dimension.
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def build(cls, sample: np.ndarray, dims: int, wanted: int) -> Cells:
        nodes: list[list] = []
        lows, highs = [], []

        def grow(rows: np.ndarray, n: int, low: np.ndarray, high: np.ndarray) -> int:
            me = len(nodes)
            nodes.append([-1, 0.0, len(lows), -1])
            spread = rows.max(axis=0) - rows.min(axis=0) if len(rows) > 1 else np.zeros(dims)
            if n < 2 or not spread.max() > 0:
                lows.append(low)
                highs.append(high)
                return me
            dim = int(spread.argmax())
            values = np.sort(rows[:, dim])
            at = values[max(0, len(values) * (n // 2) // n - 1)]
            if at == values[-1]:
                at = values[np.searchsorted(values, at) - 1]
            goes = rows[:, dim] <= at
            inner_high, inner_low = high.copy(), low.copy()
            inner_high[dim] = inner_low[dim] = at
            left = grow(rows[goes], n // 2, low, inner_high)
            right = grow(rows[~goes], n - n // 2, inner_low, high)
            nodes[me] = [dim, float(at), left, right]
            return me

        grow(sample.reshape(-1, dims), wanted, np.full(dims, -np.inf), np.full(dims, np.inf))
        dim, at, left, right = (np.array(x) for x in zip(*nodes, strict=True))
        return cls(dim, at, left, right, np.stack(lows), np.stack(highs))

    def of(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            dim = self.dim[node]
            inner = dim >= 0
            if not inner.any():
                return self.left[node].astype(np.int32)
            goes = x[rows, np.maximum(dim, 0)] <= self.at[node]
            node = np.where(inner, np.where(goes, self.left[node], self.right[node]), node)

    def others(self, x: np.ndarray, home: int, reach: np.ndarray) -> list[np.ndarray]:
        """Cells but ``home`` that a ball around each row of squared radius ``reach`` touches."""
        out = [np.zeros(0, np.int32)] * len(x)
        if len(self.low) < 2:
            return out
        edge = reach * (1.0 + SLACK)
        # A ball that stays within its own cell's cuts touches no other.
        nearest_cut = np.minimum(x - self.low[home], self.high[home] - x).min(axis=1) ** 2
        for i in np.flatnonzero(nearest_cut <= edge):
            gap = np.maximum(np.maximum(self.low - x[i], x[i] - self.high), 0.0)
            near = (gap * gap).sum(axis=1) <= edge[i]
            near[home] = False
            out[i] = np.flatnonzero(near).astype(np.int32)
        return out


def _assign(cells: Cells):
    @F.arrow_udf("int")
    def assign(x: pa.Array) -> pa.Array:
        return pa.array(cells.of(_matrix(pa.chunked_array([x]))), pa.int32()) if len(x) else pa.array([], pa.int32())

    return assign


def _leaves(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows in which leaves of at most ``size`` neighbours follow each other, and where leaves begin."""
    parts, stack = [], [np.arange(len(x))]
    while stack:
        rows = stack.pop()
        if len(rows) <= size:
            parts.append(rows)
            continue
        spread = x[rows].max(axis=0) - x[rows].min(axis=0)
        half = len(rows) // 2
        order = np.argpartition(x[rows, int(spread.argmax())], half)
        stack += [rows[order[half:]], rows[order[:half]]]
    starts = np.cumsum([0, *[len(p) for p in parts]])
    return np.concatenate(parts), starts


def _summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows of ``a`` and ``b`` (broadcast), dimension after dimension."""
    out = (a[..., 0] - b[..., 0]) ** 2
    for j in range(1, a.shape[-1]):
        out += (a[..., j] - b[..., j]) ** 2
    return out


class _Search:
    """The nearest points of leaves of queries: by distance, then by rank."""

    def __init__(self, points: np.ndarray, rank: np.ndarray, take: int):
        self.take = take
        self.order, self.starts = _leaves(points, max(1, SLICE // 2))
        self.points, self.rank = points[self.order], rank[self.order]
        self.low = np.minimum.reduceat(self.points, self.starts[:-1], axis=0)
        self.high = np.maximum.reduceat(self.points, self.starts[:-1], axis=0)
        self.wide = points.shape[1] > FEW_DIMS
        if self.wide:
            self.short = self.points.astype(np.float32)
            self.squares = (self.short.astype(np.float64) ** 2).sum(axis=1)

    def _pairs(self, spots: np.ndarray, at: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, ...]:
        """(query, point, squared distance) of all pairs within the limits that can be among the nearest."""
        if self.wide:
            short = spots.astype(np.float32)
            own = (short.astype(np.float64) ** 2).sum(axis=1)
            # Rounding to single precision and the product's sums are off by less than this.
            off = 16.0 * (spots.shape[1] + 4) * np.finfo(np.float32).eps * (own.max() + self.squares[at].max())
            d2 = self.squares[at].astype(np.float32)[None, :] - 2.0 * (short @ self.short[at].T)
            d2 += own.astype(np.float32)[:, None]
            slack = 2.0 * off if np.isfinite(off) else np.inf
        else:
            d2, slack = _summed(spots[:, None, :], self.points[None, at, :]), 0.0
        if len(at) > self.take and not np.isfinite(limit).all():
            limit = np.minimum(limit, np.partition(d2, self.take - 1, axis=1)[:, self.take - 1])
        rows, cols = np.nonzero(d2 <= (limit + slack)[:, None])
        cols_at = at[cols]
        exact = _summed(spots[rows], self.points[cols_at]) if self.wide else d2[rows, cols]
        return rows, cols_at, exact

    def _best(self, rows, cols, d2) -> tuple[np.ndarray, ...]:
        good = np.isfinite(d2)
        rows, cols, d2 = rows[good], cols[good], d2[good]
        order = np.lexsort((self.rank[cols], d2, rows))
        rows, cols, d2 = rows[order], cols[order], d2[order]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < self.take
        return rows[keep], cols[keep], d2[keep]

    def leaf(self, spots: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, ...]:
        """(query, point, squared distance) in order, for one leaf of queries; farther ones than ``limit`` are left out."""
        low, high = spots.min(axis=0), spots.max(axis=0)
        gap = np.maximum(np.maximum(self.low - high, low - self.high), 0.0)
        bound = (gap * gap).sum(axis=1) * (1.0 - SLACK)
        order = np.argsort(bound, kind="stable")
        rows, cols, d2 = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        limit, done, some = limit.copy(), 0, 4
        while done < len(order) and bound[order[done]] <= limit.max():
            chosen = order[done : done + some]
            done += len(chosen)
            chosen = chosen[bound[chosen] <= limit.max()]
            at = np.concatenate([np.arange(self.starts[c], self.starts[c + 1]) for c in chosen])
            found = self._pairs(spots, at, limit)
            rows, cols, d2 = self._best(*(np.concatenate(x) for x in zip((rows, cols, d2), found, strict=True)))
            last = np.flatnonzero(np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") == self.take - 1)
            limit[rows[last]] = np.minimum(limit[rows[last]], d2[last])
            some = min(2 * some, max(1, 2 * DATA_BLOCK // SLICE))
        return rows, self.order[cols], d2


def _search_cell(cells: Cells, take: int, schema: pa.Schema, first_round: bool):
    """Queries of a cell (or some of them) against its points; see ``nearest`` for the columns."""

    def search(queries: pa.Table, data: pa.Table) -> pa.Table:
        spots = _matrix(queries["q_x"])
        reach = np.full(len(spots), np.inf) if first_round else queries["reach"].to_numpy().astype(float)
        n = len(spots)
        query, point, d2 = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if n and len(data):
            order = pc.array_sort_indices(data["first"].combine_chunks(), null_placement="at_start").to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            index = _Search(_matrix(data["d_x"]), rank, take)
            leaves, starts = _leaves(spots, SLICE)
            parts = []
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                mine = leaves[a:b]
                rows, cols, far = index.leaf(spots[mine], reach[mine])
                parts.append((mine[rows], cols, far))
            query, point, d2 = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(query, kind="stable")
            query, point, d2 = query[order], point[order], d2[order]
        if first_round and len(query):
            # The ball that holds as many rows as are needed.
            held = np.cumsum(data["size"].to_numpy()[point])
            begin = np.searchsorted(query, query, side="left")
            held -= (np.append(0, held)[begin])
            enough = np.flatnonzero(held >= take)
            np.minimum.at(reach, query[enough], d2[enough])
            keep = d2 <= reach[query]
            query, point, d2 = query[keep], point[keep], d2[keep]
        counts = np.bincount(query, minlength=n)
        entries = data["rows"].combine_chunks()
        entries = pa.concat_arrays(entries.chunks) if isinstance(entries, pa.ChunkedArray) else entries
        near = pa.ListArray.from_arrays(
            pa.array(np.append(0, np.cumsum(counts)), pa.int32()),
            pa.StructArray.from_arrays([pa.array(d2), entries.take(pa.array(point))], ["d2", "rows"]))
        columns = {"q": queries["q"], "q_x": queries["q_x"], "near": near}
        if first_round:
            home = int(queries["cell"][0].as_py()) if n else 0
            columns["reach"] = pa.array(reach)
            columns["others"] = pa.array(cells.others(spots, home, reach), pa.list_(pa.int32()))
        return pa.table(columns).select(schema.names).cast(schema)

    return search


def _blocks(asked: DataFrame, placed: DataFrame, sizes: dict[int, int], per_block: int) -> tuple[DataFrame, DataFrame]:
    """Queries and points by ``cell`` and ``block``: a cell with many queries is copied for each block of them."""
    spark = asked.sparkSession
    least = max(1, math.ceil(2 * spark.sparkContext.defaultParallelism / max(1, len(sizes))))
    plan = []
    for r in asked.groupBy("cell").count().collect():  # a row per cell
        pairs = sizes.get(r["cell"], 0) * r["count"]
        plan.append((r["cell"], max(least if pairs > SLICE * SLICE else 1, math.ceil(r["count"] / per_block))))
    plan_df = F.broadcast(spark.createDataFrame(plan, "cell int, blocks int"))
    left = asked.join(plan_df, "cell").withColumn("block", F.pmod(F.xxhash64("q"), "blocks").cast("int")).drop("blocks")
    right = placed.join(plan_df, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return left, right


def _distinct_points(rows: DataFrame, k: int, ids: int) -> DataFrame:
    """One row per point: its first ``ids`` ids (``first`` the smallest), each with up to ``k`` of its rows."""
    by_point = Window.partitionBy("d_x").orderBy("d_id")
    by_id = Window.partitionBy("d_x", "d_id").orderBy(F.lit(0))
    some = rows.withColumn("_r", F.dense_rank().over(by_point)).where(F.col("_r") <= ids)
    some = some.withColumn("_r", F.row_number().over(by_id)).where(F.col("_r") <= k)
    entries = some.groupBy("d_x", "d_id").agg(F.collect_list("d_row").alias("d_rows"))
    return entries.groupBy("d_x").agg(
        F.min_by("d_id", F.struct(F.col("d_id"))).alias("first"), F.count(F.lit(1)).alias("size"),
        F.collect_list(F.struct("d_id", "d_rows")).alias("rows"),
    )


def _whole(vector: str) -> Column:
    """Whether every coordinate is there and finite."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))


def nearest(
    queries: DataFrame, data: DataFrame, query_id: str, data_id: str, vector: str, k: int,
    exclude_self: bool = False, payload: list[str] | tuple[str, ...] = (),
) -> DataFrame:
    """The ``k`` nearest data rows per query: ``query_id, neighbor_id, place, distance, payload...``.

    Euclidean distance over the array column ``vector``; ties go to the smaller id.  Rows
    that lack a coordinate have no neighbours and are none.
    """
    payload = list(payload)
    require_columns(queries, [query_id, vector])
    require_columns(data, [data_id, vector, *payload])
    spark = data.sparkSession
    ship_package(spark)
    rows = data.select(
        col(data_id).alias("d_id"), col(vector).cast("array<double>").alias("d_x"),
        F.struct(F.lit(0).alias("_"), *[col(p).alias(f"p{i}") for i, p in enumerate(payload)]).alias("d_row"),
    )
    asks = queries.select(col(query_id).alias("q_id"), col(vector).cast("array<double>").alias("q_x"))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("d_x")).alias("dims")).first()
    if not facts["n"]:
        raise ValueError("no data rows")
    dims = max(1, facts["dims"] or 1)
    # Without one id, whichever it is, the others must still be k rows.
    ids = k + 1 if exclude_self else k
    points = cut_lineage(_distinct_points(rows.where(_whole("d_x")), k, ids))
    take = ids
    if exclude_self:
        # An id that lies at several points can be left out of as many.
        most = points.select(F.explode("rows").alias("r")).groupBy("r.d_id").count().agg(F.max("count")).first()[0]
        take = k + (most or 1)

    total = points.count()
    wide = dims > FEW_DIMS
    per_cell = max(1, min(WIDE_FACTOR * ROWS_PER_CELL, WIDE_BYTES // (8 * dims))) if wide else ROWS_PER_CELL
    per_block = max(1, min(WIDE_FACTOR * QUERY_BLOCK, WIDE_BYTES // (8 * dims))) if wide else QUERY_BLOCK
    n_cells = max(1, min(MAX_CELLS, math.ceil(total / per_cell), SAMPLE_NUMBERS // (8 * dims)))
    sample = np.zeros((0, dims))
    if n_cells > 1:
        share = min(SAMPLE * n_cells, SAMPLE_NUMBERS // dims) / total
        marks = points.where(F.pmod(F.xxhash64("d_x"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
        sample = np.array([r[0] for r in marks.select("d_x").collect()], dtype=float).reshape(-1, dims)
    cells = Cells.build(sample, dims, n_cells)
    assign = _assign(cells)

    placed = points.withColumn("cell", assign("d_x"))
    sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # a row per cell
    spots = asks.select("q_x").where(_whole("q_x")).distinct().withColumn("q", F.monotonically_increasing_id())
    spots = cut_lineage(spots.withColumn("cell", assign("q_x")))
    near = T.ArrayType(T.StructType([T.StructField("d2", T.DoubleType()), T.StructField("rows", points.schema["rows"].dataType)]))
    base = T.StructType([
        T.StructField("q", T.LongType()), T.StructField("q_x", T.ArrayType(T.DoubleType())), T.StructField("near", near)])
    ball = T.StructType([*base, T.StructField("reach", T.DoubleType()), T.StructField("others", T.ArrayType(T.IntegerType()))])

    def compared(asked: DataFrame, schema: T.StructType, first_round: bool) -> DataFrame:
        left, right = _blocks(asked, placed, sizes, per_block)
        run = _search_cell(cells, take, to_arrow_schema(schema, prefers_large_types=False), first_round)
        return left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInArrow(
            lambda a, b: run(a, b), schema)

    found = compared(spots, ball, True)
    if len(cells.low) > 1:
        home = cut_lineage(found)
        open_ = home.where(F.size("others") > 0)
        away = compared(open_.select("q", "q_x", "reach", F.explode("others").alias("cell")), base, False)
        both = open_.select("q", "q_x", "near").unionByName(away).groupBy("q").agg(
            F.max("q_x").alias("q_x"), F.flatten(F.collect_list("near")).alias("near"))
        found = home.where(F.size("others") == 0).select("q_x", "near").unionByName(both.select("q_x", "near"))
    listed = F.flatten(F.transform("near", lambda p: F.transform(p["rows"], lambda e: F.struct(
        p["d2"].alias("d2"), e["d_id"].alias("d_id"), e["d_rows"].alias("d_rows")))))
    found = found.select("q_x", F.slice(F.array_sort(listed), 1, take).alias("near"))

    mine = asks.join(found, "q_x").select("q_id", "near")
    if exclude_self:
        same = lambda e: F.coalesce(e["d_id"] == F.col("q_id"), F.lit(False))
        mine = mine.select("q_id", F.filter("near", lambda e: ~same(e)).alias("near"))
    each = F.flatten(F.transform("near", lambda e: F.transform(e["d_rows"], lambda r: F.struct(
        e["d2"].alias("d2"), e["d_id"].alias("d_id"), r.alias("r")))))
    mine = mine.select("q_id", F.slice(each, 1, k).alias("near")).where(F.size("near") > 0)
    # Rows that share an id share its k places; more than k of them cannot matter.
    first = Window.partitionBy("q_id").orderBy(F.col("near")[0]["d2"], F.col("near")[0]["d_id"])
    mine = mine.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k)
    mine = mine.groupBy("q_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    out = mine.select("q_id", F.posexplode("near").alias("p", "e"))
    return out.select(
        F.col("q_id").alias(query_id), F.col("e.d_id").alias("neighbor_id"), (F.col("p") + 1).alias("place"),
        F.sqrt("e.d2").alias("distance"), *[F.col("e.r")[f"p{i}"].alias(p) for i, p in enumerate(payload)],
    )


def knn_predict(
    queries: DataFrame, data: DataFrame, key: str, vector: str, label: str, k: int = 5,
    classify: bool = True, exclude_self: bool = False,
) -> DataFrame:
    """``key, prediction``: majority label (ties: smallest) or mean of the k nearest rows."""
    near = nearest(queries, data, key, key, vector, k, exclude_self, [label])
    if not classify:
        return near.groupBy(key).agg(F.avg(col(label)).alias("prediction"))
    votes = near.groupBy(key, label).agg(F.count(F.lit(1)).alias("_n"))
    best = votes.groupBy(key).agg(F.min(F.struct((-F.col("_n")).alias("m"), col(label).alias("l"))).alias("_b"))
    return best.select(key, F.col("_b.l").alias("prediction"))


def knn_probabilities(
    queries: DataFrame, data: DataFrame, key: str, vector: str, label: str, k: int = 5, exclude_self: bool = False,
) -> DataFrame:
    """``key, label, probability``: share of each label among the k nearest rows."""
    near = nearest(queries, data, key, key, vector, k, exclude_self, [label])
    votes = near.groupBy(key, label).agg(F.count(F.lit(1)).alias("_n"))
    totals = near.groupBy(key).agg(F.count(F.lit(1)).alias("_t"))
    return votes.join(totals, key).select(key, label, (F.col("_n") / F.col("_t")).alias("probability"))

