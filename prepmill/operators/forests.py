"""Forests grown on rows of equal bins, for tables too large to keep counts and nodes of each row and tree.

Spark's forest keeps two numbers for every row and tree (how often the tree draws the row,
and the node it is in); 100 trees on 30 million rows are over 20 GB of memory or disk.  Its
trees see a row only by its bins (at most 32 a slot), so rows of equal bins, label and
weight are one cell here: a tree draws a cell of n rows as often as it would have drawn
these rows, a Poisson count of mean n.  The cells are few enough to be sent to all tasks;
a task grows whole trees of them, in no more than its own memory.

The trees are Spark's: Gini impurity, a new choice of slots at every node, leaves of one
prediction joined.  They are written in the form of a saved ``RandomForestClassificationModel``
and read back as one.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_at_exit, scratch_path, ship_package

#: Different cells of a table at most; a task holds all of them.
MAX_CELLS = 500_000
#: Numbers in the sums of one step.
MAX_SUMS = 1 << 20
#: Gains below it are rounding.
NO_GAIN = 1e-15
#: Settings that trees of cells know.
KNOWN = {"numTrees", "maxDepth", "minInstancesPerNode", "featureSubsetStrategy", "seed", "cacheNodeIds"}
#: A row of a saved forest's nodes.
SAVED_NODE = (
    "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, "
    "gain: double, leftChild: int, rightChild: int, "
    "split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"
)


@dataclass
class Cells:
    """Different (bins, label, weight) and how many rows have each, in one order whatever the partitions were."""

    bins: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    rows: np.ndarray
    classes: int


def table_cells(train: DataFrame, edges: list[np.ndarray], weight: str | None, classes: int) -> Cells | None:
    """The cells of a table's ``features`` between ``edges``; none if they are more than ``MAX_CELLS``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            label, w = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            bins = [np.searchsorted(e, x[:, s], "left").astype(np.uint8)[:, None] for s, e in enumerate(edges)]
            # Adding 0 makes a negative zero the same bytes as zero.
            ends = [np.ascontiguousarray(v).view(np.uint8).reshape(len(v), 8) for v in (label + 0.0, w + 0.0)]
            whole = np.ascontiguousarray(np.concatenate([*ends, *bins], axis=1))
            keys, n = np.unique(whole.view(f"V{whole.shape[1]}").reshape(-1), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(n.astype(np.int64))], ["key", "n"])

    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = train.select(F.col("_label").cast("double").alias("label"), w.alias("w"), vector_to_array("features").alias("x"))
    parts = rows.mapInArrow(each, "key binary, n bigint")
    found = parts.groupBy("key").agg(F.sum("n").alias("n")).limit(MAX_CELLS + 1).toArrow()
    if found.num_rows > MAX_CELLS or not found.num_rows:
        return None
    keys = found.column("key").to_pylist()
    order = sorted(range(len(keys)), key=keys.__getitem__)
    whole = np.frombuffer(b"".join(keys[i] for i in order), np.uint8).reshape(len(keys), -1)
    ends = np.ascontiguousarray(whole[:, :16]).view(np.float64)
    n = found.column("n").to_numpy()[order]
    kept = ends[:, 1] > 0
    return Cells(whole[kept, 16:], ends[kept, 0].astype(np.int64), ends[kept, 1], n[kept], classes)


@dataclass
class Tree:
    """Nodes of a tree, children behind their parents; a leaf has slot -1."""

    slot: np.ndarray
    cut: np.ndarray
    gain: np.ndarray
    left: np.ndarray
    right: np.ndarray
    stats: np.ndarray
    raw: np.ndarray


def _gini(stats: np.ndarray) -> np.ndarray:
    shares = stats / np.maximum(stats.sum(axis=1, keepdims=True), 1e-300)
    return 1.0 - (shares * shares).sum(axis=1)


def _best_splits(bins, label, weight, draws, local, stats, raw, widths, least, allowed):
    """(slot, cut, gain) of each node; ``local`` is the node of a cell."""
    nodes, classes = stats.shape
    total = stats.sum(axis=1)
    before = (stats * stats).sum(axis=1) / total
    slot, cut, gain = np.full(nodes, -1), np.zeros(nodes, np.int64), np.full(nodes, NO_GAIN)
    for s, width in enumerate(widths):
        if width < 2 or not allowed[:, s].any():
            continue
        at = local * width + bins[:, s]
        left = np.bincount(at * classes + label, weight, nodes * width * classes).reshape(nodes, width, classes).cumsum(axis=1)[:, :-1]
        count = np.bincount(at, draws, nodes * width).reshape(nodes, width).cumsum(axis=1)[:, :-1]
        right = stats[:, None] - left
        low, high = left.sum(axis=2), right.sum(axis=2)
        valid = (count >= least) & (raw[:, None] - count >= least) & allowed[:, s, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            after = (left * left).sum(axis=2) / low + (right * right).sum(axis=2) / high
        won = np.where(valid, (after - before[:, None]) / total[:, None], -1.0)
        best = won.argmax(axis=1)
        top = won[np.arange(nodes), best]
        better = top > gain
        slot[better], cut[better], gain[better] = s, best[better], top[better]
    return slot, cut, gain


def grow_tree(cells: Cells, widths: list[int], depth: int, least: int, pick: int, rng: np.random.Generator) -> Tree:
    """One tree on its own draw of the cells, level by level."""
    draws = rng.poisson(cells.rows).astype(float)
    use = np.flatnonzero(draws)
    if not len(use):  # nothing drawn: as Spark, no tree without rows
        draws, use = cells.rows.astype(float), np.arange(len(cells.rows))
    bins, label, draws = cells.bins[use].astype(np.int64), cells.label[use], draws[use]
    weight, place = draws * cells.weight[use], np.zeros(len(use), np.int64)
    classes, slots, least = cells.classes, len(widths), max(1, least)
    levels, nodes = [], 1
    for level in range(depth + 1):
        stats = np.bincount(place * classes + label, weight, nodes * classes).reshape(nodes, classes)
        raw = np.bincount(place, draws, nodes)
        slot, cut, gain = np.full(nodes, -1), np.zeros(nodes, np.int64), np.full(nodes, -1.0)
        if level < depth:
            allowed = np.ones((nodes, slots), bool)
            if pick < slots:
                allowed = rng.random((nodes, slots)).argsort(axis=1).argsort(axis=1) < pick
            mixed = np.flatnonzero((_gini(stats) > np.finfo(float).eps) & (raw >= 2 * least))
            order = np.argsort(place, kind="stable")
            starts = np.searchsorted(place[order], np.arange(nodes + 1))
            step = max(1, MAX_SUMS // (max(widths, default=1) * classes))
            for i in range(0, len(mixed), step):
                some = mixed[i:i + step]
                index = np.full(nodes, -1)
                index[some] = np.arange(len(some))
                near = order[starts[some[0]]:starts[some[-1] + 1]]
                near = near[index[place[near]] >= 0]
                found = _best_splits(
                    bins[near], label[near], weight[near], draws[near], index[place[near]], stats[some], raw[some], widths,
                    least, allowed[some])
                slot[some], cut[some], gain[some] = found
            gain[slot < 0] = -1.0
        split = slot >= 0
        child = np.where(split, 2 * (np.cumsum(split) - 1), -1)
        levels.append((slot, cut, gain, child, stats, raw))
        if not split.any():
            break
        kept = split[place]
        bins, label, draws, weight, place = bins[kept], label[kept], draws[kept], weight[kept], place[kept]
        place = child[place] + (bins[np.arange(len(place)), slot[place]] > cut[place])
        nodes = 2 * int(split.sum())
    return _numbered(levels)


def _numbered(levels: list[tuple]) -> Tree:
    """The levels as one list of nodes; two leaves of one prediction are a leaf."""
    for (slot, _, gain, child, _, _), (below, *_, stats, _) in zip(levels[-2::-1], levels[:0:-1], strict=True):
        guess, at = stats.argmax(axis=1), np.flatnonzero(slot >= 0)
        low = child[at]
        same = at[(below[low] < 0) & (below[low + 1] < 0) & (guess[low] == guess[low + 1])]
        slot[same], gain[same] = -1, -1.0
    parts, ids, first = [], np.zeros(1, np.int64), 0
    for slot, cut, gain, child, stats, raw in levels:
        slot, cut, gain, child, stats, raw = (a[ids] for a in (slot, cut, gain, child, stats, raw))
        split = slot >= 0
        left = np.where(split, first + len(ids) + 2 * (np.cumsum(split) - 1), -1)
        parts.append((slot, cut, gain, left, np.where(split, left + 1, -1), stats, raw))
        first += len(ids)
        ids = (child[split][:, None] + np.arange(2)).reshape(-1)
        if not len(ids):
            break
    return Tree(*(np.concatenate(a) for a in zip(*parts, strict=True)))


def _node_batch(number: int, tree: Tree, edges: list[np.ndarray]) -> pa.RecordBatch:
    """A tree's nodes as rows of a saved forest."""
    n, inner = len(tree.slot), tree.slot >= 0

    def ends(count: int) -> pa.Array:
        return pa.array(np.arange(n + 1) * count, pa.int32())

    limits = [float(edges[s][c]) for s, c in zip(tree.slot[inner], tree.cut[inner], strict=True)]
    split = pa.StructArray.from_arrays([
        pa.array(tree.slot, pa.int32()),
        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(inner)]), pa.int32()), pa.array(limits, pa.float64())),
        pa.array(np.full(n, -1), pa.int32()),
    ], ["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
    columns = {
        "id": pa.array(np.arange(n), pa.int32()), "prediction": pa.array(tree.stats.argmax(axis=1).astype(float)),
        "impurity": pa.array(_gini(tree.stats)),
        "impurityStats": pa.ListArray.from_arrays(ends(tree.stats.shape[1]), pa.array(tree.stats.reshape(-1))),
        "rawCount": pa.array(tree.raw.astype(np.int64)), "gain": pa.array(tree.gain),
        "leftChild": pa.array(tree.left, pa.int32()), "rightChild": pa.array(tree.right, pa.int32()), "split": split,
    }
    data = pa.StructArray.from_arrays(list(columns.values()), list(columns))
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, number), pa.int32()), data], ["treeID", "nodeData"])


def _facts(kind: str, estimator, uid: str, version: str, **more) -> str:
    """The metadata of a saved model that has the estimator's settings."""
    plain, defaults = ({p.name: v for p, v in m.items()} for m in (estimator._paramMap, estimator._defaultParamMap))
    return json.dumps({
        "class": f"org.apache.spark.ml.classification.{kind}", "timestamp": 0, "sparkVersion": version, "uid": uid,
        "paramMap": plain, "defaultParamMap": defaults, **more})


def fit_cells(cells: Cells, edges: list[np.ndarray], settings: dict, columns: dict, train: DataFrame) -> RandomForestClassificationModel:
    """A forest on cells, as Spark's own model."""
    spark = train.sparkSession
    estimator = RandomForestClassifier(**columns, **settings)
    count, depth, least, seed = (estimator.getOrDefault(p) for p in ("numTrees", "maxDepth", "minInstancesPerNode", "seed"))
    slots, widths = len(edges), [len(e) + 1 for e in edges]
    pick = slots if estimator.getFeatureSubsetStrategy() == "all" else math.ceil(math.sqrt(slots))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                rng = np.random.default_rng([abs(seed), number])
                yield _node_batch(number, grow_tree(cells, widths, depth, least, pick, rng), edges)

    ship_package(spark)
    path = scratch_path(spark, "forest")
    tasks = min(count, 4 * spark.sparkContext.defaultParallelism)
    nodes = spark.range(0, count, 1, tasks).mapInArrow(each, SAVED_NODE)
    nodes.write.parquet(f"{path}/data")
    drop_at_exit(spark, path)
    of_tree = DecisionTreeClassifier(**columns, maxDepth=depth, minInstancesPerNode=least, seed=seed)
    trees = [(i, _facts("DecisionTreeClassificationModel", of_tree, f"{of_tree.uid}_{i}", spark.version), 1.0) for i in range(count)]
    spark.createDataFrame(trees, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    facts = _facts(
        "RandomForestClassificationModel", estimator, estimator.uid, spark.version, numFeatures=slots, numClasses=cells.classes, numTrees=count)
    spark.createDataFrame([(facts,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    model = RandomForestClassificationModel.load(path)
    model.saved_at = path
    return model
