"""Scores of many ensembles that are parts of one: forests cut in trees and in depth.

A forest's first trees are a smaller forest, and a tree cut at a depth is the tree that a
smaller depth limit grows.  So one fit of the largest forest holds all smaller ones, and
one pass over held-out rows scores them together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_at_exit, scratch_path, ship_package

#: Different rows scored at a time; bounds the (row, tree) arrays of a task.
SCORE_ROWS = 256
#: The largest category index of a split (one-hot slots have 0 and 1).
MAX_KINDS = 61


@dataclass
class TreeNodes:
    """Nodes of all trees, one after another.  ``value`` is a row per node: class shares, or the mean."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    #: Bits of the category indices that go left; -1 where the split is a threshold.
    left_kinds: np.ndarray

    def votes(self, x: np.ndarray, trees: list[int], depths: list[int]) -> np.ndarray:
        """Sums of values over the first ``trees`` trees cut at ``depths``: (depth, trees, row, value)."""
        node = np.repeat(self.roots[None, :], len(x), axis=0)
        out = np.empty((len(depths), len(trees), len(x), self.value.shape[1]))
        rows = np.arange(len(x))[:, None]
        for depth in range(max(depths) + 1):
            for d in [k for k, limit in enumerate(depths) if limit == depth]:
                for t, n in enumerate(trees):
                    out[d, t] = self.value[node[:, :n]].sum(axis=1)
            inner = self.left[node] >= 0
            if not inner.any():
                for d in [k for k, limit in enumerate(depths) if limit > depth]:
                    for t, n in enumerate(trees):
                        out[d, t] = self.value[node[:, :n]].sum(axis=1)
                break
            seen = x[rows, np.maximum(self.feature[node], 0)]
            kinds = self.left_kinds[node]
            low = np.where(kinds < 0, seen <= self.threshold[node], (kinds >> np.clip(seen, 0, MAX_KINDS).astype(np.int64)) & 1 > 0)
            node = np.where(inner, np.where(low, self.left[node], self.right[node]), node)
        return out

    def alike(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first of the rows that no split parts, and for each row its place among these."""
        codes, inner = x.copy(), self.left >= 0
        for s in range(x.shape[1]):
            mine = inner & (self.feature == s)
            if not (self.left_kinds[mine] >= 0).any():
                codes[:, s] = np.searchsorted(np.unique(self.threshold[mine]), x[:, s], "left")
        _, first, place = np.unique(codes, axis=0, return_index=True, return_inverse=True)
        return first, place.reshape(-1)


def tree_nodes(model, classify: bool) -> TreeNodes:
    """The nodes of a fitted tree or forest, as its saved form lists them."""
    spark = SparkSession.active()
    path = getattr(model, "saved_at", None)
    if path is None:
        path = scratch_path(spark, "trees")
        model.write().save(path)
        drop_at_exit(spark, path)
    saved = spark.read.parquet(f"{path}/data")
    saved = saved.select("treeID", "nodeData.*") if "nodeData" in saved.columns else saved.withColumn("treeID", F.lit(0))
    rows = saved.select(
        "treeID", "id", "prediction", "impurityStats", "leftChild", "rightChild", F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), F.col("split.numCategories").alias("kinds"),
        F.aggregate("split.leftCategoriesOrThreshold", F.lit(0).cast("bigint"), lambda a, c: F.when(
            (F.col("split.numCategories") >= 0) & (c <= MAX_KINDS), a + F.pow(F.lit(2.0), c).cast("bigint")
        ).otherwise(a)).alias("bits"),
    ).toArrow()
    order = np.lexsort((rows["id"].to_numpy(), rows["treeID"].to_numpy()))
    tree, feature, left, right, kinds, bits = (
        rows[c].to_numpy()[order] for c in ("treeID", "feature", "leftChild", "rightChild", "kinds", "bits"))
    if (kinds > MAX_KINDS + 1).any():
        raise ValueError(f"splits on more than {MAX_KINDS + 1} category indices cannot be staged")
    roots = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]]))
    base = np.repeat(roots, np.diff(np.append(roots, len(tree)))).astype(np.int32)
    if classify:
        stats = rows["impurityStats"].combine_chunks().flatten().to_numpy().reshape(len(tree), -1)[order]
        value = stats / np.maximum(stats.sum(axis=1, keepdims=True), 1e-300)
    else:
        value = rows["prediction"].to_numpy()[order][:, None]
    return TreeNodes(
        roots, feature, rows["threshold"].fill_null(0.0).to_numpy()[order],
        np.where(left >= 0, base + left, np.int32(-1)), np.where(right >= 0, base + right, np.int32(-1)), value,
        np.where(kinds >= 0, bits, -1),
    )


def staged_predictions(model, classify: bool, held: DataFrame, stages: list[tuple[int, int]]) -> DataFrame:
    """``model`` (the stage's number as text), ``label, prediction`` of every stage (trees, depth) for every row.

    ``held`` has ``features`` and ``_label``; a forest's classes are decided by the sum of
    its trees' class shares, numbers by their mean, as Spark's own forests do.
    """
    ship_package(held.sparkSession)
    nodes = tree_nodes(model, classify)
    trees, depths = sorted({t for t, _ in stages}), sorted({d for _, d in stages})
    at = [(depths.index(d), trees.index(t)) for t, d in stages]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack(batch.column(0).to_numpy(zero_copy_only=False))
            first, place = nodes.alike(x)
            found = np.empty((len(at), len(first)))
            for start in range(0, len(first), SCORE_ROWS):
                votes = nodes.votes(x[first[start:start + SCORE_ROWS]], trees, depths)
                for k, (d, t) in enumerate(at):
                    guess = votes[d, t].argmax(axis=1) if classify else votes[d, t][:, 0] / trees[t]
                    found[k, start:start + SCORE_ROWS] = guess
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for k in range(len(at)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([str(k)] * len(x)), pa.array(label), pa.array(found[k][place])], ["model", "label", "prediction"])

    rows = held.select(vector_to_array("features").alias("x"), F.col("_label").cast("double").alias("label"))
    return rows.mapInArrow(each, "model string, label double, prediction double")
