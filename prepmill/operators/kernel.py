"""Support vector regression: a kernel map by landmarks and an epsilon-insensitive fit.

The RBF kernel is replaced by that of landmark rows (Nystroem): with K the kernel among
landmarks, the map x -> k(x, landmarks) K^(-1/2) has the kernel's values at the landmarks
as dot products.  The fit minimises

    lambda / 2 |w|^2 + mean of max(0, |y - w x - b| - epsilon),   lambda = 1 / (C n),

by Newton steps on a loss whose corners are rounded over a width that shrinks from step to
step.  A pass over the rows sums gradient and curvature in blocks and adds them up in
tasks; the driver solves one system of as many unknowns as the map has slots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

#: Landmark rows, chosen by hash; the sums of a pass hold so many squared.
LANDMARKS = 256
#: Directions of the landmarks' kernel below this share of its largest are left out.
FLAT = 1e-9
#: Widths over which corners are rounded, as shares of the label's deviation.
WIDTHS = tuple(float(w) for w in np.geomspace(1.0, 1e-4, 9))
STEPS = tuple(0.5**k for k in range(12))
MAX_STEPS = 12
BLOCK_ROWS = 4096


class LandmarkMap:
    """Adds ``out``, the landmark features of ``features``."""

    def __init__(self, landmarks: np.ndarray, gamma: float, out: str = "_land"):
        self.landmarks, self.gamma, self.out = np.atleast_2d(landmarks), gamma, out
        values, vectors = np.linalg.eigh(self.kernel(self.landmarks))
        keep = values > FLAT * values.max()
        self.root = vectors[:, keep] / np.sqrt(values[keep])

    def kernel(self, x: np.ndarray) -> np.ndarray:
        far = (x * x).sum(1)[:, None] + (self.landmarks * self.landmarks).sum(1)[None, :] - 2 * x @ self.landmarks.T
        return np.exp(-self.gamma * np.maximum(far, 0.0))

    @classmethod
    def fit(cls, train: DataFrame, gamma: float, size: int = LANDMARKS, seed: int = 42) -> LandmarkMap:
        """Landmarks are the rows of the smallest hashes among different ones."""
        x = vector_to_array("features").alias("x")
        picked = train.select(x).groupBy("x").agg(F.xxhash64("x", F.lit(seed)).alias("h")).orderBy("h").limit(size)
        return cls(np.array([r["x"] for r in picked.collect()], dtype=float), gamma)

    def transform(self, df: DataFrame) -> DataFrame:
        kernel, root = self.kernel, self.root
        ship_package(df.sparkSession)

        @F.pandas_udf("array<double>")
        def mapped(batch: pd.Series) -> pd.Series:
            if not len(batch):
                return pd.Series([], dtype=object)
            return pd.Series(list(kernel(np.stack(batch.to_numpy())) @ root))

        return df.withColumn(self.out, array_to_vector(mapped(vector_to_array("features"))))


def rounded_loss(gap: np.ndarray, epsilon: float, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss of gaps, its slope and its curvature; the corner at epsilon is a parabola of that width."""
    over = np.abs(gap) - epsilon
    inside, bend = over <= 0, (over > 0) & (over < width)
    value = np.where(inside, 0.0, np.where(bend, over * over / (2 * width), over - width / 2))
    slope = np.where(inside, 0.0, np.where(bend, over / width, 1.0)) * np.sign(gap)
    return value, slope, np.where(bend, 1.0 / width, 0.0)


def _sums(block: tuple[np.ndarray, np.ndarray, np.ndarray], w: np.ndarray, epsilon: float, width: float) -> np.ndarray:
    """Weighted gradient and curvature of a block, the curvature in the rows below the gradient."""
    x, y, weight = block
    _, slope, bend = rounded_loss(y - x @ w, epsilon, width)
    return np.concatenate([(-(weight * slope) @ x)[None, :], (x * (weight * bend)[:, None]).T @ x])


def _losses(block: tuple[np.ndarray, np.ndarray, np.ndarray], tries: np.ndarray, epsilon: float, width: float) -> np.ndarray:
    x, y, weight = block
    return np.array([(weight * rounded_loss(y - x @ w, epsilon, width)[0]).sum() for w in tries])


def fit_epsilon(
    rows: DataFrame, vector: str, C: float = 1.0, epsilon: float = 0.1, weight: str | None = None
) -> tuple[np.ndarray, float]:
    """(weights, intercept) of the epsilon-insensitive fit of ``_label`` on a vector column."""
    ship_package(rows.sparkSession)
    one = F.col(weight).cast("double") if weight else F.lit(1.0)
    data = rows.select(vector_to_array(vector).alias("x"), F.col("_label").cast("double").alias("y"), one.alias("w"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK_ROWS):
                part = whole.slice(start, BLOCK_ROWS)
                x = np.stack(part.column(0).to_numpy(zero_copy_only=False))
                x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
                y, w = (part.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (x, y, w)], ["x", "y", "w"])

    def block(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        y = np.frombuffer(r["y"])
        return np.frombuffer(r["x"]).reshape(len(y), -1), y, np.frombuffer(r["w"])

    blocks = data.mapInArrow(pack, "x binary, y binary, w binary").rdd.map(block).persist(StorageLevel.MEMORY_AND_DISK)

    def total(f):
        return blocks.map(f).treeReduce(np.add, 2)

    try:
        facts = total(lambda b: np.array([b[2].sum(), (b[2] * b[1]).sum(), (b[2] * b[1] * b[1]).sum(), b[0].shape[1] * len(b[1]), len(b[1])]))
        n, slots = facts[0], int(round(facts[3] / facts[4]))
        spread = float(np.sqrt(max(facts[2] / n - (facts[1] / n) ** 2, 0.0))) or 1.0
        w = np.zeros(slots)
        w[-1] = facts[1] / n
        ridge = np.full(slots, 1.0 / (C * n))
        ridge[-1] = 0.0  # the intercept is free

        def objective(tries: np.ndarray, width: float) -> np.ndarray:
            return total(lambda b: _losses(b, tries, epsilon, width)) / n + 0.5 * (tries * tries) @ ridge

        for width in (spread * share for share in WIDTHS):
            best = objective(w[None, :], width)[0]
            for _ in range(MAX_STEPS):
                sums = total(lambda b, w=w, width=width: _sums(b, w, epsilon, width)) / n
                gradient, bend = sums[0] + ridge * w, sums[1:] + np.diag(ridge)
                # Where few rows lie in the corner the curvature is flat; a little more keeps the step finite.
                bend += np.eye(slots) * (1e-10 + 1e-8 * np.trace(bend) / slots)
                step = np.linalg.solve(bend, gradient)
                tries = np.stack([w - s * step for s in STEPS])
                found = objective(tries, width)
                k = int(found.argmin())
                if not found[k] < best - 1e-12 * max(abs(best), 1e-12):
                    break
                done = best - found[k] < 1e-9 * max(abs(best), 1e-12)
                w, best = tries[k], found[k]
                if done:
                    break
        return w[:-1], float(w[-1])
    finally:
        blocks.unpersist()


class LinearScore:
    """``prediction`` as weights times a vector column plus intercept."""

    def __init__(self, weights: np.ndarray, intercept: float, vector: str):
        self.weights, self.intercept, self.vector = np.asarray(weights, float), intercept, vector

    def transform(self, df: DataFrame) -> DataFrame:
        products = F.zip_with(vector_to_array(self.vector), F.lit(self.weights.tolist()), lambda a, b: a * b)
        return df.withColumn("prediction", F.aggregate(products, F.lit(self.intercept), lambda a, x: a + x))
