"""Many boosted ensembles grown side by side, for searches over their parameters.

A search fits one ensemble for each fold and combination of depth and step; the number of
rounds needs no fit of its own, as an ensemble of 200 rounds holds those of 50 and 100.
Instead of growing them one after another, with a pass over the data for each level of
each tree, all of them grow their next level in the same pass: a level is one job, whatever
the number of ensembles.

Trees are those of gradient boosting with squared impurity on binned features: the first
tree fits the labels, later ones the loss's residuals (log loss for classes -1 and 1,
squared error for numbers), shrunk by the step.  Rows that agree in all bins, label and
fold are one row with their weight, since no tree can part them; these stay where they are,
as blocks of arrays; a job sends sums by (ensemble, node, slot, bin) to the driver, in pieces of at most
``MAX_CELLS`` numbers, and the driver answers with splits.  A table of one block (at most
``BLOCK_ROWS`` rows) needs no such exchange: each task gets a copy of it and grows some of
the ensembles, by the same steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir, ship_package

#: Bins of a feature, as Spark's trees have by default.
BINS = 32
#: Rows of a block.
BLOCK_ROWS = 16_384
#: Numbers in the sums of one job.
MAX_CELLS = 1 << 23
#: Rounds between reliable checkpoints of the margins.
CHECKPOINT_EVERY = 20
#: Up to so many partitions their sums go straight to the driver, above it through other tasks first.
FLAT_PARTITIONS = 32


@dataclass(frozen=True)
class Ensemble:
    """What is grown: trees of ``depth`` with shrinkage ``step`` on the rows outside ``fold``."""

    fold: int
    depth: int
    step: float
    rounds: int
    #: The class told apart from all others (None for numbers).
    target: int | None


@dataclass
class Trees:
    """The current tree of every ensemble, nodes in heap order; a node without slot is a leaf."""

    slot: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, ensembles: int, depth: int) -> Trees:
        size = (ensembles, (2 << depth) - 1)
        return cls(np.full(size, -1, np.int32), np.zeros(size, np.int16), np.zeros(size))

    def place(self, m: int, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node of ensemble m's tree that each row (slots in columns) reaches within ``depth`` levels."""
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(depth):
            slot = self.slot[m, node]
            inner = slot >= 0
            if not inner.any():
                break
            right = bins[rows, np.maximum(slot, 0)] > self.cut[m, node]
            node = np.where(inner, 2 * node + 1 + right, node)
        return node


@dataclass
class Block:
    """Some rows: bins by preparation, label, fold, weight, table rows and the margins of all ensembles."""

    bins: np.ndarray
    label: np.ndarray
    fold: np.ndarray
    weight: np.ndarray
    count: np.ndarray
    margin: np.ndarray
    #: Weighted residuals that the next trees fit, a row per ensemble; none before the first.
    pull: np.ndarray | None = None

    @classmethod
    def joined(cls, blocks: list[Block]) -> Block:
        """Several blocks before the first round as one."""
        parts = {f: [getattr(b, f) for b in blocks] for f in ("bins", "label", "fold", "weight", "count", "margin")}
        bins = np.concatenate(parts.pop("bins"), axis=1)
        return cls(bins, **{f: np.concatenate(x) for f, x in parts.items()})

    def goal(self, e: Ensemble) -> np.ndarray:
        return self.label if e.target is None else np.where(self.label == e.target, 1.0, -1.0)

    def residual(self, m: int, e: Ensemble) -> np.ndarray:
        goal = self.goal(e)
        if self.pull is None:
            return self.weight * goal
        return self.pull[m]

    def sums(self, ensembles: list[Ensemble], trees: Trees, level: int, wanted: dict[int, np.ndarray]) -> np.ndarray:
        """(node, slot, bin, [weight, residual]) of the wanted nodes, ensemble after ensemble."""
        slots = self.bins.shape[2]
        out = []
        for m, nodes in wanted.items():
            e = ensembles[m]
            use = np.flatnonzero(self.fold != e.fold)
            bins = self.bins[e.fold][use]
            place = trees.place(m, bins, level)
            index = np.full(trees.slot.shape[1], -1, np.int64)
            index[nodes] = np.arange(len(nodes))
            local = index[place]
            live = local >= 0
            use, bins, local = use[live], bins[live], local[live]
            weight = self.weight[use]
            pull = self.residual(m, e)[use]
            part = np.empty((len(nodes), slots, BINS, 2))
            for s in range(slots):
                key = local * BINS + bins[:, s]
                for k, w in enumerate((weight, pull)):
                    part[:, s, :, k] = np.bincount(key, w, len(nodes) * BINS).reshape(-1, BINS)
            out.append(part)
        return np.concatenate(out)

    def moved(self, ensembles: list[Ensemble], trees: Trees, first: bool, live: list[int]) -> Block:
        """The block after a round: margins, and the loss's residuals there."""
        margin, pull = self.margin.copy(), np.zeros((len(ensembles), len(self.label)))
        for m in live:
            e = ensembles[m]
            place = trees.place(m, self.bins[e.fold], e.depth)
            margin[:, m] += (1.0 if first else e.step) * trees.value[m, place]
            goal = self.goal(e)
            if e.target is None:
                pull[m] = 2.0 * self.weight * (goal - margin[:, m])
            else:
                pull[m] = 4.0 * self.weight * goal / (1.0 + np.exp(2.0 * goal * margin[:, m]))
        return Block(self.bins, self.label, self.fold, self.weight, self.count, margin, pull)

    def judged(self, groups: list[tuple[int, list[int]]], classes: int) -> np.ndarray:
        """Per (fold, ensembles of one parameter point): what the score of the held-out rows needs."""
        out = []
        for fold, members in groups:
            held = self.fold == fold
            label, margin, n = self.label[held], self.margin[held][:, members], self.count[held]
            if classes == 0:
                error = label - margin[:, 0]
                out.append(np.array([n.sum(), n @ label, n @ (label * label), n @ (error * error)]))
                continue
            guess = margin.argmax(axis=1) if len(members) > 1 else (margin[:, 0] > 0).astype(np.int64)
            out.append(np.bincount(label.astype(np.int64) * classes + guess, n, classes * classes))
        return np.stack(out)


def vector_of(data: DataFrame, fold: int) -> str:
    """The feature column prepared without a fold's rows, or the one that all folds share."""
    name = f"features_{fold}"
    return name if name in data.columns else "features"


def bin_edges(data: DataFrame, folds: int, only: list[int] | None = None) -> list[list[np.ndarray]]:
    """By preparation and slot (``only`` these have edges): ascending values at which a feature is cut, from the rows that fold trains on."""
    each = [
        F.struct(F.lit(i).alias("i"), vector_to_array(vector_of(data, i)).alias("x")) for i in range(folds)
    ]
    rows = data.select("fold", F.explode(F.array(*each)).alias("p")).filter(F.col("p.i") != F.col("fold"))
    values = rows.select("p.i", F.posexplode("p.x").alias("s", "v"))
    if only is not None:
        values = values.filter(F.col("s").isin(only))
    marks = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    found = values.groupBy("i", "s").agg(
        F.percentile_approx("v", marks, F.lit(10_000)).alias("q"), F.max("v").alias("top")
    ).collect()
    slots = 1 + max((r["s"] for r in found), default=-1)
    edges = [[np.zeros(0)] * slots for _ in range(folds)]
    for r in found:
        values_ = np.unique(r["q"])
        edges[r["i"]][r["s"]] = values_[values_ < r["top"]]
    return edges


def _cells(data: DataFrame, folds: int, weight: str | None, edges: list[list[np.ndarray]]) -> DataFrame:
    """Rows that agree in all bins, label and fold as one: ``key`` (these as bytes), weight, and count of table rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            label, fold, w = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            vectors = [np.stack(batch.column(3 + i).to_numpy(zero_copy_only=False)) for i in range(folds)]
            bins = [
                np.searchsorted(edges[i][s], x[:, s], "left").astype(np.uint8)[:, None]
                for i, x in enumerate(vectors) for s in range(x.shape[1])
            ]
            # Adding 0 makes a negative zero the same bytes as zero.
            ends = [np.ascontiguousarray(v).view(np.uint8).reshape(len(v), 8) for v in (label.astype(float) + 0.0, fold.astype(np.int64))]
            keys, place = np.unique(np.concatenate([*ends, *bins], axis=1), axis=0, return_inverse=True)
            place = place.reshape(-1)
            yield pa.RecordBatch.from_arrays([
                pa.array([k.tobytes() for k in keys], pa.binary()),
                pa.array(np.bincount(place, w.astype(float), len(keys))), pa.array(np.bincount(place, minlength=len(keys)).astype(np.int64)),
            ], ["key", "weight", "n"])

    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = data.select(
        F.col("_label").cast("double"), F.col("fold").cast("bigint"), w.alias("w"),
        *[vector_to_array(vector_of(data, i)).alias(f"x{i}") for i in range(folds)],
    )
    parts = max(data.rdd.getNumPartitions(), data.sparkSession.sparkContext.defaultParallelism)
    found = rows.mapInArrow(each, "key binary, weight double, n bigint").repartition(parts, "key")
    return found.groupBy("key").agg(F.sum("weight").alias("weight"), F.sum("n").alias("n"))


def _blocks(cells: DataFrame, folds: int, slots: int, ensembles: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(start, BLOCK_ROWS)
                weight, n = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (1, 2))
                yield pa.RecordBatch.from_arrays([
                    pa.array([a], pa.binary()) for a in (b"".join(batch.column(0).to_pylist()), weight.tobytes(), n.tobytes())
                ], ["keys", "weight", "n"])

    def block(r) -> Block:
        weight = np.frombuffer(r["weight"])
        keys = np.frombuffer(r["keys"], np.uint8).reshape(len(weight), -1)
        label, fold = (np.ascontiguousarray(keys[:, k : k + 8]).view(kind).reshape(-1) for k, kind in ((0, np.float64), (8, np.int64)))
        bins = np.ascontiguousarray(keys[:, 16:].reshape(len(weight), folds, slots).transpose(1, 0, 2))
        return Block(bins, label, fold, weight, np.frombuffer(r["n"]), np.zeros((len(label), ensembles)))

    # In one order, so that sums do not depend on which task was first.
    packed = cells.sortWithinPartitions("key").mapInArrow(each, "keys binary, weight binary, n binary")
    return packed.rdd.map(block)


def _best_splits(sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per node: slot (-1: none), cut, mean of the node, and the means left and right of the cut."""
    total = sums[:, 0].sum(axis=1)
    left = np.cumsum(sums, axis=2)[:, :, :-1]
    right = total[:, None, None, :] - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[..., 1] ** 2 / left[..., 0] + right[..., 1] ** 2 / right[..., 0] - (total[:, 1] ** 2 / total[:, 0])[:, None, None]
    gain[(left[..., 0] < 1) | (right[..., 0] < 1) | ~np.isfinite(gain)] = -1.0
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(axis=1)
    scale = np.abs(sums[..., 1]).sum(axis=(1, 2)) / sums.shape[1]
    good = flat[np.arange(len(flat)), best] > 1e-12 * np.maximum(scale, 1e-12)
    slot, cut = best // (BINS - 1), best % (BINS - 1)
    at = np.arange(len(flat))
    mean = lambda part: part[:, 1] / np.maximum(part[:, 0], 1e-300)
    return np.where(good, slot, -1), cut, mean(total), mean(left[at, slot, cut]), mean(right[at, slot, cut])


@dataclass
class BoostedSearch:
    """Grows the ensembles of all (fold, depth, step) and scores them after the wanted rounds."""

    data: DataFrame
    folds: int
    classes: int
    weight: str | None = None
    scores: dict[tuple[int, float, int], list[float]] = field(default_factory=dict)

    def run(self, points: list[tuple[int, float, int]]) -> dict[tuple[int, float, int], list[float]]:
        """Score per fold of each point (depth, step, rounds): weighted F1, or R2 for numbers."""
        shared_dir(self.data.sparkSession)
        ship_package(self.data.sparkSession)
        targets: list[int | None] = [None] if self.classes == 0 else [1] if self.classes == 2 else list(range(self.classes))
        shapes = sorted({(d, s) for d, s, _ in points})
        rounds = {k: max(n for d, s, n in points if (d, s) == k) for k in shapes}
        families = [
            [Ensemble(fold, d, s, rounds[d, s], t) for t in targets] for d, s in shapes for fold in range(self.folds)
        ]
        edges = bin_edges(self.data, self.folds)
        cells = _cells(self.data, self.folds, self.weight, edges).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if cells.count() <= BLOCK_ROWS:
                self._one_block(families, cells, len(edges[0]), points)
            else:
                self._many_blocks([e for family in families for e in family], cells, len(edges[0]), points)
        finally:
            cells.unpersist()
        return self.scores

    def _one_block(self, families: list[list[Ensemble]], cells: DataFrame, slots: int, points: list[tuple[int, float, int]]) -> None:
        """A table of one block: its sums are whole sums, so a task with a copy of it grows a family by itself."""
        classes, n = self.classes, len(families)
        blocks = _blocks(cells.coalesce(1), self.folds, slots, len(families[0]))
        copies = blocks.glom().filter(len).flatMap(lambda found: [(k, Block.joined(found)) for k in range(n)])

        def grown(pair: tuple[int, Block]) -> list[tuple[tuple[int, float, int], int, float]]:
            family, block, out = families[pair[0]], pair[1], []
            first = family[0]
            stops = {r for d, s, r in points if (d, s) == (first.depth, first.step)}
            live = list(range(len(family)))
            for number in range(1, first.rounds + 1):
                trees = grow(family, live, lambda *sent, b=block: b.sums(family, *sent))
                block = block.moved(family, trees, number == 1, live)
                if number in stops:
                    facts = block.judged([(first.fold, live)], classes)[0]
                    out.append(((first.depth, first.step, number), first.fold, _score(facts, classes)))
            return out

        found = copies.partitionBy(n, int).flatMap(grown).collect()  # a number per point and fold
        for name, _, score in sorted(found):
            self.scores.setdefault(name, []).append(score)

    def _many_blocks(self, ensembles: list[Ensemble], cells: DataFrame, slots: int, points: list[tuple[int, float, int]]) -> None:
        """All ensembles grow their next level in one pass over the blocks."""
        stops = sorted({n for _, _, n in points})
        blocks = _blocks(cells, self.folds, slots, len(ensembles))
        blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
        flat = blocks.getNumPartitions() <= FLAT_PARTITIONS

        def total(parts):
            return parts.reduce(np.add) if flat else parts.treeReduce(np.add, 3)

        older = None
        try:
            for number in range(1, stops[-1] + 1):
                live = [m for m, e in enumerate(ensembles) if e.rounds >= number]
                trees = grow(ensembles, live, lambda *sent, rows=blocks: total(rows.map(lambda b: b.sums(ensembles, *sent))))
                sent = (ensembles, trees, number == 1, live)
                after = blocks.map(lambda b, sent=sent: b.moved(*sent)).persist(StorageLevel.MEMORY_AND_DISK)
                if number % CHECKPOINT_EVERY == 0:
                    after.checkpoint()
                if number % CHECKPOINT_EVERY == 0 or number in stops:
                    after.count()
                if number in stops:
                    self._judge(after, ensembles, number, points, total)
                if older is not None:
                    older.unpersist()
                older, blocks = blocks, after
        finally:
            blocks.unpersist()
            if older is not None:
                older.unpersist()

    def _judge(self, blocks, ensembles: list[Ensemble], number: int, points: list[tuple[int, float, int]], total) -> None:
        groups, names = [], []
        for d, s, n in points:
            if n != number:
                continue
            for fold in range(self.folds):
                groups.append((fold, [m for m, e in enumerate(ensembles) if (e.depth, e.step, e.fold) == (d, s, fold)]))
                names.append((d, s, n))
        classes = self.classes
        found = total(blocks.map(lambda b: b.judged(groups, classes)))
        for name, facts in zip(names, found, strict=True):
            self.scores.setdefault(name, []).append(_score(facts, classes))


def grow(ensembles: list[Ensemble], live: list[int], sums_of: Callable[..., np.ndarray]) -> Trees:
    """The next tree of every live ensemble, level by level; ``sums_of(trees, level, nodes)`` gives the sums of nodes."""
    deepest = max(ensembles[m].depth for m in live)
    trees = Trees.empty(len(ensembles), deepest)
    wanted = {m: np.zeros(1, np.int64) for m in live}
    slots = None
    for level in range(deepest):
        following: dict[int, np.ndarray] = {}
        for part in _pieces(wanted, slots):
            sums = sums_of(trees, level, part)
            slots = sums.shape[1]
            _split(trees, ensembles, part, sums, level, following)
        wanted = following
        if not wanted:
            break
    return trees


def _pieces(wanted: dict[int, np.ndarray], slots: int | None) -> Iterator[dict[int, np.ndarray]]:
    """Nodes in pieces of at most MAX_CELLS sums (the roots, whose slots are not known yet, together)."""
    each = max(1, MAX_CELLS // (2 * BINS * (slots or 1)))
    piece: dict[int, np.ndarray] = {}
    size = 0
    for m, nodes in wanted.items():
        for start in range(0, len(nodes), each):
            some = nodes[start : start + each]
            if size and size + len(some) > each or m in piece:
                yield piece
                piece, size = {}, 0
            piece[m] = some
            size += len(some)
    if piece:
        yield piece


def _split(
    trees: Trees, ensembles: list[Ensemble], part: dict[int, np.ndarray], sums: np.ndarray, level: int,
    following: dict[int, np.ndarray],
) -> None:
    """Write the best splits of some nodes into the trees, and name the nodes below that go on."""
    slot, cut, mean, low, high = _best_splits(sums)
    at = 0
    for m, nodes in part.items():
        here = slice(at, at + len(nodes))
        at += len(nodes)
        trees.value[m, nodes] = mean[here]
        split = slot[here] >= 0
        inner = nodes[split]
        trees.slot[m, inner], trees.cut[m, inner] = slot[here][split], cut[here][split]
        trees.value[m, 2 * inner + 1], trees.value[m, 2 * inner + 2] = low[here][split], high[here][split]
        if level + 1 < ensembles[m].depth and len(inner):
            below = np.concatenate([2 * inner + 1, 2 * inner + 2])
            following[m] = np.sort(np.concatenate([following.get(m, below[:0]), below]))


def _score(facts: np.ndarray, classes: int) -> float:
    return _r2(facts) if classes == 0 else _weighted_f1(facts.reshape(classes, classes))


def _r2(facts: np.ndarray) -> float:
    n, y, yy, error = facts
    spread = yy - y * y / max(n, 1.0)
    return float(1.0 - error / spread) if spread > 0 else 0.0


def _weighted_f1(pairs: np.ndarray) -> float:
    """From counts by (label, prediction); a zero division counts as 0."""
    support, guessed, hits = pairs.sum(axis=1), pairs.sum(axis=0), np.diag(pairs)
    f1 = np.divide(2 * hits, support + guessed, out=np.zeros(len(pairs)), where=support + guessed > 0)
    return float((f1 * support).sum() / max(support.sum(), 1.0))
