"""Document fingerprints by winnowing.

A text's grams are its runs of GRAM code points, hashed by a rolling polynomial.  Of every
WINDOW grams in a row the smallest hash is chosen, the rightmost of equal ones, and kept
with its position.  So two texts that share a passage of GRAM + WINDOW - 1 code points
share a fingerprint inside it, and shared runs of fewer than GRAM code points go unseen.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import with_range_bucket
from .common import for_python, named, text_of
from .shingles import mix, powers

#: Code points of a gram: shorter matches count as chance.
GRAM = 20
#: Grams of a window: a shared passage of GRAM + WINDOW - 1 = 40 code points is always found.
WINDOW = 21
#: Code points hashed at a time; bounds the working arrays whatever a text's length.
SLICE = 1 << 18

_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
Prints = tuple[np.ndarray, np.ndarray]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """The rolling hash of each run of ``gram`` code points; a shorter text is one gram."""
    size = min(gram, len(codes))
    if not size:
        return np.zeros(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(
        (codes.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(codes))
    )])
    return mix((total[size:] - total[:-size]) * powers(_INVERSE, len(codes))[: len(codes) - size + 1] + np.uint64(size))


def window_minima(hashes: np.ndarray, window: int) -> np.ndarray:
    """Where the smallest of each ``window`` hashes in a row is (rightmost of equals), by doubling spans."""
    at, span = np.arange(len(hashes)), 1
    best = hashes
    while span < window:
        step = min(span, window - span)
        right = best[step:] <= best[:-step]
        at = np.where(right, at[step:], at[:-step])
        best = np.where(right, best[step:], best[:-step])
        span += step
    return at


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> Prints:
    """Positions (code points from 0, ascending) and hashes of a text's chosen grams.

    A text of fewer than ``window`` grams is one window, one of fewer than ``gram`` code
    points is one gram, the empty text has none.  Long texts are read in slices that
    overlap by all but one window, so the choice is that of the whole text.
    """
    found: list[Prints] = []
    step = SLICE - gram - window + 2
    for start in range(0, max(1, len(text) - gram - window + 2), step):
        hashes = gram_hashes(_codes(text[start : start + SLICE]), gram)
        if len(hashes):
            at = window_minima(hashes, min(window, len(hashes)))
            at = at[np.concatenate([[True], at[1:] != at[:-1]])]
            found.append((at + start, hashes[at]))
    if len(found) == 1:
        return found[0]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, first = np.unique(np.concatenate([p for p, _ in found]), return_index=True)
    return at, np.concatenate([h for _, h in found])[first]


def winnow_all(texts: list[str], gram: int = GRAM, window: int = WINDOW) -> list[Prints]:
    """``winnow`` of each text; texts of ordinary length are hashed together."""
    out: list[Prints] = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))] * len(texts)
    least = gram + window - 1
    group: list[int] = []
    size = 0

    def settle() -> None:
        lengths = np.array([len(texts[k]) for k in group])
        starts = np.cumsum(lengths) - lengths
        hashes = gram_hashes(_codes("".join([texts[k] for k in group])), gram)
        at = window_minima(hashes, window)
        # Windows that lie inside one text; the others would mix two.
        valid = np.zeros(len(at) + 1, np.int64)
        np.add.at(valid, starts, 1)
        np.add.at(valid, np.minimum(starts + lengths - least + 1, len(at)), -1)
        at = at[np.cumsum(valid[:-1]) > 0]
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
        cuts = np.searchsorted(at, starts)
        for k, start, a, b in zip(group, starts, cuts, np.append(cuts[1:], len(at)), strict=True):
            out[k] = (at[a:b] - start, hashes[at[a:b]])

    for k, text in enumerate(texts):
        if least <= len(text) <= SLICE // 4:
            if size + len(text) > SLICE:
                settle()
                group, size = [], 0
            group.append(k)
            size += len(text)
        else:
            out[k] = winnow(text, gram, window)
    if group:
        settle()
    return out


def likeness(a: Prints, b: Prints) -> float:
    """Jaccard similarity of the hashes of two fingerprints; 1 if both are empty."""
    x, y = np.unique(a[1]), np.unique(b[1])
    both = np.intersect1d(x, y, assume_unique=True).size
    total = len(x) + len(y) - both
    return both / total if total else 1.0


def matches(positions: str, hashes: str, other_positions: str, other_hashes: str) -> Column:
    """Pairs (position, other) of equal hashes in two fingerprints of one row, by position."""
    mine, other = F.arrays_zip(positions, hashes), F.arrays_zip(other_positions, other_hashes)
    return F.flatten(F.transform(mine, lambda m: F.transform(
        F.filter(other, lambda o: o[other_hashes] == m[hashes]),
        lambda o: F.struct(m[positions].alias("position"), o[other_positions].alias("other")),
    )))


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values], dtype=np.int64)]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int64)))


def fingerprint(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW
) -> DataFrame:
    """One row per input row: id, n_chars (code points), positions and hashes of the fingerprint.

    Row by row, without a shuffle.  Null texts are empty and, like empty ones, have an empty
    fingerprint; very long texts are hashed whole, in slices.  Equal texts have equal
    fingerprints.  Ids may be null or repeat.  Other columns are ignored; an empty table
    gives an empty table.
    """
    for_python(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = winnow_all(texts, gram, window)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(t) for t in texts], pa.int64()),
                _lists([p for p, _ in found]), _lists([h for _, h in found]),
            ], ["id", "n_chars", "positions", "hashes"])

    rows = docs.select(named(docs, id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(
        each, "id bigint, n_chars bigint, positions array<bigint>, hashes array<bigint>"
    ).withColumnRenamed("id", id_col)


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows (id, text) in partitions sorted by id, each range of ids closed by a copy of its successor.

    Ranges of ids are cut by a quantile sketch.  A range's last row is followed by the
    first row of the next range (``tail``), the last range by the first one.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged, _ = with_range_bucket(rows, "id", 4 * parts, source=rows.select("id"))
    firsts = ranged.groupBy("_bucket").agg(F.min("id").alias("first"))
    # One row for each range: at most four for each shuffle partition.
    order, every = Window.orderBy("_bucket"), Window.partitionBy()
    before = F.coalesce(F.lag("_bucket").over(order), F.max("_bucket").over(every))
    firsts = firsts.select(F.col("_bucket").alias("__bucket"), "first", before.alias("before"))
    same = (F.col("_bucket") == F.col("__bucket")) & F.col("id").eqNullSafe(F.col("first"))
    tails = ranged.join(F.broadcast(firsts), same).groupBy(F.col("before").alias("_bucket")).agg(
        F.first("id").alias("id"), F.min("text").alias("text")
    )
    both = ranged.select("_bucket", "id", "text", F.lit(False).alias("tail")).unionByName(
        tails.withColumn("tail", F.lit(True))
    )
    return both.repartition("_bucket").sortWithinPartitions("_bucket", "tail", F.asc_nulls_last("id"), "text")


def compare_edited(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW
) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how much they have in common.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as
    many (or all) of the next document, in ascending order of the id; the last document is
    followed by the first, rows without id come last, and rows of one id are ordered by
    text.  One row per input row: id, n_chars, edited_sha256, positions, hashes,
    edited_positions, edited_hashes, near_edited and near_next (``likeness`` to the edited
    text and to the next document).  Texts are shuffled once, by ranges of the id, and
    streamed in order; a task holds a batch of them.  Null and empty texts, very long
    texts, other columns and an empty table are treated as in ``fingerprint``.
    """
    for_python(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last row seen, which waits for its successor
        for batch in batches:
            new = list(zip(*[c.to_pylist() for c in batch.columns], strict=True))
            rows = held + [(b, i, t, tail, p) for (b, i, t, tail), p in zip(
                new, winnow_all([r[2] for r in new], gram, window), strict=True)]
            held = rows[-1:]
            own = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[3]]
            edited = []
            for a, b in own:
                cut = len(a[2]) // 4
                edited.append(a[2][: len(a[2]) - cut] + b[2][:cut])
            found = winnow_all(edited, gram, window)
            yield pa.RecordBatch.from_arrays([
                pa.array([a[1] for a, _ in own], pa.int64()), pa.array([len(a[2]) for a, _ in own], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                _lists([a[4][0] for a, _ in own]), _lists([a[4][1] for a, _ in own]),
                _lists([p for p, _ in found]), _lists([h for _, h in found]),
                pa.array([likeness(a[4], e) for (a, _), e in zip(own, found, strict=True)], pa.float64()),
                pa.array([likeness(a[4], b[4]) for a, b in own], pa.float64()),
            ], names)

    schema = (
        "id bigint, n_chars bigint, edited_sha256 string, positions array<bigint>, hashes array<bigint>, "
        "edited_positions array<bigint>, edited_hashes array<bigint>, near_edited double, near_next double"
    )
    names = [c.split()[0] for c in schema.split(", ")]
    rows = docs.select(named(docs, id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"))
    return _in_order(rows).mapInArrow(each, schema).withColumnRenamed("id", id_col)


def digests(compared: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The result of ``compare_edited`` with SHA-256 digests of the fingerprints (positions and hashes)."""

    def digest(positions: str, hashes: str) -> Column:
        text = [F.concat_ws(" ", F.col(c).cast("array<string>")) for c in (positions, hashes)]
        return F.sha2(F.concat_ws(":", *text), 256)

    return compared.select(
        id_col, "n_chars", "edited_sha256", digest("positions", "hashes").alias("fingerprint"),
        digest("edited_positions", "edited_hashes").alias("edited_fingerprint"), "near_edited", "near_next",
        F.size("hashes").cast("bigint").alias("n_prints"),
    )
