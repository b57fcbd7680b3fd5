"""Removal of repeated passages by distributed prefix doubling.

A position's rank among equal-length strings is replaced by a name: a 64-bit hash that
two positions share if their strings are equal.  Names of 2h bytes come from pairs of
names of h bytes, as in prefix doubling; up to GRAM bytes a document's own task can do
that.  From there Spark sorts names in ranges, in three rounds of growing length, and
drops positions as soon as their names are unique:

1. GRAM bytes.  Only anchors are sorted: in each window of ``length`` bytes, the string
   with the smallest name.  Equal windows have equal anchors, so a window whose anchor is
   unique is unique, and about 2 / (length - GRAM + 2) of all positions are sorted.
2. What surrounds an anchor: all windows that share it, as one string.  Equal
   surroundings settle all their windows at once.
3. ``length`` bytes, for windows whose anchor occurs in different surroundings.

Names of rounds 2 and 3 count together with the anchor's, 112 bits in all.  Documents
are packed into blocks on shared files; a block and a range exchange sorted, compressed
lists, in which a name occurs once per block however many documents share it.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import drop_at_exit, scratch_path
from .common import for_python, materialise, named, text_of
from .shingles import mix, powers

LENGTH = 50
GRAM = 24
#: Bytes of text in a block, of names in a range, and of text hashed at a time.
BLOCK_BYTES = 6 << 20
RANGE_BYTES = 8 << 20
#: The last round has this many times the ranges: it may send several windows for an anchor.
LAST_RANGES = 4
PIECE = 1 << 17
#: Buckets of the table of blocks at most; a bucket may hold many blocks.
MAX_BUCKETS = 20_000
#: Stands for a null id: larger than any other, so it is never an earlier document.
NO_ID = (1 << 63) - 1
_BASE = 0xD6E8FEB86659FD93 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shrink(values: np.ndarray) -> bytes:
    """64-bit values as compressed byte planes: steady high bytes cost next to nothing."""
    return zlib.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def grow(data: bytes, kind: type = np.uint64) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def shrink_sorted(values: np.ndarray) -> bytes:
    return shrink(np.diff(values, prepend=np.uint64(0)))


def grow_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(grow(data))


def shrink_bits(bits: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def grow_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(data), np.uint8), count=n).astype(bool)


def gram_names(text: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Names of all strings of ``gram`` bytes, by doubling; the last step may overlap."""
    names, h = _LETTER[text], 1
    while h < gram:
        step = min(h, gram - h)
        left, right = names[: len(names) - step], names[step:]
        names = (left * np.uint64(0xBF58476D1CE4E5B9)) ^ (right + np.uint64(h))
        names ^= names >> np.uint64(29)
        names *= np.uint64(0x94D049BB133111EB)
        names ^= names >> np.uint64(32)
        h += step
    return names


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    out, h = values, 1
    while h < width:
        step = min(h, width - h)
        out = np.minimum(out[: len(out) - step], out[step:])
        h += step
    return out


class Block:
    """Intervals of windows that share an anchor, for the documents of a block.

    Arrays by interval: doc (place in the block), first and last window (offsets within
    the document), name (of the anchor, 48 bits) and the anchor's offset from the first.
    """

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, text: bytes, length: int, gram: int = GRAM):
        self.ids, self.lengths, self.length, self.gram = ids, lengths, length, gram
        self.text = np.frombuffer(text, np.uint8)
        self.starts = np.cumsum(lengths) - lengths
        parts = [self._intervals(*p) for p in self._pieces()]
        join = lambda k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64)
        self.doc, self.first, self.last = join(0), join(1), join(2)
        self.name, self.anchor = join(3).astype(np.uint64), join(4)

    def _pieces(self) -> Iterator[tuple[int, int, int]]:
        """(begin, end, first document) of stretches of text that are hashed together."""
        begin = k = 0
        n = len(self.lengths)
        while k < n:
            end, j = self.starts[k] + self.lengths[k], k + 1
            while j < n and self.starts[j] + self.lengths[j] - self.starts[k] <= PIECE:
                end, j = self.starts[j] + self.lengths[j], j + 1
            begin = int(self.starts[k])
            while end - begin > PIECE:  # a long document: every window lies within one stretch
                yield begin, begin + PIECE, k
                begin += PIECE - self.length + 1
            yield begin, int(end), k
            k = j

    def _intervals(self, begin: int, end: int, k: int) -> tuple[np.ndarray, ...]:
        text, length = self.text[begin:end], self.length
        none = (np.zeros(0, np.int64),) * 5
        if len(text) < length:
            return none
        names = gram_names(text, self.gram)
        place = np.uint64(PIECE - 1)
        keyed = (names & ~place) | np.arange(len(names), dtype=np.uint64)
        anchor = (window_minimum(keyed, length - self.gram + 1) & place).astype(np.int64)
        at = np.arange(len(anchor))
        doc = np.searchsorted(self.starts, at + begin, "right") - 1
        inside = at + begin + length <= self.starts[doc] + self.lengths[doc]
        at, doc, anchor = at[inside], doc[inside], anchor[inside]
        if not len(at):
            return none
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]))
        first, last = at[new], at[np.append(new[1:], len(at)) - 1]
        doc, anchor = doc[new], anchor[new]
        offset = begin - self.starts[doc]
        return doc, first + offset, last + offset, names[anchor] >> np.uint64(16), anchor - first

    def _spell(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Names of strings text[begin:end] of less than PIECE bytes, given in order of ``begin``.

        A string's name is the polynomial of its bytes, from running sums over stretches
        of text, and its length.
        """
        out = np.zeros(len(begin), np.uint64)
        done = 0
        while done < len(begin):
            base = int(begin[done])
            text = self.text[base : base + 2 * PIECE]
            stop = int(np.searchsorted(begin, base + PIECE))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(
                (text.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(text))
            )])
            at = begin[done:stop] - base
            out[done:stop] = (total[end[done:stop] - base] - total[at]) * powers(_INVERSE, PIECE)[at]
            done = stop
        return mix(mix(out) + (end - begin).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))

    def around(self, chosen: np.ndarray) -> np.ndarray:
        """Names of all that the windows of chosen intervals cover, and of the anchor's place in it."""
        begin = self.starts[self.doc[chosen]] + self.first[chosen]
        name = self._spell(begin, begin + (self.last - self.first)[chosen] + self.length)
        return mix(name + self.anchor[chosen].astype(np.uint64))

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Single windows of chosen intervals: (interval, offset in document, anchor's name, own name)."""
        counts = (self.last - self.first + 1)[chosen]
        interval = np.repeat(chosen, counts)
        at = np.arange(len(interval)) - np.repeat(np.cumsum(counts) - counts, counts) + self.first[interval]
        begin = self.starts[self.doc[interval]] + at
        return interval, at, self.name[interval], self._spell(begin, begin + self.length)


def _range_cuts(names: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range begins in sorted 48-bit names."""
    return np.searchsorted((names >> np.uint64(16)) * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1))


def _least_by(doc_ids: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, with the smallest id of each and the inverse."""
    order = np.lexsort((doc_ids, *keys[::-1]))
    sorted_keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[1:] != k[:-1] for k in sorted_keys], axis=0)
    inverse = np.zeros(len(order), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return *(k[new] for k in sorted_keys), doc_ids[order][new], inverse


_SENT = "round int, place int, block bigint, n bigint, names binary, others binary, least binary"
_REPLY = "block bigint, round int, place int, n bigint, least binary, bits binary"


def _sent(rnd: int, block: int, ranges: int, names, others, least) -> Iterator[tuple]:
    cuts = _range_cuts(names, ranges)
    for r in range(ranges):
        a, b = cuts[r], cuts[r + 1]
        if a < b:
            yield (
                rnd, r, block, int(b - a), shrink_sorted(names[a:b]), b"" if others is None else shrink(others[a:b]),
                shrink_bits(least[a:b]) if least.dtype == bool else shrink(least[a:b]),
            )


def _table(rows: list[tuple], kinds: str) -> pa.Table:
    arrow = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    names, types = zip(*(x.split() for x in kinds.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.table({n: pa.array(list(c), arrow[t]) for n, c, t in zip(names, columns, types, strict=True)})


def _open_block(table: pa.Table, length: int) -> tuple[int, Block]:
    row = table.to_pylist()[0]
    return row["block"], Block(
        np.frombuffer(row["ids"], np.int64), np.frombuffer(row["lengths"], np.int64), zlib.decompress(row["text"]), length
    )


class _Replies:
    """What the ranges have told a block so far."""

    def __init__(self, table: pa.Table):
        self.by: dict[int, list[dict]] = {}
        for row in table.to_pylist():
            self.by.setdefault(row["round"], []).append(row)
        for rows in self.by.values():
            rows.sort(key=lambda r: r["place"])

    def bits(self, rnd: int) -> np.ndarray:
        rows = self.by.get(rnd, [])
        return np.concatenate([grow_bits(r["bits"], r["n"]) for r in rows]) if rows else np.zeros(0, bool)

    def least(self, rnd: int) -> np.ndarray:
        rows = self.by.get(rnd, [])
        return np.concatenate([grow(r["least"], np.int64) for r in rows]) if rows else np.zeros(0, np.int64)


class _State:
    """A block's intervals seen with the replies of the rounds so far.

    Every quantity follows from the block and the replies, so any round can be taken up
    again by any task.
    """

    def __init__(self, table: pa.Table, replies: pa.Table | None, length: int):
        self.number, self.block = _open_block(table, length)
        self.replies = _Replies(replies) if replies is not None else None
        b = self.block
        self.id = b.ids[b.doc] if len(b.doc) else np.zeros(0, np.int64)

    def first(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchor names, and whether two documents of the block share them."""
        b = self.block
        order = np.lexsort((self.id, b.name))
        name, doc = b.name[order], self.id[order]
        new = np.concatenate([[True], name[1:] != name[:-1]]) if len(name) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        return name[at], doc[at] < doc[np.append(at[1:], len(doc)) - 1] if len(at) else np.zeros(0, bool)

    def second(self) -> tuple[np.ndarray, ...]:
        """Distinct (anchor, surroundings) of anchors that other documents share."""
        b = self.block
        shared = self.replies.bits(1)
        found = np.unique(b.name)[shared] if len(shared) else np.zeros(0, np.uint64)
        place = np.minimum(np.searchsorted(found, b.name), max(len(found) - 1, 0))
        self.open = np.flatnonzero(found[place] == b.name) if len(found) else np.zeros(0, np.int64)
        *keys, self.inverse2 = _least_by(self.id[self.open], b.name[self.open], b.around(self.open))
        return tuple(keys)

    def third(self) -> tuple[np.ndarray, ...]:
        """Distinct (anchor, window) of first occurrences among several surroundings."""
        self.second()
        least, several = self.replies.least(2), self.replies.bits(2)
        mine = least[self.inverse2] if len(least) else np.zeros(0, np.int64)
        self.settled = self.open[mine < self.id[self.open]]
        asks = (mine >= self.id[self.open]) & (several[self.inverse2] if len(several) else False)
        self.interval, self.at, name, window = self.block.windows(self.open[asks])
        *keys, self.inverse3 = _least_by(self.id[self.interval], name, window)
        return tuple(keys)

    def last(self) -> list[list[tuple[int, int]]]:
        """Removed spans of every document of the block."""
        self.third()
        b, n = self.block, self.block.length
        least = self.replies.least(3)
        hit = least[self.inverse3] < self.id[self.interval] if len(least) else np.zeros(0, bool)
        doc = np.concatenate([b.doc[self.settled], b.doc[self.interval[hit]]])
        begin = np.concatenate([b.first[self.settled], self.at[hit]])
        end = np.concatenate([b.last[self.settled], self.at[hit]]) + n
        # On one line, with a gap of one between documents, spans are unions of intervals.
        shift = b.starts + np.arange(len(b.starts))
        order = np.argsort(shift[doc] + begin, kind="stable")
        doc, begin, end = doc[order], begin[order], end[order]
        reach = np.maximum.accumulate(shift[doc] + end) if len(doc) else end
        new = np.flatnonzero(np.concatenate([[True], (shift[doc] + begin)[1:] > reach[:-1]])) if len(doc) else np.zeros(0, np.int64)
        stop = reach[np.append(new[1:], len(doc)) - 1] - shift[doc[new]] if len(new) else np.zeros(0, np.int64)
        spans: list[list[tuple[int, int]]] = [[] for _ in b.ids]
        for d, x, y in zip(doc[new].tolist(), begin[new].tolist(), stop.tolist(), strict=True):
            spans[d].append((x, y))
        return spans


def _pack_blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Blocks of a task's documents, each numbered by the task and its place there.

    The third column, whatever it holds, travels with the block as Arrow data.
    """
    task, number = TaskContext.get().partitionId(), 0
    ids: list[int] = []
    texts: list[bytes] = []
    rest: list[pa.RecordBatch] = []
    size = 0

    def out() -> pa.RecordBatch:
        lengths = np.array([len(t) for t in texts], np.int64)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rest[0].schema) as stream:
            for part in rest:
                stream.write_batch(part)
        return pa.RecordBatch.from_arrays([
            pa.array([task << 24 | number], pa.int64()), pa.array([np.array(ids, np.int64).tobytes()]),
            pa.array([lengths.tobytes()]), pa.array([zlib.compress(b"".join(texts), 1)]),
            pa.array([zlib.compress(sink.getvalue(), 1)], pa.binary()),
        ], ["block", "ids", "lengths", "text", "rest"])

    for batch in batches:
        others, first = batch.select([2]), 0
        for k, (key, value) in enumerate(zip(batch.column(0), batch.column(1), strict=True)):
            text = value.as_py().encode()
            if texts and size + len(text) > limit:
                rest.append(others.slice(first, k - first))
                yield out()
                ids, texts, rest, size, number, first = [], [], [], 0, number + 1, k
            ids.append(NO_ID if key.as_py() is None else key.as_py())
            texts.append(text)
            size += len(text)
        rest.append(others.slice(first))
    if texts:
        yield out()


def _rest(block: pa.Table) -> pa.ChunkedArray:
    return pa.ipc.open_stream(zlib.decompress(block.column("rest")[0].as_py())).read_all().column(0)


def _answer(table: pa.Table) -> pa.Table:
    """One range of one round: what each block's names share with other blocks."""
    rows = table.to_pylist()
    rnd = rows[0]["round"]
    names = np.concatenate([grow_sorted(r["names"]) for r in rows])
    owner = np.repeat(np.arange(len(rows)), [r["n"] for r in rows])
    if rnd == 1:
        flags = np.concatenate([grow_bits(r["least"], r["n"]) for r in rows])
        order = np.argsort(names, kind="stable")
        same = names[order][1:] == names[order][:-1]
        bits = np.zeros(len(names), bool)
        bits[order[1:][same]] = True
        bits[order[:-1][same]] = True
        # A name that one block sends is in it once, so equal neighbours are of two blocks.
        bits |= flags
        least = None
    else:
        others = np.concatenate([grow(r["others"]) for r in rows])
        ids = np.concatenate([grow(r["least"], np.int64) for r in rows])
        key, _, low, inverse = _least_by(ids, names, others)
        least = low[inverse]
        several = np.zeros(len(key), bool)
        same = key[1:] == key[:-1]
        several[1:][same] = True
        several[:-1][same] = True
        bits = several[inverse]
    out = []
    for k, row in enumerate(rows):
        mine = slice(*np.searchsorted(owner, [k, k + 1]))
        out.append((
            row["block"], rnd, row["place"], row["n"], b"" if least is None else shrink(least[mine]), shrink_bits(bits[mine])
        ))
    return _table(out, _REPLY)


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
    block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """One row per input row: row, id, n_bytes, spans (array of removed [start, stop)), kept (binary), text.

    ``row`` is a struct of all input columns but the text; ``text`` is what is kept, without
    characters that a cut has broken.

    Texts are UTF-8 bytes; null is empty.  A byte is removed if a string of ``length``
    bytes that covers it also starts in a document with a smaller id; strings never cross
    documents and are judged on the input.  Texts shorter than ``length`` are untouched.
    Rows that repeat an id are the same document and take nothing from each other.  A
    null id counts as larger than all others.  Ids are 64-bit integers; other columns are
    ignored; an empty table gives an empty table.
    """
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM}")
    spark = docs.sparkSession
    for_python(spark)
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    source = docs.select(
        named(docs, id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"), F.struct(*others).alias("row")
    )
    total = source.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()[0]
    share = 2 / (length - GRAM + 2)
    ranges = max(1, int(total * share * 8 // range_bytes) + 1)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MAX_BUCKETS, total // block_bytes + 1))
    # The table is bucketed by block and each task writes its own, so no text is shuffled.
    name, path = f"blocks_{uuid.uuid4().hex}", scratch_path(spark, "blocks")
    pack = lambda batches: _pack_blocks(batches, block_bytes)
    source.mapInArrow(pack, "block bigint, ids binary, lengths binary, text binary, rest binary").write.bucketBy(
        int(buckets), "block"
    ).option("path", path).saveAsTable(name)
    drop_at_exit(spark, path)
    blocks = spark.table(name).groupBy("block")

    def ask(rnd: int, replies: DataFrame | None) -> DataFrame:
        def each(block: pa.Table, told: pa.Table | None = None) -> pa.Table:
            state = _State(block, told, length)
            if rnd == 1:
                names, flags = state.first()
                return _table(list(_sent(1, state.number, ranges, names, None, flags)), _SENT)
            names, others, least = state.second() if rnd == 2 else state.third()
            parts = ranges * (LAST_RANGES if rnd == 3 else 1)
            return _table(list(_sent(rnd, state.number, parts, names, others, least)), _SENT)

        if replies is None:
            asked = blocks.applyInArrow(lambda block: each(block), _SENT)
        else:
            asked = blocks.cogroup(replies.groupBy("block")).applyInArrow(_skip_empty(each, _SENT), _SENT)
        return materialise(asked.groupBy("place").applyInArrow(_answer, _REPLY), f"round{rnd}")

    replies = ask(1, None)
    for rnd in (2, 3):
        replies = replies.unionByName(ask(rnd, replies))

    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def end(block: pa.Table, told: pa.Table) -> pa.Table:
        state = _State(block, told, length)
        b = state.block
        spans, kept = state.last(), []
        for k, mine in enumerate(spans):
            text = b.text[b.starts[k] : b.starts[k] + b.lengths[k]]
            if mine:
                keep = np.ones(len(text), bool)
                for x, y in mine:
                    keep[x:y] = False
                text = text[keep]
            kept.append(text.tobytes())
        return pa.table({
            "row": _rest(block), "id": pa.array([None if i == NO_ID else i for i in b.ids.tolist()], pa.int64()),
            "n_bytes": pa.array(b.lengths, pa.int64()),
            "spans": pa.array([[{"start": x, "stop": y} for x, y in s] for s in spans], kind),
            "kept": pa.array(kept, pa.binary()), "text": pa.array([t.decode("utf-8", "ignore") for t in kept], pa.string()),
        })

    schema = T.StructType([
        T.StructField("row", source.schema["row"].dataType),
        *T._parse_datatype_string(
            "id bigint, n_bytes bigint, spans array<struct<start: bigint, stop: bigint>>, kept binary, text string"
        ).fields,
    ])
    empty = to_arrow_schema(schema).empty_table()
    out = blocks.cogroup(replies.groupBy("block")).applyInArrow(
        lambda block, told: end(block, told) if block.num_rows else empty, schema
    )
    return out.withColumnRenamed("id", id_col)


def _skip_empty(each: Callable, schema: str) -> Callable:
    """A reply always has its block; the other way round a block may have no reply."""
    return lambda block, told: each(block, told) if block.num_rows else _table([], schema)


def passage_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and the digest of what is left."""
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        id_col, "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
