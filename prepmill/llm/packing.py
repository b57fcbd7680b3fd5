"""Packing along a space-filling curve.

Documents become hashed token vectors, projected to a few dimensions; their Hilbert key
orders them so that neighbours on the curve are alike.  Spark sorts by ranges of the
key, and the stream of tokens in that order is cut into full sequences, so documents
that share a sequence are neighbours.  What is left after the last full sequence is cut
into powers of two, which need no padding.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import WESTERN, byte_letters
from .common import materialise, named, for_python, text_of

DIMS, BITS = 3, 20
#: Slots of a document's hashed vector.
SLOTS = 256
#: White-space separated words, and pieces of two generations each, kept by one worker; bounds its memory (some 60 MB).
CACHE_WORDS = 1 << 17
#: Words that go to the tokenizer as one text.
MARKED_WORDS = 256
#: The split of tokenizers that make one piece of every run of letters.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What Western texts lack.  Their characters are whole in composed form and become one
#: character in lower case, so that the split can be stated without a Unicode table.
OTHER = re.compile(f"[^\x00\x02-\x1b\x20-\xff{WESTERN}]")
_LETTERS, _NUMBERS = "a-zªµºß-öø-ÿœ", "0-9²³¹¼½¾"
PIECES = re.compile(rf"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
_BYTES = {b: c for c, b in byte_letters().items()}
#: Spelling of characters in byte-level vocabularies.
SPELLED = {c: "".join(_BYTES[b] for b in chr(c).encode()) for c in [*range(0x100), *map(ord, WESTERN)]}


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of integer points, one per row of ``cells``.

    Skilling's transform: undo the excess rotations from the highest bit down, then read
    the Gray code, then interleave the axes' bits.
    """
    x = [cells[:, k].astype(np.int64) for k in range(cells.shape[1])]
    top = np.int64(1) << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for k in range(len(x)):
            high = (x[k] & q) != 0
            swap = (x[0] ^ x[k]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if k:
                x[k] = np.where(high, x[k], x[k] ^ swap)
        q >>= 1
    for k in range(1, len(x)):
        x[k] = x[k] ^ x[k - 1]
    flip = np.zeros_like(x[0])
    q = top
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << 1) | (((axis ^ flip) >> bit) & 1)
    return key


def _projection() -> np.ndarray:
    """Fixed pseudo-random directions, from a rule: no state, the same on every worker."""
    return np.random.Generator(np.random.PCG64(7)).standard_normal((SLOTS, DIMS))


def _codec() -> pa.Codec:
    return pa.Codec("zstd", 1)


def stored(ids: bytes, kind: type, codec: pa.Codec) -> bytes:
    """Token ids of 2 or 4 bytes each as they are written: their width, then the ids compressed."""
    return bytes([np.dtype(kind).itemsize]) + codec.compress(ids, asbytes=True)


def restored(packed: bytes, tokens: int, codec: pa.Codec) -> np.ndarray:
    """The ``tokens`` ids that ``stored`` wrote."""
    width = packed[0]
    data = codec.decompress(memoryview(packed)[1:], decompressed_size=width * tokens)
    return np.frombuffer(data, f"<u{width}")


def document_cells(ids: list[np.ndarray]) -> np.ndarray:
    """Grid cells of documents: unit vectors of hashed token counts, projected."""
    directions = _projection()
    cells = np.zeros((len(ids), DIMS), np.int64)
    for row, tokens in enumerate(ids):
        if len(tokens):
            slots = (tokens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)
            vector = np.bincount(slots.astype(np.int64), minlength=SLOTS).astype(np.float64)
            at = vector @ directions / np.sqrt(vector @ vector)
            cells[row] = np.clip((np.tanh(at / 2) + 1) * (1 << (BITS - 1)), 0, (1 << BITS) - 1).astype(np.int64)
    return cells


class Pieces(dict):
    """Ids of the pieces of a byte-level tokenizer's split, from its merges on first use; ``older`` is asked before."""

    def __init__(self, merges, kind: str, older: dict[str, bytes]):
        self.merges, self.kind, self.older = merges, kind, older

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            spelled = piece if piece.isascii() and piece.isprintable() else piece.translate(SPELLED)
            ids = array(self.kind, [t.id for t in self.merges.tokenize(spelled)]).tobytes()
        self[piece] = ids
        return ids


class Words:
    """Ids of texts by a tokenizer that never joins characters across white space.

    White space only separates words for it, so equal words have equal ids, which are
    kept.  Words that are not known yet go to the tokenizer together, as one text with a
    mark between words: a character that forms a token of its own and that none of them
    has.  Texts with control characters that some libraries count as white space, and
    words with the mark, are passed whole.

    With ``added`` (see ``split_pieces``) Western texts are split into the tokenizer's own
    pieces here, and each new piece goes straight to its merges.
    """

    MARK = "\x01"

    def __init__(self, file: str, end: int, separable: bool, added: list[str] | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = np.uint16 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
        self.end = np.array([end], self.kind).tobytes()
        mark = self._ids(self.MARK)
        self.mark = int(mark[0]) if len(mark) == 1 else None
        self.separable = separable and self.mark is not None
        self.lowers = self._ids("A").tolist() == self._ids("a").tolist()
        self.known: dict[str, bytes] = {}
        self.added = added
        self.pieces = Pieces(self.tokenizer.model, self.kind().dtype.char, {})
        self.odd = re.compile("[\x01\x1c-\x1f]")

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words without the mark."""
        ids = self._ids(f" {self.MARK} ".join(words))
        cuts = np.flatnonzero(ids == self.mark)
        if len(cuts) != len(words) - 1:  # a word spells the mark's token in another way
            return [self._ids(w).tobytes() for w in words]
        data, size = ids.tobytes(), ids.itemsize
        starts, ends = [0, *((cuts + 1) * size).tolist()], [*(cuts * size).tolist(), len(data)]
        return [data[a:b] for a, b in zip(starts, ends, strict=True)]

    def _parts(self, word: str) -> tuple[str, str]:
        """A word as letters and the punctuation after them, which are tokens of their own."""
        stem = word.rstrip(".,!?;:")
        # Some letters have marks in normal form, which join the punctuation.
        if not (stem.isalpha() and (stem.isascii() or unicodedata.normalize("NFC", stem).lower().isalpha())):
            return word, ""
        return (stem.lower() if self.lowers and stem.isascii() else stem), word[len(stem):]

    def _learn(self, words: set[str]) -> None:
        known = self.known
        parts = {w: self._parts(w) for w in words}
        new = list({p for pair in parts.values() for p in pair if p and p not in known})
        for start in range(0, len(new), MARKED_WORDS):
            some = new[start : start + MARKED_WORDS]
            known.update(zip(some, self._words(some), strict=True))
        for word, (stem, tail) in parts.items():
            known[word] = known[stem] + known[tail] if tail else known[stem]

    def _by_pieces(self, text: str) -> bytes | None:
        """Ids of a Western text without added tokens; none if it is another one."""
        if self.added is None or OTHER.search(text):
            return None
        text = text.lower()
        if any(a in text for a in self.added):
            return None
        if len(self.pieces) > CACHE_WORDS:  # pieces in use are taken along, others are forgotten
            self.pieces = Pieces(self.pieces.merges, self.pieces.kind, dict(self.pieces))
        return b"".join(map(self.pieces.__getitem__, PIECES.findall(text)))

    def encode(self, texts: list[str]) -> list[bytes]:
        out = [self._by_pieces(t) for t in texts]
        others = iter(self._by_words([t for t, ids in zip(texts, out, strict=True) if ids is None]))
        return [(next(others) if ids is None else ids) + self.end for ids in out]

    def _by_words(self, texts: list[str]) -> list[bytes]:
        known, out = self.known, []
        split = [t.split() if self.separable and not self.odd.search(t) else None for t in texts]
        words = {w for words in split if words for w in words}
        new = {w for w in words if w not in known}
        if len(known) + 2 * len(new) > CACHE_WORDS:
            known.clear()
            new = words
        self._learn(new)
        for text, words in zip(texts, split, strict=True):
            if words is None:
                out.append(self._ids(text).tobytes())
            else:
                out.append(b"".join([known[w] for w in words]))
        return out


def splits_at_space(file: str) -> bool:
    """Whether the tokenizer file is of the kind whose words never contain white space."""
    import json

    made = json.loads(file)
    steps = (made.get("pre_tokenizer") or {}).get("pretokenizers") or []
    return bool(
        steps and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
        and made["model"].get("end_of_word_suffix")
        and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or " " in t["content"] for t in made.get("added_tokens", []))
        and all(n.get("type") in ("NFC", "Replace", "Lowercase") for n in (made.get("normalizer") or {}).get("normalizers", []))
    )


def split_pieces(file: str) -> list[str] | None:
    """The added tokens, lower-cased, of a tokenizer that merges lower-cased UTF-8 bytes within the pieces of ``SPLIT``, else none."""
    import json

    made = json.loads(file)
    steps = (made.get("pre_tokenizer") or {}).get("pretokenizers") or []
    changes = (made.get("normalizer") or {}).get("normalizers") or []
    fits = (
        len(steps) == 2 and steps[0].get("type") == "Split" and steps[0].get("pattern") == {"Regex": SPLIT}
        and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
        and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and steps[1].get("use_regex") is False
        and any(n.get("type") == "Lowercase" for n in changes)
        and all(
            n.get("type") in ("NFC", "Lowercase")
            or (n.get("type") == "Replace" and n.get("pattern") == {"Regex": r"\s+"} and n.get("content") == " ") for n in changes
        )
        and made["model"].get("type") == "BPE" and not made["model"].get("dropout")
    )
    return [t["content"].lower() for t in made.get("added_tokens", [])] if fits else None


_WORDS: dict[int, Words] = {}


def _words(shared, end: int) -> Words:
    key = hash((*shared.value[:2], end))
    if key not in _WORDS:
        _WORDS.clear()
        _WORDS[key] = Words(shared.value[0], end, *shared.value[1:])
    return _WORDS[key]


def tokenise(docs: DataFrame, path: str, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, curve (Hilbert key), tokens (count with the end id), ids (compressed, in 2 or 4 bytes each)."""
    spark = docs.sparkSession
    for_python(spark)
    with open(path, encoding="utf-8") as f:
        file = f.read()
    shared = spark.sparkContext.broadcast((file, splits_at_space(file), split_pieces(file)))  # bounded by the vocabulary file
    source = docs.select(named(docs, id_col).cast("bigint").alias("__id"), text_of(text_col).alias("__text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, codec = _words(shared, end), _codec()
        for batch in batches:
            ids = words.encode(batch.column(1).to_pylist())
            arrays = [np.frombuffer(x, words.kind) for x in ids]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(hilbert_key(document_cells(arrays))),
                pa.array([len(x) for x in arrays], pa.int64()),
                pa.array([stored(x, words.kind, codec) for x in ids], pa.binary()),
            ], ["id", "curve", "tokens", "ids"])

    return source.mapInArrow(each, "id bigint, curve bigint, tokens bigint, ids binary")


def _with_running_total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens before each row within its partition; holds one number."""
    total = 0
    for batch in batches:
        count = batch.column(2).to_numpy()
        before = total + np.cumsum(count) - count
        total += int(count.sum())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before)], [*batch.schema.names, "before"])


def tail_sizes(rest: int) -> list[int]:
    """The powers of two that make up ``rest``, largest first."""
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def cut(first: int, tokens: int, total: int, size: int) -> list[tuple[int, int, int, int]]:
    """Pieces (start, length, sequence, offset) of a document whose first token is number ``first``."""
    full = total // size
    ends = np.cumsum([0, *tail_sizes(total - full * size)]) + full * size
    out, at = [], first
    while at < first + tokens:
        if at < full * size:
            sequence, offset = divmod(at, size)
            room = size - offset
        else:
            k = int(np.searchsorted(ends, at, "right")) - 1
            sequence, offset, room = full + k, at - int(ends[k]), int(ends[k + 1]) - at
        length = min(room, first + tokens - at)
        out.append((at - first, length, sequence, offset))
        at += length
    return out


def pack(
    docs: DataFrame, path: str, size: int = 2048, end: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of documents packed into sequences of ``size`` tokens, along the curve.

    One row per piece: id, start, length, ids (binary, little-endian 32-bit), doc_tokens,
    sequence_id, offset, curve.  A null text counts as empty and is its end id alone.
    Documents on one point of the curve (copies) are ordered by id; repeated rows are
    packed once each; a null id is carried along.  Every sequence but those that hold the
    last ``total % size`` tokens is full, and these are powers of two, so nothing is padded.
    Very long texts are cut into as many pieces as they fill; an empty table gives an empty
    table; other columns are ignored.
    """
    spark = docs.sparkSession
    # Token ids are written once; only keys and counts are sorted along the curve.
    coded = materialise(
        tokenise(docs, path, end, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "tokens"
    )
    keys = ["curve", "id", "row"]
    ordered = coded.select("row", "id", "tokens", "curve").repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = materialise(
        ordered.mapInArrow(_with_running_total, "row bigint, id bigint, tokens bigint, curve bigint, before bigint")
        .select("row", "tokens", "before", F.spark_partition_id().alias("part")),
        "order",
    )
    # One row per partition, whatever the data; their totals give every partition's start.
    sums = placed.groupBy("part").agg(F.sum("tokens").alias("n"))
    starts = sums.select("part", (F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("shift"))
    total = placed.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]
    firsts = placed.join(F.broadcast(starts), "part").select("row", (F.col("before") + F.col("shift")).alias("first"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "curve"]
        kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 4
        codec = _codec()
        for batch in batches:
            rows: list[tuple] = []
            for doc, curve, tokens, packed, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = restored(packed, tokens, codec).astype(np.uint32).tobytes()
                for start, length, sequence, offset in cut(first, tokens, total, size):
                    rows.append((doc, start, length, ids[4 * start : 4 * (start + length)], tokens, sequence, offset, curve))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    out = coded.join(firsts, "row").select("id", "curve", "tokens", "ids", "first").mapInArrow(each, (
        "id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, curve bigint"
    ))
    return out.withColumnRenamed("id", id_col)


def sequences(pieces: DataFrame, size: int = 2048, pad: int = 0, id_col: str = "doc_id") -> DataFrame:
    """Whole sequences: sequence_id, ids (padded unless a power of two), n_tokens.  Bounded by ``size`` tokens."""

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("offset")
        ids = b"".join(rows["ids"])
        n = len(ids) // 4
        if n & (n - 1):
            ids += np.full(size - n, pad, np.uint32).tobytes()
        return pd.DataFrame({"sequence_id": [rows["sequence_id"].iloc[0]], "ids": [ids], "n_tokens": [n]})

    return pieces.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInPandas(
        whole, "sequence_id bigint, ids binary, n_tokens bigint"
    )


def piece_digests(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The pieces with a checksum instead of their ids."""
    return pieces.select(
        id_col, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "curve"
    )
