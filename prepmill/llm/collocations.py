"""Phrase collocations by stripes.

A stripe belongs to one first word and is an associative counter of what follows it: the
empty extension (the word's own total), the next word, the next two, and so on.  Tasks
build the stripes of whole chunks of text, one shuffle brings the stripes of a first word
together, and merging them element by element gives every phrase's count: extensions,
prefix totals and the counts of longer phrases (for subsumption) come from one structure.

A first word with a large share of all words would be one task's work, so the stripes of
such words are cut into segments by a hash of the extension.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, for_python, join_counted, materialise, text_of

#: Phrases of 2 to LONGEST words that occur LEAST times are candidates.
LONGEST, LEAST = 3, 10
#: Percent of a candidate's occurrences inside a longer one that make it part of that one.
SUBSUMED = 50
#: Scores are floored millionths.
SCALE = 1_000_000
TOP = 2000
#: Bytes of text whose stripes are built together.
CHUNK = 4 << 20
#: Shuffle partitions for each of spark.sql.shuffle.partitions: a byte of text becomes several of stripes.
SPREAD = 4
ROWS_OUT = 4096
#: The best of each of so many parts of a language are ranked together.
RANK_PARTS = 16

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
#: Bytes between words of a piece, and bytes that end a piece (fixed by the task).
_GAP, _BREAK = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _GAP
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK

#: A language, bytes of text, and how many of its last words are only there to be looked ahead at.
Part = tuple[str, bytes, int]


def _parts(lang: str, text: bytes, ahead: int) -> Iterator[Part]:
    """A text as parts of about CHUNK bytes; a part repeats in its end the words that the next one starts with."""
    at = 0
    while len(text) - at > CHUNK:
        end = at + CHUNK
        while True:  # a word may be longer than a part
            kinds = _KIND[np.frombuffer(text, np.uint8, min(end, len(text)) - at, at)]
            starts = np.flatnonzero((kinds == 0) & (np.concatenate([[_BREAK], kinds[:-1]]) != 0))
            if len(starts) > ahead + 1 or end >= len(text):
                break
            end += CHUNK
        if end >= len(text):
            break
        # The part's last word may go on, so it stays out; the `ahead` words before it are looked at only.
        yield lang, text[at : at + int(starts[-1])], ahead
        at += int(starts[-1 - ahead])
    yield lang, text[at:], 0


def _chunks(batches: Iterator[pa.RecordBatch], ahead: int) -> Iterator[list[Part]]:
    """Parts of texts (lang, text) in lists of about CHUNK bytes."""
    chunk: list[Part] = []
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for part in _parts(lang, text.encode(), ahead):
                chunk.append(part)
                size += len(part[1]) + 1
                if size >= CHUNK:
                    yield chunk
                    chunk, size = [], 0
    if chunk:
        yield chunk


class Words:
    """The words of a chunk: codes into a dictionary, and what each word may be followed by."""

    def __init__(self, chunk: list[Part]):
        data = _FOLD[np.frombuffer(b"\n".join(p[1] for p in chunk) + b"\n", np.uint8)]
        kind = _KIND[data]
        inside = kind == 0
        edges = np.flatnonzero(np.diff(inside, prepend=False))
        starts, ends = edges[::2], edges[1::2]
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        packed = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
        coded = packed.dictionary_encode()
        self.words: pa.Array = coded.dictionary
        self.code = coded.indices.to_numpy().astype(np.int64)
        piece = np.cumsum(kind == _BREAK)[starts]
        #: Whether the word and the next one are in one piece.
        self.joined = np.append(piece[1:] == piece[:-1], False)
        limits = np.cumsum([len(p[1]) + 1 for p in chunk])
        counts = np.diff(np.searchsorted(starts, limits), prepend=0)
        self.langs = sorted({p[0] for p in chunk})
        number = {x: k for k, x in enumerate(self.langs)}
        self.lang = np.repeat([number[p[0]] for p in chunk], counts)
        #: Whether the word counts as a first word here.
        self.counted = np.ones(len(starts), bool)
        for last, n, part in zip(np.cumsum(counts), counts, chunk, strict=True):
            if part[2]:
                self.counted[last - min(n, part[2]) : last] = False
        #: First words are told apart by language.
        self.first = self.lang * len(self.words) + self.code


def _stripes(w: Words, longest: int, hot: dict[tuple[str, str], int]) -> Iterator[pa.RecordBatch]:
    """(lang, word, segment, extensions, counts) for the first words of a chunk.

    Extensions are one text, a line each: a list of many short texts would be mostly padding.
    """
    size = max(1, len(w.words))
    listed = w.words.to_pylist()
    crc = np.array([zlib.crc32(x.encode()) for x in listed], np.uint64)
    at = np.flatnonzero(w.counted)
    first, phrase, n = np.unique(w.first[at], return_inverse=True, return_counts=True)
    ext, mark = pa.array([""] * len(first), pa.string()), np.zeros(len(first), np.uint64)
    firsts, exts, counts, marks = [first], [ext], [n], [mark]
    for depth in range(1, longest):
        go = w.joined[at + depth - 1]
        at, phrase = at[go], phrase[go]
        longer, phrase, n = np.unique(phrase * size + w.code[at + depth], return_inverse=True, return_counts=True)
        parent, last = longer // size, longer % size
        word = w.words.take(pa.array(last))
        ext = word if depth == 1 else pc.binary_join_element_wise(ext.take(pa.array(parent)), word, " ")
        first, mark = first[parent], mark[parent] * np.uint64(0x9E3779B1) + crc[last] + np.uint64(1)
        for column, values in zip((firsts, exts, counts, marks), (first, ext, n, mark), strict=True):
            column.append(values)
    first, n, mark = (np.concatenate(x) for x in (firsts, counts, marks))
    codes = {x: k for k, x in enumerate(listed)}
    cut = np.zeros(len(w.langs) * size, np.uint64)
    for (lang, word), segments in hot.items():
        if lang in w.langs and word in codes:
            cut[w.langs.index(lang) * size + codes[word]] = segments
    # The empty extension (mark 0) stays in segment 0.
    segments = cut[first]
    segment = np.where((segments > 0) & (mark > 0), 1 + (mark >> np.uint64(7)) % np.maximum(segments, np.uint64(1)), 0).astype(np.int64)
    most = int(segment.max(initial=0)) + 1
    key = first * most + segment
    order = np.argsort(key, kind="stable")
    key = key[order]
    edges = np.flatnonzero(np.diff(key, prepend=-1))
    offsets = pa.array(np.append(edges, len(key)).astype(np.int32))
    heads = key[edges] // most
    out = pa.RecordBatch.from_arrays([
        pa.array(w.langs, pa.string()).take(pa.array(heads // size)), w.words.take(pa.array(heads % size)),
        pa.array((key[edges] % most).astype(np.int32)),
        pc.binary_join(pa.ListArray.from_arrays(offsets, pa.concat_arrays(exts).take(pa.array(order))), "\n"),
        pa.ListArray.from_arrays(offsets, pa.array(n[order].astype(np.int32))),
    ], ["lang", "word", "segment", "ext", "n"])
    for row in range(0, out.num_rows, ROWS_OUT):
        yield out.slice(row, ROWS_OUT)


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), text_of(text_col).alias("text")
    )


def _partitions(docs: DataFrame) -> int:
    return SPREAD * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def frequent_words(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang"
) -> tuple[DataFrame, dict[tuple[str, str], int]]:
    """Words of each language (lang, total), and segments for the (language, word) that start very many phrases.

    A word with more than one shuffle partition's share of all words is cut into as many
    segments as its share makes partitions.  A chunk names the words with at least half
    that share of its own: a word with the whole share has more than half of it in such
    chunks, so none is missed, and at most two for each shuffle partition are returned.
    """
    for_python(docs.sparkSession)
    share = max(HOT_SHARE, _partitions(docs))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, 0):
            w = Words(chunk)
            size = max(1, len(w.words))
            first, n = np.unique(w.first, return_counts=True)
            much = n * 2 * share >= len(w.first)
            langs, totals = np.unique(w.lang, return_counts=True)
            names = pa.array(w.langs, pa.string())
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([names.take(pa.array(first[much] // size)), names.take(pa.array(langs))]),
                pa.concat_arrays([w.words.take(pa.array(first[much] % size)), pa.nulls(len(langs), pa.string())]),
                pa.array(np.concatenate([n[much], totals]).astype(np.int64)),
            ], ["lang", "word", "n"])

    rows = _texts(docs, text_col, lang_col).mapInArrow(each, "lang string, word string, n bigint")
    rows = materialise(rows.groupBy("lang", "word").agg(F.sum("n").alias("n")), "frequent", True)
    totals = rows.filter("word is null").select("lang", F.col("n").alias("total"))
    total = totals.agg(F.sum("total")).first()[0] or 0
    hot = rows.filter(F.col("word").isNotNull() & (2 * share * F.col("n") >= total))
    return totals, {(r["lang"], r["word"]): -(-2 * share * r["n"] // total) for r in hot.collect()}


def phrase_counts(
    docs: DataFrame, hot: dict[tuple[str, str], int], text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST,
    least: int = LEAST,
) -> DataFrame:
    """(lang, phrase, words, n): all phrases of 1 to ``longest`` words that occur ``least`` times."""
    for_python(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, longest - 1):
            yield from _stripes(Words(chunk), longest, hot)

    stripes = _texts(docs, text_col, lang_col).mapInArrow(
        each, "lang string, word string, segment int, ext string, n array<int>"
    )
    # Dealt by the stripe's key; the grouping below adds up its elements where they lie.
    dealt = stripes.repartition(_partitions(docs), "lang", "word", "segment").withColumn("ext", F.split("ext", "\n"))
    met = dealt.select("lang", "word", "segment", F.explode(F.arrays_zip("ext", "n")).alias("e"))
    merged = met.groupBy("lang", "word", "segment", F.col("e.ext").alias("ext")).agg(F.sum("e.n").alias("n"))
    phrase = F.when(F.col("ext") == "", F.col("word")).otherwise(F.concat_ws(" ", "word", "ext"))
    words = F.when(F.col("ext") == "", 1).otherwise(F.size(F.split("ext", " ")) + 1)
    return merged.filter(F.col("n") >= least).select("lang", phrase.alias("phrase"), words.alias("words"), "n")


def _with_counts(rows: DataFrame, counts: DataFrame, part: str, name: str) -> DataFrame:
    """Add the count of the phrase in column ``part``; a phrase that very many rows ask for meets them by broadcast."""
    asked = rows.groupBy("lang", part).agg(F.count(F.lit(1)).alias("__asked"))
    facts = counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(name)).join(asked, ["lang", part])
    return join_counted(rows, materialise(facts, "asked", True), ["lang", part], "__asked", rows.count()).drop("__asked")


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE * a * a / (left * right)), exact for counts below 10**14."""
    d = lambda c: c.cast("decimal(14,0)")
    top = (F.lit(SCALE).cast("decimal(7,0)") * (d(a) * d(a)).cast("decimal(28,0)")).cast("decimal(38,0)")
    return F.call_function("div", top, (d(left) * d(right)).cast("decimal(28,0)"))


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of each phrase of several words, by its lowest-scoring cut (ties: the first)."""
    words = F.split("phrase", " ")
    join = lambda w: F.array_join(w, " ")
    cuts = counts.filter("words > 1").select(
        "lang", "phrase", F.col("n").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    ).select(
        "lang", "phrase", "a", "k", join(F.slice("w", F.lit(1), F.col("k"))).alias("left"),
        join(F.slice("w", F.col("k") + 1, F.size("w"))).alias("right"),
    )
    cuts = materialise(_with_counts(materialise(cuts, "cuts"), counts, "left", "l"), "cuts")
    cuts = _with_counts(cuts, counts, "right", "r").withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    best = F.min(F.struct("score", "k", "l", "r")).alias("best")
    return cuts.groupBy("lang", "phrase", "a").agg(best).select(
        "lang", "phrase", "a", "best.l", "best.r", "best.score"
    )


def subsumed(counts: DataFrame, percent: int = SUBSUMED) -> DataFrame:
    """(lang, phrase) of the phrases whose most frequent longer phrase has ``percent`` of their occurrences."""
    words = F.split("phrase", " ")
    inner = counts.filter("words > 2").select("lang", "n", words.alias("w"), "words").select(
        "lang", "n", "w", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size")
    ).select("lang", "n", "w", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("from"))
    most = inner.groupBy("lang", F.array_join(F.slice("w", F.col("from"), F.col("size")), " ").alias("phrase")).agg(
        F.max("n").alias("most")
    )
    return counts.join(most, ["lang", "phrase"]).filter(100 * F.col("most") >= percent * F.col("n")).select("lang", "phrase")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST,
    percent: int = SUBSUMED, top: int = TOP,
) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased in A-Z and cut into pieces at ``.,;:!?`` and line ends, pieces
    into words at blanks and tabs.  a, l, r count the phrase and the two parts of its
    lowest-scoring cut, n all words of the language; a phrase mostly found inside a longer
    candidate is left out.  Ranks follow score, a (both descending) and the phrase.  Null
    texts are empty, a null language is ``und``; repeated rows count again, ids are not
    read, other columns are ignored.  Very long texts are read in parts that overlap by
    the longest phrase.  An empty table, or one without candidates, gives an empty result.
    """
    totals, hot = frequent_words(docs, text_col, lang_col)
    counts = materialise(phrase_counts(docs, hot, text_col, lang_col, longest, least), "phrases")
    found = scored(counts).join(subsumed(counts, percent), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    first = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    best = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    ranked = first.filter(F.col("rank") <= top).withColumn("rank", best).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score"
    )
