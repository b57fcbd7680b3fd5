"""Near duplicates by weighted Jaccard similarity of word-shingle bags: BagMinHash and bands.

Each bag becomes a signature drawn from hierarchical Poisson processes over its
discretised weights: a shingle of weight w owns the unit intervals up to w, grouped in
octaves [0,1), [1,2), [2,4), ...; every octave has its own process at the rate of its
length, whose points carry a time, a component and a weight, and a point counts if its
weight is below w.  A component's value is the time of its first point, so two
signatures agree there with the bags' weighted Jaccard similarity as probability.  An
octave's process stops once its time passes the latest component.

Signatures are cut into bands.  Texts in one band bucket are candidates, and candidates
are verified on their whole bags.  Nothing enumerates a bucket's pairs: each bucket is
first compared with its most connected member, which settles groups of copies.  Buckets
whose members still belong to several classes are settled exactly by further members,
after parts that no link can join have been told apart by size and unshared shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SMALL_GROUPS, for_python, join_groups, materialise, named, text_of
from .components import components, extend
from .shingles import WORDS, bags, counted, mix, overlap

THRESHOLD = 0.8
#: Bands and rows: a pair at the threshold of 0.8 is missed with probability 5e-5.
BANDS, ROWS = 25, 5
#: Open buckets of up to so many members are settled by all their pairs of different classes.
SMALL_BUCKET = 32
#: Members of one task that are compared with the same text.
CHUNK = 64
#: Askers and members of a large part that one task compares.
ASKERS = 256
SUB = 256
#: Size classes grow by this ratio.
STEP = 1.1


def bag_minhash(
    doc: np.ndarray, key: np.ndarray, weight: np.ndarray, docs: int, m: int = BANDS * ROWS
) -> np.ndarray:
    """Signatures (docs x m, times of first points) of bags given as (doc, key, weight) entries."""
    best = np.full((docs, m), np.inf)
    if not len(doc):
        return best
    octaves = 1 + np.ceil(np.log2(weight)).astype(np.int64)
    entry = np.repeat(np.arange(len(doc)), octaves)
    octave = np.arange(len(entry)) - np.repeat(np.cumsum(octaves) - octaves, octaves)
    low = np.where(octave == 0, 0, 1 << np.maximum(octave - 1, 0)).astype(np.float64)
    rate = np.maximum(low, 1.0)
    doc, top = doc[entry], weight[entry].astype(np.float64)
    seed = mix(key[entry] + (octave + 1).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    time, points = np.zeros(len(doc)), 0
    flat = best.reshape(-1)
    while len(doc):
        # The schedule depends on the point's number alone, so equal processes give equal times.
        number = 1 if points < 4 else 32
        numbers = np.arange(points + 1, points + 1 + number, dtype=np.uint64)
        points += number
        draw = mix(seed[:, None] + numbers[None, :] * np.uint64(0x9E3779B97F4A7C15))
        gap = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53)
        at = time[:, None] + np.cumsum(gap / rate[:, None], axis=1)
        other = mix(draw ^ np.uint64(0xE7037ED1A0B428DB))
        component = ((other >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        place = low[:, None] + (other & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * rate[:, None]
        hit = place < top[:, None]
        cell = doc[:, None] * m + component.astype(np.int64)
        np.minimum.at(flat, cell[hit], at[hit])
        time = at[:, -1]
        live, where = np.unique(doc, return_inverse=True)
        go = time < best[live].max(axis=1)[where]
        doc, top, seed, time, low, rate = (x[go] for x in (doc, top, seed, time, low, rate))
    return best


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of each signature; the band's number is part of it."""
    parts = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), bands, rows)
    keys = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for k in range(rows):
        keys = mix(keys * np.uint64(0xD1342543DE82EF95) + parts[:, :, k])
    return keys.view(np.int64)


def sign(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, key, bag (128-bit digest of the whole bag), size (its weight) and band keys, for (id, text, key)."""
    for_python(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            found = bags(texts, words)
            sets = [counted(b) for b in found]
            lengths = [len(s[0]) for s in sets]
            doc = np.repeat(np.arange(len(sets)), lengths)
            signature = bag_minhash(
                doc, np.concatenate([s[0] for s in sets] or [np.zeros(0, np.uint64)]),
                np.concatenate([s[1] for s in sets] or [np.zeros(0, np.int64)]), len(sets), bands * rows,
            )
            keys = band_keys(signature, bands, rows)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2),
                pa.array([hashlib.blake2b(b.tobytes(), digest_size=16).digest() for b in found], pa.binary()),
                pa.array([len(b) for b in found], pa.int64()),
                pa.array([list(k) if n else [] for k, n in zip(keys, lengths, strict=True)], pa.list_(pa.int64())),
            ], ["id", "key", "bag", "size", "bands"])

    return docs.mapInArrow(each, "id bigint, key binary, bag binary, size bigint, bands array<bigint>")


def key_of(text_col: str) -> Column:
    """128-bit digest that tells the texts of one id (or of none) apart."""
    return F.unhex(F.md5(text_of(text_col).cast("binary")))


class Texts:
    """Texts of bags by the bag's number, as (id, text); a bag's text is that of its first row."""

    def __init__(self, source: DataFrame, reps: DataFrame, once: bool):
        self.source, self.firsts, self.once = source, reps.select(F.col("id").alias("node"), "row", "key"), once
        self.sparkSession = source.sparkSession

    def of(self, wanted: DataFrame) -> DataFrame:
        """The texts of the wanted bags: by broadcast if they are counted to be few, else by a shuffle."""
        firsts = materialise(
            wanted.select(F.col("id").alias("node")).join(self.firsts, "node").withColumnRenamed("key", "row_key"), "firsts", True
        )
        few = firsts.count() <= SMALL_GROUPS
        same = F.col("id").eqNullSafe(F.col("row")) & (F.col("key") == F.col("row_key"))
        found = self.source.join(F.broadcast(firsts) if few else firsts, same).select(F.col("node").alias("id"), "text")
        return found if self.once else found.groupBy("id").agg(F.first("text").alias("text"))


def verify(pairs: DataFrame, docs: Texts, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """Pairs (a, b) whose weighted Jaccard similarity on whole texts is at least the threshold.

    A text that meets many others is sent once for every CHUNK of them.
    """
    for_python(docs.sparkSession)
    degree = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    spread = join_groups(pairs, degree, ["a"], "n", pairs.count()).select(
        "a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / CHUNK)).alias("part")
    )
    spread = materialise(spread, "pairs", True)
    wanted = materialise(spread.select(F.col("a").alias("id")).union(spread.select("b")).distinct(), "wanted", True)
    texts = docs.of(wanted)
    right = spread.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    left = spread.select("a", "part").distinct().join(
        texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a"
    )
    share = threshold / (1 + threshold)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, bag = None, None
        for batch in batches:
            a, ta, b, tb = batch.columns
            others = bags([t.as_py().encode() for t in tb], words)
            keep = []
            for k, other in enumerate(others):
                if a[k].as_py() != last:
                    last = a[k].as_py()
                    bag = counted(bags([ta[k].as_py().encode()], words)[0])
                total = int(bag[1].sum()) + len(other)
                keep.append(overlap(bag, counted(other)) >= share * total - 1e-9)
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return left.join(right, ["a", "part"]).select("a", "ta", "b", "tb").mapInArrow(each, "a bigint, b bigint")


def meet(asks: DataFrame, rows: DataFrame, keys: list[str], docs: Texts, threshold: float, words: int) -> DataFrame:
    """Links (a, b) of different classes between some members of each part and all its members.

    ``asks`` and ``rows`` are (keys, id, label) with the part's size n.  A task compares up
    to ASKERS askers with up to SUB members at once through their sorted shingles, so no
    row is made for a pair that isn't linked; of an asker's links to a class, one is kept.
    """
    for_python(docs.sparkSession)
    count = materialise(asks.groupBy(*keys).agg(F.count(F.lit(1)).alias("asked"), F.max("n").alias("n")), "asked", True)
    chunks, subs = (F.ceil(F.col("asked") / ASKERS).cast("int"), F.ceil(F.col("n") / SUB).cast("int"))
    count = count.select(*keys, chunks.alias("chunks"), subs.alias("subs"), "n")

    def placed(side: DataFrame, own: str, other: str, seed: int) -> DataFrame:
        sized = join_groups(side.drop("n"), count, keys, "n", rows.count()).filter("n is not null")
        mine = F.pmod(F.xxhash64("id", F.lit(seed)), F.col(own)).cast("int")
        both = [mine, F.explode(F.sequence(F.lit(0), F.col(other) - 1))]
        named_ = [c.alias(n) for c, n in zip(both, (own[:-1], other[:-1]), strict=True)]
        return sized.select(*keys, "id", "label", *named_).select(
            F.xxhash64(*keys, "chunk", "sub").alias("task"), "id", "label"
        )

    left = materialise(placed(asks, "chunks", "subs", 1), "askers", True)
    right = materialise(placed(rows, "subs", "chunks", 2), "asked", True)
    wanted = materialise(left.select("id").union(right.select("id")).distinct(), "wanted", True)
    texts = docs.of(wanted)
    share = threshold / (1 + threshold)

    def each(askers: pa.Table, members: pa.Table) -> pa.Table:
        links: set[tuple[int, int]] = set()
        if askers.num_rows and members.num_rows:
            encoded = lambda t: [x.as_py().encode() for x in t.column("text")]
            mine = [counted(b) for b in bags(encoded(askers), words)]
            sizes = np.array([int(m[1].sum()) for m in mine])
            who = np.repeat(np.arange(len(mine)), [len(m[0]) for m in mine])
            keys_, counts = np.concatenate([m[0] for m in mine]), np.concatenate([m[1] for m in mine])
            order = np.argsort(keys_, kind="stable")
            keys_, counts, who = keys_[order], counts[order], who[order]
            ids, labels = askers.column("id").to_pylist(), askers.column("label").to_numpy()
            theirs = zip(members.column("id").to_pylist(), members.column("label").to_pylist(), bags(encoded(members), words), strict=True)
            seen: set[tuple[int, int]] = set()
            for member, label, bag in theirs:
                key, number = counted(bag)
                low, high = np.searchsorted(keys_, key, "left"), np.searchsorted(keys_, key, "right")
                hits = high - low
                at = np.repeat(low - (np.cumsum(hits) - hits), hits) + np.arange(hits.sum())
                both = np.bincount(
                    who[at], np.minimum(counts[at], np.repeat(number, hits)), minlength=len(mine)
                )
                for k in np.flatnonzero((both >= share * (sizes + len(bag)) - 1e-9) & (labels != label)):
                    if (k, label) not in seen:
                        seen.add((k, label))
                        links.add((ids[k], member))
        pairs = sorted(links)
        return pa.table({"a": pa.array([x for x, _ in pairs], pa.int64()), "b": pa.array([y for _, y in pairs], pa.int64())})

    def read(side: DataFrame) -> DataFrame:
        own = texts.select(F.col("id").alias("who"), F.col("text").alias("words"))
        return side.join(own, F.col("id") == F.col("who")).select("task", "id", "label", F.col("words").alias("text"))

    return read(left).groupBy("task").cogroup(read(right).groupBy("task")).applyInArrow(each, "a bigint, b bigint")


def _can_link(size_a: Column, size_b: Column, threshold: float) -> Column:
    return (size_a >= threshold * size_b - 1e-9) & (size_b >= threshold * size_a - 1e-9)


def _members(reps: DataFrame) -> DataFrame:
    """(bucket, id, size, n) of representatives that share a bucket with another."""
    rows = reps.select("id", "size", F.explode(F.array_distinct("bands")).alias("bucket"))
    counts = materialise(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets", True)
    return materialise(
        join_groups(rows, counts, ["bucket"], "n", rows.count()).filter("n is not null"), "members"
    )


def _with_top(members: DataFrame) -> DataFrame:
    """Add each bucket's most connected member (most bucket mates in all, then the smallest id)."""
    mass = members.groupBy("id").agg(F.sum("n").alias("mass"))
    top = members.join(mass, "id").groupBy("bucket").agg(
        F.max(F.struct("mass", (-F.col("id")).alias("first"), "size")).alias("t"), F.count(F.lit(1)).alias("k")
    ).select("bucket", (-F.col("t.first")).alias("top"), F.col("t.size").alias("top_size"), "k")
    return join_groups(members, materialise(top, "tops", True), ["bucket"], "k", members.count()).drop("k")


def _open(members: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Members of buckets that hold several classes, with their label and the bucket's size now."""
    plain = members.select(*keys, "id", "size")
    marked = plain.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "label", F.coalesce("label", "id")
    )
    marked = materialise(marked, "marked", True)
    state = marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")
    ).filter("lo < hi")
    state = materialise(state.drop("lo", "hi"), "open", True)
    return materialise(
        join_groups(marked, state, keys, "n", marked.count()).filter("n is not null"), "open"
    )


def _pairs(left: DataFrame, right: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Pairs of different classes within a bucket, each once, that sizes allow to link."""
    other = right.select(*keys, F.col("id").alias("b"), F.col("size").alias("size_b"), F.col("label").alias("label_b"))
    met = left.select(*keys, F.col("id").alias("a"), "size", "label").join(other, keys)
    fits = (F.col("label") != F.col("label_b")) & _can_link(F.col("size"), F.col("size_b"), threshold)
    return met.filter(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _unshared(ids: DataFrame, docs: Texts, words: int) -> DataFrame:
    """(id, own): weight of a text's shingles that no other of these texts has."""
    for_python(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [counted(b) for b in bags([t.as_py().encode() for t in batch.column(1)], words)]
            for start in range(0, len(sets), 64):
                part = sets[start : start + 64]
                ids = np.repeat(batch.column(0).to_numpy()[start : start + 64], [len(s[0]) for s in part])
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids), pa.array(np.concatenate([s[0] for s in part]).view(np.int64)),
                    pa.array(np.concatenate([s[1] for s in part])),
                ], ["id", "key", "weight"])

    rows = docs.of(ids).select("id", "text").mapInArrow(each, "id bigint, key bigint, weight bigint")
    single = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("id"), F.min("weight").alias("weight")
    ).filter("n = 1")
    return single.groupBy("id").agg(F.sum("weight").alias("own"))


def _refine(rows: DataFrame, docs: Texts, threshold: float, words: int) -> DataFrame:
    """Members of large open buckets with their size class c and the classes [low, high] that can link.

    Two bags can only link if what others may share of each reaches the needed overlap:
    size - own >= t / (1 + t) * (both sizes).  So each text admits a range of partner
    sizes.  One row per bucket and text, however many classes it admits; a text that
    admits none can have no link.
    """
    own = _unshared(materialise(rows.select("id").distinct(), "large", True), docs, words)
    most = (F.col("size") - F.coalesce("own", F.lit(0))) * ((1 + threshold) / threshold) - F.col("size")
    step = lambda c: F.floor(F.log(F.greatest(c.cast("double"), F.lit(1.0))) / float(np.log(STEP))).cast("int")
    return rows.join(own, "id", "left").select(
        "bucket", "id", "size", step(F.col("size")).alias("c"),
        (step(F.col("size") * threshold) - 1).alias("low"),
        F.least(step(F.col("size") / threshold) + 1, step(most) + 1).alias("high"),
    ).filter("high >= low")


def _open_ranges(parts: DataFrame, labels: DataFrame) -> DataFrame:
    """Members that admit a size class of their bucket in which another label is, with label and bucket's size n.

    A bucket's classes are a short list (their sizes grow by STEP), so it is joined to the
    members as one row.  Labels only ever merge, so a member left out stays settled.
    """
    plain = parts.select("bucket", "id", "size", "c", "low", "high")
    marked = plain.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    marked = materialise(marked, "marked", True)
    by_class = marked.groupBy("bucket", "c").agg(
        F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")
    )
    state = by_class.groupBy("bucket").agg(
        F.sum("n").alias("n"), F.min("lo").alias("least"), F.max("hi").alias("most"),
        F.collect_list(F.struct("c", "lo", "hi")).alias("classes"),
    ).filter("least < most").drop("least", "most")
    met = join_groups(marked, materialise(state, "open", True), ["bucket"], "n", marked.count()).filter("n is not null")
    other = F.exists("classes", lambda x: x["c"].between(F.col("low"), F.col("high")) & (
        (x["lo"] != F.col("label")) | (x["hi"] != F.col("label"))
    ))
    return materialise(met.filter(other).drop("classes"), "open", True)


def _settle(members: DataFrame, docs: Texts, links: DataFrame, threshold: float, words: int) -> DataFrame:
    """Labels (node, label) of classes, from the first links and the members of buckets.

    Small open buckets compare all pairs of different classes.  In large ones a growing
    number of open members meet all others, and who has met all others leaves, until no
    member admits one of another class.
    """
    labels = components(links)
    rows = _open(members, labels, ["bucket"])
    small = rows.filter(F.col("n") <= SMALL_BUCKET)
    pairs = materialise(_pairs(small, small, ["bucket"], threshold), "candidates", True)
    if not pairs.isEmpty():
        labels = extend(labels, materialise(verify(pairs, docs, threshold, words), "links", True))
    large = rows.filter(F.col("n") > SMALL_BUCKET)
    if large.isEmpty():
        return labels
    parts = materialise(_refine(large, docs, threshold, words), "parts", True)
    turn = 0
    while True:
        rows = _open_ranges(parts, labels)
        if rows.isEmpty():
            return labels
        turn += 1
        wanted = CHUNK * 8 ** (turn - 1)
        # Every turn takes all of a part that is small by now, else about `wanted` by hash.
        chance = (F.col("n") <= wanted) | (F.pmod(F.xxhash64("id", F.lit(turn)), F.col("n")) < wanted)
        links = materialise(meet(rows.filter(chance), rows, ["bucket"], docs, threshold, words), "links", True)
        labels = extend(labels, links)
        parts = materialise(rows.filter(~chance).drop("label", "n"), "parts", True)


def near_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, words: int = WORDS,
    bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """The result of ``near_dedup`` with the text's digest (``key_of``) in column ``__key``."""
    source = docs.select(
        named(docs, id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"), key_of(text_col).alias("key")
    )
    signed = materialise(sign(source, words, bands, rows), "signed")
    total = signed.count()
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")
    grouped = signed.groupBy("bag").agg(
        first, F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands"),
    )
    # Bags are numbered as they are written; ids may repeat with other texts, or be missing.
    reps = materialise(grouped.select(
        F.monotonically_increasing_id().alias("id"), "bag", F.col("first.id").alias("row"),
        F.col("first.key").alias("key"), "copies", "size", "bands",
    ), "reps")
    once = signed.groupBy("id", "key").count().filter("count > 1").isEmpty()
    texts = Texts(source, reps, once)
    members = _members(reps)
    topped = _with_top(members)
    first_pairs = topped.filter((F.col("id") != F.col("top")) & _can_link(F.col("size"), F.col("top_size"), threshold))
    pairs = materialise(first_pairs.select(F.col("top").alias("a"), F.col("id").alias("b")).distinct(), "stars", True)
    links = materialise(verify(pairs, texts, threshold, words), "links", True)
    labels = _settle(members, texts, links, threshold, words).withColumnRenamed("node", "id")
    classes = materialise(
        reps.join(labels, "id", "left").select(
            "bag", F.coalesce("label", "id").alias("label"), "copies", F.col("row").alias("id"), "key"
        ), "classes"
    )
    heads = classes.groupBy("label").agg(first, F.sum("copies").alias("class_size"))
    classes = materialise(classes.join(heads, "label").select(
        "bag", "copies", F.col("first.id").alias("class_id"), F.col("first.key").alias("class_key"), "class_size"
    ), "classes", True)
    out = join_groups(signed, classes, ["bag"], "copies", total)
    return out.select(
        F.col("id").alias(id_col), "class_id", "class_size", F.col("size").alias("bag_size"),
        (F.col("class_id").eqNullSafe(F.col("id")) & (F.col("class_key") == F.col("key"))).alias("kept"),
        F.col("key").alias("__key"),
    )


def near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, words: int = WORDS,
    bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """One row per input row: id, class_id, class_size, bag_size, kept.

    Texts belong to one class if a chain of links at or above the threshold joins them;
    class_id is the smallest id of the class, and that document is kept.  A text of
    fewer than ``words`` words is one shingle; texts without words (null, empty, blank)
    have equal, empty bags and form one class.  Texts with equal bags are one class
    without comparison.  Links join texts, not ids: rows that repeat an id with other
    texts are documents of their own.  If a class has several texts of its smallest id,
    the one of the smallest digest is kept; rows equal in id and text are kept together.
    Rows without id are compared as all others; their class has a null class_id if none
    of its rows has an id.  Ids are 64-bit integers.  Very long texts are compared whole; an
    empty table gives an empty table.  Other columns are ignored.
    """
    return near_classes(docs, id_col, text_col, threshold, words, bands, rows).drop("__key")
