"""Prefix trie of conversations, built as burst tries.

A turn is known by a digest of its role and text.  Equal conversations are one sequence
with a count.  Sequences are cut into blocks of BLOCK turns; under a trie head (the root,
or a node at a block's end) the rest of a block is a suffix, and suffixes wait in
containers.  A container with more than CAPACITY suffixes is burst: its suffixes move to
containers by their next turn, one level at a time.  The containers that remain are dealt
to shards, sorted there and swept once, which names the node that each suffix reaches at
each depth by the smallest conversation through it.

Everything a node reports is a sum over the sequences through it, so partial sums of
containers add up, also for the heads above them: for a sequence c of weight w that
reaches depth d, with S the bytes from d to its end and T the bytes of those nodes among
them that bear c's name, the nodes below have w * S - T bytes to save in sum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import for_python, join_counted, materialise, named, text_of

#: Turns of a block: bounds the suffix rows, whatever a conversation's length.
BLOCK = 128
#: Suffixes of a container that are swept in one task.
CAPACITY = 4096
#: Conversation ids written into one piece of text when a node's ends are hashed.
IDS = 4096


def turn_id(role_col: str = "role", text_col: str = "text") -> Column:
    """Digest of a turn's role and text (null is empty)."""
    role, text = text_of(role_col), text_of(text_col)
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))


def turns_in_order(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv, pos, id, size): the turns of each conversation from 0, their digests and bytes of text."""
    rows = conversations.select(
        named(conversations, conv_col).cast("bigint").alias("conv"), named(conversations, turn_col).alias("turn"),
        F.unhex(turn_id(role_col, text_col)).alias("id"), F.octet_length(text_of(text_col)).cast("bigint").alias("size"),
    ).filter("conv is not null")
    placed = materialise(
        rows.repartitionByRange("conv", "turn", "id").sortWithinPartitions("conv", "turn", "id")
        .withColumn("at", F.monotonically_increasing_id()), "turns"
    ).withColumn("part", F.shiftright("at", 33))
    inside = Window.partitionBy("conv", "part").orderBy("at")
    # A conversation that lies in several ranges goes on counting; a range shares at most its
    # first conversation with an earlier one, so there is at most one such row for each range.
    runs = placed.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    firsts = runs.groupBy("conv").agg(F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = runs.join(firsts, "conv").withColumn("before", F.sum("n").over(before)).filter("before > 0")
    counted = placed.withColumn("pos", F.row_number().over(inside).cast("bigint") - 1)
    counted = counted.join(F.broadcast(shifts.select("conv", "part", "before")), ["conv", "part"], "left")
    return counted.select("conv", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "id", "size")


def regraft(turns: DataFrame, family: int = 5, longest: int = 9) -> tuple[DataFrame, DataFrame]:
    """Rebuild each conversation c on the first turns of the first one of its family.

    The first h turns are those of conversation c - c % family (as many as there are), then
    c's own turns after its first h follow; h = crc32(decimal c) % longest.  Returns the
    turns, and (conv, length) of every conversation, also of those left without turns.
    """
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(longest))
    own = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own"))
    own = materialise(own.select("conv", "own", h.alias("h"), (F.col("conv") - F.col("conv") % family).alias("base")), "convs", True)
    first = own.select(F.col("conv").alias("base"), F.col("own").alias("there"))
    # At most 2 * family conversations ask for one base.
    convs = own.join(first, "base", "left").withColumn("graft", F.least("h", F.coalesce("there", F.lit(0))))
    convs = materialise(convs.withColumn("length", F.col("graft") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "convs", True)
    heads = turns.filter((F.col("conv") % family == 0) & (F.col("pos") < longest)).withColumnRenamed("conv", "base")
    grafted = convs.select("conv", "base", "graft").join(heads, "base").filter("pos < graft").select("conv", "pos", "id", "size")
    facts = convs.select("conv", "own", "graft", "h")
    kept = join_counted(turns.filter(F.col("pos") >= h), facts, ["conv"], "own", turns.count())
    kept = kept.select("conv", (F.col("pos") - F.col("h") + F.col("graft")).alias("pos"), "id", "size")
    return grafted.unionByName(kept), convs.select("conv", "length")


def _blocks(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, block, ids, sizes): the turns of each block in order; a conversation without turns has one empty block."""
    entry = F.sort_array(F.collect_list(F.struct("pos", "id", "size"))).alias("e")
    full = turns.groupBy("conv", F.expr(f"pos div {BLOCK}").alias("block")).agg(entry).select(
        "conv", "block", F.col("e.id").alias("ids"), F.col("e.size").alias("sizes")
    )
    none = convs.filter("length = 0").select(
        "conv", F.lit(0).cast("bigint").alias("block"), F.expr("cast(array() as array<binary>)").alias("ids"),
        F.expr("cast(array() as array<bigint>)").alias("sizes"),
    )
    return materialise(full.unionByName(none), "blocks")


def _sequences(blocks: DataFrame) -> DataFrame:
    """(conv, rep, weight, length): the smallest conversation with the same turns, and how many there are.

    A conversation's digest is a sum over its blocks, so it needs no order and no gathering.
    """
    digest = F.md5(F.concat(F.encode(F.col("block").cast("string"), "utf-8"), F.array_join(F.transform("ids", F.hex), "").cast("binary")))
    words = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)]
    keys = [f"s{k}" for k in range(4)] + ["length"]
    one = blocks.groupBy("conv").agg(
        *[F.sum(w).alias(f"s{k}") for k, w in enumerate(words)], F.sum(F.size("ids")).alias("length")
    )
    one = materialise(one, "digests", True)
    groups = materialise(one.groupBy(*keys).agg(F.min("conv").alias("rep"), F.count(F.lit(1)).alias("weight")), "sequences", True)
    return materialise(join_counted(one, groups, keys, "weight", one.count()).select("conv", "rep", "weight", "length"), "members", True)


def _ends(members: DataFrame) -> DataFrame:
    """(rep, ends): SHA-256 of the decimal ids of the conversations with rep's turns, ascending, comma-joined.

    A digest is computed in order, but ids first become pieces of text where they lie, by
    ranges, so a task reads few rows even for a sequence that very many conversations share.
    """
    for_python(members.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, ids = None, []
        out: list[tuple[int, int, str]] = []
        for batch in batches:
            for r, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (r != rep or len(ids) == IDS):
                    out.append((rep, ids[0], ",".join(map(str, ids))))
                    ids = []
                rep = r
                ids.append(c)
            yield pieces_batch(out)
            out = []
        if ids:
            yield pieces_batch([(rep, ids[0], ",".join(map(str, ids)))])

    def pieces_batch(out: list[tuple[int, int, str]]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["rep", "first", "text"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, state = None, hashlib.sha256()
        for batch in batches:
            out = []
            for r, _, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if r == rep:
                    state.update(b",")
                else:
                    if rep is not None:
                        out.append((rep, state.hexdigest()))
                    rep, state = r, hashlib.sha256()
                state.update(text.encode())
            yield digest_batch(out)
        if rep is not None:
            yield digest_batch([(rep, state.hexdigest())])

    def digest_batch(out: list[tuple[int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string())], ["rep", "ends"])

    rows = members.select("rep", "conv").repartitionByRange("rep", "conv").sortWithinPartitions("rep", "conv")
    text = rows.mapInArrow(pieces, "rep bigint, first bigint, text string")
    return text.repartition("rep").sortWithinPartitions("rep", "first").mapInArrow(digests, "rep bigint, ends string")


def _burst(suffixes: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame]:
    """Deal suffixes (rep, head, ids) to containers of at most ``capacity``, bursting larger ones by the next turn.

    Returns suffixes in containers, with the owners (smallest rep) of the heads they passed
    and the container's size, and those that end at a head that was burst.
    """
    start = F.unhex(F.md5(F.col("head").cast("string")))
    going = suffixes.select("rep", "ids", start.alias("container"), F.expr("cast(array() as array<bigint>)").alias("owners"))
    settled, ended, depth = [], [], 0
    while True:
        groups = going.groupBy("container").agg(F.min("rep").alias("low"), F.count(F.lit(1)).alias("n"))
        met = join_counted(going, materialise(groups, "containers", True), ["container"], "n", going.count())
        if depth:
            met = met.withColumn("owners", F.array_append("owners", F.col("low")))
        met = materialise(met.drop("low"), "burst")
        settled.append(met.filter(F.col("n") <= capacity))
        large = met.filter(F.col("n") > capacity)
        ended.append(large.filter(F.size("ids") == depth))
        following = F.unhex(F.md5(F.concat("container", F.get("ids", F.lit(depth)))))
        going = large.filter(F.size("ids") > depth).drop("n").withColumn("container", following)
        depth += 1
        if going.isEmpty():
            return reduce(DataFrame.unionByName, settled), reduce(DataFrame.unionByName, ended)


def sweep(reps: np.ndarray, container: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes given by lengths and turn codes (one after another): the smallest rep through each
    node they reach, in the same order, and whether nothing else reaches a suffix's end."""
    rows, depth = len(lengths), int(lengths.max(initial=0))
    starts = np.cumsum(lengths) - lengths
    table = np.full((rows, depth), -1, np.int64)
    row = np.repeat(np.arange(rows), lengths)
    column = np.arange(len(codes)) - starts[row]
    table[row, column] = codes
    order = np.lexsort((*table.T[::-1], container))
    low, alone = np.empty((rows, depth), np.int64), np.zeros(rows, bool)
    mine, names = table[order], reps[order]
    same = container[order][1:] == container[order][:-1]
    for d in range(depth):
        same = same & (mine[1:, d] == mine[:-1, d]) & (mine[1:, d] >= 0)
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        count = np.diff(np.append(first, rows))
        low[order, d] = np.repeat(np.minimum.reduceat(names, first), count)
        single = np.zeros(rows, bool)
        single[order] = np.repeat(count == 1, count)
        alone |= single & (lengths == d + 1)
    return low[row, column], alone


def _swept(settled: DataFrame, capacity: int) -> DataFrame:
    """(rep, owners, alone) for the suffixes of containers with more than one; a shard holds several containers."""
    for_python(settled.sparkSession)
    shards = max(1, -(-settled.count() // capacity))

    def each(shard: pa.Table) -> pa.Table:
        shard = shard.combine_chunks()
        lists = shard.column("ids").combine_chunks()
        container = shard.column("container").combine_chunks().dictionary_encode().indices.to_numpy()
        codes = lists.flatten().dictionary_encode().indices.to_numpy()
        lengths = np.diff(lists.offsets.to_numpy())
        reps = shard.column("rep").to_numpy()
        found, alone = sweep(reps, container, lengths, codes)
        known = shard.column("owners").to_pylist()
        cuts = np.cumsum(lengths)[:-1]
        owners = [k + part[len(k) :].tolist() for k, part in zip(known, np.split(found, cuts), strict=True)]
        return pa.table({"rep": pa.array(reps), "owners": pa.array(owners, pa.list_(pa.int64())), "alone": pa.array(alone)})

    rows = settled.withColumn("shard", F.pmod(F.xxhash64("container"), F.lit(shards)))
    return rows.groupBy("shard").applyInArrow(each, "rep bigint, owners array<bigint>, alone boolean")


def _owners(blocks: DataFrame, capacity: int) -> DataFrame:
    """(rep, block, owners, alone) for the blocks of sequences that share their start with others.

    Block by block; a sequence whose block ends at a node of its own needs no later ones.
    """
    found, number = None, 0
    suffixes = blocks.filter("block = 0").select("rep", F.lit(0).alias("head"), "ids")
    while True:
        settled, ended = _burst(suffixes, capacity)
        several = _swept(settled.filter("n > 1"), capacity)
        single = settled.filter("n = 1").select(
            "rep", F.concat("owners", F.array_repeat("rep", F.size("ids") - F.size("owners"))).alias("owners"), F.lit(True).alias("alone")
        )
        here = several.unionByName(single).unionByName(ended.select("rep", "owners", F.lit(False).alias("alone")))
        here = materialise(here.withColumn("block", F.lit(number).cast("bigint")), "owners")
        found = here if found is None else found.unionByName(here)
        number += 1
        further = here.filter(~F.col("alone")).select("rep", F.try_element_at("owners", F.lit(-1)).alias("head"))
        suffixes = blocks.filter(F.col("block") == number).select("rep", "ids").join(further, "rep")
        if suffixes.isEmpty():
            return found


def _node_parts(blocks: DataFrame, root: int) -> DataFrame:
    """What each sequence adds to the node that it reaches at each depth, from the root on."""
    L, start = F.size("ids"), F.col("block") * BLOCK
    at = F.array_position("owners", F.col("rep"))
    own = F.when(F.col("rep") == root, F.lit(0)).when(at > 0, start + at)
    path = Window.partitionBy("rep")
    in_order = path.orderBy("block")
    later = in_order.rowsBetween(1, Window.unboundedFollowing)
    total = lambda values: F.aggregate(values, F.lit(0).cast("bigint"), lambda x, y: x + y)
    rows = blocks.select(
        "*", own.alias("own_here"), total(F.col("sizes")).alias("bytes"), (start + L == F.col("length")).alias("final")
    ).select(
        "*", F.coalesce(F.min("own_here").over(path), F.col("length") + 1).alias("own"),
        F.coalesce(F.sum("bytes").over(later), F.lit(0)).alias("after"),
        F.max(F.col("final") & F.col("alone")).over(path).cast("bigint").alias("leaf"),
        F.coalesce(F.lag(F.try_element_at("owners", F.lit(-1))).over(in_order), F.lit(root)).alias("above"),
    )
    # Bytes of the nodes that bear the sequence's name, from the block in which they begin.
    from_ = F.greatest(F.col("own") - start, F.lit(1)).cast("int")
    begins = ((F.col("own") > start) & (F.col("own") <= start + L)) | ((F.col("own") == 0) & (F.col("block") == 0))
    named_ = F.when(begins & (L > 0), F.col("after") + total(F.slice("sizes", from_, F.greatest(L, F.lit(1)))))
    rows = rows.withColumn("named", F.coalesce(F.max(named_).over(path), F.lit(0)))

    def part(depth: Column, node: Column, parent: Column, tid: Column, rest: Column) -> Column:
        """Its end's childless node, own next nodes, and the bytes saved from this depth on."""
        own_bytes = F.when(depth >= F.col("own"), rest).otherwise(F.col("named"))
        child = ((depth < F.col("length")) & (F.col("own") <= depth + 1)).cast("bigint")
        return F.struct(
            node.alias("conv_id"), depth.alias("depth"), parent.alias("parent_conv_id"), tid.alias("id"),
            F.col("weight").alias("n_convs"), child.alias("n_children"), F.col("leaf").alias("n_leaves"),
            (F.col("weight") * rest - own_bytes).alias("saved_tokens"),
            F.when(depth == F.col("length"), F.col("ends")).alias("ends"),
        )

    def reached(j: Column) -> Column:
        parent = F.when(j == 1, F.col("above")).otherwise(F.get("owners", j - 2))
        rest = F.col("after") + total(F.slice("sizes", j, F.greatest(L, F.lit(1))))
        return part(start + j, F.get("owners", j - 1), parent, F.get("ids", j - 1), rest)

    nothing = F.lit(None)
    top = part(F.lit(0).cast("bigint"), F.lit(root), nothing.cast("bigint"), nothing.cast("binary"), F.col("after") + F.col("bytes"))
    along = F.when(L > 0, F.transform(F.sequence(F.lit(1), F.greatest(L, F.lit(1))), reached)).otherwise(F.array())
    every = F.when(F.col("block") == 0, F.concat(F.array(top), along)).otherwise(along)
    return rows.select(F.explode(every).alias("p")).select("p.*")


def prefix_trie(turns: DataFrame, convs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Nodes of the trie of conversations given as turns (conv, pos, id, size) and (conv, length).

    One row per node: conv_id (smallest member), depth, parent_conv_id, turn_id (hex, null at
    the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.  ``id`` is a binary
    digest of the turn, ``size`` its bytes.  No conversations give no nodes.
    """
    blocks = _blocks(turns, convs)
    members = _sequences(blocks)
    root = members.agg(F.min("rep")).first()[0]
    if root is None:
        root = 0
    facts = members.filter("conv = rep").select("rep", "weight", "length", (F.expr(f"length div {BLOCK}") + 1).alias("n"))
    facts = materialise(facts.join(_ends(members), "rep"), "facts", True)
    mine = join_counted(blocks.withColumnRenamed("conv", "rep"), facts, ["rep"], "n", blocks.count()).filter("weight is not null")
    mine = materialise(mine.drop("n"), "suffixes")
    shared = _owners(mine, capacity)
    whole = mine.join(shared, ["rep", "block"], "left")
    alone = F.array_repeat("rep", F.size("ids"))
    whole = whole.withColumns({"owners": F.coalesce("owners", alone), "alone": F.coalesce("alone", F.lit(True))})
    nodes = _node_parts(whole, root).groupBy("conv_id", "depth").agg(
        F.min("parent_conv_id").alias("parent_conv_id"), F.lower(F.hex(F.min("id"))).alias("turn_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("ends").alias("ends"),
    )
    none = hashlib.sha256(b"").hexdigest()
    return nodes.withColumn("ends_sha256", F.coalesce("ends", F.lit(none))).drop("ends")


def conversation_trie(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text", capacity: int = CAPACITY,
) -> DataFrame:
    """The nodes (see ``prefix_trie``) of conversations as rebuilt by ``regraft``.

    Turns are ordered by number, null first; turns of one number by their digest (role and
    text).  Null roles and texts are empty.  Repeated rows are turns of their own.  Rows
    without a conversation id belong to no conversation and are left out.  Texts of any
    length take part through their digest and size only.  Other columns are ignored; an
    empty table gives an empty table.
    """
    turns = materialise(turns_in_order(conversations, conv_col, turn_col, role_col, text_col), "numbered")
    rebuilt, convs = regraft(turns)
    return prefix_trie(materialise(rebuilt, "rebuilt"), convs, capacity)
