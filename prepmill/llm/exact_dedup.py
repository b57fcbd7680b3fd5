"""Exact deduplication over an extendible-hash index on shared files.

Only DataFrame functions are used.  The index holds one small row per document; whole
texts are read for fingerprints, and again only for documents whose fingerprint repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import measured
from .common import SPACE, join_groups, materialise, named, text_of

#: The directory doubles at most this often, so it never has more than 2**16 entries.
MAX_DEPTH = 16
#: Index entries that a bucket may hold before it is split.
CAPACITY = 500_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, "")


def _prefix(depth: int) -> Column:
    """The first ``depth`` bits of the fingerprint."""
    return F.shiftrightunsigned(F.col("fp"), 64 - depth).cast("int") if depth else F.lit(0)


def _number(value: int) -> Column:
    return F.lit(str(value)).cast("decimal(20,0)")


def _wide(chars: Column) -> Column:
    """A length moved beyond the range of ids."""
    return (chars.cast("decimal(17,0)") * _number(2**64)).cast("decimal(38,0)")


def build_directory(entries: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Directory (slot, bucket, depth) of an extendible hash over column ``fp``.

    Every pass counts the buckets of one depth and splits those over capacity into two,
    which doubles the directory.  A bucket whose entries share one fingerprint cannot be
    split; it stays, and its entries form a chain.  Buckets still too large at MAX_DEPTH
    stay as well.  At most 2**MAX_DEPTH rows.
    """
    spark = entries.sparkSession
    leaves: list[tuple[int, int]] = []
    depth, open_prefixes = 0, None
    while True:
        counted = entries.groupBy(_prefix(depth).alias("p")).agg(
            F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")
        )
        over = {
            r["p"] for r in counted.filter((F.col("n") > capacity) & (F.col("lo") < F.col("hi"))).collect()
        } if depth < MAX_DEPTH else set()
        mine = range(1) if open_prefixes is None else open_prefixes
        leaves += [(p, depth) for p in mine if p not in over]
        open_prefixes = [q for p in mine if p in over for q in (2 * p, 2 * p + 1)]
        if not open_prefixes:
            break
        depth += 1
    rows = [
        (slot, bucket, local)
        for bucket, (p, local) in enumerate(leaves)
        for slot in range(p << (depth - local), (p + 1) << (depth - local))
    ]
    return spark.createDataFrame(rows, "slot int, bucket int, depth int").withColumn("global_depth", F.lit(depth))


def build_index(docs: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY) -> DataFrame:
    """Index entries by bucket on shared files: bucket, fp, sha, chars and the id."""
    text = text_of(text_col)
    entries = materialise(
        docs.select(
            named(docs, id_col).alias("__id"), F.char_length(text).cast("bigint").alias("chars"),
            normalised(text).alias("__norm"),
        ).select("__id", "chars", F.xxhash64("__norm").alias("fp"), F.sha2("__norm", 256).alias("sha")),
        "entries",
    )
    directory = build_directory(entries, capacity)
    depth = directory.first()["global_depth"]
    placed = entries.withColumn("slot", _prefix(depth)).join(
        F.broadcast(directory.select("slot", "bucket")), "slot"
    )
    # Owner tasks: each takes whole key ranges; entries of one fingerprint are spread by id.
    owned = placed.repartitionByRange("bucket", "fp", "__id").sortWithinPartitions("bucket", "fp")
    return materialise(owned.select("bucket", "fp", "sha", "chars", "__id"), "index")


def chain_classes(docs: DataFrame, index: DataFrame, text_col: str) -> DataFrame:
    """Classes of equal texts among entries whose fingerprint repeats.

    Grouping by (fp, normalised text) compares bytes; entries that collide in fp alone
    become separate links of its chain.  Partial aggregation folds copies before the
    shuffle, so a text that a third of the rows share costs one row per task.
    """
    repeated = index.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fp")
    text = text_of(text_col)
    suspects = docs.select(
        named(docs, "__id"), F.char_length(text).cast("bigint").alias("chars"), normalised(text).alias("norm"),
    ).withColumn("fp", F.xxhash64("norm")).join(measured(repeated), "fp", "left_semi")
    # The longest original wins, then the smallest id: one number orders both.
    order = _wide(F.col("chars")) - F.coalesce(F.col("__id").cast("decimal(20,0)"), _number(2**63))
    best = suspects.withColumn("rank", order.cast("decimal(38,0)")).groupBy("fp", "norm").agg(
        F.count(F.lit(1)).alias("group_size"), F.max("rank").alias("rank"), F.max("chars").alias("most"),
    )
    keep = _wide(F.col("most")) - F.col("rank")
    return best.select(
        "fp", F.sha2("norm", 256).alias("sha"), "group_size",
        F.when(keep < _number(2**63), keep).cast("bigint").alias("keep_id"),
    )


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, bucket.

    Texts are equal when identical without ASCII white space; null counts as empty, and
    empty texts form a group like any other.  The row with the most code points stays,
    then the smallest id; a null id loses every tie.  Rows that repeat an id within a
    group carry the same verdict.  Ids are 64-bit integers.  Very long texts are compared
    whole; an empty table gives an empty table.  Other columns are ignored.
    """
    source = docs.select(named(docs, id_col).cast("bigint").alias("__id"), named(docs, text_col).alias(text_col))
    index = build_index(source, "__id", text_col, capacity)
    classes = materialise(chain_classes(source, index, text_col), "classes")
    out = join_groups(index, classes, ["fp", "sha"], "group_size", index.count())
    alone = F.col("group_size").isNull()
    keep_id = F.when(alone, F.col("__id")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("__id").alias(id_col), keep_id.alias("keep_id"),
        F.coalesce(F.col("group_size"), F.lit(1)).cast("bigint").alias("group_size"),
        keep_id.eqNullSafe(F.col("__id")).alias("kept"), F.col("sha").alias("text_sha256"), "bucket",
    )
