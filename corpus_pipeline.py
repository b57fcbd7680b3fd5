"""The training-data pipeline: stages of the operators of ``prepmill.llm``, in order.

Each stage takes the documents that the one before it kept.  All but the last return the
columns of ``documents``, with any further columns unchanged; the last returns pieces of
packed sequences.  Null texts count as empty and very long ones are read whole; an empty
table gives an empty table in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepmill.llm import exact_dedup, near_dedup, packing, quality_rules, suffix_dedup
from prepmill.llm.common import SMALL_GROUPS, materialise, table, text_of
from prepmill.llm.queries import tokenizer_file


def _without(docs: DataFrame, dropped: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys (null equals null) are not listed; the list is broadcast if counted to be small."""
    dropped = dropped.select(*[F.col(k).alias(f"__{k}") for k in keys])
    if dropped.count() <= SMALL_GROUPS:
        dropped = F.broadcast(dropped)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return docs.join(dropped, same, "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of the rules keeps."""
    return quality_rules.filter_documents(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts; rows that repeat an id and its text are one."""
    found = materialise(exact_dedup.exact_dedup(docs), "exact")
    sha = F.sha2(exact_dedup.normalised(text_of("text")), 256)
    marked = docs.withColumn("__sha", sha)
    keys = found.select(F.col("doc_id"), F.col("text_sha256").alias("__sha"), "kept")
    kept = _without(marked, keys.filter(~F.col("kept")).select("doc_id", "__sha"), ["doc_id", "__sha"])
    if not keys.filter("kept").groupBy("doc_id", "__sha").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "__sha"])
    return kept.select(docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, also where ids repeat with other texts or are missing."""
    found = materialise(near_dedup.near_classes(docs), "near")
    marked = docs.withColumn("__key", near_dedup.key_of("text"))
    gone = found.filter(~F.col("kept")).select("doc_id", "__key").distinct()
    return _without(marked, gone, ["doc_id", "__key"]).select(docs.columns)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that documents of smaller id have; n_chars is counted anew."""
    found = suffix_dedup.repeated_passages(docs)
    changed = F.size("spans") > 0
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns if c != "text"}
    columns["text"] = F.col("text")
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(changed, F.char_length("text").cast(kind)).otherwise(columns["n_chars"])
    return found.select(*[columns[c].alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sequences that the documents are packed into."""
    return packing.piece_digests(packing.pack(docs, tokenizer_file("word_bpe_49k.json")))


#: (name, function of (spark, docs, sf_dir)).
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("suffix_dedup", suffix_stage),
    ("packing", packing_stage),
]
#: No SQL: near duplicates by banding and tokenisation cannot be stated in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written as Parquet and read by the next stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name, wide=True)
    return STAGES[-1][1](spark, docs, sf_dir)
