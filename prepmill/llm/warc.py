"""WARC archives written by Spark's text writer and read back by boundary-chain verification.

Reading: tasks split archives at every ``WARC/1.0`` line, wherever it stands, and emit
each as a candidate with the offset of its successor (offset plus header plus
Content-Length plus the closing line breaks).  A candidate is a record only if the chain
from the file's start reaches it; magic inside a payload is never reached.  Chains are
followed inside a block by the task that read it, and across blocks by pointer jumping,
whose rounds grow with the logarithm of the blocks in the largest file.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.joins import measured
from ..session import drop_at_exit, scratch_path
from .common import join_counted, materialise, named, for_python, text_of

# Fixed values of the format.
MAGIC = b"WARC/1.0\r\n"
CLOSE = b"\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2020-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1, from five hex digits (four base32 digits) at a time."""
    digest = F.sha1(payload)
    parts = [
        F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)
    ]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def plan_records(pages: DataFrame, id_col: str, body_col: str, min_bytes: int) -> DataFrame:
    """Add to each page: key, payload, digest and, for revisits, refers_to.

    Of pages with equal payloads (SHA-256) of at least ``min_bytes``, those with the
    smallest id are responses.  Copies are folded before the shuffle; pages meet their
    group through a counted broadcast or a join that spreads large groups.
    """
    full = pages.withColumn("__body", text_of(body_col)).withColumn("__key", F.sha2("__body", 256))
    keys = full.filter(F.octet_length("__body") >= min_bytes).groupBy("__key").agg(
        F.count(F.lit(1)).alias("__n"), F.min(named(pages, id_col)).alias("__first")
    )
    groups = materialise(keys.filter("__n > 1"), "payloads")
    total = pages.count()
    return join_counted(full, groups, ["__key"], "__n", total).withColumn(
        "__refers", F.when(~F.col("__first").eqNullSafe(named(pages, id_col)), F.col("__first"))
    )


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
    min_bytes: int = 0,
) -> None:
    """Write one record per page to archives under ``path``, one file per task.

    Spark's text writer puts the records down, with the record's closing line breaks as
    its line separator, so any store will do and failed tasks leave nothing behind.
    Null payloads count as empty; line breaks in a URL are written as %0D and %0A.
    """
    rows = plan_records(pages, id_col, body_col, min_bytes)
    revisit = F.col("__refers").isNotNull()
    url = F.replace(F.replace(text_of(url_col), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    size = F.octet_length("__body")
    header = F.concat(
        F.lit(MAGIC.decode()),
        F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(named(pages, id_col).cast("string"), F.lit("")),
        F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), base32_sha1(F.col("__body")),
        F.lit("\r\nWARC-Payload-Length: "), size.cast("string"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), F.col("__refers").cast("string"), F.lit(">")))
        .otherwise(""),
        F.lit("\r\nContent-Length: "), F.when(revisit, 0).otherwise(size).cast("string"), F.lit("\r\n\r\n"),
    )
    body = F.when(revisit, "").otherwise(F.col("__body"))
    rows.select(F.concat(header, body).alias("value")).write.option("lineSep", CLOSE.decode()).text(path)


_CHUNK = (
    "file string, block bigint, at bigint, size bigint, next bigint, leave bigint, "
    "head bigint, length bigint, kind string, record string, digest string, stated bigint, refers string, found string"
)
_CHUNK_TYPES = [
    pa.string(), *[pa.int64()] * 7, pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()
]
_CHUNK_NAMES = [part.split()[0] for part in _CHUNK.split(", ")]


def _id_in(value: str | None) -> str | None:
    return value.strip("<>").removeprefix("urn:page:") if value else None


def parse_head(chunk: bytes) -> dict | None:
    """Header fields of what follows the magic, or None if it is no header."""
    end = chunk.find(CLOSE)
    lines = chunk[: max(end, 0)].decode("latin-1").split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines if ": " in x)
    length = fields.get("Content-Length", "")
    if end < 0 or len(fields) != len(lines) or not (length.isascii() and length.isdigit()):
        return None
    stated = fields.get("WARC-Payload-Length", "")
    return {
        "head": len(MAGIC) + end + len(CLOSE), "length": int(length), "kind": fields.get("WARC-Type"),
        "record": _id_in(fields.get("WARC-Record-ID")), "refers": _id_in(fields.get("WARC-Refers-To")),
        "digest": fields.get("WARC-Payload-Digest", "").removeprefix("sha1:"),
        "stated": int(stated) if stated.isascii() and stated.isdigit() else None,
    }


def _sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _leave(rows: list[dict]) -> None:
    """Where the chain from each candidate of a block leaves the block; -1 if it breaks off."""
    ends = rows[-1]["at"] + rows[-1]["size"] if rows else 0
    leaves: dict[int, int] = {}
    for row in reversed(rows):
        after = row["next"]
        row["leave"] = after if after < 0 or after >= ends else leaves.get(after, -1)
        leaves[row["at"]] = row["leave"]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of each block: offsets within the block, successors, header fields, digests.

    A task holds the candidates (not the payloads) of one block at a time.
    """
    now: tuple | None = None
    rows: list[dict] = []
    at = 0

    def out() -> Iterator[pa.RecordBatch]:
        _leave(rows)
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.get(n) for r in rows], t) for n, t in zip(_CHUNK_NAMES, _CHUNK_TYPES, strict=True)], _CHUNK_NAMES
            )

    for batch in batches:
        for value, file, block in zip(*batch.columns, strict=True):
            chunk, key = value.as_py(), (file.as_py(), block.as_py())
            if key != now:
                yield from out()
                now, rows, at = key, [], 0
                if key[1] == 0:  # what stands before the first magic is no candidate
                    rows.append({"file": key[0], "block": 0, "at": 0, "size": len(chunk), "next": -1})
                    at = len(chunk)
                    continue
            row = {"file": key[0], "block": key[1], "at": at, "size": len(MAGIC) + len(chunk), "next": -1}
            head = parse_head(chunk)
            if head:
                row |= head
                row["next"] = at + head["head"] + head["length"] + len(CLOSE)
                if row["next"] == at + row["size"]:
                    row["found"] = _sha1_base32(chunk[head["head"] - len(MAGIC) : len(chunk) - len(CLOSE)])
            rows.append(row)
            at += row["size"]
    yield from out()


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """The archives' bytes between magics, with file and block; splittable."""
    read = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return read.select(F.col("value").cast("binary").alias("value"), "_metadata.file_path", "_metadata.file_block_start")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """All candidates with offsets within their file."""
    for_python(spark)
    local = materialise(_chunks(spark, path).mapInArrow(_scan, _CHUNK), "candidates")
    sums = local.groupBy("file", "block").agg(F.sum("size").alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"))
    shift = lambda c: F.when(F.col(c) < 0, -1).otherwise(F.col(c) + F.col("start")).alias(c)
    moved = [shift(c) if c in ("at", "next", "leave") else F.col(c) for c in local.columns]
    return local.join(measured(starts), ["file", "block"]).select(*moved)


def entries(nodes: DataFrame) -> DataFrame:
    """Offsets (file, at) at which the chain from each file's start enters a block.

    Only candidates that some chain enters from outside matter here: a few per block.
    Pointers double each round, so the rounds are the logarithm of a file's blocks.
    """
    valid = nodes.filter("next >= 0").select("file", "block", "at", "leave")
    starts = valid.filter("block = 0").groupBy("file").agg(F.min("at").alias("at"))
    # A file's chain starts at its first byte; bytes before the first magic break it.
    starts = starts.filter("at = 0")
    targets = valid.select("file", F.col("leave").alias("at")).filter("at >= 0").union(starts).distinct()
    links = materialise(valid.join(targets, ["file", "at"], "left_semi").select("file", "at", F.col("leave").alias("to")), "links")
    most = nodes.select("file", "block").distinct().groupBy("file").count().agg(F.max("count")).first()[0] or 0
    reached, jump = starts, links
    for k in range(int(most).bit_length()):
        step = jump.select("file", "at", "to")
        reached = reached.union(
            reached.join(step, ["file", "at"]).select("file", F.col("to").alias("at"))
        ).distinct()
        reached = materialise(reached, "reached")
        if k + 1 < int(most).bit_length():
            over = jump.select("file", F.col("at").alias("to"), F.col("to").alias("further"))
            jump = materialise(
                jump.join(over, ["file", "to"]).select("file", "at", F.col("further").alias("to")), "jump"
            )
    return reached


def _follow(rows: pd.DataFrame) -> pd.DataFrame:
    """Candidates of one block: which the chain reaches, and the record that each belongs to."""
    rows = rows.sort_values("at", ignore_index=True)
    place = {a: k for k, a in enumerate(rows["at"]) if rows["next"][k] >= 0}
    reached = np.zeros(len(rows), bool)
    first = rows["enter"].dropna()
    at = int(first.iloc[0]) if len(first) else -1
    while at in place:
        reached[place[at]] = True
        at = int(rows["next"][place[at]])
    owner = rows["at"].astype("Int64").where(pd.Series(reached)).ffill()
    return rows.drop(columns="enter").assign(reached=reached, owner=owner)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records on the chain from each file's start: file, at, kind, record, payload_bytes, digest, refers.

    Digests are computed from the payload as read.  A payload that holds magic spans
    several chunks; those are read again and put together, one record at a time.
    """
    nodes = candidates(spark, path)
    enter = entries(nodes)
    entered = nodes.select("file", "block", "at").join(enter, ["file", "at"]).select(
        "file", "block", F.col("at").alias("enter")
    )
    schema = f"{_CHUNK}, reached boolean, owner bigint"
    marked = materialise(
        nodes.join(measured(entered), ["file", "block"], "left").groupBy("file", "block").applyInPandas(_follow, schema),
        "marked",
    )
    records = marked.filter("reached")
    split = records.filter("found is null")
    if split.isEmpty():
        return _records(records)
    # A chunk before its block's entry belongs to the last record of the blocks before.
    last = marked.groupBy("file", "block").agg(F.max("owner").alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select("file", "block", F.max("last").over(before).alias("carry"))
    owned = marked.join(measured(carry), ["file", "block"], "left").withColumn("owner", F.coalesce("owner", "carry"))
    whole = split.select("file", F.col("at").alias("owner"), F.col("head").alias("o_head"), F.col("length").alias("o_length"))
    parts = owned.join(measured(whole), ["file", "owner"]).select(
        "file", "block", "at", "owner", "o_head", "o_length",
    )
    first = marked.groupBy("file", "block").agg(F.min("at").alias("first"))
    wanted = measured(parts.join(measured(first), ["file", "block"]).withColumn("at", F.col("at") - F.col("first")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, 0
        for batch in batches:
            offsets, values = [], []
            for value, file, block in zip(*batch.columns, strict=True):
                chunk, key = value.as_py(), (file.as_py(), block.as_py())
                head = key == now or key[1] != 0
                at = at if key == now else 0
                now = key
                offsets.append(at)
                values.append(MAGIC + chunk if head else chunk)
                at += len(values[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(offsets, pa.int64()), pa.array(values, pa.binary())],
                ["file", "block", "at", "value"],
            )

    bytes_of = _chunks(spark, path).mapInArrow(place, "file string, block bigint, at bigint, value binary")
    joined = bytes_of.join(wanted, ["file", "block", "at"]).groupBy("file", "owner", "o_head", "o_length").agg(
        F.sort_array(F.collect_list(F.struct((F.col("first") + F.col("at")).alias("at"), "value"))).alias("parts")
    )
    body = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["value"]))
    payload = F.expr("substring(body, cast(o_head + 1 as int), cast(o_length as int))")
    made = joined.withColumn("body", body).select("file", F.col("owner").alias("at"), base32_sha1(payload).alias("made"))
    return _records(records.join(measured(made), ["file", "at"], "left").withColumn("found", F.coalesce("found", "made")))


def _records(rows: DataFrame) -> DataFrame:
    revisit = F.col("kind") == "revisit"
    return rows.select(
        "file", "at", "kind", "record",
        F.when(revisit, F.col("stated")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(revisit, F.col("digest")).otherwise(F.col("found")).alias("payload_digest"),
        F.col("digest").alias("stated_digest"), F.when(revisit, F.col("refers")).alias("refers"),
    )


def archive_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 0
) -> DataFrame:
    """Write archives in the shared folder, read them back, one row per page.

    Columns: id, payload_bytes, payload_digest, record_type, refers_to.  Null payloads
    are empty ones.  Rows that repeat the smallest id of a group are all responses; a
    null id is a revisit unless its group has only null ids.  Ids are 64-bit integers.  Very
    long payloads are archived whole; an empty table gives an empty table; other columns
    are ignored.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    source = pages.select(
        named(pages, id_col).cast("bigint").alias(id_col), named(pages, url_col).alias(url_col),
        named(pages, body_col).alias(body_col),
    )
    write_archives(source, path, id_col, url_col, body_col, min_bytes)
    drop_at_exit(spark, path)
    return read_records(spark, path).select(
        F.when(F.col("record") != "", F.col("record")).cast("bigint").alias(id_col), "payload_bytes", "payload_digest",
        F.col("kind").alias("record_type"), F.col("refers").cast("bigint").alias("refers_to"),
    )
