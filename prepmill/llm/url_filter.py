"""URL rules by host suffix and path prefix, matched through short hash prefixes.

A URL is expanded into host-suffix/path-prefix expressions, no longer than the longest
rule.  Expressions meet rules in an equi-join on the first 32 bits of their SHA-256;
survivors are confirmed by the full digest and the rule's own path, and the longest
fitting rule decides.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, named

#: Rules beyond this number are joined by shuffle instead of a broadcast (about 100 bytes each).
MAX_BROADCAST_RULES = 200_000
#: Salts that spread the pages of a common expression in the shuffled join.
SALTS = 32

# The rules of the query, as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty without ``://`` or for null."""
    there = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substr(url, F.instr(url, "://") + 3)
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(there, low).otherwise(""), F.when(there, path).otherwise("")


def _folder(path: str) -> str:
    """The part of a rule's path up to its last slash: what URLs are expanded to."""
    return path[: path.rfind("/") + 1]


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Rules with digest and the short prefix; a later rule repeats an earlier one in vain."""
    rows = list(dict.fromkeys((v, h, p) for v, h, p in rules))
    if not all(p.startswith("/") and h for _, h, p in rows):
        raise ValueError("a rule needs a host and a path that starts with /")
    made = spark.createDataFrame(
        [(k, v, h + p, p, h + _folder(p)) for k, (v, h, p) in enumerate(rows)],
        "rule_no int, rule_verdict string, rule string, rule_path string, expression string",
    )
    digest = F.sha2("expression", 256)
    return made.select(
        "rule_no", "rule_verdict", "rule", "rule_path", digest.alias("digest"), F.substring(digest, 1, 8).alias("short")
    )


def expressions(host: Column, path: Column, labels: int, depth: int) -> Column:
    """Host suffixes of up to ``labels`` labels times path folders of up to ``depth`` slashes."""
    # A suffix of k labels starts after the k-th dot from the end; substring_index finds it.
    suffixes = F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.lit(labels)), lambda k: F.call_function("substring_index", host, F.lit("."), -k)
    ))
    folders = F.filter(F.transform(
        F.sequence(F.lit(1), F.lit(depth)),
        lambda k: F.concat(F.call_function("substring_index", path, F.lit("/"), k), F.lit("/")),
    ), lambda p: F.startswith(path, p))
    pairs = F.transform(suffixes, lambda s: F.transform(F.array_distinct(folders), lambda p: F.concat(s, p)))
    return F.flatten(pairs)


def judge_urls(
    pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, id_col: str = "page_id",
    url_col: str = "url", default: str = "allow",
) -> DataFrame:
    """One row per input row: id, host, path, rule (or null), verdict.

    A URL that no rule fits gets ``default``.  Null and malformed URLs have an empty host
    and path and fit no rule.  Of fitting rules the longest wins, then the first given.
    Repeated rows get a row each.  Expansion is bounded by the longest rule, so a URL of
    any length makes a fixed number of expressions.
    """
    spark = pages.sparkSession
    rules = list(rules)
    host, path = split_url(named(pages, url_col))
    base = pages.select(named(pages, id_col).alias(id_col), host.alias("host"), path.alias("path"))
    if not rules:
        return base.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    book = rule_table(spark, rules)
    labels = max(h.count(".") + 1 for _, h, _ in rules)
    depth = max(p.count("/") for _, _, p in rules)
    spread = expressions(F.col("host"), F.col("path"), labels, depth)
    digests = F.transform(spread, lambda e: F.sha2(e, 256))
    if len(rules) <= MAX_BROADCAST_RULES:
        # Short prefixes first: most expressions end here.  The row stays whole, no shuffle.
        rows = base.withColumn("__row", F.monotonically_increasing_id())
        book = F.broadcast(book)
        salt = F.lit(0)
    else:
        rows = materialise(base.withColumn("__row", F.monotonically_increasing_id()), "urls")
        book = book.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.col("__row"), F.lit(SALTS)).cast("int")
    if "salt" not in book.columns:
        book = book.withColumn("salt", F.lit(0))
    met = rows.select("*", salt.alias("salt"), F.explode_outer(digests).alias("full")).withColumn(
        "short", F.substring("full", 1, 8)
    ).join(book, ["short", "salt"], "left")
    fits = (F.col("full") == F.col("digest")) & F.startswith(F.col("path"), F.col("rule_path"))
    ranked = F.when(fits, F.struct(
        F.char_length("rule").alias("size"), (-F.col("rule_no")).alias("first"), F.col("rule"), F.col("rule_verdict")
    ))
    best = met.groupBy("__row", id_col, "host", "path").agg(F.max(ranked).alias("best"))
    return best.select(
        id_col, "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.rule_verdict"), F.lit(default)).alias("verdict"),
    )
