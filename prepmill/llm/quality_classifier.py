"""Quality of documents from their own words and from their sites, by hierarchical empirical Bayes.

A document's evidence is a sum of log-odds of the words and shapes that labelled bad
documents have significantly more often than good ones.  Sites are a hierarchy of host
and path.  A host's good share is shrunk toward the global one, a path's toward its
host's; the strength of either shrinkage is estimated from how much the groups really
differ (method of moments), so sparse sites follow their prior and large ones speak for
themselves.  A document's posterior combines its evidence with the shift of its site,
computed without the document itself.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, join_groups, materialise, named, text_of

#: Labelled documents that the word model is fitted on, about so many at most, chosen by hash of the id.
MAX_TRAIN = 20_000
#: A word counts if it is in so many texts, and so unevenly that chance would hardly do it
#: for any of the sample's words: G = 2 * log(words) + MARGIN.
LEAST_TEXTS = 3
MARGIN = 4.0
STEM = 5
#: Grid of the model's constant.
STEP = 0.25
#: Evidence beyond this log-odds counts as this much.
MOST_EVIDENCE = 12.0
#: Shares are summed as whole millionths, so that sums don't depend on the order of rows.
UNIT = 1_000_000
STRENGTHS = (1.0, 1_000_000.0)


def features(text: Column) -> Column:
    """Distinct lower-case words and runs of symbols, and what else counts like a word.

    That is four shapes in bins, and the first STEM letters of words if two or three words
    of the text share them: what is rare in one form may be frequent in many.
    """
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|[^\p{L}\p{N}\s]+)"), F.lit(1))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")

    def bound(value: Column, body: Callable[[Column], Column]) -> Column:
        """``body(value)`` with the value computed once."""
        return F.transform(F.array(value), body)[0]

    def shapes(words: Column, distinct: Column, rows: Column) -> Column:
        n, chars = F.greatest(F.size(words), F.lit(1)), F.greatest(F.char_length(text), F.lit(1))
        bins = {
            "capitals": F.least(F.floor(20 * F.regexp_count(text, F.lit(r"\p{Lu}")) / chars), F.lit(9)),
            "symbols": F.least(F.floor(40 * F.regexp_count(text, F.lit(r"[#*$%&|<>!]")) / chars), F.lit(9)),
            "repeats": F.floor(10 * (F.size(words) - F.size(distinct)) / n),
            "lines": F.floor(10 * (F.size(rows) - F.size(F.array_distinct(rows))) / F.greatest(F.size(rows), F.lit(1))),
        }
        return F.array(*[F.concat(F.lit(f"<{k} "), v.cast("string"), F.lit(">")) for k, v in bins.items()])

    def stems(words: Column) -> Column:
        return F.sort_array(F.transform(
            F.filter(words, lambda w: F.char_length(w) >= STEM), lambda w: F.substring(w, 1, STEM)
        ))

    def repeated(s: Column, k: int) -> Column:
        """Stems that the k-th neighbour in order shares, marked by k."""
        same = F.zip_with(s, F.slice(s, k + 1, F.size(s)), lambda a, b: F.when(a == b, F.concat(a, F.lit(f"~{k + 1}"))))
        return F.array_distinct(F.filter(same, lambda x: x.isNotNull()))

    return bound(found, lambda w: F.concat(
        bound(F.array_distinct(w), lambda d: F.concat(d, bound(lines, lambda x: shapes(w, d, x)))),
        bound(stems(w), lambda s: F.concat(repeated(s, 1), repeated(s, 2))),
    ))


@dataclass
class WordModel:
    """Log-odds of the words that speak against a document, and of a document without any."""

    constant: float = 0.0
    words: dict[str, float] = field(default_factory=dict)

    def evidence_of(self, found: Column) -> Column:
        total = F.lit(self.constant)
        if self.words:
            # Words are looked up in a hashed set; only the few that hit are searched in the book.
            names = list(self.words)
            book = F.map_from_arrays(F.lit(names), F.lit(list(self.words.values())))
            hits = F.filter(found, lambda w: w.isin(names))
            total = total + F.aggregate(hits, F.lit(0.0), lambda s, w: s + book[w])
        bounded = F.least(F.greatest(total, F.lit(-MOST_EVIDENCE)), F.lit(MOST_EVIDENCE))
        return F.round(bounded, 6)

    def evidence(self, rows: DataFrame) -> DataFrame:
        """Add ``evidence`` (log-odds of good) to rows with a ``text``."""
        return rows.withColumn("__found", features(F.col("text"))).withColumn(
            "evidence", self.evidence_of(F.col("__found"))
        ).drop("__found")


def _sample(docs: DataFrame, labels: DataFrame, max_train: int, good: Column, id_col: str, text_col: str) -> DataFrame:
    """(label, found) of labelled texts; of texts that share their smallest shingle (copies), one."""
    marks = labels.filter(named(labels, id_col).isNotNull()).withColumn("__good", good.cast("int")).filter(
        "__good is not null"
    ).groupBy(named(labels, id_col).alias("__id")).agg(F.min("__good").alias("label"))
    marks = materialise(marks, "labels")
    chosen = marks.filter(F.pmod(F.xxhash64("__id"), F.lit(max(marks.count(), 1))) < max_train)
    texts = docs.select(named(docs, id_col).alias("__id"), text_of(text_col).alias("text"))
    picked = texts.join(F.broadcast(chosen), "__id").withColumn("words", F.split("text", SPACE))
    least = F.array_min(F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("words") - 5, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(5)]),
    ))
    picked = picked.select("label", "__id", features(F.col("text")).alias("found"), least.alias("least"))
    return materialise(
        materialise(picked, "train").groupBy("label", "least").agg(F.min_by("found", "__id").alias("found")), "train"
    )


def fit_words(
    docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, good: Column | None = None, id_col: str = "doc_id",
    text_col: str = "text",
) -> WordModel:
    """Fit the word model on a bounded sample of labelled documents.

    ``good`` is a condition on the labels' columns; by default quality 1 and not toxic.
    A document labelled more than once is good if all its labels say so.  Words count
    only against a document: words of good texts are as many as a language has.  With
    labels of one class only, the model says nothing.  Every word that passes the test is
    kept; the sample, at most ``max_train`` texts or so, bounds how many there are.
    """
    good = good if good is not None else (F.col("quality") == 1) & (F.col("toxic") == 0)
    train = _sample(docs, labels, max_train, good, id_col, text_col)
    size = dict(train.groupBy("label").count().collect())
    if len(size) < 2:
        return WordModel()
    fine, bad = size[1], size[0]
    n = fine + bad
    counted = materialise(train.select("label", F.explode("found").alias("word")).groupBy("word").agg(
        F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("c")
    ).filter(F.col("p") + F.col("c") >= LEAST_TEXTS), "words")
    all_words = max(counted.count(), 1)
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    p, c = F.col("p"), F.col("c")
    has, lacks = p + c, F.lit(n) - (p + c)
    g = 2 * (
        part(p, has * (fine / n)) + part(c, has * (bad / n))
        + part(F.lit(fine) - p, lacks * (fine / n)) + part(F.lit(bad) - c, lacks * (bad / n))
    )
    odds = F.log(((p + 0.5) / (fine + 1)) / ((c + 0.5) / (bad + 1)))
    strong = counted.select("word", F.round(odds, 6).alias("odds"), F.round(g, 6).alias("g")).filter(
        (F.col("odds") < 0) & (F.col("g") >= 2 * math.log(all_words) + MARGIN)
    ).orderBy(F.desc("g"), "word").collect()
    model = WordModel(0.0, {r["word"]: r["odds"] for r in strong})
    # The constant is the one that tells the sample's classes apart best; of several, the middle one.
    bins = train.groupBy("label", F.floor(model.evidence_of(F.col("found")) / STEP).alias("bin")).count().collect()
    errors = {
        k: sum(r["count"] for r in bins if (r["bin"] * STEP + k * STEP > 0) != (r["label"] == 1))
        for k in range(1, int(MOST_EVIDENCE / STEP))
    }
    least = min(errors.values())
    best = [k for k, e in errors.items() if e == least]
    model.constant = STEP * best[len(best) // 2]
    return model


def _logit(p: Column) -> Column:
    return F.log(p / (F.lit(1.0) - p))


def shrinkage(groups: DataFrame, prior: Column) -> float:
    """Prior strength k of groups (good, n) around their priors, by the method of moments.

    For shares drawn from Beta(k * prior, k * (1 - prior)), the expected squared
    deviation of a group of n is prior * (1 - prior) * (1 + (n - 1) / (k + 1)) / n.
    """
    spread = prior * (F.lit(1.0) - prior)
    share = F.col("good") / UNIT / F.col("n")
    row = groups.filter("n > 1").agg(
        F.sum(F.round(F.col("n") * F.pow(share - prior, 2) * UNIT).cast("bigint")).alias("seen"),
        F.sum(F.round(spread * UNIT).cast("bigint")).alias("noise"),
        F.sum(F.round(spread * (F.col("n") - 1) * UNIT).cast("decimal(38,0)")).alias("slope"),
    ).first()
    if not row["seen"] or not row["slope"]:
        return STRENGTHS[1]
    over = (row["seen"] - row["noise"]) / float(row["slope"])  # 1 / (k + 1)
    return min(max(1 / over - 1 if over > 0 else STRENGTHS[1], STRENGTHS[0]), STRENGTHS[1])


def site_posteriors(rows: DataFrame) -> tuple[DataFrame, DataFrame, float, dict[str, float]]:
    """Hosts and paths with shrunk shares, the global share, and the strengths.

    One aggregation by (host, path) folds the rows; hosts and the total come from it.
    """
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("evidence")))
    paths = materialise(rows.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(p * UNIT).cast("bigint")).alias("good")
    ), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    row = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    share = min(max((row["good"] or 0) / UNIT / (row["n"] or 1), 1e-4), 1 - 1e-4) if row["n"] else 0.5
    k_host = shrinkage(hosts, F.lit(share))
    hosts = hosts.withColumn(
        "host_posterior", (F.col("good") / UNIT + F.lit(k_host * share)) / (F.col("n") + F.lit(k_host))
    )
    paths = paths.join(
        hosts.select("host", F.col("n").alias("host_n"), F.col("good").alias("host_good"), "host_posterior"), "host"
    )
    k_path = shrinkage(paths, F.col("host_posterior"))
    paths = paths.withColumn(
        "path_posterior",
        (F.col("good") / UNIT + F.col("host_posterior") * k_path) / (F.col("n") + F.lit(k_path)),
    )
    return hosts, paths, share, {"host": k_host, "path": k_path}


def classify(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text",
    max_train: int = MAX_TRAIN, threshold: float = 0.5, model: WordModel | None = None,
) -> DataFrame:
    """One row per input row: id, host, path, evidence, host_posterior, path_posterior, posterior, kept.

    ``host`` and ``path`` are columns of ``docs``; null counts as an empty name.  Null
    texts are empty, with the evidence of the model's constant.  Without labels of both
    classes, the evidence is 0 and every document is kept.  Repeated rows and ids get a
    row each; very long texts are read whole; an empty table gives an empty table; other
    columns are ignored.  Sites of any size are joined by counted
    broadcast or by a shuffle without hot keys.
    """
    model = model or fit_words(docs, labels, max_train, id_col=id_col, text_col=text_col)
    rows = docs.select(
        named(docs, id_col).alias("__id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"),
        F.coalesce(path.cast("string"), F.lit("")).alias("path"), text_of(text_col).alias("text"),
    )
    scored = materialise(model.evidence(rows).drop("text"), "evidence")
    _, paths, share, strength = site_posteriors(scored)
    paths = materialise(paths, "posteriors")
    total = paths.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    joined = join_groups(scored, paths, ["host", "path"], "n", total)
    own = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("evidence")))
    left_host = (F.col("host_good") / UNIT - own + strength["host"] * share) / (F.col("host_n") - 1 + F.lit(strength["host"]))
    left = (F.col("good") / UNIT - own + left_host * strength["path"]) / (F.col("n") - 1 + F.lit(strength["path"]))
    bounded = F.least(F.greatest(left, F.lit(1e-4)), F.lit(1 - 1e-4))
    odds = F.col("evidence") + _logit(bounded) - _logit(F.lit(share))
    posterior = F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-odds)), 6)
    return joined.select(
        F.col("__id").alias(id_col), "host", "path", "evidence", F.round("host_posterior", 6).alias("host_posterior"),
        F.round("path_posterior", 6).alias("path_posterior"), posterior.alias("posterior"),
        (posterior >= threshold).alias("kept"),
    )
