"""Quality rules as a bitmask ledger, in DataFrame functions only.

Each rule is evaluated once for each document.  The ledger keeps the measurements and
one bit per failed rule; policies are versioned masks over those bits, so a change of
policy or an ablation reads the ledger, never the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, named, text_of

SYMBOLS = r"[#*$%&|<>]"
WORD = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class Rule:
    """A rule's bit in the ledger and the test that fails a document."""

    bit: int
    name: str
    fails: Callable[[], Column]

    @property
    def mask(self) -> int:
        return 1 << self.bit


RULES = (
    Rule(0, "few_words", lambda: F.col("n_words") < 50),
    Rule(1, "repeated_words", lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    Rule(2, "symbols", lambda: 10 * F.col("n_symbols") > F.col("n_words")),
    Rule(3, "repeated_lines", lambda: 10 * F.col("n_dup_lines") > 6 * F.col("n_lines")),
    Rule(4, "short_words", lambda: F.col("word_chars") < 2 * F.col("n_words")),
    Rule(5, "long_words", lambda: F.col("word_chars") > 20 * F.col("n_words")),
)
BASE = RULES[0].mask | RULES[1].mask
#: Versions of the policy: the rules that each enforces.
POLICIES = {1: BASE, 2: BASE | RULES[2].mask | RULES[3].mask, 3: sum(r.mask for r in RULES)}
CURRENT = 3


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, wherever the optimizer moves the expression."""
    return F.transform(F.array(value), body)[0]


def _repeated(w: Column) -> Column:
    """Words in windows of three that occur twice or more: hashes of windows are sorted with
    their positions, and neighbours with equal hashes are compared word by word."""
    windows = F.when(F.size(w) > 2, F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
    ))

    def same(a: Column, b: Column) -> Column:
        equal = a["h"] == b["h"]
        for k in range(3):
            equal = equal & (F.get(w, a["i"] + k) == F.get(w, b["i"] + k))
        return equal

    def starts(s: Column) -> Column:
        pairs = F.zip_with(
            F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1),
            lambda a, b: F.when(same(a, b), F.array(a["i"], b["i"])),
        )
        return F.flatten(F.filter(pairs, lambda p: p.isNotNull()))

    covered = lambda at: F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2))))
    return _bound(F.sort_array(windows), lambda s: _bound(
        F.when(F.size(s) > 1, starts(s)), lambda at: F.when(F.size(at) > 0, F.size(covered(at))).otherwise(0)
    ))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Measurements of every whole text; a null text has no words and no lines.

    All are found inside the row, so nothing is shuffled.  With ``carry``, the input row
    comes along as struct ``row``.
    """
    text = text_of(text_col)
    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    found = {
        "n_words": lambda w, _: F.size(w),
        "word_chars": lambda w, _: F.char_length(F.array_join(w, "")),
        "n_symbols": lambda w, _: F.regexp_count(text, F.lit(SYMBOLS)),
        "n_lines": lambda _, x: F.size(x),
        "n_dup_lines": lambda _, x: F.size(x) - F.size(F.array_distinct(x)),
        "n_repeat_words": lambda w, _: _repeated(w),
    }
    all_of = _bound(words, lambda w: _bound(
        lines, lambda x: F.struct(*[f(w, x).cast("bigint").alias(k) for k, f in found.items()])
    ))
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    rows = docs.select(*row, named(docs, id_col).alias(id_col), all_of.alias("__m"))
    return rows.select(*(["row"] if carry else []), id_col, *[F.col(f"__m.{k}").alias(k) for k in found])


def ledger(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Iterable[Rule] = RULES, carry: bool = False
) -> DataFrame:
    """Measurements plus ``fail_bits``: bit b is set where the rule with bit b fails."""
    bits = F.lit(0)
    for rule in rules:
        bits = bits.bitwiseOR(F.when(rule.fails(), F.lit(rule.mask)).otherwise(F.lit(0)))
    return measure(docs, id_col, text_col, carry).withColumn("fail_bits", bits)


def apply_policy(rows: DataFrame, version: int = CURRENT, base: int = BASE) -> DataFrame:
    """Add base_failed, policy and kept; reads only the bits."""
    failed = F.col("fail_bits")
    return rows.withColumns({
        "base_failed": failed.bitwiseAND(F.lit(base)) != 0,
        "policy": F.lit(version),
        "kept": failed.bitwiseAND(F.lit(base | POLICIES[version])) == 0,
    })


def ablate(rows: DataFrame, version: int = CURRENT, rules: Iterable[Rule] = RULES) -> DataFrame:
    """For each rule of a policy: failures, failures by it alone, and kept without it.

    One aggregation folds the ledger to its distinct bit patterns (2**rules at most);
    all counts come from those.
    """
    mask = POLICIES[version]
    patterns = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    mine = [r for r in rules if r.mask & mask]
    table = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.mask).alias("m")) for r in mine]))
    bits = F.col("fail_bits").bitwiseAND(F.lit(mask))
    own = F.col("r.m")
    when = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return patterns.withColumn("r", table).groupBy(F.col("r.rule").alias("rule")).agg(
        when(bits.bitwiseAND(own) != 0).alias("n_failed"),
        when(bits == own).alias("n_alone"),
        when((bits == 0) | (bits == own)).alias("n_kept_without"),
    )


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", version: int = CURRENT
) -> DataFrame:
    """Ledger with the verdict of a policy: one row per input row, in no shuffle.

    Words are runs of characters outside ASCII white space.  Null and empty texts have no
    words and fail; a text of any length is measured whole; repeated rows and ids get a
    row each; other columns are ignored.
    """
    return apply_policy(ledger(docs, id_col, text_col), version)


def filter_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", version: int = CURRENT
) -> DataFrame:
    """The input rows that a policy keeps, with all their columns; no shuffle.

    Rows are dropped by exploding nothing: a filter would be moved below the
    measurements and have them made twice.
    """
    judged = apply_policy(ledger(docs, id_col, text_col, carry=True), version)
    return judged.select(F.explode(F.when(F.col("kept"), F.array("row"))).alias("row")).select("row.*")
