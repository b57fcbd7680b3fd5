"""Quality rules, exact duplicates, sharding and URL rules on small tables."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from prepmill.llm import exact_dedup, quality_rules, sharding, url_filter

from .helpers import WORD

TEXTS = [
    None, "", "  \n\t", "one", "a b c a b c", "x " * 200, "a b\n\na b\na b\nc\r\n", "é ü # $ | <tag>", "日本 語",
    "w" * 5000, " ".join(str(i % 7) for i in range(3000)), "same text", "same  text", "same text",
]
DOCS = "doc_id bigint, text string, l string, s string, fp string, row string, kept string, n_words string, slot string"


def docs_of(spark, rows):
    extra = ("l", "s", "fp", "row", "kept", "nw", "slot")
    return spark.createDataFrame([(*r, *extra) for r in rows], DOCS)


def plain_rules(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    at = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(grams) < 400 else None
    if at is None:
        count = {}
        for g in grams:
            count[g] = count.get(g, 0) + 1
        at = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    return (
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(at)
    )


def test_measurements_and_base(spark):
    rows = list(enumerate(TEXTS)) + [(None, "null id"), (3, "one")]
    got = quality_rules.quality_rules(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for i, t in enumerate(TEXTS):
        r = by[i]
        mine = plain_rules(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == mine, t
        assert r["base_failed"] == (mine[0] < 50 or 100 * mine[4] > 50 * mine[0])
        assert not (r["base_failed"] and r["kept"])


def test_filter_keeps_columns_and_agrees(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("row", F.lit(1)).withColumn("fail_bits", F.lit("x"))
    kept = quality_rules.filter_documents(docs)
    assert kept.columns == docs.columns
    want = {r[0] for r in quality_rules.quality_rules(docs).filter("kept").select("doc_id").collect()}
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == want


def test_ablation_from_bits(spark, sf):
    rows = quality_rules.quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).cache()
    bits = [r[0] for r in rows.select("fail_bits").collect()]
    for r in quality_rules.ablate(rows).collect():
        mask = next(x.mask for x in quality_rules.RULES if x.name == r["rule"])
        assert r["n_failed"] == sum(b & mask != 0 for b in bits)
        assert r["n_alone"] == sum(b == mask for b in bits)
        assert r["n_kept_without"] == sum(b & ~mask == 0 for b in bits)


def test_labelled_good_documents_stay(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    found = quality_rules.quality_rules(docs).join(labels, "doc_id").filter("not base_failed")
    good = found.filter("quality = 1").agg(F.min(F.col("kept").cast("int"))).first()[0]
    assert good == 1


@pytest.mark.parametrize("capacity", [2, 500_000])
def test_exact_groups(spark, capacity):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "same text"), (40, "sametext"), (41, "sametext " * 9), (3, "one")]
    got = exact_dedup.exact_dedup(docs_of(spark, rows), capacity=capacity).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, t or ""))
    want = {}
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        for i, _ in members:
            want[i, hashlib.sha256(norm.encode()).hexdigest()] = (keep, len(members), i == keep)
    assert {(r["doc_id"], r["text_sha256"]): (r["keep_id"], r["group_size"], r["kept"]) for r in got} == want


def test_directory_splits_until_buckets_fit(spark):
    entries = spark.range(1000).select(F.xxhash64("id").alias("fp")).union(
        spark.range(300).select(F.lit(7).cast("bigint").alias("fp")))
    directory = exact_dedup.build_directory(entries, capacity=100)
    depth = directory.first()["global_depth"]
    assert directory.count() == 1 << depth
    sized = entries.withColumn("slot", exact_dedup._prefix(depth)).join(directory, "slot").groupBy("bucket").agg(
        F.count("*").alias("n"), F.countDistinct("fp").alias("d"))
    assert sized.filter("n > 100 and d > 1").filter(F.col("n") - 300 > 100).isEmpty()


def plain_jump(key, n):
    key &= 2**64 - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 2, 16, 17, 61, 1000])
def test_jump_matches_the_published_loop(spark, n):
    keys = [0, 1, 2, 3, 10**6, 2**62, -1, -(2**63), 2**63 - 1, *range(100, 160)]
    got = spark.createDataFrame([(k,) for k in keys], "k bigint").select("k", sharding.jump_shard(F.col("k"), n).alias("s"))
    assert {r["k"]: r["s"] for r in got.collect()} == {k: plain_jump(k, n) for k in keys}


def test_shards_slots_and_growth(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 20)] + [(None, "x"), (None, "x"), (5, "again")]
    got = sharding.assign_shards(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by = {r["doc_id"]: r for r in got if r["doc_id"] not in (None, 5)}
    for i, t in rows[:100]:
        if i != 5:
            assert (by[i]["size"], by[i]["text_crc32"]) == (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert sharding.assign_shards(docs_of(spark, [])).count() == 0


URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x", "https://example.com/en/",
    "https://a.example.com/en", "https://a.example.com/en/?q", "http://example.net/es/1#x", "http://xnet/es/", "x://y://com/",
    "http://.com/", "http://a..com//", "http://" + "a." * 3000 + "net/fr/" + "b/" * 3000, "http://é.com/é\nf", "http://u@b.net:80/fr/",
    "http://notexample.com/en/", "http://example.com/EN/",
]


def plain_url(url):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [
        (len(h + p), h + p, v) for v, h, p in url_filter.RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fit, default=(0, None, "allow"))
    return host, path, best[1], best[2]


@pytest.mark.parametrize("limit", [10, 0])
def test_url_rules(spark, monkeypatch, limit):
    monkeypatch.setattr(url_filter, "MAX_BROADCAST_RULES", limit)
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS)] + [(0, None, "x", "y"), (None, "http://a.com/", "x", "y")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, rule string, short string")
    got = url_filter.judge_urls(pages).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: tuple(r)[1:] for r in got}
    for i, u in enumerate(URLS):
        assert by[i] == plain_url(u), u
    assert url_filter.judge_urls(pages, []).filter("verdict <> 'allow'").isEmpty()
    partial = [("block", "com", "/e"), ("allow", "com", "/en")]
    longest = {r["page_id"]: r["rule"] for r in url_filter.judge_urls(pages, partial).collect()}
    assert longest[URLS.index("https://example.com/en/")] == "com/en" and longest[URLS.index("http://com/")] is None


def test_empty_tables_and_very_long_texts(spark):
    long = "word " * 400_000
    docs = docs_of(spark, [(1, long), (2, None), (3, long + " ")])
    rules = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    assert rules[1]["n_words"] == 400_000 == rules[1]["n_repeat_words"] and rules[1]["base_failed"]
    copies = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(docs).collect()}
    assert copies == {1: (3, 2), 2: (2, 1), 3: (3, 2)}
    none = docs.limit(0)
    assert quality_rules.quality_rules(none).collect() == [] == exact_dedup.exact_dedup(none).collect()
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []
