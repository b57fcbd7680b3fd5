"""Near duplicates, repeated passages and archives against brute force."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from prepmill.llm import near_dedup, suffix_dedup, warc
from prepmill.llm.components import components
from prepmill.llm.shingles import bags, counted, mix, word_hashes

from .helpers import WORD, near_classes, removed_spans


def test_words_and_bags_of_any_size():
    rng = random.Random(2)
    texts = ["", " ", "a", "a b c", "a b c d e f a b c d e", "\n".join("xyz" for _ in range(50)), "é\u00a0b \x1c c", "w" * 9_000_000]
    texts += [" ".join(rng.choice(["a", "b", "cc"]) for _ in range(rng.randrange(40))) for _ in range(200)]
    for t, b in zip(texts, bags([t.encode() for t in texts]), strict=True):
        w = WORD.findall(t)
        grams = [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
        assert len(b) == len(grams) and len(set(b.tolist())) == len(set(grams))
        assert counted(b)[1].sum() == len(grams)
    long = ("word " * 1_000_000 + "end").encode()
    assert len(word_hashes(long)) == 1_000_001 and len(set(word_hashes(long).tolist())) == 2


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    key = mix(rng.integers(0, 1 << 62, 400).astype(np.uint64))
    a = rng.integers(1, 40, 400)
    b = np.maximum(1, a + rng.integers(-9, 9, 400))
    b[:60] = 0
    sets = [(key, a), (key[b > 0], b[b > 0])]
    doc = np.repeat([0, 1], [len(s[0]) for s in sets])
    sign = near_dedup.bag_minhash(doc, np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets]), 2, 20_000)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sign[0] == sign[1]).mean() - true) < 0.015


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(201, 200), (200, 201), (7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**9)}"
    return " ".join(out)


def test_near_classes_of_a_large_group(spark):
    """One hot group whose copies differ from each other, chains through it, and exact copies."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    rows = [(i, edited(rng, base, rng.randrange(0, 9))) for i in range(260)]
    rows += [(1000 + i, f"alone {i} " + edited(rng, [f"v{rng.randrange(10**6)}" for _ in range(60)], 0)) for i in range(40)]
    rows += [(2000 + i, "the same short text of seven words") for i in range(300)]
    rows += [(3000, None), (3001, ""), (3002, " \n"), (3003, "a b"), (3004, "a  b"), (3005, "x " * 30_000), (3006, "x " * 28_000)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, "z", "q") for r in rows], "doc_id bigint, text string, id string, bands string")
    got = near_dedup.near_dedup(docs).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == near_classes(rows)
    sizes = {}
    for r in got:
        sizes[r["class_id"]] = sizes.get(r["class_id"], 0) + 1
    assert all(r["class_size"] == sizes[r["class_id"]] and r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)


def test_near_odd_tables(spark):
    kind = "doc_id bigint, text string"
    assert near_dedup.near_dedup(spark.createDataFrame([], kind)).count() == 0
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (None, "only here"), (2, "else")]
    got = sorted(tuple(r)[:3] + (r["kept"],) for r in near_dedup.near_dedup(spark.createDataFrame(rows, kind)).fillna(-1).collect())
    assert got == [(-1, -1, 1, True), (-1, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True), (2, 2, 1, True)]


def test_near_texts_of_repeated_and_missing_ids(spark, sf):
    """Links join texts: an id's other text stays in its own class, and texts without id are compared."""
    rng = random.Random(5)
    a, b, c = ([f"{x}{rng.randrange(10**6)}" for _ in range(120)] for x in "abc")
    rows = [
        (0, " ".join(b)), (1, " ".join(a)), (1, edited(rng, b, 1)), (2, edited(rng, a, 1)),
        (None, " ".join(c)), (None, edited(rng, c, 1)), (None, edited(rng, a, 1)), (1, "alone"), (1, "alone"), (None, "other"),
    ]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id bigint, text string, n int")
    got = near_dedup.near_classes(docs).join(docs.withColumn("__key", near_dedup.key_of("text")).drop("doc_id"), "__key")
    found = {r["n"]: (r["class_id"], r["class_size"], r["kept"]) for r in got.collect()}
    assert {n: found[n] for n in (0, 1, 2, 3, 6, 7, 8, 9)} == {
        0: (0, 2, True), 2: (0, 2, False), 1: (1, 3, True), 3: (1, 3, False), 6: (1, 3, False),
        7: (1, 2, True), 8: (1, 2, True), 9: (None, 1, True)}
    assert sorted(found[n] for n in (4, 5)) == [(None, 2, False), (None, 2, True)]
    left = {r["n"] for r in corpus_pipeline.near_stage(spark, docs, sf).collect()}
    assert left - {4, 5} == {0, 1, 7, 8, 9} and len(left & {4, 5}) == 1


@pytest.mark.parametrize("block,ranges", [(1 << 12, 1 << 12), (6 << 20, 8 << 20)])
def test_repeated_passages(spark, block, ranges):
    rng = random.Random(9)
    words = [f"{rng.randrange(10**9):x}" for _ in range(3000)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [say(rng.randrange(4, 40)) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [say(rng.randrange(0, 30))]
        for _ in range(rng.randrange(3)):
            piece = rng.choice(shared)
            cut = rng.randrange(len(piece))
            parts += [piece[cut:] if rng.random() < 0.3 else piece, say(rng.randrange(12))]
        rows.append((i, " ".join(parts)))
    rows += [(200 + i, rows[3][1]) for i in range(30)]
    rows += [(300, None), (301, ""), (302, "a" * 500), (303, "a" * 700), (304, "é" * 200), (305, "xé" * 100), (306, "é" * 200)]
    rows += [(307, say(120_000)), (308, say(3))]
    rows += [(309, rows[-2][1][1_040_000:1_060_000]), (310, "b" * 49), (311, "b" * 49)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, "r", "k") for r in rows], "doc_id bigint, text string, row string, kept string")
    got = {r["id"]: r for r in suffix_dedup.repeated_passages(
        docs, block_bytes=block, range_bytes=ranges).withColumnRenamed("doc_id", "id").collect()}
    assert len(got) == len(rows)
    for i, n, spans, kept in removed_spans(rows):
        r = got[i]
        assert (r["n_bytes"], [(s["start"], s["stop"]) for s in r["spans"]]) == (n, spans), i
        assert bytes(r["kept"]) == kept and r["text"] == kept.decode("utf-8", "ignore")
        assert (r["row"]["row"], r["row"]["kept"], r["row"]["doc_id"]) == ("r", "k", i)


def test_passages_of_odd_tables(spark):
    kind = "doc_id bigint, text string"
    assert suffix_dedup.repeated_passages(spark.createDataFrame([], kind)).count() == 0
    text = "0123456789" * 6
    rows = [(None, text), (7, text), (7, text), (8, text), (None, text)]
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.passage_digests(
        suffix_dedup.repeated_passages(spark.createDataFrame(rows, kind))).collect())
    assert got == [(-1, 60, 1), (-1, 60, 1), (7, 0, 0), (7, 0, 0), (8, 60, 1)]


TRAP = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
PAGES = [
    (1, "http://a/", "<p>one</p>"), (2, "http://b/", "<p>one</p>"), (3, None, None), (4, "", ""), (5, "http://x\r\nEvil: 1", TRAP),
    (6, "http://c/", "x" + TRAP * 3 + "WARC/1.0\r\n"), (7, "http://d/", "WARC/1.0\r\n" * 5), (8, "http://é/", "é" * 1000),
    (9, "http://e/", "y" * 300_000 + TRAP + "z" * 300_000), (10, "u", TRAP), (11, "u", "\r\n\r\n"), (12, "u", "<p>one</p>"),
]


@pytest.mark.parametrize("split", ["134217728", "4096"])
def test_archives_round_trip(spark, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = PAGES + [(100 + i, "u", f"page {i} " * 50) for i in range(300)] + [(None, "u", "null id")]
        pages = spark.createDataFrame([(*r, "v") for r in rows], "page_id bigint, url string, html string, value string").coalesce(3)
        got = warc.archive_pages(pages).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = {}
    for i, _, h in rows:
        h = h or ""
        sha = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        to = first.get(h)
        want[i] = (len(h.encode()), sha, "response" if to == i else "revisit", None if to == i else to)
    assert len(got) == len(rows)
    assert {r["page_id"]: tuple(r)[1:] for r in got} == want


def test_minimum_size_and_empty_table(spark):
    kind = "page_id bigint, url string, html string"
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef"), (4, "u", "abcdef"), (3, "u", "abcdef")]
    got = sorted((r["page_id"], r["record_type"], r["refers_to"] or 0) for r in warc.archive_pages(
        spark.createDataFrame(rows, kind), min_bytes=3).collect())
    assert got == [(1, "response", 0), (2, "response", 0), (3, "response", 0), (3, "response", 0), (4, "revisit", 3), (4, "revisit", 3)]
    assert warc.archive_pages(spark.createDataFrame([], kind)).count() == 0


def test_broken_chain_is_not_followed():
    head = warc.parse_head(b"Content-Length: 5\r\n\r\nhello\r\n\r\n")
    assert (head["head"], head["length"]) == (10 + 21, 5)
    assert warc.parse_head(b"Content-Length: x\r\n\r\n") is None and warc.parse_head(b"no header") is None
    rows = [{"at": 0, "size": 10, "next": 10}, {"at": 10, "size": 5, "next": 99}, {"at": 15, "size": 5, "next": 17}]
    warc._leave(rows)
    assert [r["leave"] for r in rows] == [99, 99, -1]


def test_base32_of_sha1(spark):
    got = spark.createDataFrame([("",), ("abc",), ("é" * 99,)], "t string").select("t", warc.base32_sha1(F.col("t"))).collect()
    assert all(d == base64.b32encode(hashlib.sha1(t.encode()).digest()).decode() for t, d in got)
