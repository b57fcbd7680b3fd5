"""Collocations against plain counting of every phrase."""

import random
import re
import string
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from prepmill.llm import collocations as co
from prepmill.llm.queries import ORACLES, QUERIES

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id bigint, text string, lang string, word string, ext string, phrase string, n string, rank string, segment string"


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
        yield re.findall(r"[^\x20\x09]+", piece)


def plain_counts(rows, longest=3):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    return f, n


def plain(rows, longest=3, least=10, percent=50, top=2000):
    f, n = plain_counts(rows, longest)
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = set()
    for (lang, w), a in cand.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                if 100 * a >= percent * cand[(lang, w[i : i + size])]:
                    gone.add((lang, w[i : i + size]))
    by = defaultdict(list)
    for (lang, w), a in cand.items():
        if (lang, w) in gone:
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = f[(lang, w[:k])], f[(lang, w[k:])]
            cuts.append((1000000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        by[lang].append((-score, -a, " ".join(w).encode(), left, right))
    out = []
    for lang, found in by.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def fixture():
    rng = random.Random(3)
    words = ["the", "The", "of", "é", "日本", "x-y", "A1", "b", "naïve", "#"] + [f"w{i}" for i in range(12)]
    rows = []
    for i in range(300):
        w = [rng.choice(words[:4] if rng.random() < 0.5 else words) for _ in range(rng.randint(0, 60))]
        text = "".join(x + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", " ; "]) for x in w)
        rows.append((text, rng.choice(["en", "fr", None, "und", ""])))
    rows += [(None, "en"), ("", None), ("  \t. ,", "en"), ("same same same " * 40, "en"), ("same same same " * 40, "en")]
    rows.append(("long word phrase here. " * 3000, "en"))
    rows.append(("x" * 5000 + " y z " + "q" * 3000, "fr"))
    return rows


def docs_of(spark, rows):
    return spark.createDataFrame([(i, *r, *"abcdefg"[:6]) for i, r in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("chunk", [co.CHUNK, 700])
def test_equals_plain_counting(spark, monkeypatch, chunk):
    monkeypatch.setattr(co, "CHUNK", chunk)
    rows = fixture()
    docs = docs_of(spark, rows).repartition(3, "doc_id")
    assert sorted(map(tuple, co.collocations(docs).collect())) == plain(rows)
    assert sorted(map(tuple, co.collocations(docs, longest=4, least=3, percent=80, top=40).collect())) == plain(rows, 4, 3, 80, 40)


def test_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(co, "CHUNK", 64)
    rng = random.Random(1)
    for _ in range(40):
        text = "".join(rng.choice(["ab ", "c ", "d. ", "e\n", "long" * 30 + " "]) for _ in range(200))
        f, _ = plain_counts([(text, "en")])
        got = Counter()
        for part in co._parts("en", text.encode(), 2):
            w = co.Words([part])
            names = w.words.to_pylist()
            for i in range(len(w.code)):
                phrase = (names[w.code[i]],)
                if not w.counted[i]:
                    continue
                got["en", phrase] += 1
                for k in (1, 2):
                    if not w.joined[i + k - 1]:
                        break
                    phrase += (names[w.code[i + k]],)
                    got["en", phrase] += 1
        assert got == f


def test_hot_words_are_found_and_cut(spark):
    rows = [("the " + " ".join(f"the r{i * 50 + k}" for k in range(50)), "en") for i in range(20)]
    docs = docs_of(spark, rows)
    totals, hot = co.frequent_words(docs)
    assert hot["en", "the"] > 100 and len(hot) <= 2 * co.HOT_SHARE
    assert [tuple(r) for r in totals.collect()] == [("en", 2020)]
    counts = {tuple(r) for r in co.phrase_counts(docs, hot, least=1).collect()}
    f, _ = plain_counts(rows)
    assert counts == {(lang, " ".join(w), len(w), n) for (lang, w), n in f.items()}
    w = co.Words([("en", rows[0][0].encode(), 0)])
    segments = {r for b in co._stripes(w, 3, hot) for r in b.column(2).to_pylist()}
    assert len(segments) > 10


def test_scores_are_exact(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(300):
        top = 10 ** rng.randint(1, 14) - 1
        left, right = rng.randint(1, top), rng.randint(1, top)
        rows.append((rng.randint(1, min(left, right)), left, right))
    rows.append((10**14 - 1,) * 3)
    df = spark.createDataFrame(rows, "a bigint, l bigint, r bigint").withColumn("s", co.score(F.col("a"), F.col("l"), F.col("r")))
    for r in df.collect():
        assert r["s"] == 1000000 * r["a"] ** 2 // (r["l"] * r["r"])


def test_empty_tables(spark):
    docs = docs_of(spark, fixture()).limit(0)
    got = co.collocations(docs)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and got.collect() == []
    assert co.collocations(docs_of(spark, [(None, None), ("one two", "en")])).collect() == []


def test_query_equals_sql(spark, duck, sf):
    want = sorted(duck.sql(ORACLES["op11_collocations"]).fetchall())
    assert sorted(map(tuple, QUERIES["op11_collocations"](spark, sf).collect())) == want and want
