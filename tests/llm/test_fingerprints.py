"""Winnowing against a plain version that looks at every window."""

import hashlib
import random

from pyspark.sql import functions as F

from prepmill.llm import fingerprints as fp
from prepmill.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, id string, tail string, _bucket string, hashes string"


def plain(text, gram, window, rolled=False):
    """Chosen positions by the definition; gram hashes come from the operator, one by one or rolled."""
    size = min(gram, len(text))
    if not size:
        return []
    if rolled:
        hashes = fp.gram_hashes(fp._codes(text), size).tolist()
    else:
        hashes = [int(fp.gram_hashes(fp._codes(text[i : i + size]), size)[0]) for i in range(len(text) - size + 1)]
    chosen = set()
    for s in range(max(1, len(hashes) - window + 1)):
        part = hashes[s : s + window]
        low = min(part)
        chosen.add(s + max(k for k, h in enumerate(part) if h == low))
    return [(p, hashes[p]) for p in sorted(chosen)]


def as_pairs(prints):
    return [(int(p), int(h)) for p, h in zip(*prints, strict=True)]


def samples():
    rng = random.Random(5)
    out = ["", "a", "short", "x" * 200, "ab" * 100, "é日本𝄞" * 30]
    for n in (18, 19, 20, 21, 38, 39, 40, 41, 42, 300, 1000):
        out.append("".join(rng.choice("abcd é𝄞\n") for _ in range(n)))
    return out


def test_winnow_is_the_definition(monkeypatch):
    texts = samples()
    for gram, window in ((20, 21), (5, 4), (3, 1), (1, 8)):
        want = [plain(t, gram, window) for t in texts]
        assert [as_pairs(p) for p in fp.winnow_all(texts, gram, window)] == want
        assert [as_pairs(fp.winnow(t, gram, window)) for t in texts] == want
    monkeypatch.setattr(fp, "SLICE", 64)  # long texts in slices, short ones in groups
    assert [as_pairs(p) for p in fp.winnow_all(texts)] == [plain(t, 20, 21) for t in texts]


def test_shared_passage_is_always_found(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    rows = []
    for i in range(60):
        passage = word(fp.GRAM + fp.WINDOW - 1)
        rows.append((i, word(rng.randint(0, 90)) + passage + word(50), word(rng.randint(0, 90)) + passage, passage))
    docs = spark.createDataFrame(rows, "doc_id bigint, a string, b string, passage string")
    left, right = fp.fingerprint(docs, text_col="a"), fp.fingerprint(docs, text_col="b").toDF("doc_id", "m", "p2", "h2")
    found = left.join(right, "doc_id").join(docs, "doc_id").select("*", fp.matches("positions", "hashes", "p2", "h2").alias("m2"))
    for r in found.collect():
        assert r["m2"], r["doc_id"]
        for x in r["m2"]:
            assert r["a"][x["position"] :][: fp.GRAM] == r["b"][x["other"] :][: fp.GRAM]
    other = docs.select("doc_id", F.lit("z" * 500).alias("text"))
    assert fp.fingerprint(other).filter("size(hashes) = 0").count() == 0


def expected(rows):
    """(id, n_chars, edited digest, likeness to edited and next) by the definition."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    out = []
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    bags = [{h for _, h in plain(t, fp.GRAM, fp.WINDOW, True)} for _, t in rows]
    for k, (i, t) in enumerate(rows):
        n = (k + 1) % len(rows)
        cut = len(t) // 4
        edited = t[: len(t) - cut] + rows[n][1][:cut]
        bag = {h for _, h in plain(edited, fp.GRAM, fp.WINDOW, True)}
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), like(bags[k], bag), like(bags[k], bags[n])))
    return sorted(out, key=str)


def compared(df):
    cols = ["doc_id", "n_chars", "edited_sha256", "near_edited", "near_next"]
    return sorted([tuple(r) for r in df.select(cols).collect()], key=str)


def test_edited_texts_nulls_ties_and_clashing_names(spark):
    texts = samples()
    rows = list(enumerate(texts)) + [(3, "again 3"), (3, "again 3"), (None, "no id " * 9), (None, None), (-4, None), (10**9, texts[-1])]
    docs = spark.createDataFrame([(*r, "i", "t", "b", "h") for r in rows], SCHEMA)
    got = fp.compare_edited(docs)
    assert compared(got) == expected(rows)
    by = {}
    for r in fp.digests(got).collect():
        by.setdefault(r["n_chars"], set()).add(r["fingerprint"])
    assert len(by[0]) == 1
    one = docs.filter("doc_id = 16")
    assert compared(fp.compare_edited(one)) == expected([(16, texts[16])])
    assert fp.compare_edited(docs.limit(0)).collect() == []
    assert fp.fingerprint(docs.limit(0)).collect() == []


def test_query_equals_plain(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = QUERIES["op13_winnowing"](spark, sf)
    assert compared(got) == expected(rows)
    same = got.join(docs, "doc_id").groupBy("text").agg(F.count_distinct("fingerprint").alias("n"))
    assert same.filter("n > 1").count() == 0
