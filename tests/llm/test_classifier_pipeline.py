"""The classifier on held-out labels, and the pipeline against plain versions of its stages."""

import math

import corpus_pipeline
from pyspark.sql import functions as F

from prepmill.llm import quality_classifier, quality_rules, suffix_dedup
from prepmill.llm.common import table

from .helpers import near_classes, removed_spans

SMALL = "/root/testdata/sf0.01"


def test_held_out_labels(spark):
    docs, labels = (table(spark, SMALL, t) for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)) == 0
    got = quality_classifier.classify(docs, labels.filter(~held), F.col("source"), F.col("lang"))
    assert got.count() == docs.count()
    rates = {
        (r["quality"], r["toxic"]): r["kept"]
        for r in got.join(labels.filter(held), "doc_id").groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    }
    assert rates[1, 0] >= 0.98 and rates[0, 0] <= 0.2 and rates[1, 1] <= 0.4


def test_shrinkage_follows_the_formula(spark):
    rows = [(f"h{i % 3}", f"p{i % 5}", ((i * 7) % 11 - 5) / 2) for i in range(300)] + [("rare", "x", -5.0)]
    scored = spark.createDataFrame(rows, "host string, path string, evidence double")
    hosts, paths, share, k = quality_classifier.site_posteriors(scored)
    p = lambda e: 1 / (1 + math.exp(-e))
    assert abs(share - sum(p(e) for *_, e in rows) / len(rows)) < 1e-5
    for r in hosts.collect():
        mine = [p(e) for h, _, e in rows if h == r["host"]]
        assert abs(r["host_posterior"] - (sum(mine) + k["host"] * share) / (len(mine) + k["host"])) < 1e-4
    rare = next(r for r in paths.collect() if r["host"] == "rare")
    assert p(-5.0) < rare["path_posterior"] <= share + 1e-6


def test_verdicts_by_plain_counting(spark):
    """Words, their G and odds, the constant, evidence, leave-one-out posterior and verdict, all by hand."""
    docs, labels = (table(spark, SMALL, t) for t in ("documents", "labels"))
    model = quality_classifier.fit_words(docs, labels)
    found = {
        r["doc_id"]: (r["f"], r["source"], r["lang"])
        for r in docs.select("doc_id", "source", "lang", quality_classifier.features(F.coalesce("text", F.lit(""))).alias("f")).collect()
    }
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    good = {}
    for r in labels.collect():
        good[r["doc_id"]] = min(good.get(r["doc_id"], 1), int(r["quality"] == 1 and r["toxic"] == 0))
    # Of labelled texts with the same smallest five words, the smallest id is looked at.
    import re

    first = {}
    hashes = spark.createDataFrame(
        [(d, re.split(r"[\x20\x09-\x0D]+", texts[d])) for d in good if d in texts], "d bigint, words array<string>"
    ).select("d", F.array_min(F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("words") - 5, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(5)]))).alias("least")).collect()
    for r in hashes:
        key = (good[r["d"]], r["least"])
        first[key] = min(first.get(key, r["d"]), r["d"])
    train = [(label, d) for (label, _), d in first.items()]
    fine, bad = sum(x for x, _ in train), sum(1 - x for x, _ in train)
    has = {}
    for label, d in train:
        for w in set(found[d][0]):
            has.setdefault(w, [0, 0])[0 if label else 1] += 1
    has = {w: pc for w, pc in has.items() if sum(pc) >= quality_classifier.LEAST_TEXTS}
    n = fine + bad
    words = {}
    for w, (p, c) in has.items():
        cells = [(p, (p + c) * fine / n), (c, (p + c) * bad / n), (fine - p, (n - p - c) * fine / n), (bad - c, (n - p - c) * bad / n)]
        g = 2 * sum(x * math.log(x / e) for x, e in cells if x)
        odds = math.log((p + 0.5) / (fine + 1) / ((c + 0.5) / (bad + 1)))
        if odds < 0 and g >= 2 * math.log(len(has)) + quality_classifier.MARGIN:
            words[w] = odds
    assert words.keys() == model.words.keys() and len(words) > 5
    assert all(abs(words[w] - model.words[w]) < 1e-5 for w in words)
    clip = lambda x: max(-quality_classifier.MOST_EVIDENCE, min(quality_classifier.MOST_EVIDENCE, x))
    bare = {d: clip(sum(model.words[w] for w in set(f) if w in model.words)) for d, (f, _, _) in found.items()}
    step = quality_classifier.STEP
    wrong = {
        k: sum((math.floor(round(bare[d], 6) / step) * step + k * step > 0) != (label == 1) for label, d in train)
        for k in range(1, int(quality_classifier.MOST_EVIDENCE / step))
    }
    best = [k for k, e in wrong.items() if e == min(wrong.values())]
    assert model.constant == step * best[len(best) // 2]
    evidence = {d: round(clip(model.constant + sum(model.words[w] for w in set(f) if w in model.words)), 6) for d, (f, _, _) in found.items()}
    p = lambda x: 1 / (1 + math.exp(-x))
    sites, hosts = {}, {}
    for d, (_, h, q) in found.items():
        for book, key in ((sites, (h or "", q or "")), (hosts, h or "")):
            book.setdefault(key, []).append(p(evidence[d]))
    rows = spark.createDataFrame([(h or "", q or "", evidence[d]) for d, (_, h, q) in found.items()], "host string, path string, evidence double")
    *_, share, k = quality_classifier.site_posteriors(rows)
    for r in quality_classifier.classify(docs, labels, F.col("source"), F.col("lang")).collect():
        d = r["doc_id"]
        h, q = found[d][1] or "", found[d][2] or ""
        mine = p(evidence[d])
        assert abs(r["evidence"] - evidence[d]) < 1e-5
        left_host = (sum(hosts[h]) - mine + k["host"] * share) / (len(hosts[h]) - 1 + k["host"])
        left = (sum(sites[h, q]) - mine + left_host * k["path"]) / (len(sites[h, q]) - 1 + k["path"])
        left = min(max(left, 1e-4), 1 - 1e-4)
        posterior = p(evidence[d] + math.log(left / (1 - left)) - math.log(share / (1 - share)))
        assert abs(r["posterior"] - posterior) < 1e-4 and (abs(posterior - 0.5) < 1e-4 or r["kept"] == (posterior >= 0.5))


def test_odd_tables_are_classified(spark):
    kind = "doc_id bigint, text string, source string, lang string, evidence string, found string"
    rows = [(1, None, None, None, "e", "f"), (1, "", "a", "b", "e", "f"), (None, "x " * 50_000, "a", "b", "e", "f")]
    docs = spark.createDataFrame(rows, kind)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = quality_classifier.classify(docs, none, F.col("source"), F.col("lang")).collect()
    assert len(got) == 3 and all(r["kept"] and r["evidence"] == 0 for r in got)
    some = spark.createDataFrame([(1, None, 0), (1, 1, None), (None, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert quality_classifier.classify(docs.limit(0), some, F.col("source"), F.col("lang")).count() == 0


def test_stages_against_plain_versions(spark, sf):
    docs = table(spark, sf, "documents")
    stages = dict(corpus_pipeline.STAGES)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "exact_dedup", "near_dedup", "suffix_dedup", "packing"]
    rows = {r["doc_id"]: r for r in docs.collect()}
    good = stages["quality_rules"](spark, docs, sf)
    assert good.columns == docs.columns
    kept = {r["doc_id"] for r in quality_rules.quality_rules(docs).filter("kept").collect()}
    assert {r["doc_id"] for r in good.collect()} == kept
    single = stages["exact_dedup"](spark, good, sf)
    groups = {}
    for i in kept:
        groups.setdefault("".join((rows[i]["text"] or "").translate({c: None for c in [32, *range(9, 14)]})), []).append(i)
    want = {min(g, key=lambda i: (-len(rows[i]["text"]), i)) for g in groups.values()}
    assert {r["doc_id"] for r in single.collect()} == want
    near = stages["near_dedup"](spark, single, sf)
    classes = near_classes([(i, rows[i]["text"]) for i in sorted(want)])
    left = {i for i, c in classes.items() if i == c}
    assert {r["doc_id"] for r in near.collect()} == left
    cut = stages["suffix_dedup"](spark, near, sf)
    assert cut.columns == docs.columns
    texts = {i: k.decode("utf-8", "ignore") for i, _, _, k in removed_spans([(i, rows[i]["text"]) for i in sorted(left)])}
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == texts
    packed = stages["packing"](spark, cut, sf)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == left
    whole = corpus_pipeline.run(spark, sf)
    key = ["doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert sorted(map(tuple, whole.select(key).collect())) == sorted(map(tuple, packed.select(key).collect()))


def test_stages_on_odd_rows(spark, sf):
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    text = " ".join(f"word{i}" for i in range(80))
    odd = [(1, text, "en", "s", 5), (1, text, "en", "s", 5), (None, text, None, None, None), (2, None, "en", "s", 0), (3, "", "en", "s", 0)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, kind)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, sf).collect(), kind)
        assert docs.count() == (1 if rows else 0)
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
        assert packed.select("doc_id").distinct().count() == (1 if rows else 0)
    assert suffix_dedup.LENGTH == 50
