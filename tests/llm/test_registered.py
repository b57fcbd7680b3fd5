"""Registered queries without SQL, run as they are over whole small tables."""

import hashlib

import numpy as np
from tokenizers import Tokenizer

from prepmill.llm.common import table
from prepmill.llm.queries import QUERIES, tokenizer_file

from .helpers import near_classes, removed_spans


def texts(spark, sf):
    return [(r["doc_id"], r["text"] or "") for r in table(spark, sf, "documents").select("doc_id", "text").collect()]


def test_op3_equals_the_tokenizer(spark, sf):
    rows = texts(spark, sf)
    tokenizer = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    got = {r["doc_id"]: r for r in QUERIES["op3_bpe_automaton"](spark, sf).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()


def test_op6_equals_the_definition(spark, sf):
    got = {r["doc_id"]: r for r in QUERIES["op6_suffix_dedup"](spark, sf).collect()}
    for i, size, spans, kept in removed_spans(texts(spark, sf)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (size, sum(b - a for a, b in spans), len(spans))
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_op7_equals_all_pairs(spark, sf):
    got = {r["doc_id"]: r["class_id"] for r in QUERIES["op7_near_dedup"](spark, sf).collect()}
    assert got == near_classes(texts(spark, sf))


def test_op8_packs_every_id_once(spark, sf):
    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    import zlib

    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in texts(spark, sf)}
    seen, fill = {}, {}
    for r in sorted(QUERIES["op8_packing"](spark, sf).collect(), key=lambda r: (r["doc_id"], r["start"])):
        mine = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert seen.get(r["doc_id"], 0) == r["start"] and len(mine) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(mine, "<u4").tobytes())
        seen[r["doc_id"]] = r["start"] + r["length"]
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert seen == {i: len(x) for i, x in ids.items()}
    for pieces in fill.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048
