"""Tokenisation by the automaton and packing along the curve, against the library."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from prepmill.llm import bpe, packing

BYTES = str(public_tokenizers.path("byte_bpe_50k.json"))
WORDS = str(public_tokenizers.path("word_bpe_49k.json"))
PARTS = [
    "a", "b", "e", "t", "th", "the ", " ", "  ", "\n", "é", "ß", "1", "23", "!!", "--", "----", "'s", "ing", " of", "中", "🙂",
    "\u00a0", "\x1c", "=", "====", "<|endoftext|>", "<|startoftext|>", "\t", "A", "AA", "e\u0301", "Σ", "ΑΣ", "\u2003", "İ", "\x85", "\x01",
]


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(25))) for _ in range(n)]


def test_automaton_equals_the_library():
    library = Tokenizer.from_file(BYTES)
    coder = bpe.Coder(bpe.Automaton.from_json(open(BYTES, encoding="utf-8").read()))
    for t in [*texts(1, 4000), "a" * 5000, " " * 3000, "ab" * 2000, "\n" * 999 + "x"]:
        ids = library.encode(t, add_special_tokens=False).ids
        got = coder.encode(t)
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == ids, t
        assert coder.decode(got) == library.decode(ids, skip_special_tokens=False)


def test_western_texts_need_no_unicode_split_and_words_in_use_are_kept(monkeypatch):
    """The split of Western texts is the library's; a full cache forgets words not in use, and no arc is asked twice."""
    library = Tokenizer.from_file(BYTES)
    coder = bpe.Coder(bpe.Automaton.from_json(open(BYTES, encoding="utf-8").read()))
    monkeypatch.setattr(bpe, "CACHE_WORDS", 500)
    passed, table, runs, run = [], coder.find, [], coder.run
    coder.find = lambda t: passed.append(t) or table(t)
    coder.run = lambda w: runs.append(w) or run(w)
    rng = random.Random(13)
    western = [chr(c) for c in range(256)] + [*bpe.WESTERN]
    common = [*"abcdeorstz", " ", " ", "'s", "'T", "'", "'re", " E", "Ö", "...", "\n"]
    for _ in range(4000):
        text = "in use " + "".join(rng.choice(western if rng.random() < 0.3 else common) for _ in range(rng.randrange(60)))
        got = coder.encode(text)
        assert struct.unpack(f"<{len(got) // 4}I", got) == tuple(library.encode(text, add_special_tokens=False).ids), repr(text)
        assert len(coder.known) + len(coder.older) < 2 * 500 + 60
    assert not passed and runs.count(b" use") == 1
    assert coder.encode("в use") and passed == ["в use"]


def test_small_vocabularies_follow_the_merges():
    """Random merge lists over few letters, against merging by rank."""
    rng = random.Random(5)
    letters = {b: c for c, b in bpe.byte_letters().items()}
    for _ in range(60):
        words, merges = ["a", "b", "c"], []
        for _ in range(rng.randrange(1, 12)):
            x, y = rng.choice(words), rng.choice(words)
            if x + y not in words and len(x + y) < 9:
                words.append(x + y)
                merges.append((x, y))
        vocab = {c: k for k, c in enumerate([*letters.values(), *[w for w in words if len(w) > 1]])}
        coder = bpe.Coder(bpe.Automaton(vocab, merges))
        rank = {m: k for k, m in enumerate(merges)}
        for _ in range(200):
            text = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 14)))
            parts = list(text)
            while True:
                pairs = [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]
                if not pairs:
                    break
                best = min(pairs)[0]
                i = 0
                while i < len(parts) - 1:
                    if rank.get((parts[i], parts[i + 1])) == best:
                        parts[i : i + 2] = [parts[i] + parts[i + 1]]
                    i += 1
            got = coder.encode_word(text)
            assert list(struct.unpack(f"<{len(got) // 4}I", got)) == [vocab[p] for p in parts], (merges, text)


def test_encode_and_decode_tables(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate([None, "", "x" * 100_000, *texts(3, 300)])] + [(None, "null id", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, n_tokens string")
    library = Tokenizer.from_file(BYTES)
    got = bpe.decode(bpe.encode(docs, BYTES), BYTES).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert by[i]["ids"] == struct.pack(f"<{len(ids)}I", *ids) and by[i]["n_tokens"] == len(ids)
        assert by[i]["decoded"] == library.decode(ids, skip_special_tokens=False)
    digest = bpe.digests(bpe.decode(bpe.encode(docs.limit(0), BYTES), BYTES))
    assert digest.count() == 0 and digest.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert hashlib.sha256(b"").hexdigest() == bpe.digests(bpe.decode(bpe.encode(docs.filter("doc_id = 1"), BYTES), BYTES)).first()[2]


def test_word_cache_equals_the_library():
    library = Tokenizer.from_file(WORDS)
    file = open(WORDS, encoding="utf-8").read()
    assert packing.splits_at_space(file) and not packing.splits_at_space(open(BYTES, encoding="utf-8").read())
    words = packing.Words(file, 1, True)
    sample = [*texts(7, 5000), "The the THE, the. it's It's! it's. don't, re've x.y x. .x ..,! aʰ, Ⅷ. ñ, ǅ. e\u0301, \u0301, 1, a1. don'T."]
    for t, got in zip(sample, words.encode(sample), strict=True):
        want = [*library.encode(t, add_special_tokens=False).ids, 1]
        assert np.frombuffer(got, words.kind).tolist() == want, repr(t)


def test_western_texts_go_to_the_merges_and_few_pieces_are_kept(monkeypatch):
    """Western texts need no pass of the whole tokenizer; the caches stay bounded; all ids are the library's."""
    file = open(WORDS, encoding="utf-8").read()
    library = Tokenizer.from_file(WORDS)
    added = packing.split_pieces(file)
    assert added == ["<|startoftext|>", "<|endoftext|>"] and packing.split_pieces(open(BYTES, encoding="utf-8").read()) is None
    words = packing.Words(file, 1, packing.splits_at_space(file), added)
    monkeypatch.setattr(packing, "CACHE_WORDS", 2000)
    passed = []
    whole = words._by_words
    words._by_words = lambda some: passed.extend(some) or whole(some)
    rng = random.Random(9)
    western = [chr(c) for c in range(1, 256) if c != 1 and not 0x1C <= c <= 0x1F] + [*packing.WESTERN]
    common = [*"abcdeorstz", " ", " ", "'s", "'T", "'", "'re", "E", "Ö", "..."]
    sample = ["".join(rng.choice(western if rng.random() < 0.3 else common) for _ in range(rng.randrange(60))) for _ in range(4000)]
    for start in range(0, len(sample), 500):
        some = sample[start : start + 500]
        for text, got in zip(some, words.encode(some), strict=True):
            assert np.frombuffer(got, words.kind).tolist() == [*library.encode(text, add_special_tokens=False).ids, 1], repr(text)
        assert len(words.pieces) + len(words.pieces.older) < 2 * 2000 + 2 * 60
    assert not passed
    odd = [*texts(11, 3000), *[a + x + b for a in ("é", "A", "'", "") for x in ("\u0301", "İ", "Σ", "ŉ", "K", "<|EndOfText|>", "<|endoftext|>", "ſ", "\u0958", "aİ") for b in ("s", ".", " x", "")]]
    for text, got in zip(odd, words.encode(odd), strict=True):
        assert np.frombuffer(got, words.kind).tolist() == [*library.encode(text, add_special_tokens=False).ids, 1], repr(text)
    assert passed


@pytest.mark.parametrize("kind", [np.uint16, np.uint32])
def test_stored_ids_are_restored(kind):
    """Ids come back as they were, in either width; the width is written, not guessed from the size."""
    codec = packing._codec()
    for n in (1, 2, 3, 5000):
        ids = np.arange(n, dtype=kind) * kind(13)
        got = packing.restored(packing.stored(ids.tobytes(), kind, codec), n, codec)
        assert got.dtype == kind and got.tolist() == ids.tolist()


def test_words_kept_by_a_worker_are_few():
    """Two workers of an executor keep some 60 MB of words each."""
    assert packing.CACHE_WORDS <= 1 << 18


@pytest.mark.parametrize("bits,dims", [(3, 2), (2, 3)])
def test_hilbert_curve_visits_all_cells_by_single_steps(bits, dims):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    key = packing.hilbert_key(grid, bits)
    assert sorted(key) == list(range(len(grid)))
    path = grid[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("size", [16, 2048])
def test_packing_is_whole_and_gapless(spark, size):
    sample = [None, "", "word " * 5000, "same text here", "same text here", *texts(11, 200)]
    rows = [(i, t, "x", 1) for i, t in enumerate(sample)] + [(None, "null id", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, curve string, part int")
    library = Tokenizer.from_file(WORDS)
    want = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], np.uint32).tobytes() for i, t, *_ in rows}
    pieces = packing.pack(docs, WORDS, size=size)
    got = pieces.collect()
    docs_seen, sequences = {}, {}
    for r in got:
        docs_seen.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
        assert r["doc_tokens"] == len(want[r["doc_id"]]) // 4
    assert set(docs_seen) == set(want)
    for i, parts in docs_seen.items():
        parts.sort(key=lambda r: r["start"])
        assert b"".join(p["ids"] for p in parts) == want[i]
        assert [p["start"] for p in parts] == np.cumsum([0, *[p["length"] for p in parts]])[:-1].tolist()
    assert sorted(sequences) == list(range(len(sequences)))
    padded = 0
    for parts in sequences.values():
        parts.sort(key=lambda r: r["offset"])
        assert [p["offset"] for p in parts] == np.cumsum([0, *[p["length"] for p in parts]])[:-1].tolist()
        n = sum(p["length"] for p in parts)
        assert n <= size
        padded += 0 if n & (n - 1) == 0 else size - n
    assert padded == 0
    for r in packing.piece_digests(pieces).collect():
        part = want[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]
        assert r["ids_crc32"] == zlib.crc32(part)
    if size == 2048:
        for r in packing.sequences(pieces, size).collect():
            assert len(r["ids"]) // 4 in (r["n_tokens"], size)
    assert packing.pack(docs.limit(0), WORDS).count() == 0
