"""Byte-pair encoding by a deterministic automaton compiled from the merge list.

Compilation adds one gadget for each merge (u, v) -> w, in order.  In the automaton so
far, the state behind an arc u loses its arc v, and a new arc w leads from where u
started to where v ended; the state behind w starts as a copy of the one behind v.  So
states stand for the last token, and a state differs from "every token may follow" only
by forbidden arcs.  Written out, that is up to (tokens x tokens) arcs; here each gadget
stays shared: a state keeps its two parents and its time, and an arc is absent exactly
if some merge joins an ancestor of the state with an ancestor of the token before both
descendants existed.  Arcs are looked up in a table that is filled on first use.

Every byte string has exactly one path from the start, so encoding is one pass over a
word's bytes, and decoding emits the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, for_python, text_of

# White space and the published pre-splitting pattern of byte-level BPE.
_BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + _BLANK + r"\p{L}\p{N}]+|["
    + _BLANK + r"]+(?![^" + _BLANK + r"])|[" + _BLANK + r"]+"
)
#: Characters above U+00FF that Western texts have.
WESTERN = "Œœ–—‘’‚“”„•…€"
NOT_WESTERN = re.compile(f"[^\x00-\xff{WESTERN}]")


def western_split() -> re.Pattern:
    """``SPLIT`` for Western texts, without a Unicode table; runs of letters, which are most pieces, are tried first."""
    here = [chr(c) for c in range(0x100)] + list(WESTERN)
    letters, numbers = ("".join(c for c in here if unicodedata.category(c)[0] == k) for k in "LN")
    return re.compile(SPLIT.replace(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+|", r" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d|").replace(
        r"[^" + _BLANK + r"\p{L}\p{N}]", f"[^{_BLANK}{letters}{numbers}]"
    ).replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]"))


#: Words of two generations kept by one worker, and the longest word kept; both only bound memory.
CACHE_WORDS = 1 << 18
CACHE_LENGTH = 64
FOREVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The printable letter that vocabulary files write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Automaton:
    """States, gadgets and labels compiled from a vocabulary and its merges."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], added: dict[str, int] | None = None):
        letters = byte_letters()
        spell = lambda s: bytes(letters[c] for c in s)
        self.label = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.left, self.right, self.time = [-1] * 256, [-1] * 256, [-1] * 256
        self.state_of = {bytes([b]): b for b in range(256)}
        self.merge_time: dict[tuple[int, int], int] = {}
        for step, (a, b) in enumerate(merges):
            self._add_gadget(step, spell(a), spell(b), vocab[a + b])
        self.words = {vocab[c]: bytes([b]) for c, b in letters.items()}
        self.words |= {vocab[a + b]: spell(a + b) for a, b in merges}
        self.added = dict(added or {})
        self.words |= {k: s.encode() for s, k in self.added.items()}
        self.width = [0] * len(self.label)
        for word, state in self.state_of.items():
            self.width[state] = len(word)
        #: The state of every token, and -1 for other beginnings of tokens.
        self.begun = dict.fromkeys((t[:k] for t in self.state_of for k in range(1, len(t))), -1) | self.state_of

    @classmethod
    def from_json(cls, text: str) -> Automaton:
        """From a tokenizer file: byte-level BPE without normaliser, prefix or suffix."""
        file = json.loads(text)
        model, pre = file["model"], file.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback") if model.get(k)]
        if odd or file.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
            raise ValueError(f"not plain byte-level BPE: {odd or 'normaliser or pre-tokenizer'}")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        return cls(model["vocab"], merges, {t["content"]: t["id"] for t in file.get("added_tokens", [])})

    def _add_gadget(self, step: int, u: bytes, v: bytes, label: int) -> None:
        a, b = self.state_of.get(u), self.state_of.get(v)
        if a is None or b is None or (a, b) in self.merge_time:
            return
        forbidden = self.forbidden(a, b)
        self.merge_time[a, b] = step
        if forbidden or u + v in self.state_of:
            return  # no such arcs are left, so the gadget adds none
        self.state_of[u + v] = len(self.label)
        self.label.append(label)
        self.left.append(a)
        self.right.append(b)
        self.time.append(step)

    def forbidden(self, last: int, token: int) -> bool:
        """Whether the state behind ``last`` has lost the arc ``token``."""
        merges, right, left, time = self.merge_time, self.right, self.left, self.time
        before = FOREVER
        while last >= 0:
            d, until = token, FOREVER
            while d >= 0:
                at = merges.get((last, d))
                if at is not None and at < before and at <= until:
                    return True
                until, d = time[d], left[d]
            before, last = time[last], right[last]
        return False


class Coder:
    """An automaton with its table of arcs and a bounded table of whole words."""

    def __init__(self, automaton: Automaton, pattern: str = SPLIT):
        self.a = automaton
        self.arcs: dict[int, bool] = {}
        #: Words of this generation, and of the one before it; words in use move along.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.find = regex.compile(pattern).findall
        self.find_western = western_split().findall if pattern == SPLIT else None
        self.special = regex.compile(
            "(" + "|".join(map(regex.escape, sorted(automaton.added, key=len, reverse=True))) + ")"
        ) if automaton.added else None
        self.emit = [automaton.words.get(k) for k in range(max(automaton.words) + 1)]

    def run(self, word: bytes) -> list[int]:
        """States along the only path that spells the word, longest arcs tried first.

        As every beginning of the word has one path, a place that led nowhere is not entered again.
        """
        a, arcs, n = self.a, self.arcs, len(word)
        begun, whole = a.begun, a.state_of.get(word)
        if whole is not None:
            return [whole]
        path: list[int] = []
        ways: list[list[tuple[int, int]]] = []  # untried arcs (state, end) of each place on the path, longest last
        dead: set[int] = set()
        at, last = 0, -1
        while at < n:
            open_ = []
            for i in range(at + 1, n + 1):
                token = begun.get(word[at:i])
                if token is None:
                    break
                if token >= 0:
                    open_.append((token, i))
            ways.append(open_)
            while True:
                if not ways[-1]:  # nothing leads on from here
                    ways.pop()
                    dead.add(at)
                    at -= a.width[path.pop()]
                    last = path[-1] if path else -1
                    continue
                token, end = ways[-1].pop()
                if end in dead:
                    continue
                if last >= 0:
                    arc = last << 32 | token
                    lost = arcs.get(arc)
                    if lost is None:
                        lost = arcs[arc] = a.forbidden(last, token)
                    if lost:
                        continue
                path.append(token)
                at, last = end, token
                break
        return path

    def encode_word(self, word: str) -> bytes:
        got = self.known.get(word)
        if got is None:
            got = self.older.get(word)
            if got is None:
                label = self.a.label
                got = b"".join([label[s].to_bytes(4, "little") for s in self.run(word.encode("utf-8"))])
            if len(word) <= CACHE_LENGTH:
                if len(self.known) >= CACHE_WORDS:
                    self.known, self.older = {}, self.known
                if len(self.arcs) >= 8 * CACHE_WORDS:
                    self.arcs.clear()
                self.known[word] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian unsigned 32-bit integers."""
        find = self.find if self.find_western is None or NOT_WESTERN.search(text) else self.find_western
        parts = self.special.split(text) if self.special else [text]
        out = []
        for part in parts:
            if part in self.a.added:
                out.append(self.a.added[part].to_bytes(4, "little"))
            else:
                known, encode = self.known, self.encode_word
                out += [known.get(w) or encode(w) for w in find(part)]
        return b"".join(out)

    def decode_bytes(self, ids: bytes) -> bytes:
        numbers = np.frombuffer(ids, "<u4").tolist()
        return b"".join([self.emit[k] for k in numbers])

    def decode(self, ids: bytes) -> str:
        """The text that the labels spell; broken UTF-8 becomes U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


_CODERS: dict[str, Coder] = {}


def _coder(shared) -> Coder:
    key, automaton = shared.value
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(automaton)
    return _CODERS[key]


def _share(spark, path: str):
    """Compile on the driver and broadcast; its size is that of the vocabulary file."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    return spark.sparkContext.broadcast((hashlib.sha256(text.encode()).hexdigest(), Automaton.from_json(text)))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of whole texts: id, n_tokens, ids (binary, little-endian 32-bit).

    Null texts count as empty and give no token.  Strings of added tokens become those
    tokens.  Very long texts are encoded whole.  Every input row gives a row, repeated ones too;
    an empty table gives an empty table; other columns are ignored.
    """
    spark = docs.sparkSession
    for_python(spark)
    shared = _share(spark, path)
    source = docs.select(named(docs, id_col).alias("__id"), text_of(text_col).alias("__text"))
    kind = source.schema["__id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        for batch in batches:
            ids = [coder.encode(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                [id_col, "n_tokens", "ids"],
            )

    return source.mapInArrow(each, f"`{id_col}` {kind}, n_tokens bigint, ids binary")


def decode(coded: DataFrame, path: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """Append the text that each row's ids spell; null ids give the empty text.

    Ids of very long texts are decoded whole; an empty table gives an empty table.
    """
    spark = coded.sparkSession
    for_python(spark)
    shared = _share(spark, path)
    place = coded.columns.index(ids_col)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema.fields)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        for batch in batches:
            texts = [coder.decode(x.as_py() or b"") for x in batch.column(place)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, to]
            )

    return coded.mapInArrow(each, f"{kinds}, `{to}` string")


def digests(coded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """SHA-256 of ids and of the decoded text."""
    return coded.select(
        id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
