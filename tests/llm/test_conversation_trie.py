"""Conversation tries against plain prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from prepmill.llm import conversation_trie as ct
from prepmill.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, pos string, id string, rep string, block string"
COLUMNS = [
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
]


def turn_key(role, text):
    return hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()


def rebuilt(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, turn_key(role, text), len((text or "").encode())))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = tuple(own.get(base, [])[:h] + v[h:])
    return out


def plain(paths):
    nodes = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes[path[:d]].append(c)
    children = defaultdict(list)
    for path in nodes:
        if path:
            children[path[:-1]].append(path)
    total = {}
    for path in sorted(nodes, key=len, reverse=True):
        below = [total[x] for x in children[path]]
        saved = (len(nodes[path]) - 1) * (path[-1][1] if path else 0)
        total[path] = (sum(x[0] for x in below) or 1, saved + sum(x[1] for x in below))
    out = []
    for path, convs in nodes.items():
        ends = ",".join(str(c) for c in sorted(convs) if paths[c] == path)
        parent = min(nodes[path[:-1]]) if path else None
        out.append((min(convs), len(path), parent, len(convs), len(children[path]), *total[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def fixture():
    rng = random.Random(11)
    rows = []
    for c in [*range(0, 60), 100, 101, 103, 204, 1003, -7, -5, 12345678901]:
        for t in range(rng.choice([1, 2, 3, 9, 12])):
            rows.append((c, t, rng.choice(["user", "bot"]), rng.choice(["hi", "yes é", "no", "x" * 30])))
    for c in range(300, 420):  # copies and a common start
        rows += [(c, t, "user", f"same {t}") for t in range(10)] + ([(c, 10, "bot", str(c))] if c % 3 == 0 else [])
    for c in (500, 501, 505, 506, 510):  # long ones that share their start
        rows += [(c, t, "user", f"long {t}") for t in range(45)] + [(c, 45 + t, "bot", f"{c // 10} {t}") for t in range(20)]
    rows += [(600, None, None, None), (600, None, "a", None), (600, 0, None, "b"), (600, 0, None, "b"), (600, -1, "", "é")]
    rows += [(None, 1, "user", "nobody"), (None, None, None, None), (700, 5, "user", "y" * 20000)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, *"abcde") for r in rows], SCHEMA)


def result(df):
    return sorted(map(tuple, df.select(COLUMNS).collect()), key=str)


@pytest.mark.parametrize(("block", "capacity", "ids"), [(128, 4096, 4096), (8, 3, 2)])
def test_equals_plain_prefixes(spark, monkeypatch, block, capacity, ids):
    monkeypatch.setattr(ct, "BLOCK", block)
    monkeypatch.setattr(ct, "IDS", ids)
    rows = fixture()
    got = ct.conversation_trie(frame(spark, rows).repartition(4), capacity=capacity)
    assert result(got) == plain(rebuilt(rows))


def test_empty_and_turnless(spark):
    assert ct.conversation_trie(frame(spark, fixture()).limit(0)).collect() == []
    only = [(None, 1, "user", "x")]
    assert ct.conversation_trie(frame(spark, only)).collect() == []
    lost = [(c, t, "u", "x") for c in (6, 7, 8, 11, 12, 13) for t in range(2)]  # no bases; some lose all turns
    paths = rebuilt(lost)
    assert any(not p for p in paths.values())
    assert result(ct.conversation_trie(frame(spark, lost))) == plain(paths)


def test_query_equals_sql(spark, duck, sf):
    got = QUERIES["op12_conversation_trie"](spark, sf)
    want = duck.sql(ORACLES["op12_conversation_trie"])
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)
