"""Plain versions of the operators' parts, for comparison on small tables."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bag(text, n=5):
    w = WORD.findall(text or "")
    return Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else Counter()


def near_classes(rows, threshold=0.8):
    """Smallest id of each id's class, by comparing all pairs that share a shingle."""
    bags = [(i, bag(t)) for i, t in rows]
    parent = {i: i for i, _ in bags}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = sorted((find(a), find(b)))
        parent[b] = a

    by = defaultdict(list)
    empty = [i for i, b in bags if not b]
    for i in empty[1:]:
        join(empty[0], i)
    for k, (_, b) in enumerate(bags):
        for s in b:
            by[s].append(k)
    seen = set()
    for ks in by.values():
        for x in range(len(ks)):
            for y in range(x):
                if (ks[y], ks[x]) not in seen:
                    seen.add((ks[y], ks[x]))
                    (i, a), (j, b) = bags[ks[y]], bags[ks[x]]
                    both = sum((a & b).values())
                    if both >= threshold * (sum(a.values()) + sum(b.values()) - both) - 1e-9:
                        join(i, j)
    return {i: find(i) for i, _ in bags}


def removed_spans(rows, length=50):
    """Bytes kept and spans removed for (id, text) rows, by a dictionary of all strings."""
    first = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, x in data:
        for p in range(len(x) - length + 1):
            w = x[p : p + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, x in data:
        gone = bytearray(len(x))
        for p in range(len(x) - length + 1):
            if first[x[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((i, len(x), spans, bytes(c for c, g in zip(x, gone) if not g)))
    return out
