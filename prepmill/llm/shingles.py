"""Word shingles of whole texts as 64-bit hashes, vectorised over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
#: Bytes of text hashed at a time; bounds the working arrays (a longer word is hashed alone).
SLICE = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# Any odd multiplier has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64, kept."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        got = _powers[base] = np.cumprod(steps)
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_slice(data: np.ndarray) -> np.ndarray:
    """Hashes of the words in bytes that end with white space."""
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[::2], edge[1::2]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(
        (data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data))
    )])
    return mix((total[ends] - total[starts]) * powers(_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """A hash for each word, in order; words are runs of bytes other than ASCII white space."""
    data = np.frombuffer(text + b" ", np.uint8)
    if len(data) <= SLICE:
        return _hash_slice(data)
    out, at = [], 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        gaps = np.flatnonzero(_SPACE[data[at:end]])
        while not len(gaps):  # a word longer than a slice
            end = min(end + SLICE, len(data))
            gaps = np.flatnonzero(_SPACE[data[at:end]])
        cut = at + int(gaps[-1]) + 1
        out.append(_hash_slice(data[at:cut]))
        at = cut
    return np.concatenate(out)


def shingle_hashes(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Hashes of all windows of n words; a shorter text is one window, an empty one none."""
    if not len(words):
        return words
    size = min(n, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(0xD1342543DE82EF95) + words[k : k + len(out)])
    return out


def bags(texts: list[bytes], n: int = WORDS) -> list[np.ndarray]:
    """The sorted shingle hashes (with repeats) of each text."""
    out: list[np.ndarray] = []
    for group in _groups(texts):
        if len(group) == 1:
            words, counts = word_hashes(group[0]), None
            out.append(np.sort(shingle_hashes(words, n)))
            continue
        joined = b" ".join(group) + b" "
        data = np.frombuffer(joined, np.uint8)
        space = _SPACE[data]
        starts = np.flatnonzero(np.diff(space, prepend=True))[::2]
        words = _hash_slice(data)
        ends = np.cumsum([len(t) + 1 for t in group])
        counts = np.searchsorted(starts, ends)
        first = 0
        for last in counts:
            out.append(np.sort(shingle_hashes(words[first:last], n)))
            first = last
    return out


def _groups(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Consecutive texts of up to SLICE bytes together; a longer one comes alone."""
    group: list[bytes] = []
    size = 0
    for text in texts:
        if group and size + len(text) >= SLICE - len(group) - 1:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def counted(bag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of a sorted bag and their counts."""
    if not len(bag):
        return bag, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], bag[1:] != bag[:-1]]))
    return bag[first], np.diff(np.append(first, len(bag)))


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Size of the intersection of two bags."""
    if not len(a[0]) or not len(b[0]):
        return 0
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    same = a[0][at] == b[0]
    return int(np.minimum(a[1][at], b[1])[same].sum())
