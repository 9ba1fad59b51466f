"""Words of texts as numbers, many texts at a time."""

from __future__ import annotations

import numpy as np

#: A-Z to a-z; other bytes stay. White space is what ``bytes.split`` takes as such: \\x20 and \\x09-\\x0D.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Fixed value: odd, so that it can be undone modulo 2**64.
FACTOR = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all (fixed constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    found = np.empty(max(n, 1), np.uint64)
    found[0], have = 1, 1
    while have < n:
        more = min(have, n - have)
        found[have : have + more] = found[:more] * np.uint64(pow(base, have, 1 << 64))
        have += more
    return found


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of a byte string, and where each word begins.

    The hash of a word is that of its bytes as a polynomial, so it does not depend on the place.
    """
    raw = np.frombuffer(data, np.uint8)
    inside = ~SPACE[raw]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    begin, stop = edges[::2], edges[1::2]
    if not len(begin):
        return np.zeros(0, np.uint64), begin
    weights = powers(FACTOR, len(raw))
    total = np.concatenate(([np.uint64(0)], np.cumsum(mixed(raw.astype(np.uint64) + np.uint64(1)) * weights, dtype=np.uint64)))
    undo = powers(pow(FACTOR, -1, 1 << 64), len(raw))
    return mixed((total[stop] - total[begin]) * undo[begin] + (stop - begin).astype(np.uint64)), begin


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """The distinct shingles of a document's words, ascending; all words as one if there are fewer than ``width``."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    found = np.zeros(n, np.uint64)
    for i in range(width):
        found = mixed(found * np.uint64(FACTOR) + words[i : i + n] + np.uint64(i))
    return np.unique(found)


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """The shingle set of each text after lower-casing A-Z."""
    raw = [(text or "").encode().translate(LOWER) for text in texts]
    hashes, begin = word_hashes(b"\n".join(raw))
    starts = np.cumsum([0, *(len(r) + 1 for r in raw)])
    cuts = np.searchsorted(begin, starts[1:-1])
    return [shingles(words, width) for words in np.split(hashes, cuts)] if raw else []
