"""Words and word shingles of whole texts as 64-bit hashes, many texts at a time.

A word is a run of letters and digits, in lower case. A shingle is five words
in a row; a text of one to four words has one shingle of them all, a text
without words none."""

from __future__ import annotations

import numpy as np

from ._shared import text_slabs

SHINGLE = 5
SLAB_CHARS = 1_000_000
_IS_WORD: np.ndarray | None = None
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # splitmix64
_POWERS = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: one-to-one, spreads every bit."""
    with np.errstate(over="ignore"):
        x = x + _M1
        x = (x ^ (x >> np.uint64(30))) * _M2
        x = (x ^ (x >> np.uint64(27))) * _M3
        return x ^ (x >> np.uint64(31))


def _tables(longest: int) -> tuple[np.ndarray, np.ndarray]:
    global _IS_WORD, _POWERS
    if _IS_WORD is None:
        _IS_WORD = np.fromiter(map(str.isalnum, map(chr, range(0x110000))), bool, 0x110000)
    if len(_POWERS) < longest:
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.full(max(256, 2 * longest), 0xD6E8FEB86659FD93, np.uint64))
    return _IS_WORD, _POWERS


def _slab(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, position of each word's first character) of one string."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    is_word, _ = _tables(1)
    at = np.flatnonzero(is_word[codes])
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]))
    sizes = np.diff(np.concatenate([first, [len(at)]]))
    _, powers = _tables(int(sizes.max()) + 1)
    nth = np.arange(len(at)) - np.repeat(first, sizes)
    with np.errstate(over="ignore"):
        parts = mix(codes[at].astype(np.uint64)) * powers[nth]
        return mix(np.add.reduceat(parts, first) + sizes.astype(np.uint64)), at[first]


def _cuts(text: str) -> list[str]:
    """A long text in parts that end between words."""
    parts, lo = [], 0
    while len(text) - lo > 2 * SLAB_CHARS:
        hi = lo + SLAB_CHARS
        while hi < len(text) and text[hi].isalnum() and text[hi - 1].isalnum():
            hi += 1
        parts.append(text[lo:hi])
        lo = hi
    parts.append(text[lo:])
    return parts


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of all texts in order, number of words of each text)."""
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    lowered = [(t or "").lower() for t in texts]
    for lo, hi in text_slabs(lowered, SLAB_CHARS):
        if hi == lo + 1:
            got = [_slab(p)[0] for p in _cuts(lowered[lo])]
            hashes += got
            counts[lo] = sum(map(len, got))
            continue
        h, at = _slab("\n".join(lowered[lo:hi]))
        ends = np.cumsum([len(t) + 1 for t in lowered[lo:hi]])
        counts[lo:hi] = np.bincount(np.searchsorted(ends, at, "right"), minlength=hi - lo)
        hashes.append(h)
    return np.concatenate(hashes) if hashes else np.empty(0, np.uint64), counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles of all texts in order, number of shingles of each text)."""
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    starts = np.cumsum(counts) - counts
    first = np.repeat(starts, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    size = np.repeat(np.minimum(counts, k), n)
    out = np.zeros(len(first), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            inside = size > j
            out[inside] = mix(out[inside] ^ words[first[inside] + j]) if not inside.all() else mix(out ^ words[first + j])
    return out, n


def shingles_of(text: str | None) -> set[int]:
    """The set of one text's shingle hashes."""
    h, _ = shingle_hashes(*word_hashes([text]))
    return set(h.tolist())
