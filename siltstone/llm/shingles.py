"""Word shingles of whole texts as sets of 64-bit hashes, vectorised over the bytes of many documents."""

from __future__ import annotations

import numpy as np

WORDS = 5
_RNG = np.random.default_rng(20240601)
_TABLE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
#: Bytes of text that are hashed at once; a longer text is a block by itself.
BLOCK = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX[0]
    x ^= x >> np.uint64(29)
    x *= _MIX[1]
    x ^= x >> np.uint64(32)
    return x


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _ODD, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _block(raws: list[bytes], words: int) -> list[np.ndarray]:
    flat = np.frombuffer(b" ".join(raws), np.uint8)
    gap = (flat == 32) | ((flat >= 9) & (flat <= 13))
    first = ~gap
    first[1:] &= gap[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in raws]
    place = np.arange(len(flat), dtype=np.int64)
    place -= starts[np.maximum(np.cumsum(first) - 1, 0)]
    value = _TABLE[flat] * _powers(int(place.max()) + 1)[np.maximum(place, 0)]
    value[gap] = 0
    word = mix(np.add.reduceat(value, starts))
    ends = np.cumsum([len(r) + 1 for r in raws])
    edge = np.searchsorted(starts, ends)
    out, lo = [], 0
    for hi in edge:
        w = word[lo:hi]
        n = len(w)
        if n == 0:
            out.append(np.zeros(0, np.uint64))
        else:
            k = min(n, words)
            total = w[: n - k + 1].copy()
            for j in range(1, k):
                total = total * _ODD + w[j : n - k + 1 + j]
            out.append(np.unique(mix(total + np.uint64(k))))
        lo = hi
    return out


def shingle_sets(texts: list[str | None], words: int = WORDS):
    """Yields the sorted set of each text: lower-cased A-Z, words between ASCII white space, whole text as one if short."""
    block, size = [], 0
    for text in texts:
        block.append((text or "").encode().lower())
        size += len(block[-1])
        if size >= BLOCK:
            yield from _block(block, words)
            block, size = [], 0
    if block:
        yield from _block(block, words)
