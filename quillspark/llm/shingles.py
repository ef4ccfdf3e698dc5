"""Weighted word shingles of whole texts, in numpy.

Words are runs of word characters in lower case. A shingle is five words in a row, or all
words of a text that has fewer; its weight is how often it occurs in the text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import xxhash

SIZE = 5
WORD = re.compile(r"\w+")
MAX_CACHED = 250_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MAX_CACHED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_HASHES = _Hashes()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64 finisher)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def window_hashes(hashes: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Hash of each run of ``size`` words; of all words if there are fewer; none for none."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    n = len(hashes) - size + 1
    out = np.full(n, size, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * _MULTIPLIER + hashes[k : n + k]
        return mix(out)


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in ascending order, and their weights."""
    return np.unique(window_hashes(word_hashes(words_of(text))), return_counts=True)


def flat_shingles(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of many texts: shingle hashes, weights and the number of the text."""
    per = [shingles(t) for t in texts]
    sizes = [len(h) for h, _ in per]
    if not per:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([h for h, _ in per]), np.concatenate([w for _, w in per]), np.repeat(np.arange(len(per)), sizes)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two weighted sets: the sum over common elements i of
    1 / sum over j of max(x_j / x_i, y_j / y_i). Equal weights give the plain Jaccard.

    With r_i = x_i / y_i, element j takes its x part where r_j >= r_i, so the inner sums
    are suffix and prefix sums over the elements in the order of r.
    """
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return float(len(ha) == len(hb))
    x, y = wa / wa.sum(), wb / wb.sum()
    common, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    cx, cy = x[ia], y[ib]
    ratio = cx / cy
    order = np.argsort(ratio, kind="stable")
    cx, cy, ratio = cx[order], cy[order], ratio[order]
    only_x, only_y = 1.0 - cx.sum(), 1.0 - cy.sum()
    sx = np.cumsum(cx[::-1])[::-1]
    sy = np.concatenate([[0.0], np.cumsum(cy)[:-1]])
    inner = (only_x + sx) / cx + (only_y + sy) / cy
    return float(np.sum(1.0 / inner))


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the lesser weights over the sum of the greater; 1 for two empty sets."""
    (ha, wa), (hb, wb) = a, b
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    low = np.minimum(wa[ia], wb[ib]).sum()
    high = wa.sum() + wb.sum() - low
    return float(low / high) if high else 1.0
