"""Counts over one whole text."""

from __future__ import annotations

import re

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"


def word_codes(words: list[str]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    seen: dict[str, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))


def repeated_words(words: list[str]) -> int:
    """Words in three-word windows that occur twice or more, the first included."""
    n = len(words)
    if n < 4:
        return 0
    codes = word_codes(words)
    size = int(codes.max()) + 1
    pair = codes[:-1] * size + codes[1:]
    if size > 2_000_000:  # the cube would not fit 64 bits
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    triple = pair[:-1] * size + codes[2:]
    order = np.argsort(triple)
    ranked = triple[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; zeros for null."""
    if not text:
        return 0, 0, 0, 0, 0
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)] if "\n" in text else []
    return (
        len(words),
        sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )
