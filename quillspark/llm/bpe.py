"""Byte-level BPE with the tokenizers library, one vocabulary per Python worker.

A text is split by the public pattern; equal pieces get equal ids, so each distinct
piece is encoded by the library once and kept in a bounded table. Texts with code
points from U+0250 on, or with the string of an added token, go to the library whole.
"""

from __future__ import annotations

import base64
import itertools
import re
import unicodedata
from collections.abc import Sequence

import numpy as np
from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

FAST_BELOW = 0x250
MAX_PIECES = 800_000


def byte_table() -> list[str]:
    """The character that byte-level vocabularies use for each byte: printable Latin-1
    characters stand for themselves, the others move up from U+0100 in byte order."""
    own = {b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b}
    moved = iter(range(256))
    return [chr(b) if b in own else chr(256 + next(moved)) for b in range(256)]


BYTE_CHARS = byte_table()
CHAR_BYTES = {c: b for b, c in enumerate(BYTE_CHARS)}


_SPELLING = {b: c for b, c in enumerate(BYTE_CHARS) if chr(b) != c}


def _spelt(piece: str) -> str:
    """The bytes of a piece in the characters of the vocabulary."""
    raw = piece if piece.isascii() else piece.encode().decode("latin-1")
    return raw.translate(_SPELLING)


def token_bytes(token: str) -> bytes:
    """The bytes of a vocabulary entry; characters outside the byte table (only in
    added tokens) give their UTF-8."""
    try:
        return bytes(map(CHAR_BYTES.__getitem__, token))
    except KeyError:
        return token.encode()


def _latin_pattern() -> re.Pattern[str]:
    """The public pattern for texts below U+0250, with its classes spelt out for ``re``."""

    def ranges(kind: str) -> str:
        return "".join(re.escape(chr(c)) for c in range(FAST_BELOW) if unicodedata.category(chr(c))[0] == kind)

    letters, numbers, space = ranges("L"), ranges("N"), "\t-\r \x85\xa0"
    return re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+"
        f"|[{space}]+(?![^{space}])|[{space}]+"
    )


LATIN = _latin_pattern()
BEYOND = re.compile(f"[^\x00-{chr(FAST_BELOW - 1)}]")


def load_json(path: str) -> Tokenizer:
    """A tokenizer file of the library."""
    return Tokenizer.from_file(path)


def load_ranks(path: str, pattern: str) -> Tokenizer:
    """A tokenizer of the library for a file of base64 tokens and ranks.

    A rank file merges any neighbours whose join is a token, the lowest rank first. So
    each token lists every split of itself into two tokens, in rank order.
    """
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    name = {t: "".join(BYTE_CHARS[b] for b in t) for t in ranks}
    merges = [
        (name[t[:i]], name[t[i:]])
        for t in sorted(ranks, key=ranks.__getitem__)
        for i in range(1, len(t))
        if t[:i] in ranks and t[i:] in ranks
    ]
    tok = Tokenizer(models.BPE({name[t]: r for t, r in ranks.items()}, merges, ignore_merges=True))
    tok.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    tok.decoder = decoders.ByteLevel()
    return tok


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """The array, or a copy with at least twice its room if n entries don't fit."""
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), dtype=a.dtype)])


class _Numbers(dict[str, int]):
    """Numbers pieces in the order of their first look-up, and lists the new ones."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.fresh.append(piece)
        return n


class Codec:
    """Encodes lists of texts to flat id arrays, and decodes ids to bytes."""

    def __init__(self, tok: Tokenizer):
        self.tok = tok
        size = tok.get_vocab_size(with_added_tokens=True)
        table = [b""] * size
        for token, i in tok.get_vocab(with_added_tokens=True).items():
            table[i] = token_bytes(token)
        for i, added in tok.get_added_tokens_decoder().items():
            table[i] = added.content.encode()
        self.lengths = np.array([len(b) for b in table], dtype=np.int64)
        self._starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self._bytes = np.frombuffer(b"".join(table), dtype=np.uint8)
        self._added = [a.content for a in tok.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self._index = _Numbers()
        self._flat = np.zeros(1 << 16, dtype=np.uint32)
        self._offsets = np.zeros(1 << 15, dtype=np.int64)

    def _encode(self, texts: Sequence[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _learn(self, fresh: list[str]) -> None:
        """Ids of pieces that have just been given the next numbers."""
        tokenize = self.tok.model.tokenize
        coded = [[t.id for t in tokenize(p)] for p in map(_spelt, fresh)]
        have, more = len(self._index) - len(fresh), len(fresh)
        self._offsets = _room(self._offsets, have + more + 1)
        np.cumsum(np.fromiter(map(len, coded), dtype=np.int64, count=more), out=self._offsets[have + 1 : have + more + 1])
        self._offsets[have + 1 : have + more + 1] += self._offsets[have]
        used, end = self._offsets[have], self._offsets[have + more]
        self._flat = _room(self._flat, end)
        self._flat[used:end] = np.fromiter(itertools.chain.from_iterable(coded), dtype=np.uint32, count=end - used)

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the n + 1 offsets of the texts in it. A null
        text counts as empty."""
        whole = {
            i: t
            for i, t in enumerate(texts)
            if t and ((not t.isascii() and BEYOND.search(t)) or any(a in t for a in self._added))
        }
        direct = dict(zip(whole, self._encode(list(whole.values())), strict=True)) if whole else {}
        split = [LATIN.findall(t) if t and i not in whole else [] for i, t in enumerate(texts)]
        if len(self._index) > MAX_PIECES:
            self._forget()
        per_text = np.concatenate([[0], np.cumsum([len(p) for p in split])]).astype(np.int64)
        at = np.fromiter(map(self._index.__getitem__, itertools.chain.from_iterable(split)), dtype=np.int64, count=int(per_text[-1]))
        if self._index.fresh:
            self._learn(self._index.fresh)
            self._index.fresh = []
        begin = self._offsets[at]
        sizes = self._offsets[at + 1] - begin if len(at) else at
        ends = np.cumsum(sizes)
        ids = self._flat[np.repeat(begin - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        offsets = np.concatenate([[0], ends])[per_text]
        if not direct:
            return ids, offsets
        parts = [np.array(direct[i], dtype=np.uint32) if i in direct else ids[offsets[i] : offsets[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for; a character may be split over tokens."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        if not len(ids):
            return b""
        return self._bytes[np.repeat(self._starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1])].tobytes()

    def char_offsets(self, ids: np.ndarray) -> np.ndarray:
        """Start and end of each token in characters (n, 2). A token that holds part of a
        character spans the whole character."""
        raw = np.frombuffer(self.decode(ids), dtype=np.uint8)
        ends = np.cumsum(self.lengths[ids])
        first = (raw & 0xC0) != 0x80
        before = np.concatenate([[0], np.cumsum(first)])  # characters begun before each byte
        starts = ends - self.lengths[ids]
        start = before[starts] - (~np.concatenate([first, [True]])[starts]).astype(np.int64)
        return np.stack([start, before[ends]], axis=1)


_CODECS: dict[tuple[str, str | None], Codec] = {}


def codec(path: str, pattern: str | None = None) -> Codec:
    """The worker's codec for a library file, or for a rank file if a pattern is given."""
    key = (path, pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(load_ranks(path, pattern) if pattern else load_json(path))
    return _CODECS[key]
