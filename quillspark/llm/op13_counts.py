"""Token counts by merging ragged arrays of symbols, rank by rank.

The distinct pre-tokens of an Arrow batch lie in one array of symbols, each pre-token a run of it.
In every step each pre-token finds the lowest rank among its neighbouring pairs and merges all the
places of that pair at once, from the left where they overlap; a pre-token without a known pair has
as many tokens as symbols left and goes from the arrays. Ranks are looked up again only beside a
merged place. This gives the tokens of the library because a pair that a merge makes always has a
higher rank than the merge itself; a vocabulary where that does not hold merges one place a step.

The operator is narrow: no shuffle, no state between rows but a bounded table of pre-tokens that
have been counted. A null text counts as empty: no bytes and no tokens, as the empty text. Repeated
rows are counted each for itself, a very long text is a batch of its own, an empty table gives no
rows, and only ``doc_id`` and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm.batches import bounded
from quillspark.llm.bpe import BEYOND, BYTE_CHARS, LATIN, MAX_PIECES, _Numbers, _room, token_bytes

#: Marks pieces that the library has split and so has spelt in the characters of the vocabulary; it
#: stands in no piece of a text that is split here.
_RAW = "\U0010ffff"
NONE = np.int32(np.iinfo(np.int32).max)
#: What a vocabulary file must say for pairs of byte symbols to be merged by rank alone.
PLAIN = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}


class Merges:
    """The merges of a vocabulary as a sorted table of pairs."""

    def __init__(self, vocab: dict[str, int], merges: Sequence[tuple[str, str]]):
        self.size = max(vocab.values()) + 1
        left, right = (np.array([vocab[m[k]] for m in merges], dtype=np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int32), made.astype(np.int32)  # made goes by rank
        # the last merge that makes a symbol must come before the first that uses it
        last = np.full(self.size, -1, np.int64)
        np.maximum.at(last, made, np.arange(len(made)))
        self.at_once = bool((np.maximum(last[left], last[right]) < np.arange(len(made))).all())
        self.first = np.array([vocab[c] for c in BYTE_CHARS], dtype=np.int32)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or ``NONE``."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def counts(self, pieces: Sequence[bytes]) -> np.ndarray:
        """Tokens of each pre-token."""
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        out = sizes.copy()
        symbols = self.first[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        own = np.repeat(np.arange(len(pieces)), sizes)
        # the rank of each symbol with the next of its piece
        rank = np.full(len(symbols), NONE)
        if len(symbols) > 1:
            rank[:-1] = np.where(own[1:] == own[:-1], self.ranks(symbols[:-1], symbols[1:]), NONE)
        while len(symbols):
            begins = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            lengths = np.diff(np.append(begins, len(own)))
            low = np.minimum.reduceat(rank, begins)
            out[own[begins]] = lengths
            going = low < NONE
            if not going.all():
                live = np.repeat(going, lengths)
                symbols, own, rank = symbols[live], own[live], rank[live]
                low, lengths = low[going], lengths[going]
                if not len(symbols):
                    break
            at = self._places(rank == np.repeat(low, lengths), own)
            symbols[at] = self.made[rank[at]]
            kept = np.ones(len(symbols), bool)
            kept[at + 1] = False
            place = np.cumsum(kept) - 1
            symbols, own, rank = symbols[kept], own[kept], rank[kept]
            # a merged symbol has new pairs with both its neighbours
            new = place[at]
            beside = np.zeros(len(own) + 1, bool)
            beside[new] = beside[new - 1] = True
            beside[-2:] = False
            rank[new] = NONE
            near = np.flatnonzero(beside)
            near = near[own[near] == own[near + 1]]
            rank[near] = self.ranks(symbols[near], symbols[near + 1])
        return out

    def _places(self, lowest: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Places to merge: of overlapping ones, which are runs, each second from the left; only
        the first of a piece where merges must go one by one."""
        at = np.flatnonzero(lowest)
        if not self.at_once:
            return at[np.unique(own[at], return_index=True)[1]]
        begins = np.concatenate([[True], np.diff(at) != 1])
        since = at - at[begins][np.cumsum(begins) - 1]
        return at[since % 2 == 0]


class Counter:
    """Counts the tokens of whole texts with a file of the tokenizers library: byte-level BPE
    without a normalizer; any other kind is an error. Added tokens in a text are one token each,
    as the library has it by default."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, pre = told["model"], told["pre_tokenizer"] or {}
        added = told.get("added_tokens") or []
        plain = all(model.get(k, v) == v for k, v in PLAIN.items()) and told["normalizer"] is None
        plain &= pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        plain &= not any(a[k] for a in added for k in ("single_word", "lstrip", "rstrip"))
        if not plain:
            raise ValueError(f"{path}: not a byte-level BPE vocabulary by ranks alone")
        self.merges = Merges(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])
        self._split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        texts = sorted((a["content"] for a in added if a["content"]), key=len, reverse=True)
        self._added = re.compile("|".join(map(re.escape, texts))) if texts else None
        self._forget()

    def _forget(self) -> None:
        self._index, self._counts = _Numbers(), np.zeros(1 << 15, dtype=np.int64)

    def _pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text without added tokens."""
        if text.isascii() or not BEYOND.search(text):
            return LATIN.findall(text)
        return [_RAW + p for p, _ in self._split(text)]

    def count(self, texts: Sequence[str | None]) -> np.ndarray:
        """Tokens of each text; none for null."""
        extra = np.zeros(len(texts), np.int64)
        split = []
        for i, t in enumerate(texts):
            parts = self._added.split(t) if t and self._added else [t or ""]
            extra[i] = len(parts) - 1
            split.append(self._pieces(parts[0]) if len(parts) == 1 else [p for x in parts for p in self._pieces(x)])
        if len(self._index) > MAX_PIECES:
            self._forget()
        sizes = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        at = np.fromiter(map(self._index.__getitem__, itertools.chain.from_iterable(split)), dtype=np.int64, count=int(sizes.sum()))
        if self._index.fresh:
            have = len(self._index) - len(self._index.fresh)
            self._counts = _room(self._counts, len(self._index))
            self._counts[have : len(self._index)] = self.merges.counts([token_bytes(p[1:]) if p[0] == _RAW else p.encode() for p in self._index.fresh])
            self._index.fresh = []
        before = np.concatenate([[0], np.cumsum(self._counts[at])])
        ends = np.cumsum(sizes)
        return before[ends] - before[ends - sizes] + extra


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The worker's counter for a vocabulary file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, limit: int = 1024, text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``, which tells
    whether the tokens are more than ``limit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for b in bounded(batches):
            n = own.count(b.column("text").to_pylist())
            size = pc.fill_null(pc.binary_length(b.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    base = docs.select("doc_id", F.col(f"`{text}`").alias("text"))
    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean")
