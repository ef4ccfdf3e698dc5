"""Benchmark decontamination by SimHash over item-sized windows.

Each benchmark item gives the SimHash of its five-word shingles, weighted by how often they
occur. Windows with as many words slide over every text, and prefix sums of the bits of its
shingles give the fingerprint of each; a text shorter than the item is one window.
Fingerprints are cut into blocks: if two differ in at most ``RADIUS`` bits, some block differs
in at most RADIUS // BLOCKS. The multi-index holds for each value of a block the items that
near to it, so four look-ups find every item within the radius. These candidates, and no
others, are verified by the exact weighted Jaccard of their shingles.

A window without any shingle of the benchmark has similarity 0 to all items, so no fingerprint
is made for it.

The items go to the workers in slices of bounded text, one pass over the texts per slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillspark.llm.batches import bounded
from quillspark.llm.shingles import SIZE, weighted_jaccard, window_hashes, word_hashes, words_of

THRESHOLD = 0.8
BLOCKS = 4
#: A pair at the threshold has a cosine of 0.89 or more, so 9.7 of 64 bits differ on average,
#: with a standard deviation of 2.9; this is three of them above.
RADIUS = 19
SLICE_CHARS = 16_000_000
SLICE_ITEMS = 20_000
#: Words of a text that are fingerprinted at a time.
STRETCH = 1 << 15
#: Bytes of the index's look-up rows, and cells of the windows x items matrix at a time.
ROWS_BYTES, CELLS = 32_000_000, 1 << 23


def bit_sums(shingles: np.ndarray) -> np.ndarray:
    """(n + 1, 64) prefix sums of the bits of the hashes."""
    out = np.zeros((len(shingles) + 1, 64), np.int32)
    np.cumsum(np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1), axis=0, dtype=np.int32, out=out[1:])
    return out


def simhash(votes: np.ndarray, n: int) -> np.ndarray:
    """64-bit SimHash from rows of bit sums over n shingles; a repeated shingle counts repeatedly."""
    return np.packbits(2 * votes > n, axis=-1).view(np.uint64).ravel()


class Index:
    """Multi-index of fingerprints. For a value of a block, the row with a bit for each item
    whose block is near is made at its first look-up and kept, in bounded memory."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.blocks = np.ascontiguousarray(prints.view(np.uint16).reshape(-1, BLOCKS).T)
        self.width = -(-len(prints) // 8)
        self.room = max(64, ROWS_BYTES // max(1, self.width))
        self._forget()

    def _forget(self) -> None:
        self.slot = np.full((BLOCKS, 1 << 16), -1, np.int32)
        self.rows = np.zeros((min(self.room, 1 << 10), self.width), np.uint8)
        self.used = 0

    def look_up(self, block: int, values: np.ndarray) -> np.ndarray:
        """A row for each value: the items within RADIUS // BLOCKS bits of it in the block."""
        every = np.unique(values)
        if self.used + len(every) > self.room:
            self._forget()
        new = every[self.slot[block, every] < 0]
        if self.used + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(len(new), len(self.rows)), self.width), np.uint8)])
        step = max(1, CELLS // max(1, len(self.prints)))
        for k in range(0, len(new), step):
            some = new[k : k + step]
            near = np.bitwise_count(some[:, None] ^ self.blocks[block][None, :]) <= RADIUS // BLOCKS
            self.rows[self.used : self.used + len(some)] = np.packbits(near, axis=1)
            self.slot[block, some] = np.arange(self.used, self.used + len(some))
            self.used += len(some)
        return self.rows[self.slot[block, values]]

    def near(self, prints: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (fingerprint, item) within the radius; ``among`` has for each fingerprint a row
        with a bit for each item that counts."""
        ws, js = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step = max(1, min(self.room // 2, CELLS // max(1, 8 * self.width)))
        for k in range(0, len(prints), step):
            some = prints[k : k + step]
            parts = some.view(np.uint16).reshape(-1, BLOCKS)
            found = self.look_up(0, parts[:, 0])
            for block in range(1, BLOCKS):
                found = found | self.look_up(block, parts[:, block])
            w, j = np.nonzero(np.unpackbits(found & among[k : k + step], axis=1, count=len(self.prints)))
            within = np.bitwise_count(some[w] ^ self.prints[j]) <= RADIUS
            ws.append(w[within] + k)
            js.append(j[within])
        return np.concatenate(ws), np.concatenate(js)


class Benchmark:
    """A slice of the benchmark: fingerprints, shingles with weights, and sizes."""

    def __init__(self, items: list[tuple[object, str]], skip: bool = True):
        self.skip = skip
        self.items: list[tuple[object, int]] = []
        self.sets, prints = [], []
        for i, text in items:
            words = word_hashes(words_of(text))
            if len(words):
                h = window_hashes(words)
                self.items.append((i, len(words)))
                self.sets.append(np.unique(h, return_counts=True))
                prints.append(simhash(bit_sums(h)[-1:], len(h)))
        self.index = Index(np.concatenate(prints) if prints else np.zeros(0, np.uint64))
        sizes = np.array([n for _, n in self.items], np.int64)
        #: Per size in words: the items of that size, as bits.
        self.of_size = {int(n): np.packbits(sizes == n) for n in np.unique(sizes)}
        #: By length of the shingles (shorter for short items): sizes, and all shingles.
        self.spans: dict[int, tuple[list[int], np.ndarray]] = {}
        for span in {min(SIZE, n) for n in self.of_size}:
            known = [h for (h, _), n in zip(self.sets, sizes, strict=True) if min(SIZE, n) == span]
            self.spans[span] = [n for n in self.of_size if min(SIZE, n) == span], np.unique(np.concatenate(known))

    def _windows(self, h: np.ndarray, sizes: list[int], known: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Start, shingles and size of the item of windows over the shingles ``h``, with their
        fingerprints, a stretch of the text at a time."""
        span = min(SIZE, sizes[0])
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        on = known[at] == h if self.skip else np.ones(len(h), bool)
        upto = np.concatenate([[0], np.cumsum(on)])
        longest = min(len(h), max(sizes) - span + 1)
        for a in range(0, len(h), STRETCH):
            here = np.flatnonzero(on[a : a + STRETCH + longest - 1])
            if not len(here):
                continue
            low, high = a + max(0, int(here[0]) - longest + 1), a + int(here[-1]) + 1
            sums = bit_sums(h[low : high + longest - 1])
            starts, lengths, of, prints = [], [], [], []
            for n in sizes:
                m = min(n - span + 1, len(h))  # a text shorter than the item is its one window
                s = np.arange(low, max(low, min(high, a + STRETCH, len(h) - m + 1)))
                s = s[upto[s + m] > upto[s]]
                starts.append(s)
                lengths.append(np.full(len(s), m))
                of.append(np.full(len(s), n))
                prints.append(simhash(sums[s - low + m] - sums[s - low], m))
            yield np.stack([np.concatenate(x) for x in (starts, lengths, of)]), np.concatenate(prints)

    def hits(self, text: str | None, threshold: float) -> list[tuple[object, float, int, int]]:
        """Per item that the text holds: id, best similarity, first word and number of words
        of the first such window."""
        hashes = word_hashes(words_of(text))
        best: dict[int, tuple[float, int, int]] = {}
        for span, (sizes, known) in self.spans.items():
            if len(hashes) < span:
                continue
            h = window_hashes(hashes, span)
            for (start, length, size), prints in self._windows(h, sizes, known):
                among = np.stack([self.of_size[n] for n in sizes])[np.searchsorted(sizes, size)] if len(size) else np.zeros((0, self.index.width), np.uint8)
                w, j = self.index.near(prints, among)
                own, last = None, None
                for k, item in zip(w.tolist(), j.tolist(), strict=True):
                    at, m = int(start[k]), int(length[k])
                    if (at, m) != last:
                        own, last = np.unique(h[at : at + m], return_counts=True), (at, m)
                    s = weighted_jaccard(own, self.sets[item])
                    if s >= threshold and s > best.get(item, (0.0,))[0]:
                        best[item] = s, at, min(int(size[k]), len(hashes))
        return [(self.items[j][0], *best[j]) for j in sorted(best)]


def _slices(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[object, str]]]:
    """The items in slices of bounded size, cut by a hash of the item."""
    items = benchmark.select(F.col(f"`{item}`").alias("item_id"), F.col(f"`{text}`").alias("text")).where("item_id is not null and text is not null").distinct()
    chars, count = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count("*")).first()
    n = 1 + max(chars // SLICE_CHARS, count // SLICE_ITEMS)
    for k in range(n):
        yield [tuple(r) for r in (items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)).collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and item found in it: ``doc_id``, ``item_id``, ``similarity``,
    ``first_word`` and ``n_words`` of the best window, the first of several.

    Null and empty texts hold nothing, null, empty and wordless items are in nothing; items of
    fewer than five words are matched as one shingle; equal items are each reported; repeated
    document rows repeat their rows; no items, no rows. Ids may be of any type. Other columns
    are not read.
    """
    base = docs.select("doc_id", F.col(f"`{text}`").alias("text"))
    item_type = benchmark.schema["item_id"].dataType
    schema = f"doc_id {base.schema['doc_id'].dataType.simpleString()}, item_id {item_type.simpleString()}, similarity double, first_word bigint, n_words bigint"

    def scan(items: list[tuple[object, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Benchmark(items)
            for b in bounded(batches):
                found = [(d, *hit) for d, t in zip(b.column("doc_id"), b.column("text").to_pylist(), strict=True) for hit in index.hits(t, threshold)]
                if found:
                    kinds = [b.schema.field("doc_id").type, to_arrow_type(item_type), pa.float64(), pa.int64(), pa.int64()]
                    rows = [[x[k].as_py() if k == 0 else x[k] for x in found] for k in range(5)]
                    yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds, strict=True)], ["doc_id", "item_id", "similarity", "first_word", "n_words"])

        return base.mapInArrow(run, schema)

    return reduce(DataFrame.union, [scan(items) for items in _slices(benchmark, "item_id", "text")])


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id holds no item; rows without doc_id stay."""
    hit = contaminated(docs, benchmark).select(F.col("doc_id").alias("__qs_id")).where("__qs_id is not null").distinct()
    return docs.join(hit, docs["doc_id"] == F.col("__qs_id"), "left_anti")
