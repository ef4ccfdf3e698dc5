"""Exact removal of repeated byte strings, by rank refinement over sampled suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier. Ranking
every suffix by prefix doubling needs some seven sorts of all positions, tens of times the
input on disk. Two facts reduce it. A string that is found where its least
``GRAM``-byte hash lies (the leftmost, if several) shares that place with all its equals,
so only those places, one in thirty-five, stand for their suffixes. And the hash of any
prefix is known where the text is, so a rank needs no look-up.

* Rank 0 is the hash of the ``GRAM`` bytes at the place. Places with a rank of their own
  repeat nothing and drop out.
* Rank 1 adds the hash of the whole context: all strings that the place stands for. Spark
  sorts (rank 0, rank 1, position); all but the first of equal pairs are repeats entire.
* Where one rank 0 has several ranks 1 (a repeat begins or ends there), the first place of
  each goes on to rank 2: the hash of each single string, ``LENGTH`` bytes, past the
  threshold. Spark sorts (rank 2, position); all but the first are repeats.

Strings count as equal if a hash of 64 bits and an independent one of 32 agree, which for 10**12
different strings fails with a probability of about 10**-5; bytes are not compared again.
``prefix_doubling`` is the plain form without hashes, for tables whose positions all fit.

Before each shuffle a task settles what repeats within its own batch, so a passage that
stands in a third of all documents costs a row per batch. Runs of equal ranks are read as
a stream; no group is collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from quillspark.llm.batches import bounded
from quillspark.llm.shingles import mix
from quillspark.operators.running import numbered
from quillspark.plans.scratch import Scratch

LENGTH, GRAM = 100, 32
PIECE = 4_000_000
BATCH_BYTES = 3_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
#: Base of the second, independent hash.
_CHECK_BASE = 0xD1342543DE82EF95
_HIGH = np.uint64(0xFFFFFFFF00000000)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _values(base: int) -> np.ndarray:
    """A value for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each at least."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size, out = max(n, 1 << 22), []
        for factor in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, factor, dtype=np.uint64)
            a[0] = 1
            with np.errstate(over="ignore"):
                out.append(np.cumprod(a, dtype=np.uint64))
        _POWERS[base] = out[0], out[1]
    return _POWERS[base]


class Hashes:
    """Hashes of any substrings of a byte array, from prefix sums."""

    def __init__(self, raw: np.ndarray, base: int = _BASE):
        up, self.down = _powers(base, len(raw) + 1)
        with np.errstate(over="ignore"):
            self.prefix = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(_values(base)[raw] * up[: len(raw)], dtype=np.uint64, out=self.prefix[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.prefix[end] - self.prefix[begin]) * self.down[begin])

    def checks(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """32 bits of the hashes."""
        return (self.of(begin, end) >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def grams(self, size: int) -> np.ndarray:
        n = len(self.prefix) - size
        with np.errstate(over="ignore"):
            return mix((self.prefix[size:] - self.prefix[:n]) * self.down[:n])


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    m, have = keys, 1
    while have * 2 <= width:
        m, have = np.minimum(m[:-have], m[have:]), have * 2
    return np.minimum(m[: len(keys) - width + 1], m[width - have :][: len(keys) - width + 1]) if have < width else m


def places(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places of the texts that lie in ``raw`` one after the other, up to ``ends``: number of
    the text, place, first and last start of the strings it stands for (all within raw),
    rank 0, rank 1 and the check."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int32))
    if len(raw) < LENGTH:
        return none
    h = Hashes(raw)
    grams = h.grams(GRAM)
    keys = (grams & _HIGH) | np.arange(len(grams), dtype=np.uint64)
    at = (_least(keys, LENGTH - GRAM + 1) & ~_HIGH).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    valid = np.zeros(len(at) + 1, np.int32)
    whole = ends - starts >= LENGTH
    np.add.at(valid, starts[whole], 1)
    np.add.at(valid, (ends - LENGTH + 1)[whole], -1)
    where = np.flatnonzero(np.cumsum(valid[:-1]))
    if not len(where):
        return none
    chosen = at[where]
    new = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (where[1:] != where[:-1] + 1)])
    first = where[new]
    last = np.concatenate([where[np.flatnonzero(new)[1:] - 1], where[-1:]])
    place = chosen[new]
    with np.errstate(over="ignore"):
        context = h.of(first, last + LENGTH) * np.uint64(_BASE) + ((place - first) * 256 + last - first).astype(np.uint64)
    rank1 = mix(context)
    rank1[rank1 == 0] = 1
    rank0, check = grams[place], Hashes(raw, _CHECK_BASE).checks(first, last + LENGTH)
    return np.searchsorted(ends, place, "right"), place, first, last, rank0, rank1, check


def _pieces(docs: list[int], texts: list[str | None]) -> Iterator[tuple[list[int], list[int], np.ndarray, np.ndarray]]:
    """Bytes of the texts, a very long one in overlapping pieces: doc ids, offsets of the
    pieces in their texts, all bytes and the ends of the pieces in them."""
    ids, offsets, parts, size = [], [], [], 0
    for doc, text in zip(docs, texts, strict=True):
        raw = (text or "").encode()
        for k in range(0, max(1, len(raw) - LENGTH + 1), PIECE):
            part = raw[k : k + PIECE + LENGTH - 1]
            ids.append(doc)
            offsets.append(k)
            parts.append(part)
            size += len(part)
            if size >= BATCH_BYTES:
                yield ids, offsets, np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
                ids, offsets, parts, size = [], [], [], 0
    if parts:
        yield ids, offsets, np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])


def _later(order: np.ndarray, *ranks: np.ndarray) -> np.ndarray:
    """In the given order: whether the entry has the ranks of the one before it."""
    same = np.ones(max(len(order) - 1, 0), bool)
    for r in ranks:
        s = r[order]
        same &= s[1:] == s[:-1]
    return np.concatenate([[False], same])[: len(order)]


#: ``spot`` holds a place and, in a byte each, how far before it its first and last string start.
_RANKED = "rank0 bigint, rank1 bigint, check int, doc bigint, spot bigint"
_RANGES = "doc bigint, lo bigint, hi bigint, open boolean"


def _table(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in names.split(", ")])


def rank(docs: DataFrame) -> DataFrame:
    """Places with their ranks. Repeats within the batch are settled here: they have rank1 0
    and a rank0 that only spreads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "text", BATCH_BYTES):
            for ids, offsets, raw, ends in _pieces(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                text, place, lo, hi, rank0, rank1, check = places(raw, ends)
                if not len(text):
                    continue
                shift = (np.array(offsets) - np.concatenate([[0], ends[:-1]]))[text]
                doc, place, lo, hi = np.array(ids, np.int64)[text], place + shift, lo + shift, hi + shift
                order = np.lexsort((place, doc, check, rank1, rank0))
                later = _later(order, rank0, rank1, check)
                head = np.maximum.accumulate(np.where(later, 0, np.arange(len(order))))
                later &= (doc[order] != doc[order[head]]) | (place[order] != place[order[head]])
                known = order[later]
                rank1[known] = 0
                rank0[known] = mix(doc[known].astype(np.uint64))
                yield _table(_RANKED, rank0.view(np.int64), rank1.view(np.int64), check, doc, place << 16 | (place - lo) << 8 | (place - hi))

    return docs.mapInArrow(run, _RANKED)


def settle(ranked: DataFrame) -> DataFrame:
    """Of places sorted by rank: ranges of repeated strings (``open`` false), and the first
    place of each rank 1 where a rank 0 has several (``open`` true)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the first place of the current rank 0 while it has one rank 1: (doc, lo, hi)
        last = None  # rank0, rank1, check, doc, place of the head of the current ranks
        for b in batches:
            rank0, rank1, check, doc, spot = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            place = spot >> 16
            c = [rank0, rank1, check, doc, place, place - (spot >> 8 & 255), place - (spot & 255)]
            known = c[1] == 0
            if known.any():
                yield _table(_RANGES, c[3][known], c[5][known], c[6][known], np.zeros(int(known.sum()), bool))
                c = [x[~known] for x in c]
            rank0, rank1, check, doc, place, lo, hi = c
            n = len(doc)
            if not n:
                continue
            before = last[:3] if last else (None, None, None)
            fresh = [np.concatenate([[x[0] != y], x[1:] != x[:-1]]) for x, y in zip((rank0, rank1, check), before, strict=True)]
            new0, new1 = fresh[0], fresh[0] | fresh[1] | fresh[2]
            head = np.maximum.accumulate(np.where(new1, np.arange(n), -1))
            head_doc, head_place = np.where(head >= 0, doc[head], last[3] if last else 0), np.where(head >= 0, place[head], last[4] if last else 0)
            repeat = ~new1 & ((doc != head_doc) | (place != head_place))
            second = new1 & ~new0
            run0 = np.maximum.accumulate(np.where(new0, np.arange(n), -1))
            openers = np.unique(run0[second])
            out_doc, out_lo, out_hi = [doc[second]], [lo[second]], [hi[second]]
            firsts = openers[openers >= 0]
            out_doc.append(doc[firsts])
            out_lo.append(lo[firsts])
            out_hi.append(hi[firsts])
            if len(openers) and openers[0] < 0 and held:
                out_doc.append(np.array([held[0]]))
                out_lo.append(np.array([held[1]]))
                out_hi.append(np.array([held[2]]))
                held = None
            opened = np.concatenate(out_doc), np.concatenate(out_lo), np.concatenate(out_hi)
            yield _table(
                _RANGES,
                np.concatenate([doc[repeat], opened[0]]),
                np.concatenate([lo[repeat], opened[1]]),
                np.concatenate([hi[repeat], opened[2]]),
                np.concatenate([np.zeros(int(repeat.sum()), bool), np.ones(len(opened[0]), bool)]),
            )
            if run0[-1] >= 0:
                held = None if run0[-1] in firsts else (doc[run0[-1]], lo[run0[-1]], hi[run0[-1]])
            last = (rank0[-1], rank1[-1], check[-1], head_doc[-1], head_place[-1])

    return ranked.repartition("rank0").sortWithinPartitions("rank0", "rank1", "check", "doc", "spot").mapInArrow(run, _RANGES)


def strings(docs: DataFrame, opened: DataFrame) -> DataFrame:
    """Rank 2 of every string in the open ranges: ``rank2``, ``doc``, ``start`` and ``more`` 0.
    Strings settled within the batch come as ranges, from ``start`` on ``more`` further ones,
    with a rank2 that only spreads them, and ``more`` counted from -1 down."""
    ranges = opened.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    schema = "rank2 bigint, check int, doc bigint, start bigint, more int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in bounded(iter([whole]), "text", BATCH_BYTES):
                docs_, starts_, ranks_, checks_ = [], [], [], []
                for doc, text, ranges in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("ranges"), strict=True):
                    lo, hi = (ranges.values.field(k).to_numpy() for k in ("lo", "hi"))
                    sizes = hi - lo + 1
                    start = np.unique(np.repeat(lo - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum()))
                    raw = np.frombuffer(text.encode(), np.uint8)
                    for k in range(0, len(raw), PIECE):
                        here = start[(start >= k) & (start < k + PIECE)]
                        if len(here):
                            part = raw[k : k + PIECE + LENGTH - 1]
                            starts_.append(here)
                            ranks_.append(Hashes(part).of(here - k, here - k + LENGTH))
                            checks_.append(Hashes(part, _CHECK_BASE).checks(here - k, here - k + LENGTH))
                            docs_.append(np.full(len(here), doc, np.int64))
                if not docs_:
                    continue
                doc, start, rank2, check = (np.concatenate(x) for x in (docs_, starts_, ranks_, checks_))
                order = np.lexsort((start, doc, check, rank2))
                later = _later(order, rank2, check)
                head = np.maximum.accumulate(np.where(later, 0, np.arange(len(order))))
                known = np.zeros(len(doc), bool)
                known[order[later & ((doc[order] != doc[order[head]]) | (start[order] != start[order[head]]))]] = True
                d, lo, hi = _joined(doc[known], start[known])
                yield _table(
                    schema,
                    np.concatenate([rank2[~known], mix(d.astype(np.uint64))]).view(np.int64),
                    np.concatenate([check[~known], np.zeros(len(d), np.int32)]),
                    np.concatenate([doc[~known], d]),
                    np.concatenate([start[~known], lo]),
                    np.concatenate([np.zeros(int((~known).sum()), np.int32), (-1 - (hi - lo)).astype(np.int32)]),
                )

    joined = docs.where("text is not null").join(ranges, "doc_id").select("doc_id", "text", "ranges")
    return joined.mapInArrow(run, schema)


def _joined(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring starts of a document, given in ascending order, as ranges."""
    if not len(doc):
        return doc, start, start
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)])
    return doc[new], start[new], start[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(doc) - 1]])]


def settle_strings(ranked: DataFrame) -> DataFrame:
    """The strings that are not the first of their rank 2, as ranges."""
    schema = "doc bigint, lo bigint, hi bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            rank2, check, doc, start, more = (b.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            known = more < 0
            if known.any():
                yield _table(schema, doc[known], start[known], start[known] - 1 - more[known].astype(np.int64))
                rank2, check, doc, start = (x[~known] for x in (rank2, check, doc, start))
            n = len(doc)
            if not n:
                continue
            new = np.concatenate([[last is None or (rank2[0], check[0]) != last[:2]], (rank2[1:] != rank2[:-1]) | (check[1:] != check[:-1])])
            head = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            head_doc, head_start = np.where(head >= 0, doc[head], last[2] if last else 0), np.where(head >= 0, start[head], last[3] if last else 0)
            repeat = ~new & ((doc != head_doc) | (start != head_start))
            yield _table(schema, doc[repeat], start[repeat], start[repeat])
            last = (rank2[-1], check[-1], head_doc[-1], head_start[-1])

    return ranked.repartition("rank2").sortWithinPartitions("rank2", "check", "doc", "start").mapInArrow(run, schema)


def prefix_doubling(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The strings of ``LENGTH`` bytes that start earlier too, as ranges, by distributed prefix
    doubling: every position has the rank of its first 8 bytes; Spark sorts the pairs of the
    ranks at a position and 8, 16 and 32 bytes on, and last those 36 on, and numbers them anew.
    A position whose pair is unique drops out, and with it those that reach it.

    No hashes, so exact; but each round sorts and writes all positions that still repeat.
    """
    schema = "doc bigint, at bigint, rank bigint"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "text", BATCH_BYTES):
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                raw = np.frombuffer((text or "").encode(), np.uint8)
                for k in range(0, max(0, len(raw) - 7), PIECE):
                    part = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw[k : k + PIECE + 7], 8))
                    yield _table(schema, np.full(len(part), doc, np.int64), np.arange(k, k + len(part)), part.view(np.int64).ravel())

    ranks, length = scratch.save(docs.distinct().mapInArrow(first, schema), "ranks"), 8
    while length < LENGTH:
        step = min(length, LENGTH - length)
        ahead = ranks.select("doc", (F.col("at") - step).alias("at"), F.col("rank").alias("next"))
        pairs = ranks.join(ahead, ["doc", "at"])
        counted = pairs.groupBy("rank", "next").agg(F.count("*").alias("n")).where("n > 1").select("rank", "next")
        fresh = scratch.save(numbered(counted, ["rank", "next"], name="fresh"), "pairs")
        again = scratch.save(pairs.join(fresh, ["rank", "next"]).select("doc", "at", F.col("fresh").alias("rank")), "ranks")
        scratch.drop(ranks, fresh)
        scratch.free()
        ranks, length = again, length + step
    heads = scratch.save(ranks.groupBy("rank").agg(F.min(F.struct("doc", "at")).alias("head")), "heads")
    later = ranks.join(heads, "rank").where(F.struct("doc", "at") > F.col("head"))
    return later.select("doc", F.col("at").alias("lo"), F.col("at").alias("hi"))


def strip(raw: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[bytes, int, int]:
    """The bytes outside the strings that start at lo to hi, the number removed and the
    number of removed runs."""
    if not len(lo):
        return raw, 0, 0
    edge = np.zeros(len(raw) + 1, np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, np.minimum(hi + LENGTH, len(raw)), -1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def dedup(docs: DataFrame, text: str = "text", with_kept: bool = False, doubling: bool = False) -> DataFrame:
    """Per row: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, and the
    remaining bytes as ``kept`` if asked. ``doubling`` takes the plain form.

    Ids that are no integers are numbered in ascending order first. Null texts count as empty.
    Texts under ``LENGTH`` bytes are never touched. Rows of one
    doc_id count as one document (repeats between them at the same place are none); rows
    without doc_id are neither searched nor touched. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        ids = scratch.save(numbered(docs.where("doc_id is not null").select(F.col("doc_id").alias("id")).distinct(), ["id"], name="no"), "ids")
        found = dedup(docs.join(ids, docs["doc_id"] == ids["id"], "left").select(F.col("no").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text", with_kept, doubling)
        return found.join(ids, found["doc_id"] == ids["no"], "left").select(F.col("id").alias("doc_id"), *[c for c in found.columns if c != "doc_id"])
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    named = base.where("doc_id is not null")

    if doubling:
        found = scratch.save(prefix_doubling(named, scratch), "strings")
    else:
        settled = scratch.save(settle(rank(named)), "ranges")
        scratch.free()
        single = scratch.save(settle_strings(strings(named, settled.where("open"))), "strings")
        found = settled.where("not open").select("doc", "lo", "hi").union(single)
    scratch.free()
    ranges = found.groupBy(F.col("doc").alias("r_doc")).agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    joined = base.join(ranges, F.col("doc_id") == F.col("r_doc"), "left").select("doc_id", "text", "ranges")
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.zeros(0, np.int64)
        for whole in batches:
            for b in bounded(iter([whole]), "text"):
                rows = []
                for t, r in zip(b.column("text").to_pylist(), b.column("ranges"), strict=True):
                    raw = (t or "").encode()
                    lo, hi = (r.values.field(k).to_numpy() for k in ("lo", "hi")) if r.is_valid else (empty, empty)
                    kept, removed, spans = strip(raw, lo, hi)
                    rows.append((len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
                n = [pa.array([x[k] for x in rows], pa.int64()) for k in range(3)]
                more = [pa.array([x[4] for x in rows], pa.binary())] if with_kept else []
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *n, pa.array([x[3] for x in rows]), *more], [x.split()[0] for x in schema.split(", ")])

    return joined.mapInArrow(run, schema)
