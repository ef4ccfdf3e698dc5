"""Near-duplicate classes by ProbMinHash over weighted five-word shingles.

Each shingle of a text is a Poisson process whose rate is its weight; its arrivals go to
hashed registers, and a register keeps the element of its first arrival. An element stops
as soon as its next arrival is later than the latest register of the text. Two registers
agree with the probability Jaccard of the texts. Bands of registers are candidates'
buckets, and exact probability Jaccard over the texts verifies.

Equal texts are one document first. Within a bucket nothing is paired with everything: all
members meet the bucket's least document, and components are formed. Only buckets that
still hold several components go on: their members outside the main component are a query
set that is compared with the bucket's members in blocks, by matrix products, and only
links come out. So no link between different components is lost, a bucket of copies costs
its size, and no task holds more than two blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.batches import bounded
from quillspark.llm.shingles import flat_shingles, mix, probability_jaccard, shingles
from quillspark.operators.components import connected_components
from quillspark.plans.scratch import Scratch

THRESHOLD = 0.8
BANDS, ROWS = 26, 5  # a pair at the threshold shares a band with probability 0.99996
REGISTERS = BANDS * ROWS
BLOCK = 256
COLUMNS = 8192
_STEP = np.uint64(0x9E3779B97F4A7C15)


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """(n, REGISTERS) elements of the first arrivals; a text without elements has zeros."""
    first = np.full(n * REGISTERS, np.inf)
    signature = np.zeros(n * REGISTERS, dtype=np.uint64)
    latest = np.full(n, np.inf)
    e, w, d, t, state = elements, weights.astype(float), owner, np.zeros(len(elements)), elements
    with np.errstate(over="ignore"):
        while len(e):
            state = mix(state + _STEP)
            t = t - np.log(((state >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / w
            live = t < latest[d]
            e, w, d, t, state = e[live], w[live], d[live], t[live], state[live]
            if not len(e):
                break
            slot = d * REGISTERS + (mix(state ^ _STEP) % np.uint64(REGISTERS)).astype(np.int64)
            np.minimum.at(first, slot, t)
            won = first[slot] == t
            signature[slot[won]] = e[won]
            active = np.unique(d) if len(d) < n else np.arange(n)
            latest[active] = first.reshape(n, REGISTERS)[active].max(axis=1)
    return signature.reshape(n, REGISTERS)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(n, BANDS) keys; equal keys mean equal registers in the same band."""
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signature), BANDS)).copy()
    parts = signature.reshape(-1, BANDS, ROWS)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            out = mix(out * _STEP + parts[:, :, k])
    return out.view(np.int64)


def sign(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row with a text: ``doc_id``, ``text_key`` (equal for equal texts) and ``bands``
    (empty where the text has no word)."""
    base = docs.select("doc_id", F.col(f"`{text}`").alias("text")).where("doc_id is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            texts = b.column("text").to_pylist()
            elements, weights, owner = flat_shingles(texts)
            keys = band_keys(signatures(elements, weights, owner, len(texts)))
            full = np.bincount(owner, minlength=len(texts)) > 0
            ends = np.concatenate([[0], np.cumsum(full * BANDS)])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([hashlib.md5(t.encode(), usedforsecurity=False).digest() for t in texts], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[full].ravel())),
                ],
                ["doc_id", "text_key", "bands"],
            )

    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, text_key binary, bands array<bigint>")


def verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts have probability Jaccard at least ``threshold``. The text
    of b travels with the pair; that of a, a leader with many pairs, meets it last."""
    with_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    kind = both.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of_a = None, None
        for whole in batches:
            for b in bounded(iter([whole]), "text_b"):
                hit = []
                for a, ta, tb in zip(b.column("a").to_pylist(), b.column("text_a"), b.column("text_b"), strict=True):
                    if of_a is None or a != last:
                        last, of_a = a, shingles(ta.as_py())
                    hit.append(probability_jaccard(of_a, shingles(tb.as_py())) >= threshold)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return both.mapInArrow(run, f"a {kind}, b {kind}")


def _all_ones(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    return np.array([len(h) > 0 and int(w.max()) == 1 for h, w in sets], dtype=bool)


def block_links(left: list[tuple[np.ndarray, np.ndarray]], right: list[tuple[np.ndarray, np.ndarray]], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with probability Jaccard of left i and right j at least ``threshold``.

    One product of indicator matrices, in runs of columns, counts the common elements of
    all pairs. Where all weights are 1 that is the similarity. For the others the weight on
    common elements bounds it from above, and what the bound leaves is computed exactly.
    """
    sides = (left, right)
    owner = [np.repeat(np.arange(len(s)), [len(h) for h, _ in s]) for s in sides]
    element = [np.concatenate([h for h, _ in s]) for s in sides]
    share = [np.concatenate([w / w.sum() if len(w) else w.astype(float) for _, w in s]) for s in sides]
    common = np.intersect1d(*element)
    column = [np.searchsorted(common, e) for e in element]
    held = [(c < len(common)) & (common[np.minimum(c, max(len(common) - 1, 0))] == e) if len(common) else np.zeros(len(e), bool) for c, e in zip(column, element, strict=True)]
    both, of_left, of_right = (np.zeros((len(left), len(right)), np.float32) for _ in range(3))
    for start in range(0, len(common), COLUMNS):
        ones, mass = [], []
        for s, o, c, h, m in zip(sides, owner, column, held, share, strict=True):
            here = h & (c >= start) & (c < start + COLUMNS)
            for kind, value in ((ones, 1.0), (mass, m[here])):
                dense = np.zeros((len(s), min(COLUMNS, len(common) - start)), np.float32)
                dense[o[here], c[here] - start] = value
                kind.append(dense)
        both += ones[0] @ ones[1].T
        of_left += mass[0] @ ones[1].T
        of_right += ones[0] @ mass[1].T
    sizes = [np.array([len(h) for h, _ in s], np.float32) for s in sides]
    union = sizes[0][:, None] + sizes[1][None, :] - both
    plain = _all_ones(left)[:, None] & _all_ones(right)[None, :]
    hit = plain & (both >= threshold * union - 1e-3)
    maybe = ~plain & (np.minimum(of_left, of_right) >= threshold - 1e-4)
    for i, j in zip(*np.nonzero(hit | maybe), strict=True):
        hit[i, j] = probability_jaccard(left[i], right[j]) >= threshold
    return np.nonzero(hit)


def _blocks_of(n: Column) -> Column:
    return F.ceil(n / BLOCK).cast("int")


def link_blocks(apart: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between documents of different parts of a bucket, one of them outside the
    bucket's main part. ``apart`` has key, doc, part, main. A bucket is dealt into blocks of
    about ``BLOCK`` documents; a task compares one block of outsiders with one of all."""
    size = apart.groupBy("key").agg(F.sum((F.col("part") != F.col("main")).cast("int")).alias("outs"), F.count("*").alias("every"))
    sized = apart.join(size, "key").join(texts.withColumnRenamed("doc_id", "doc"), "doc")
    own = lambda n: F.pmod(F.xxhash64("doc", F.lit(7)), _blocks_of(F.col(n))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), _blocks_of(F.col(n)) - 1))
    columns = ["key", "doc", "part", "text"]
    heads = sized.where("part <> main").select(*columns, F.lit(True).alias("head"), own("outs").alias("h"), every("every").alias("m"))
    rest = sized.select(*columns, F.lit(False).alias("head"), every("outs").alias("h"), own("every").alias("m"))
    kind = apart.schema["doc"].dataType.simpleString()

    def run(_key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sides = [rows[rows["head"]], rows[~rows["head"]]]
        if not len(sides[0]) or not len(sides[1]):
            return pd.DataFrame({"a": [], "b": []})
        i, j = block_links(*([shingles(t) for t in s["text"]] for s in sides), threshold)
        (da, pa_), (db, pb) = ((s["doc"].to_numpy(), s["part"].to_numpy()) for s in sides)
        found = pd.DataFrame({"a": da[i], "b": db[j], "part": pb[j]})[pa_[i] != pb[j]]
        # of a task's links those that join something suffice
        return found.drop_duplicates(["a", "part"])[["a", "b"]]

    return heads.unionByName(rest).groupBy("key", "h", "m").applyInPandas(run, f"a {kind}, b {kind}").distinct()


def classes(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per document: ``doc_id`` and ``class_id``, the least doc_id of its class.

    Null texts are classes of their own; texts without words (also empty ones) only join
    equal texts. Rows with the same doc_id are one document: it joins the classes of all its
    texts, and its least text is the one compared for near copies. Rows without doc_id give
    none. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "near")
    signed = scratch.save(sign(docs, text), "signed")
    firsts = scratch.save(
        signed.groupBy("text_key").agg(F.min(F.struct("doc_id", "bands")).alias("f"), F.count("*").alias("n")).select("text_key", F.col("f.doc_id").alias("rep"), F.col("f.bands").alias("bands"), "n"),
        "texts",
        narrow=True,
    )
    copies = signed.select("doc_id", "text_key").join(firsts.where("n > 1").select("text_key", "rep"), "text_key").where("doc_id <> rep").select("doc_id", "rep").distinct()
    banded = firsts.select(F.col("rep").alias("doc"), F.explode("bands").alias("key"))
    led = scratch.save(banded.groupBy("key").agg(F.min("doc").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n"), "buckets", narrow=True)
    members = scratch.save(banded.join(led, "key"), "members", narrow=True)
    near = docs.select("doc_id", F.col(f"`{text}`").alias("text")).join(members.select(F.col("doc").alias("doc_id")).distinct(), "doc_id").where("text is not null")
    texts = scratch.save(near.groupBy("doc_id").agg(F.min("text").alias("text")), "candidates")
    tested = scratch.save(members.where("doc <> leader").select(F.col("leader").alias("a"), F.col("doc").alias("b")).distinct(), "pairs", narrow=True)
    links = scratch.save(verify(tested, texts, threshold), "links")
    done = members.select("key", F.col("leader").alias("doc")).distinct()
    every = members.select("key", "doc")
    labels = connected_components(links, scratch)
    rest = every.join(done, ["key", "doc"], "left_anti").join(labels, F.col("doc") == F.col("node"), "left").select("key", "doc", F.coalesce("label", "doc").alias("part"))
    rest = scratch.save(rest, "rest", narrow=True)
    split = rest.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.min(F.struct("doc", "part")).alias("f")).where("low < high")
    split = scratch.save(split, "split", narrow=True)  # written, so that a hot bucket can be split where they meet
    apart = scratch.save(rest.join(split.select("key", F.col("f.part").alias("main")), "key"), "apart", narrow=True)
    more = scratch.save(link_blocks(apart, texts, threshold), "links")
    links = links.union(more)
    ids = docs.where("doc_id is not null").select("doc_id").distinct()
    # a doc_id with several texts links their representatives too
    fuller = connected_components(links.union(copies.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))), scratch)
    return ids.join(fuller, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("label", "doc_id").alias("class_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` but for the documents that are not the first of their class. Rows
    without doc_id stay."""
    later = classes(docs).where("doc_id <> class_id").select(F.col("doc_id").alias("__qs_id"))
    return docs.join(later, docs["doc_id"] == F.col("__qs_id"), "left_anti")
