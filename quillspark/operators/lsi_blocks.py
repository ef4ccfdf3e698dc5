"""Latent semantic indexing over any vocabulary: no matrix of the size of the terms in one place.

As ``lsi``, by a randomized range finder, but every matrix is a written table with a row per term or
per document. The documents x terms matrix is dealt into tiles, a block of documents by a block of
terms; a product is a cogroup of tiles with the rows of the other matrix in the same block, whose
partial rows are then summed by id. The basis is made orthogonal by a tall-skinny QR: every task
folds its rows into one small triangle, few tasks fold these, and only the last triangles, components
x components, reach the driver, which sends back the inverse. Iterations stop when the singular values
rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.features import indexed
from quillspark.plans.scratch import Scratch

OVERSAMPLE, ITERATIONS, REST = 10, 8, 1e-9
#: Numbers of the matrix of a block of terms, and weights of the documents of a block.
BLOCK_VALUES, BLOCK_WEIGHTS = 4_000_000, 2_000_000
#: Numbers of the products that a task holds at once.
STEP_VALUES = 4_000_000
#: Tasks that fold what all tasks have folded.
LAST_TASKS = 8


def _rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))


def _summed(where: np.ndarray, w: np.ndarray, source: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Rows ``where`` (0 to n - 1) of the sums of ``w`` times the rows ``of`` of ``source``."""
    out, step = np.zeros((n, source.shape[1])), max(1, STEP_VALUES // max(1, source.shape[1]))
    order = np.argsort(where, kind="stable")
    for i in range(0, len(order), step):
        at = order[i : i + step]
        rows = where[at]
        begin = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        out[rows[begin]] += np.add.reduceat(source[of[at]] * w[at, None], begin)
    return out


def _folded(rows: DataFrame, fold: Callable[[np.ndarray | None, np.ndarray], np.ndarray], merge: Callable[[np.ndarray, np.ndarray], np.ndarray], vector: str = "vec") -> np.ndarray | None:
    """One small matrix from all rows: folded by every task, then by few, then here."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if b.num_rows:
                held = fold(held, _rows(b.column(vector)))
        if held is not None:
            yield pa.RecordBatch.from_arrays([_lists(held.reshape(1, -1)), pa.array([held.shape[1]], pa.int32())], ["m", "width"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            for m, width in zip(b.column("m"), b.column("width").to_pylist(), strict=True):
                x = m.values.to_numpy().reshape(-1, width)
                held = x if held is None else merge(held, x)
        if held is not None:
            yield pa.RecordBatch.from_arrays([_lists(held.reshape(1, -1)), pa.array([held.shape[1]], pa.int32())], ["m", "width"])

    schema = "m array<double>, width int"
    few = rows.select(vector).mapInArrow(first, schema).repartition(LAST_TASKS).mapInArrow(again, schema).collect()  # at most LAST_TASKS small matrices
    held = None
    for r in few:
        x = np.array(r["m"]).reshape(-1, r["width"])
        held = x if held is None else merge(held, x)
    return held


def _triangle(held: np.ndarray | None, x: np.ndarray) -> np.ndarray:
    r = np.linalg.qr(x if held is None else np.concatenate([held, x]), mode="r")
    return r


def _gram(held: np.ndarray | None, x: np.ndarray) -> np.ndarray:
    """Products of all columns, and below them the sums of the columns."""
    own = np.concatenate([x.T @ x, x.sum(axis=0, keepdims=True)])
    return own if held is None else held + own


def _extremes(held: np.ndarray | None, x: np.ndarray) -> np.ndarray:
    """Greatest and least of each column."""
    own = np.stack([x.max(axis=0), x.min(axis=0)])
    return own if held is None else np.stack([np.maximum(held[0], own[0]), np.minimum(held[1], own[1])])


class _Tiles:
    """The documents x terms matrix as ``i``, ``j`` (blocks), ``doc``, ``idx``, ``w``."""

    def __init__(self, weights: DataFrame, terms: DataFrame, n_weights: int, width: int, scratch: Scratch):
        self.scratch, self.per = scratch, max(1, BLOCK_VALUES // width)
        self.n_docs = max(1, -(-n_weights // BLOCK_WEIGHTS))
        entries = weights.join(terms.select("term", "idx"), "term").select("doc_id", "idx", F.col("weight").cast("double").alias("w"))
        dealt = entries.select(self.doc_block(F.col("doc_id")).alias("i"), self.term_block(F.col("idx")).alias("j"), F.col("doc_id").alias("doc"), "idx", "w")
        self.rows = scratch.save(dealt, "tiles")
        self.blocks = scratch.save(self.rows.select("i", "j").distinct(), "blocks", narrow=True)
        self.kind = weights.schema["doc_id"].dataType.simpleString()

    def doc_block(self, doc):
        return F.pmod(F.xxhash64(doc), F.lit(self.n_docs)).cast("int")

    def term_block(self, idx):
        return F.floor(idx / self.per).cast("int")

    def _meet(self, side: DataFrame, other: str, id_of: str, kind: str, through: np.ndarray | None) -> DataFrame:
        """Partial rows ``id``, ``vec`` of tiles times a matrix. ``side`` has i, j, id and vec; ``other`` is
        the tiles' column of its ids and ``id_of`` that of the result."""

        def product(tile: pa.Table, matrix: pa.Table) -> pa.Table:
            if not tile.num_rows or not matrix.num_rows:
                return pa.table({"id": tile.column(id_of).slice(0, 0), "vec": pa.array([], pa.list_(pa.float64()))})
            x = _rows(matrix.column("vec"))
            x = x if through is None else x @ through
            have = matrix.column("id").combine_chunks()
            at = pa.compute.index_in(tile.column(other), value_set=have).combine_chunks()
            known = pa.compute.is_valid(at).to_numpy(zero_copy_only=False)
            codes = tile.column(id_of).combine_chunks().dictionary_encode()
            out = _summed(codes.indices.to_numpy()[known], tile.column("w").to_numpy()[known], x, at.to_numpy(zero_copy_only=False)[known].astype(np.int64), len(codes.dictionary))
            return pa.table({"id": codes.dictionary, "vec": _lists(out)})

        tiles = self.rows.groupBy("i", "j").cogroup(side.groupBy("i", "j"))
        return _sums(tiles.applyInArrow(product, f"id {kind}, vec array<double>"), kind)

    def times(self, v: DataFrame, through: np.ndarray | None = None) -> DataFrame:
        """X V (through): a row per document. ``v`` has idx and vec."""
        side = v.select(self.term_block(F.col("idx")).alias("b"), F.col("idx").alias("id"), "vec").join(self.blocks.withColumnRenamed("j", "b"), "b").select("i", F.col("b").alias("j"), "id", "vec")
        return self._meet(side, "idx", "doc", self.kind, through).withColumnRenamed("id", "doc")

    def transposed_times(self, y: DataFrame) -> DataFrame:
        """X' Y: a row per term. ``y`` has doc and vec."""
        side = y.select(self.doc_block(F.col("doc")).alias("b"), F.col("doc").alias("id"), "vec").join(self.blocks.withColumnRenamed("i", "b"), "b").select(F.col("b").alias("i"), "j", "id", "vec")
        return self._meet(side, "doc", "idx", "bigint", None).withColumnRenamed("id", "idx")


def _sums(parts: DataFrame, kind: str) -> DataFrame:
    """Vectors summed by ``id``, as a stream over the sorted rows of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # the id that may go on in the next batch, and its sum
        for b in batches:
            if not b.num_rows:
                continue
            ids, x = b.column("id"), _rows(b.column("vec"))
            code = ids.dictionary_encode().indices.to_numpy()
            begin = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            own, total = ids.take(pa.array(begin)), np.add.reduceat(x, begin)
            if last is not None:
                if last[0][0] == own[0]:
                    total[0] += last[1][0]
                else:
                    yield pa.RecordBatch.from_arrays([last[0], _lists(last[1])], ["id", "vec"])
            if len(own) > 1:
                yield pa.RecordBatch.from_arrays([own.slice(0, len(own) - 1), _lists(total[:-1])], ["id", "vec"])
            last = own.slice(len(own) - 1), total[-1:]
        if last is not None:
            yield pa.RecordBatch.from_arrays([last[0], _lists(last[1])], ["id", "vec"])

    return parts.repartition("id").sortWithinPartitions("id").mapInArrow(run, f"id {kind}, vec array<double>")


def _start(terms: DataFrame, width: int, seed: int) -> DataFrame:
    """A random row per term that depends on its number alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.stack([np.random.default_rng((seed, i)).standard_normal(width) for i in b.column("idx").to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column("idx"), _lists(x)], ["idx", "vec"])

    return terms.select("idx").mapInArrow(run, "idx bigint, vec array<double>")


@dataclass
class BlockModel:
    """As ``lsi.LsiModel``, with its matrix as a table."""

    terms: DataFrame  # term, idx
    v: DataFrame  # idx, vec: rows of the terms x components matrix
    sigma: np.ndarray
    explained_variance: float

    @property
    def k(self) -> int:
        return len(self.sigma)

    def transform(self, weights: DataFrame, normalize: bool = True) -> DataFrame:
        """``doc_id``, ``vec``: X V / sigma, rows of unit length. Documents without known terms
        have no row."""
        scratch = Scratch(weights.sparkSession, "lsi-projection")
        tiles = _Tiles(weights, self.terms, weights.count(), self.k, scratch)
        rows = tiles.times(self.v, np.diag(1 / self.sigma)).select(F.col("doc").alias("doc_id"), "vec")
        if not normalize:
            return rows
        norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
        return rows.withColumn("n", norm).select("doc_id", F.when(F.col("n") > 0, F.transform("vec", lambda x: x / F.col("n"))).otherwise(F.col("vec")).alias("vec"))

    def to_terms(self, vectors: DataFrame, vector: str = "vec", key: str = "doc_id") -> DataFrame:
        """``key``, ``term``, ``weight``: vectors back in term space, c V', for few vectors."""
        of = F.posexplode(F.col("vec")).alias("i", "x")
        parts = self.v.select("idx", of).join(vectors.select(F.col(key).alias("k"), F.posexplode(F.col(vector)).alias("i", "c")), "i")
        return parts.groupBy("k", "idx").agg(F.sum(F.col("x") * F.col("c")).alias("weight")).join(self.terms, "idx").select(F.col("k").alias(key), "term", "weight")


def _times_small(rows: DataFrame, m: np.ndarray, key: str) -> DataFrame:
    """The rows times a small matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(key), _lists(_rows(b.column("vec")) @ m)], [key, "vec"])

    return rows.select(key, "vec").mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, vec array<double>")


def fit(weights: DataFrame, n_docs: int, k: int, seed: int = 42) -> BlockModel:
    """Truncated SVD with ``k`` components of the documents x terms matrix in long form."""
    scratch = Scratch(weights.sparkSession, "lsi")
    per_term = weights.groupBy("term").agg(F.count("*").alias("n"), (F.sum(F.col("weight") ** 2) / n_docs - (F.sum("weight") / n_docs) ** 2).alias("var"))
    terms = scratch.save(indexed(scratch.save(per_term, "frequencies")), "terms")
    n_terms, n_weights, of_terms = terms.agg(F.count("*"), F.sum("n"), F.sum("var")).first()
    if not n_terms:
        raise ValueError("no terms")
    k = min(k, n_terms)
    width = min(n_terms, k + OVERSAMPLE)
    tiles = _Tiles(weights, terms, n_weights, width, scratch)

    basis, through, before = _start(terms, width, seed), None, None
    for _ in range(ITERATIONS):
        y = scratch.save(tiles.times(basis, through), "documents")
        z = scratch.save(tiles.transposed_times(y), "basis")
        triangle = _folded(z, _triangle, _triangle)
        left, values, right = np.linalg.svd(triangle)
        rank = values > 1e-12 * values[0]
        # Z = Q R, so Q with its columns turned by the left vectors is Z times what follows
        basis, through = z, right[rank].T / values[rank]
        scratch.drop(y)
        now = np.sqrt(values[rank][:k])
        if before is not None and len(before) == len(now) and np.abs(now - before).max() <= REST * now[0]:
            break
        before = now
    y = scratch.save(tiles.times(basis, through), "documents")
    told = _folded(y, _gram, np.add)
    small, sums = told[:-1], told[-1]
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(values)[::-1][:k]
    keep = order[values[order] > 1e-12 * max(values.max(), 1e-300)]
    turn = through @ vectors[:, keep]
    most, least = _folded(_times_small(basis, turn, "idx"), _extremes, lambda a, b: np.stack([np.maximum(a[0], b[0]), np.minimum(a[1], b[1])]))
    signs = np.where(-least > most, -1.0, 1.0)  # a fixed sign, as the greatest entry has it
    v = scratch.save(_times_small(basis, turn * signs, "idx"), "components")
    sigma, means = np.sqrt(values[keep]), (sums @ vectors[:, keep]) / n_docs
    explained = float(np.sum(np.square(sigma) / n_docs - np.square(means)) / of_terms) if of_terms else 0.0
    return BlockModel(terms.select("term", "idx"), v, sigma, explained)
