"""Exact nearest neighbours of each category, by blocks with bounds, on the executors.

Training vectors are scaled to length one, ordered by category and by the nearest of some sampled
centers, and cut into blocks of one category. Of a block, the mean and the greatest distance from
it are kept, so no vector in it can be nearer to a query than their sum allows. That is all that is
broadcast; the number of blocks is bounded, whatever the number of vectors.

Each query first meets the most promising block of each category, which gives it a score to beat, and
then those other blocks whose bound reaches that score. The vectors of a block and the queries that
have come to it meet in one task; a block that very many queries come to is met in several chunks.
Nothing is approximate: a block is left out only if it cannot hold the nearest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.plans.scratch import Scratch

#: Rows of a block, as long as there are not too many blocks.
BLOCK_ROWS = 2048
#: Blocks that whole training sets are cut into, about; beyond this, blocks grow.
MAX_BLOCKS = 16_384
#: Sampled centers that rows are ordered by.
CELLS = 256
#: Queries that meet a block in one task.
CHUNK = 16_384
#: Numbers that a task holds at once for scores, and that may be broadcast.
VALUES = 4_000_000
BROADCAST_VALUES = 32_000_000
#: Numbers of a training set that goes to all tasks whole.
SMALL_VALUES = 500_000
#: Scores are compared after rounding, bounds with a margin beyond it.
DIGITS, MARGIN = 12, 1e-9


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))


class Blocks:
    """Categories, means and radii of all blocks; tells where a query has to look."""

    def __init__(self, rows: list[tuple[int, str | None, list[float], float]]):
        rows = sorted(rows, key=lambda r: r[0])
        self.block = np.array([r[0] for r in rows], np.int64)
        self.names = sorted({r[1] for r in rows}, key=lambda c: (c is not None, c or ""))
        number = {c: i for i, c in enumerate(self.names)}
        self.category = np.array([number[r[1]] for r in rows], np.int64)
        self.mean = np.array([r[2] for r in rows], float)
        self.radius = np.array([r[3] for r in rows], float)

    def _bounds(self, q: np.ndarray) -> np.ndarray:
        return q @ self.mean.T + np.linalg.norm(q, axis=1)[:, None] * self.radius + MARGIN

    def step(self, width: int) -> int:
        """Queries that are compared to the blocks at once."""
        return max(1, VALUES // max(2 * len(self.block), len(self.names) * width))

    def first(self, q: np.ndarray) -> np.ndarray:
        """Places of the blocks with the highest bound of each category, a row per query."""
        bounds = self._bounds(q)
        return np.stack([(own := np.flatnonzero(self.category == c))[bounds[:, own].argmax(axis=1)] for c in range(len(self.names))], axis=1)

    def others(self, q: np.ndarray, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries and places of all further blocks whose bound reaches the floor of the category."""
        able = self._bounds(q) >= floors[:, self.category]
        np.put_along_axis(able, self.first(q), False, axis=1)
        return np.nonzero(able)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _prepared(rows: DataFrame, vector: str, *more: str) -> DataFrame:
    """Ids, further columns and vectors as doubles; rows without a vector are left out."""
    return rows.select("doc_id", *[F.col(c).cast("string").alias(c) for c in more], F.col(vector).cast("array<double>").alias("v")).where("v is not null")


def _cut(train: DataFrame, n: int, width: int, scratch: Scratch) -> DataFrame:
    """``block``, ``category``, ``doc_id`` and the unit vector ``v`` of all training rows, written."""
    size = max(BLOCK_ROWS, -(-n // MAX_BLOCKS))
    cells = max(1, min(CELLS, n // size, VALUES // width))
    sample = train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(cells).select("v").collect()  # at most CELLS vectors
    centers = _unit(np.array([r["v"] for r in sample], float))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _unit(_matrix(b.column("v"), width))
                cell = (x @ centers.T).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("category"), pa.array(cell), b.column("doc_id"), _lists(x)], ["category", "cell", "doc_id", "v"])

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, last = TaskContext.get().partitionId() << 33, 0, None
        for b in batches:
            numbers = np.empty(b.num_rows, np.int64)
            for i, here in enumerate(zip(b.column("category").to_pylist(), b.column("cell").to_pylist(), strict=True)):
                other = last is not None and (here[0] != last[0] or held >= size or (here[1] != last[1] and held >= size // 4))
                block, held, last = block + other, 1 if other else held + 1, here
                numbers[i] = block
            yield pa.RecordBatch.from_arrays([pa.array(numbers), b.column("category"), b.column("doc_id"), b.column("v")], ["block", "category", "doc_id", "v"])

    kind = train.schema["doc_id"].dataType.simpleString()
    placed = train.mapInArrow(assigned, f"category string, cell int, doc_id {kind}, v array<double>")
    order = ["category", "cell", "doc_id"]
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    return scratch.save(placed.mapInArrow(blocked, f"block bigint, category string, doc_id {kind}, v array<double>"), "train")


def _blocks(train: DataFrame, n_categories: int, width: int) -> Blocks:
    """Means and radii by two passes, each summed within the tasks first."""
    if (2 * n_categories + 4 * MAX_BLOCKS) * width > BROADCAST_VALUES:
        raise ValueError(f"{n_categories} categories of {width} numbers are too many to tell every task")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                block, x = b.column("block").to_numpy(), _matrix(b.column("v"), width)
                begin = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
                yield pa.RecordBatch.from_arrays([pa.array(block[begin]), b.column("category").take(pa.array(begin)), pa.array(np.diff(np.append(begin, len(block)))), _lists(np.add.reduceat(x, begin))], ["block", "category", "n", "s"])

    parts = train.mapInArrow(sums, "block bigint, category string, n bigint, s array<double>")
    means = parts.groupBy("block").agg(F.first("category").alias("category"), F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width)]) if width <= 64 else None
    if means is not None:
        rows = means.select("block", "category", F.array(*[F.col(f"s{i}") / F.col("n") for i in range(width)]).alias("mean")).collect()
    else:
        told = parts.select("block", "category", "n", F.posexplode("s").alias("i", "x")).groupBy("block", "i").agg(F.first("category").alias("category"), (F.sum("x") / F.sum("n")).alias("m"))
        rows = told.groupBy("block").agg(F.first("category").alias("category"), F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean")).collect()
    mean = train.sparkSession.sparkContext.broadcast({r["block"]: np.array(r["mean"]) for r in rows})

    def radii(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                block, x = b.column("block").to_numpy(), _matrix(b.column("v"), width)
                own, at = np.unique(block, return_inverse=True)
                far = np.linalg.norm(x - np.stack([mean.value[k] for k in own.tolist()])[at], axis=1)
                most = np.zeros(len(own))
                np.maximum.at(most, at, far)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(most)], ["block", "r"])

    radius = {r["block"]: r["r"] for r in train.mapInArrow(radii, "block bigint, r double").groupBy("block").agg(F.max("r").alias("r")).collect()}
    mean.unpersist()
    return Blocks([(r["block"], r["category"], r["mean"], radius[r["block"]]) for r in rows])


def _first_visits(queries: DataFrame, told: Broadcast[Blocks], width: int) -> DataFrame:
    """``block``, ``doc_id``, ``v``: each query at its most promising block of each category."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = told.value
        step = blocks.step(width)
        for b in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            x = _unit(_matrix(b.column("v"), width))
            at = blocks.first(x)
            who = np.repeat(np.arange(b.num_rows), at.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(blocks.block[at.ravel()]), b.column("doc_id").take(pa.array(who)), _lists(x[who])], ["block", "doc_id", "v"])

    return queries.mapInArrow(run, f"block bigint, doc_id {queries.schema['doc_id'].dataType.simpleString()}, v array<double>")


def _further_visits(queries: DataFrame, told: Broadcast[Blocks], width: int) -> DataFrame:
    """The same at all other blocks that can hold a nearer vector than ``floors`` (category, score)
    of the query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = told.value
        step = blocks.step(width)
        number = {c: i for i, c in enumerate(blocks.names)}
        for b in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            x = _unit(_matrix(b.column("v"), width))
            floors = np.full((b.num_rows, len(number)), -np.inf)
            for i, known in enumerate(b.column("floors").to_pylist()):
                for f in known or ():
                    floors[i, number[f["category"]]] = f["score"]
            who, at = blocks.others(x, floors)
            most = max(1, VALUES // width)
            for i in range(0, len(who), most):
                some, there = who[i : i + most], at[i : i + most]
                yield pa.RecordBatch.from_arrays([pa.array(blocks.block[there]), b.column("doc_id").take(pa.array(some)), _lists(x[some])], ["block", "doc_id", "v"])

    return queries.mapInArrow(run, f"block bigint, doc_id {queries.schema['doc_id'].dataType.simpleString()}, v array<double>")


def _met(visits: DataFrame, train: DataFrame, width: int, others_only: bool, scratch: Scratch) -> DataFrame:
    """Of each visit the nearest row of the block: ``doc_id``, ``category``, ``score``, ``nn_doc_id``."""
    visits = scratch.save(visits, "visits")
    chunks = scratch.save(visits.groupBy("block").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")), "chunks", narrow=True)  # a row per block
    dealt = visits.join(chunks, "block").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks").cast("long")).cast("int"))
    copies = train.join(chunks, "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))

    def meet(there: pa.Table, asked: pa.Table) -> pa.Table:
        if not there.num_rows or not asked.num_rows:
            return there.slice(0, 0).select(["doc_id", "category"]).append_column("score", pa.array([], pa.float64())).append_column("nn_doc_id", pa.array([], there.column("doc_id").type))
        there = there.sort_by("doc_id")  # of equal scores the first is the least id
        ids, y = there.column("doc_id"), _matrix(there.column("v"), width)
        step, found = max(1, VALUES // there.num_rows), []
        for i in range(0, asked.num_rows, step):
            own = asked.slice(i, step)
            s = np.round(_matrix(own.column("v"), width) @ y.T, DIGITS)
            if others_only:
                s[own.column("doc_id").to_numpy()[:, None] == ids.to_numpy()[None, :]] = -np.inf
            j = s.argmax(axis=1)
            best = s[np.arange(len(s)), j]
            some = np.flatnonzero(np.isfinite(best))
            at = pa.array(j[some])
            found.append(pa.table([own.column("doc_id").take(pa.array(some)), there.column("category").take(at), best[some], ids.take(at)], names=["doc_id", "category", "score", "nn_doc_id"]))
        return pa.concat_tables(found)

    own, nearest = visits.schema["doc_id"].dataType.simpleString(), train.schema["doc_id"].dataType.simpleString()
    pairs = copies.select("block", "chunk", "category", "doc_id", "v").groupBy("block", "chunk").cogroup(dealt.select("block", "chunk", "doc_id", "v").groupBy("block", "chunk"))
    return scratch.save(pairs.applyInArrow(meet, f"doc_id {own}, category string, score double, nn_doc_id {nearest}"), "met", narrow=True)


def _with_all(asked: DataFrame, known: DataFrame, width: int, others_only: bool) -> DataFrame:
    """Each query against a training set of at most ``SMALL_VALUES`` numbers, in one pass."""
    rows = known.toArrow()
    rows = rows.take(pa.compute.sort_indices(rows, sort_keys=[("category", "ascending"), ("doc_id", "ascending")]))
    names = rows.column("category").to_pylist()
    begin = [i for i in range(len(names)) if not i or names[i] != names[i - 1]]
    groups = [(names[a], rows.column("doc_id").slice(a, b - a).combine_chunks(), _unit(_matrix(rows.column("v").slice(a, b - a), width))) for a, b in zip(begin, [*begin[1:], len(names)], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, VALUES // len(names))
        for b in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            x, own = _unit(_matrix(b.column("v"), width)), b.column("doc_id")
            for name, ids, y in groups:
                s = np.round(x @ y.T, DIGITS)
                if others_only:
                    s[own.to_numpy()[:, None] == ids.to_numpy()[None, :]] = -np.inf
                j = s.argmax(axis=1)
                best = s[np.arange(len(s)), j]
                some = np.flatnonzero(np.isfinite(best))
                yield pa.RecordBatch.from_arrays([own.take(pa.array(some)), pa.array([name] * len(some), pa.string()), pa.array(best[some]), ids.take(pa.array(j[some]))], ["doc_id", "category", "score", "nn_doc_id"])

    own, there = (d.schema["doc_id"].dataType.simpleString() for d in (asked, known))
    return asked.mapInArrow(run, f"doc_id {own}, category string, score double, nn_doc_id {there}")


def nearest(queries: DataFrame, train: DataFrame, vector: str = "vec", others_only: bool = False) -> DataFrame:
    """Per query and category: ``doc_id``, ``category``, ``score`` (best cosine) and ``nn_doc_id``, the
    least id of the best. ``train`` has doc_id, category and the vector; a vector of norm 0 has
    cosine 0 with all. With ``others_only`` rows with the query's own id do not count. Rows without
    a vector are left out. A training set of few numbers goes to all tasks; any other is met in
    blocks, where rows of one id are one query."""
    spark: SparkSession = train.sparkSession
    scratch = Scratch(spark, "nearest")
    asked, known = _prepared(queries, vector), _prepared(train, vector, "category")
    n, width, n_categories = known.agg(F.count("*"), F.max(F.size("v")), F.count_distinct("category")).first()
    if n and n * width <= SMALL_VALUES:
        return _with_all(asked, known, width, others_only)
    if not n:
        return spark.createDataFrame([], f"doc_id {queries.schema['doc_id'].dataType.simpleString()}, category string, score double, nn_doc_id {train.schema['doc_id'].dataType.simpleString()}")
    rows = _cut(known, n, width, scratch)
    told = spark.sparkContext.broadcast(_blocks(rows, n_categories, width))
    first = _met(_first_visits(asked, told, width), rows, width, others_only, scratch)
    floors = first.groupBy("doc_id", "category").agg(F.max("score").alias("score")).groupBy(F.col("doc_id").alias("of")).agg(F.collect_list(F.struct("category", "score")).alias("floors"))
    beaten = asked.join(floors, asked["doc_id"].eqNullSafe(floors["of"]), "left").select("doc_id", "v", "floors")
    further = _met(_further_visits(beaten, told, width), rows, width, others_only, scratch)
    best = F.min_by(F.col("nn_doc_id"), F.struct(-F.col("score"), F.col("nn_doc_id"))).alias("nn_doc_id")
    return first.unionByName(further).groupBy("doc_id", "category").agg(F.max("score").alias("score"), best).select("doc_id", "category", "score", "nn_doc_id")
