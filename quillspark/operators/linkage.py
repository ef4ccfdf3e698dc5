"""DBSCAN without pairs of points: counts and spanning forests of blocks.

Every vector lives in the cell of its nearest pivot and visits each cell whose pivot is at most two
reaches farther away, so whatever is within reach of a vector comes to where it lives. Cells are
dealt into pairs of blocks that a task compares by a matrix product, but no task tells which pairs are
near:

* Points of one block within half a reach of a leader are a ball; all of them are within reach of
  each other. Those of a ball of enough points are core points at once. Of the others each block
  pair gives the number of points in reach, one row a point.
* Core points of a ball are one node. Of the links between nodes a block pair gives a spanning
  forest: no more rows than it has nodes, and points that are all within reach are few nodes.
* A point that is no core gets the least core in reach from each block pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.components import connected_components
from quillspark.plans.scratch import Scratch

#: Cells at most, and blocks of points that a cell is for at least: fewer points need no cells.
PIVOTS, BLOCKS_OF_CELL = 64, 4
#: Cells that a pivot itself would visit, in the mean, beyond which there is one cell only.
VISITS = 8
#: Points of a block that leaders gather into balls, of a block of pairs, and of the part of such a
#: block that is compared at once: near points, few enough for the processor's cache. Every point travels once for each block that it is compared with.
BALLS, BLOCK, TILE = 1024, 32_768, 512
#: Distances by a matrix product are this near; closer calls are settled by the difference.
BLUR, EXACT = 1e-9, 1e-12

Told = Callable[[pa.Table, pa.Table, np.ndarray], pa.Table]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)


def _near(x: np.ndarray, y: np.ndarray, reach: float) -> np.ndarray:
    """Which rows are within reach of which, exactly."""
    d = _squares(x, y) - reach * reach
    near = d <= -BLUR
    i, j = np.nonzero(np.abs(d) < BLUR)
    near[i, j] = ((x[i] - y[j]) ** 2).sum(1) <= reach * reach + EXACT
    return near


def _cells(points: DataFrame, n: int, reach: float, scratch: Scratch) -> DataFrame:
    """``cell``, ``home``, ``point``, ``n``, ``v``: every point in each cell that it lives in or visits."""
    n_pivots = max(1, min(PIVOTS, n // (BLOCKS_OF_CELL * min(BALLS, BLOCK))))
    chosen = points.orderBy(F.xxhash64("point"), "point").limit(n_pivots).select("vec").collect()
    pivots = np.array([r["vec"] for r in chosen], float)
    if (_squares(pivots, pivots) <= (2 * reach) ** 2).sum(1).mean() > VISITS:
        pivots = pivots[:1]  # nearly every point would be written for nearly every cell

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            d = np.sqrt(_squares(_matrix(pa.chunked_array([b.column("vec")])), pivots))
            home = d.argmin(axis=1)
            row, cell = np.nonzero(d <= d.min(axis=1, keepdims=True) + 2 * reach + BLUR)
            at = pa.array(row)
            columns = [pa.array(cell, pa.int32()), pa.array(home[row] == cell), *(b.column(c).take(at) for c in ("point", "n", "vec"))]
            yield pa.RecordBatch.from_arrays(columns, ["cell", "home", "point", "n", "v"])

    kind = points.schema["point"].dataType.simpleString()
    return scratch.save(points.select("point", "n", "vec").mapInArrow(deal, f"cell int, home boolean, point {kind}, n bigint, v array<double>"), "cells")


def _balls(cells: DataFrame, reach: float) -> DataFrame:
    """``point``, ``ball`` (its leader) and ``held`` (points of the ball, copies counted)."""

    def gather(_key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("point")
        x, n = _matrix(rows.column("v")), rows.column("n").to_numpy()
        leader, free = np.full(len(x), -1), np.ones(len(x), bool)
        for k in range(len(x)):
            if free[k]:
                own = free & (((x - x[k]) ** 2).sum(1) <= max(reach * reach / 4 - BLUR, 0))
                own[k] = True
                leader[own], free = k, free & ~own
        held = np.bincount(leader, weights=n, minlength=len(x)).astype(np.int64)
        return pa.table({"point": rows.column("point"), "ball": rows.column("point").take(pa.array(leader)), "held": held[leader]})

    homes = cells.where("home")
    blocks = homes.groupBy("cell").agg(F.ceil(F.count("*") / BALLS).alias("blocks"))
    dealt = homes.join(blocks, "cell").withColumn("h", F.pmod(F.xxhash64("point"), F.col("blocks")))
    kind = cells.schema["point"].dataType.simpleString()
    return dealt.select("cell", "h", "point", "n", "v").groupBy("cell", "h").applyInArrow(gather, f"point {kind}, ball {kind}, held bigint")


def _tiles(x: np.ndarray) -> list[np.ndarray]:
    """Places of rows in tiles: halves by the coordinate that varies most, again and again."""
    done, rest = [], [np.arange(len(x))]
    while rest:
        at = rest.pop()
        if len(at) <= TILE:
            done.append(at)
            continue
        axis = x[at].var(axis=0).argmax()
        at = at[np.argpartition(x[at, axis], len(at) // 2)]
        rest += [at[: len(at) // 2], at[len(at) // 2 :]]
    return done


def _told(here: pa.Table, there: pa.Table, reach: float, tell: Told) -> list[pa.Table]:
    """What is told of two blocks, tile by tile. Tiles whose boxes are more than the reach apart have no
    near points."""
    out, x, y = [], _matrix(here.column("v")), _matrix(there.column("v"))
    here, there, others = here.drop_columns("v"), there.drop_columns("v"), _tiles(y)
    low, high = (np.stack([f(y[j], 0) for j in others]) for f in (np.min, np.max))
    for i in _tiles(x):
        apart = np.maximum(np.maximum(low - x[i].max(0), x[i].min(0) - high), 0)
        own = here.take(pa.array(i)).combine_chunks()
        for k in np.flatnonzero((apart * apart).sum(1) <= reach * reach + BLUR):
            near = _near(x[i], y[others[k]], reach)
            if near.any():
                out.append(tell(own, there.take(pa.array(others[k])).combine_chunks(), near))
    return out or [tell(here.slice(0, 0), there.slice(0, 0), np.zeros((0, 0), bool))]


def _compared(homes: DataFrame, visits: DataFrame, reach: float, tell: Told, schema: str) -> DataFrame:
    """What ``tell`` says of every block of points that live in a cell, every block of points that
    come to it, and which of them are within reach. Both have cell, point and v, and more."""
    sizes = lambda rows, name: rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    blocks = sizes(homes, "hs").join(sizes(visits, "ks"), "cell")
    own = lambda n: F.pmod(F.xxhash64("point"), F.col(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = homes.join(blocks, "cell").withColumn("h", own("hs")).withColumn("k", every("ks")).drop("hs", "ks")
    y = visits.join(blocks, "cell").withColumn("k", own("ks")).withColumn("h", every("hs")).drop("hs", "ks")

    y = y.select(*[F.col(c).alias(c) for c in y.columns])  # both may come from one table

    def compare(here: pa.Table, there: pa.Table) -> pa.Table:
        if not here.num_rows or not there.num_rows:
            return tell(here.slice(0, 0), there.slice(0, 0), np.zeros((0, 0), bool))
        return pa.concat_tables(_told(here, there, reach, tell))

    return x.groupBy("cell", "h", "k").cogroup(y.groupBy("cell", "h", "k")).applyInArrow(compare, schema)


def _counts(here: pa.Table, there: pa.Table, near: np.ndarray) -> pa.Table:
    """Points in reach, copies counted, itself included."""
    i, j = np.nonzero(near)
    around = np.bincount(i, there.column("n").to_numpy()[j], here.num_rows).astype(np.int64)
    return pa.table({"point": here.column("point"), "around": around})


def _forest(here: pa.Table, there: pa.Table, near: np.ndarray) -> pa.Table:
    """Each node that is linked to another one, with the least node that it is connected to here."""
    nodes = pa.chunked_array([*here.column("node").chunks, *there.column("node").chunks], here.column("node").type).dictionary_encode().combine_chunks()
    code, names = nodes.indices.to_numpy(), nodes.dictionary
    order = np.argsort(pa.compute.sort_indices(names).to_numpy()) if len(names) else np.zeros(0, np.int64)
    code = order[code]  # nodes by rank, so that the least number is the least node
    a, b = code[: here.num_rows], code[here.num_rows :]
    root = np.arange(len(names))
    i, j = np.nonzero(near)
    links = np.unique((a[i] * len(names) + b[j])[a[i] != b[j]])
    i, j = np.divmod(links, max(len(names), 1))
    i, j = np.concatenate([i, j]), np.concatenate([j, i])
    while len(i):
        before = root.copy()
        np.minimum.at(root, i, root[j])
        root = root[root]
        if (root == before).all():
            break
    some = np.flatnonzero(root < np.arange(len(names)))
    by_rank = names.take(pa.compute.sort_indices(names)) if len(names) else names
    return pa.table({"a": by_rank.take(pa.array(some)), "b": by_rank.take(pa.array(root[some]))})


def _least(here: pa.Table, there: pa.Table, near: np.ndarray) -> pa.Table:
    """The least point that is in reach, where there is one."""
    order = pa.compute.sort_indices(there.column("point"))
    near = near[:, order.to_numpy()] if here.num_rows else near
    some = np.flatnonzero(near.any(axis=1)) if here.num_rows else np.zeros(0, np.int64)
    first = near[some].argmax(axis=1) if len(some) else some
    return pa.table({"point": here.column("point").take(pa.array(some)), "core": there.column("point").take(order).take(pa.array(first))})


def dbscan(vectors: DataFrame, reach: float, min_samples: int = 10, vector: str = "vec") -> DataFrame:
    """``doc_id``, ``cluster_id`` (least core id; -1 for noise) by Euclidean distance. Equal vectors are
    one point that counts as often as it occurs; rows without a vector are noise."""
    scratch = Scratch(vectors.sparkSession, "dbscan")
    kind = vectors.schema["doc_id"].dataType.simpleString()
    rows = vectors.select("doc_id", F.col(vector).cast("array<double>").alias("vec")).withColumn("h", F.sha2(F.to_json(F.struct("vec")), 256))
    known = rows.where("vec is not null")
    points = scratch.save(known.groupBy("h").agg(F.min("doc_id").alias("point"), F.count("*").alias("n"), F.min_by("vec", "doc_id").alias("vec")), "points")
    of_point = scratch.save(rows.select("doc_id", "h").join(points.select("h", "point"), "h", "left").select("doc_id", "point"), "members")
    n = points.count()
    if not n:
        return rows.select("doc_id", F.lit(-1).cast(kind).alias("cluster_id"))
    cells = _cells(points, n, reach, scratch)
    balls = scratch.save(_balls(cells, reach), "balls")

    few = balls.where(F.col("held") < min_samples).select("point")
    counted = _compared(cells.where("home").join(few, "point", "left_semi").select("cell", "point", "v"), cells.select("cell", "point", "n", "v"), reach, _counts, f"point {kind}, around bigint")
    sparse = counted.groupBy("point").agg(F.sum("around").alias("around")).where(F.col("around") >= min_samples).select("point")
    core = scratch.save(balls.where(F.col("held") >= min_samples).select("point", F.col("ball").alias("node")).unionByName(balls.join(sparse, "point", "left_semi").select("point", F.col("ball").alias("node"))), "core")

    placed = scratch.save(cells.join(core, "point").select("cell", "home", "point", "node", "v"), "placed")
    links = scratch.save(_compared(placed.where("home").drop("home"), placed.drop("home"), reach, _forest, f"a {kind}, b {kind}").distinct(), "links")
    joined = connected_components(links, scratch)
    grouped = core.join(joined, core["node"] == joined["node"], "left").select("point", F.coalesce("label", core["node"]).alias("label"))
    named = grouped.groupBy(F.col("label").alias("of")).agg(F.min("point").alias("cluster_id"))
    labelled = scratch.save(grouped.join(named, F.col("label") == F.col("of")).select("point", "cluster_id"), "labels")

    rest = cells.where("home").join(core.select("point"), "point", "left_anti").select("cell", "point", "v")
    border = _compared(rest, placed.select("cell", "point", "v"), reach, _least, f"point {kind}, core {kind}").groupBy("point").agg(F.min("core").alias("core"))
    bordering = border.join(labelled.select(F.col("point").alias("core"), "cluster_id"), "core").select("point", "cluster_id")
    found = scratch.save(labelled.unionByName(bordering), "found")
    return of_point.join(found, "point", "left").select("doc_id", F.coalesce("cluster_id", F.lit(-1).cast(kind)).alias("cluster_id"))
