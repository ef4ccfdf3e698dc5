"""A Merkle manifest of a dataset: leaf, root, proof and verification of every row.

A leaf is the digest of a row's columns. The leaves of each language, ascending by id, make a tree
where eight consecutive nodes have one parent; the roots of the languages make the tree above them.
Rows are numbered within their language over range partitions. Blocks of up to ``8 ** LEVELS`` leaves
are reduced by one task each, and again while more than ``TOP`` nodes are left, so that what remains
is small whatever the input: the driver builds the top of the tree from it and broadcasts it. Tasks
read the suffix of their block's path from there, make the proofs of the leaves below and fold
each row, tampered or not, up to a root of its own. A hot language is many blocks.

Defined results: a null column counts as ``-``; rows without language are a language of their own
and come first; rows without id come first in theirs, and rows of one id go by their leaf, so
repeated rows are leaves beside each other; a row without id is not tampered with. An empty table has
no rows and no root. Other columns are not read, and very long texts are digested in place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from quillspark.plans.scratch import Scratch

ARITY_BITS = 3
ARITY = 1 << ARITY_BITS
#: Levels of a block: at most 4096 nodes in a task.
LEVELS = 4
#: Nodes that the driver may build the top from.
TOP = 512
#: Languages have a root each on the driver; more than this is no label.
MAX_KEYS = 200_000
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Path = list[tuple[str, str]]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*columns: Column) -> Column:
    """The digest of the columns, each ``-`` or its bytes, ``:`` and itself."""
    told = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (c.cast("string") for c in columns)]
    return F.sha2(F.concat(*told).cast("binary"), 256)


def tree(nodes: Sequence[str], most: int | None = None) -> list[list[str]]:
    """The levels over ``nodes`` until one is left; exactly ``most`` levels more if given."""
    out = [list(nodes)]
    while len(out) <= most if most is not None else len(out[-1]) > 1:
        below = out[-1]
        out.append([digest("".join(below[i : i + ARITY])) for i in range(0, len(below), ARITY)])
    return out


def path(levels: Sequence[Sequence[str]], i: int) -> Path:
    """What stands left and right of node i and its ancestors among the children of one parent."""
    out = []
    for nodes in levels[:-1]:
        first = i & ~(ARITY - 1)
        out.append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + ARITY])))
        i >>= ARITY_BITS
    return out


def fold(node: str, way: Path) -> str:
    """The root that a node and the siblings of its path give."""
    for left, right in way:
        node = digest(left + node + right)
    return node


class Top:
    """What the driver knows: the upper tree of each language, and the tree over all of them."""

    def __init__(self, blocks: Sequence[tuple[str, int, str, str]]):
        nodes: dict[str, list[tuple[int, str, str]]] = {}
        for key, block, root, tip in blocks:
            nodes.setdefault(key, []).append((block, root, tip))
        self.keys = sorted(nodes, key=lambda k: k.encode())
        self._at = {k: i for i, k in enumerate(self.keys)}
        # the only block of a language ends at its tip, where one node is left
        self.upper = {k: tree([b[1] for b in sorted(v)] if len(v) > 1 else [v[0][2]]) for k, v in nodes.items()}
        self.single = {k for k, v in nodes.items() if len(v) == 1}
        self.over = tree([self.upper[k][-1][0] for k in self.keys])
        self.root = self.over[-1][0]

    def subroot(self, key: str) -> str:
        return self.upper[key][-1][0]

    def suffix(self, key: str, block: int) -> Path:
        return path(self.upper[key], block) + path(self.over, self._at[key])


def _leaves(docs: DataFrame) -> DataFrame:
    """``key`` (of the language), ``doc_id``, ``leaf`` and, of a row that is tampered with, the leaf
    it then has."""
    known = [F.col(f"`{c}`") for c in COLUMNS]
    lowered = F.translate(known[-1].cast("string"), _UPPER, _LOWER)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return docs.select(
        F.coalesce(F.concat(F.lit("+"), F.col("lang").cast("string")), F.lit("")).alias("key"),
        "doc_id",
        leaf(*known).alias("leaf"),
        F.when(tampered, leaf(*known[:-1], lowered)).alias("changed"),
    )


def _placed(leaves: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """The leaves with ``pos``, their number within their language, and how many they are."""
    order = ["key", F.col("doc_id").asc_nulls_first(), "leaf"]
    spread = leaves.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    laid = scratch.save(spread.select("key", "doc_id", "leaf", "changed", F.shiftright("id", 33).alias("part"), F.col("id").bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "leaves")
    runs = scratch.save(laid.groupBy("part", "key").agg(F.count("*").alias("n"), F.min("place").alias("begin")), "runs", narrow=True)
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    starts = runs.select("part", "key", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("begin")).alias("start"))
    total, keys = runs.agg(F.sum("n"), F.count_distinct("key")).first()
    if keys > MAX_KEYS:
        raise ValueError(f"{keys} languages: more than {MAX_KEYS} are no labels")
    return laid.join(starts, ["part", "key"]).select("key", (F.col("place") + F.col("start")).alias("pos"), "doc_id", "leaf", F.col("leaf").alias("tip"), "changed"), total or 0


def _levels_for(n: int) -> int:
    """Levels of the blocks over n nodes: no more than leave ``TOP`` nodes."""
    k = 0
    while k < LEVELS and n >> (ARITY_BITS * k) > TOP:
        k += 1
    return max(k, 1)


def _dealt(nodes: DataFrame, k: int) -> GroupedData:
    return nodes.withColumn("block", F.shiftright("pos", ARITY_BITS * k)).groupBy("key", "block")


def _blocks(nodes: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """``key``, ``pos`` (number of the block), ``leaf`` (its node ``k`` levels up) and ``tip`` (its
    node on the first level where it has but one). The only node of a language stands for its tip."""

    def reduce(group: tuple, rows: pa.Table) -> pa.Table:
        key, block = (x.as_py() for x in group)
        only = rows.num_rows == 1 and block == 0
        levels = tree(rows.sort_by("pos").column("tip" if only else "leaf").to_pylist(), k)
        tip = next(nodes[0] for nodes in levels if len(nodes) == 1)
        return pa.table({"key": [key], "pos": [block], "leaf": [levels[-1][0]], "tip": [tip]})

    blocks = _dealt(nodes.select("key", "pos", "leaf", "tip"), k).applyInArrow(reduce, "key string, pos bigint, leaf string, tip string")
    return scratch.save(blocks, "blocks", narrow=True)


def _ways(nodes: list[str], k: int, alone: bool, suffix: Path) -> list[Path]:
    """The whole path of each node of a block: up to its last node if the language has no other
    block, else ``k`` levels, and on from there."""
    levels = tree(nodes) if alone else tree(nodes, k)
    return [path(levels, i) + suffix for i in range(len(nodes))]


def manifest(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and
    ``verified``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "merkle")
    nodes, n = _placed(scratch.save(_leaves(docs), "digests"), scratch)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if not n:
        return spark.createDataFrame([], schema)

    rounds = [(nodes, _levels_for(n))]
    while True:
        blocks = _blocks(*rounds[-1], scratch)
        left, last = blocks.agg(F.count("*"), F.max("pos")).first()
        if left <= TOP or not last:  # or no language has more than one block
            break
        rounds.append((blocks, _levels_for(left)))
    top = Top([tuple(r) for r in blocks.select("key", "pos", "leaf", "tip").collect()])  # TOP nodes, or one a language
    told = spark.sparkContext.broadcast(top)

    def finished(key: str, rows: pa.Table, k: int, suffix: Path, alone: bool) -> pa.Table:
        top, rows = told.value, rows.sort_by("pos")
        leaves = rows.column("leaf").to_pylist()
        ways = _ways(leaves, k, alone, suffix)
        roots = [fold(c or x, w) for c, x, w in zip(rows.column("changed").to_pylist(), leaves, ways, strict=True)]
        proofs = [digest("".join(a + b for a, b in w)) for w in ways]
        same = [[x] * len(leaves) for x in (top.subroot(key), top.root)]
        return pa.table([rows.column("doc_id"), leaves, *same, proofs, roots, [r == top.root for r in roots]], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    (below, k), above = rounds[0], rounds[1:]
    if not above:

        def finish(group: tuple, rows: pa.Table) -> pa.Table:
            key, block = (x.as_py() for x in group)
            return finished(key, rows, k, told.value.suffix(key, block), key in told.value.single)

        return _dealt(below, k).applyInArrow(finish, schema)

    def finish_below(group: tuple, rows: pa.Table, way: pa.Table) -> pa.Table:
        return finished(group[0].as_py(), rows, k, *_suffix(way))

    return _dealt(below, k).cogroup(_paths_above(above, told, scratch).groupBy("key", "pos")).applyInArrow(finish_below, schema)


_WAY = "key string, pos bigint, alone boolean, lefts array<string>, rights array<string>"


def _suffix(way: pa.Table) -> tuple[Path, bool]:
    row = way.slice(0, 1).to_pylist()[0]
    return list(zip(row["lefts"], row["rights"], strict=True)), row["alone"]


def _paths_above(above: list[tuple[DataFrame, int]], told: Broadcast[Top], scratch: Scratch) -> DataFrame:
    """The path of each node of the round above the leaves, from the top down: ``key``, ``pos``,
    ``alone`` (its language has no other node there), ``lefts`` and ``rights``."""

    def told_on(key: str, rows: pa.Table, k: int, suffix: Path, alone: bool) -> pa.Table:
        rows = rows.sort_by("pos")
        only = alone and rows.num_rows == 1  # it ended at its tip further down
        ways = [suffix] if only else _ways(rows.column("leaf").to_pylist(), k, alone, suffix)
        n, texts = rows.num_rows, pa.list_(pa.string())
        columns = [[key] * n, rows.column("pos"), [only] * n, *(pa.array([[x[j] for x in w] for w in ways], texts) for j in (0, 1))]
        return pa.table(columns, names=["key", "pos", "alone", "lefts", "rights"])

    def from_top(nodes: DataFrame, k: int) -> DataFrame:
        def spread(group: tuple, rows: pa.Table) -> pa.Table:
            key, block = (x.as_py() for x in group)
            return told_on(key, rows, k, told.value.suffix(key, block), key in told.value.single)

        return _dealt(nodes, k).applyInArrow(spread, _WAY)

    def from_ways(nodes: DataFrame, k: int, ways: DataFrame) -> DataFrame:
        def spread(group: tuple, rows: pa.Table, way: pa.Table) -> pa.Table:
            return told_on(group[0].as_py(), rows, k, *_suffix(way))

        return _dealt(nodes, k).cogroup(ways.groupBy("key", "pos")).applyInArrow(spread, _WAY)

    ways = scratch.save(from_top(*above[-1]), "ways")
    for nodes, k in reversed(above[:-1]):
        ways = scratch.save(from_ways(nodes, k, ways), "ways")
    return ways
