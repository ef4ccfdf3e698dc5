"""Birch: clustering features in a height-balanced tree (Zhang, Ramakrishnan, Livny 1996).

The exact tree depends on the order of insertion, so it is sequential. ``fit_tree`` builds
it for data that fits one process. ``fit_distributed`` lets each partition condense its rows to
leaf features; features are mergeable, so groups of partitions merge theirs into one tree, and
groups of these, until one is left. A tree that outgrows its bound is built anew from its leaves with
a higher threshold, so every step has bounded memory. Features, nodes and paths stay in tables; the
last tree is built by one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from quillspark.plans.scratch import Scratch

#: Leaf features that a tree may keep, and bytes of their vectors.
MAX_FEATURES, MAX_BYTES = 20_000, 256_000_000
#: Trees that one task merges, and what a threshold is raised by.
FAN, RAISE = 8, 1.5


@dataclass
class Feature:
    """A clustering feature: number, linear sum and square sum of its points, with the node
    below it or, in a leaf, the ids of its points."""

    n: float
    ls: np.ndarray
    ss: float
    child: Node | None = None
    ids: list[int] = field(default_factory=list)

    @property
    def centroid(self) -> np.ndarray:
        return self.ls / self.n

    def sq_radius_with(self, other: Feature) -> float:
        n = self.n + other.n
        c = (self.ls + other.ls) / n
        return (self.ss + other.ss) / n - float(c @ c)

    def absorb(self, other: Feature, keep_ids: bool) -> None:
        self.n += other.n
        self.ls = self.ls + other.ls
        self.ss += other.ss
        if keep_ids:
            self.ids += other.ids


@dataclass
class Node:
    leaf: bool
    features: list[Feature] = field(default_factory=list)

    def nearest(self, point: np.ndarray) -> int:
        centers = np.stack([f.centroid for f in self.features])
        return int(np.argmin(np.einsum("ij,ij->i", centers, centers) - 2 * centers @ point))


class Tree:
    """A tree with a radius threshold and a branching factor."""

    def __init__(self, threshold: float = 0.5, branching: int = 50):
        if threshold <= 0 or branching < 2:
            raise ValueError("a positive threshold and a branching factor of 2 or more")
        self.sq_threshold, self.branching = threshold * threshold, branching
        self.root = Node(leaf=True)

    def insert(self, feature: Feature) -> None:
        pair = self._insert(self.root, feature)
        if pair:
            self.root = Node(leaf=False, features=pair)

    def _insert(self, node: Node, feature: Feature) -> list[Feature] | None:
        """Inserts below the node; two features in its place if it had to split."""
        if not node.features:
            node.features.append(feature)
            return None
        k = node.nearest(feature.centroid)
        near = node.features[k]
        if node.leaf:
            if near.sq_radius_with(feature) <= self.sq_threshold:
                near.absorb(feature, keep_ids=True)
                return None
            node.features.append(feature)
        else:
            pair = self._insert(near.child, feature)
            if pair is None:
                near.absorb(feature, keep_ids=False)
                return None
            node.features[k : k + 1] = pair
        return self._split(node) if len(node.features) > self.branching else None

    def _split(self, node: Node) -> list[Feature]:
        """The farthest pair seeds two nodes; each feature goes to the nearer seed."""
        centers = np.stack([f.centroid for f in node.features])
        sq = np.einsum("ij,ij->i", centers, centers)
        d = sq[:, None] + sq[None, :] - 2 * centers @ centers.T
        i, j = np.unravel_index(np.argmax(d), d.shape)
        to_first = d[i] < d[j]
        to_first[i], to_first[j] = True, False
        out = []
        for chosen in (to_first, ~to_first):
            part = Node(node.leaf, [f for f, on in zip(node.features, chosen, strict=True) if on])
            out.append(Feature(sum(f.n for f in part.features), np.sum([f.ls for f in part.features], axis=0), sum(f.ss for f in part.features), part))
        return out

    def leaves(self, node: Node | None = None) -> Iterator[Feature]:
        for f in (node or self.root).features:
            if f.child is None:
                yield f
            else:
                yield from self.leaves(f.child)


def fit_tree(vectors: np.ndarray, ids: list[int] | None = None, threshold: float = 0.5, branching: int = 50) -> Tree:
    tree = Tree(threshold, branching)
    for i, x in enumerate(np.asarray(vectors, float)):
        tree.insert(Feature(1.0, x, float(x @ x), ids=[ids[i] if ids is not None else i]))
    return tree


def agglomerate(centers: np.ndarray, sizes: np.ndarray, n_clusters: int) -> np.ndarray:
    """Ward linkage of leaf centroids down to ``n_clusters``; labels in order of first leaf.

    Nearest-neighbour chains: each cluster points to its nearest one, and a pair that points at
    each other merges. One row of distances at a time, so the memory grows with the leaves. The
    merges of the whole tree are then done in the order of their cost.
    """
    n = len(centers)
    c, s, on = np.array(centers, float), np.array(sizes, float), np.ones(n, bool)
    merges: list[tuple[float, int, int]] = []
    chain: list[int] = []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.argmax(on))]
        while True:
            tip = chain[-1]
            cost = np.square(c - c[tip]).sum(axis=1) * (s * s[tip] / (s + s[tip]))
            cost[~on] = np.inf
            cost[tip] = np.inf
            k = int(np.argmin(cost))
            if len(chain) > 1 and cost[chain[-2]] <= cost[k]:
                k = chain[-2]
                break
            chain.append(k)
        del chain[-2:]
        a, b = min(tip, k), max(tip, k)
        merges.append((float(cost[k]), a, b))
        c[a], s[a], on[b] = (c[a] * s[a] + c[b] * s[b]) / (s[a] + s[b]), s[a] + s[b], False
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for _, a, b in sorted(merges, key=lambda m: m[0])[: n - max(1, n_clusters)]:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return np.unique([find(i) for i in range(n)], return_inverse=True)[1]


class Condenser:
    """A tree whose leaves stay within the bounds, their number and the bytes of their vectors."""

    def __init__(self, threshold: float, branching: int, bounds: tuple[int, int]):
        self.threshold, self.branching, self.bounds = threshold, branching, bounds
        self.tree, self._since = Tree(threshold, branching), 0

    def add(self, feature: Feature) -> None:
        self.tree.insert(feature)
        self._since += 1
        if self._since >= self._most(feature):
            self._rebuild(self._most(feature) // 2)

    def _most(self, feature: Feature) -> int:
        return max(2, min(self.bounds[0], self.bounds[1] // (8 * max(1, len(feature.ls)))))

    def _rebuild(self, most: int) -> None:
        leaves = list(self.tree.leaves())
        while len(leaves) > most:
            self.threshold *= RAISE
            self.tree = Tree(self.threshold, self.branching)
            for f in leaves:
                self.tree.insert(f)
            leaves = list(self.tree.leaves())
        self._since = len(leaves)

    def rows(self, part: int) -> pd.DataFrame:
        out = list(self.tree.leaves())
        return pd.DataFrame({"part": part, "threshold": self.threshold, "n": [f.n for f in out], "ls": [f.ls for f in out], "ss": [f.ss for f in out]})


_FEATURES = "part bigint, threshold double, n double, ls array<double>, ss double"


def leaf_features(vectors: DataFrame, threshold: float, branching: int = 50, vector: str = "vec") -> DataFrame:
    """``part``, ``threshold``, ``n``, ``ls``, ``ss`` of the leaves of one tree per partition."""

    bounds = MAX_FEATURES, MAX_BYTES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Condenser(threshold, branching, bounds)
        for pdf in batches:
            for v in pdf["v"]:
                x = np.asarray(v, float)
                own.add(Feature(1.0, x, float(x @ x)))
        if own.tree.root.features:
            yield own.rows(TaskContext.get().partitionId())

    return vectors.select(F.col(vector).alias("v")).where("v is not null").mapInPandas(run, _FEATURES)


def _merged(pdf: pd.DataFrame, branching: int, bounds: tuple[int, int]) -> Condenser:
    """One tree over the features of several, those of many points first."""
    own = Condenser(float(pdf["threshold"].max()), branching, bounds)
    for ls, n, ss in sorted(zip(map(tuple, pdf["ls"]), pdf["n"], pdf["ss"], strict=True), key=lambda r: (-r[1], r[0])):
        own.add(Feature(n, np.array(ls), ss))
    return own


def _together(rows: DataFrame) -> GroupedData:
    """All rows as one group; for tables whose size a tree bounds."""
    return rows.withColumn("all", F.lit(0)).groupBy("all")


def condensed(vectors: DataFrame, threshold: float = 0.5, branching: int = 50, vector: str = "vec") -> DataFrame:
    """The features of all partitions, merged group by group until they fit one tree."""
    scratch, bounds = Scratch(vectors.sparkSession, "birch"), (MAX_FEATURES, MAX_BYTES)
    features = scratch.save(leaf_features(vectors, threshold, branching, vector), "features")
    while True:
        n, last, width = features.agg(F.count("*"), F.max("part"), F.max(F.size("ls"))).first()
        if not last or n <= min(bounds[0], bounds[1] // (8 * max(1, width or 1))):
            return features

        def merge(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            return _merged(pdf, branching, bounds).rows(int(group[0]))

        merged = features.groupBy(F.floor(F.col("part") / FAN).cast("bigint").alias("of")).applyInPandas(merge, _FEATURES)
        merged = scratch.save(merged, "features")
        scratch.drop(features)
        features = merged


def fit_distributed(vectors: DataFrame, threshold: float = 0.5, branching: int = 50, n_clusters: int = 0, vector: str = "vec") -> DataFrame:
    """``cluster_id``, ``centroid``, ``size`` of the leaves, or of ``n_clusters`` Ward clusters
    of them."""
    bounds = MAX_FEATURES, MAX_BYTES

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        leaves = list(_merged(pdf, branching, bounds).tree.leaves())
        labels = agglomerate(np.stack([f.centroid for f in leaves]), np.array([f.n for f in leaves]), n_clusters) if 0 < n_clusters < len(leaves) else np.arange(len(leaves))
        owns = [[f for f, x in zip(leaves, labels, strict=True) if x == k] for k in range(labels.max() + 1)] if n_clusters else [[f] for f in leaves]
        sizes = [sum(f.n for f in own) for own in owns]
        return pd.DataFrame({"cluster_id": range(len(owns)), "centroid": [np.sum([f.ls for f in own], axis=0) / n for own, n in zip(owns, sizes, strict=True)], "size": [int(n) for n in sizes]})

    features = condensed(vectors, threshold, branching, vector)
    centers = _together(features).applyInPandas(finish, "cluster_id int, centroid array<double>, size bigint")  # bounded features
    return Scratch(vectors.sparkSession, "birch").save(centers, "centers")


# Trees as rows


def tree_rows(tree: Tree) -> list[dict]:
    """Nodes of the hierarchy in depth-first order: cluster_id, parent_id, depth, children,
    doc_ids (of all leaves below), cluster_size. A node with one child is that child."""
    rows: list[dict] = []

    def walk(features: list[Feature], parent: int | None, depth: int) -> list[int]:
        while len(features) == 1 and features[0].child is not None:
            features = features[0].child.features
        row = {"cluster_id": len(rows), "parent_id": parent, "depth": depth, "children": []}
        rows.append(row)
        if len(features) == 1:
            row["doc_ids"] = sorted(features[0].ids)
        else:
            ids: list[int] = []
            for f in features:
                row["children"].append(len(rows))
                ids += walk(f.child.features if f.child is not None else [f], row["cluster_id"], depth + 1)
            row["doc_ids"] = sorted(ids)
        row["cluster_size"] = len(row["doc_ids"])
        return row["doc_ids"]

    if tree.root.features:
        walk(tree.root.features, None, 0)
    return rows


TREE = "cluster_id int, parent_id int, depth int, children array<int>, doc_ids array<bigint>, cluster_size bigint"


def tree_frame(spark, tree: Tree) -> DataFrame:
    rows = [(r["cluster_id"], r["parent_id"], r["depth"], r["children"], [int(i) for i in r["doc_ids"]], r["cluster_size"]) for r in tree_rows(tree)]
    return spark.createDataFrame(rows, TREE)


_NODES = "cluster_id int, parent_id int, depth int, children array<int>"


def hierarchy(vectors: DataFrame, threshold: float = 0.5, branching: int = 50, vector: str = "vec") -> tuple[DataFrame, DataFrame]:
    """The tree over the condensed features of a distributed fit: nodes (``cluster_id``,
    ``parent_id``, ``depth``, ``children``, ``cluster_size``), and the deepest node of each
    document (``doc_id``, ``cluster_id``). One task builds the tree of bounded size."""
    from quillspark.operators.neighbors import nearest_centroid

    scratch = Scratch(vectors.sparkSession, "birch")
    centers = fit_distributed(vectors, threshold, branching, vector=vector)

    def rows_of(pdf: pd.DataFrame) -> list[dict]:
        tree, pdf = Tree(threshold, branching), pdf.sort_values("cluster_id")
        for k, c, n in zip(pdf["cluster_id"], pdf["centroid"], pdf["size"], strict=True):
            x = np.asarray(c, float)  # a feature weighs as many documents as it condenses
            tree.insert(Feature(float(n), n * x, n * float(x @ x), ids=[int(k)]))
        return tree_rows(tree)

    def told(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = rows_of(pdf)
        return pd.DataFrame({c: pd.Series([r[c] for r in rows], dtype="Int32" if c != "children" else object) for c in ("cluster_id", "parent_id", "depth", "children")})

    def deepest(pdf: pd.DataFrame) -> pd.DataFrame:
        found = {leaf: r["cluster_id"] for r in rows_of(pdf) for leaf in r["doc_ids"]}  # rows go down the tree
        return pd.DataFrame({"leaf": list(found), "node": list(found.values())})

    nodes = scratch.save(_together(centers).applyInPandas(told, _NODES), "nodes")
    of_leaf = scratch.save(_together(centers).applyInPandas(deepest, "leaf int, node int"), "leaves")
    near = nearest_centroid(vectors, centers, vector, "cluster_id").select("doc_id", F.col("cluster_id").alias("leaf"))
    members = scratch.save(near.join(of_leaf, "leaf").select("doc_id", F.col("node").alias("cluster_id")), "members")
    held = members.groupBy(F.col("cluster_id").alias("node")).agg(F.count("*").alias("n"))
    sizes = held.join(ancestors(nodes), "node").groupBy(F.col("above").alias("of")).agg(F.sum("n").alias("cluster_size"))
    return nodes.join(sizes, nodes["cluster_id"] == sizes["of"], "left").select(*nodes.columns, F.coalesce("cluster_size", F.lit(0)).alias("cluster_size")), members


def ancestors(nodes: DataFrame) -> DataFrame:
    """``node``, ``above`` of every node and each node above it, itself included. The paths grow by
    doubling joins, one round for each bit of the depth."""
    scratch = Scratch(nodes.sparkSession, "birch")
    tree = scratch.save(nodes.select("cluster_id", "parent_id", "depth"), "tree", narrow=True)
    deep = tree.agg(F.max("depth")).first()[0] or 0
    hops = tree.where("parent_id is not null").select(F.col("cluster_id").alias("node"), F.col("parent_id").alias("above"))
    every = scratch.save(tree.select(F.col("cluster_id").alias("node"), F.col("cluster_id").alias("above")).union(hops), "paths", narrow=True)
    reach = 1
    while reach < deep:
        # all paths of up to ``reach`` steps, one after the other
        further = every.select(F.col("node").alias("above"), F.col("above").alias("over"))
        every = scratch.save(every.join(further, "above").select("node", F.col("over").alias("above")).distinct(), "paths", narrow=True)
        reach *= 2
    return every


def node_members(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """``doc_id``, ``cluster_id`` of every node above a document, its deepest one included."""
    paths = ancestors(nodes).select(F.col("node").alias("deepest"), F.col("above").alias("cluster_id"))
    return members.withColumnRenamed("cluster_id", "deepest").join(paths, "deepest").select("doc_id", "cluster_id")


def limit_depth(rows: DataFrame, depth: int) -> DataFrame:
    """Nodes up to a depth; those at it have no children."""
    return rows.where(F.col("depth") <= depth).withColumn("children", F.when(F.col("depth") < depth, F.col("children")).otherwise(F.array().cast("array<int>")))


def dendrogram_leaves(merges: list[tuple[int, int]], n_leaves: int, node: int) -> list[int]:
    """Leaves below node ``n_leaves + i`` of a merge list, in dendrogram order."""
    if node < n_leaves:
        return [node]
    a, b = merges[node - n_leaves]
    return dendrogram_leaves(merges, n_leaves, a) + dendrogram_leaves(merges, n_leaves, b)
