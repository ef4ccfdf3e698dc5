"""Flat clustering, cluster quality, labels and sampling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import similarity as sim
from quillspark.functions.porter import stem
from quillspark.functions.stopwords import ENGLISH, GIVEN_NAMES, LABEL_EXTRA
from quillspark.operators import birch, features, linkage
from quillspark.operators.neighbors import centroids, nearest_centroid
from quillspark.operators.running import running_sums
from quillspark.plans.scratch import Scratch

MAX_LABEL_TERMS = 1000
BLOCK = 512


def reject_hashed(use_hashing: bool) -> None:
    if use_hashing:
        raise NotImplementedError("hashed features have no terms to cluster by")


def kmeans(vectors: DataFrame, n_clusters: int = 150, seed: int = 0, vector: str = "vec", bisecting: bool = False, use_hashing: bool = False) -> DataFrame:
    """``doc_id``, ``cluster_id``. ``use_hashing`` tells that the vectors stem from hashed features."""
    reject_hashed(use_hashing)
    kind = BisectingKMeans if bisecting else KMeans
    data = vectors.select("doc_id", array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = kind(k=n_clusters, seed=seed, featuresCol="features", predictionCol="cluster_id").fit(data)
    return model.transform(data).select("doc_id", "cluster_id")


def birch_clusters(vectors: DataFrame, min_similarity: float = 0.5, branching: int = 50, n_clusters: int = 0, vector: str = "vec", use_hashing: bool = False) -> tuple[DataFrame, DataFrame]:
    """(``doc_id``, ``cluster_id``) and the centers; the radius follows from a cosine."""
    reject_hashed(use_hashing)
    centers = birch.fit_distributed(vectors, sim.euclidean_from_cosine(min_similarity), branching, n_clusters, vector)
    return nearest_centroid(vectors, centers, vector, "cluster_id").select("doc_id", "cluster_id"), centers


def within(vectors: DataFrame, eps: float, vector: str = "vec", n_pivots: int = 16, seed: int = 0) -> DataFrame:
    """``a``, ``b`` (a < b) of vectors no farther apart than ``eps``, exactly.

    Every vector lives in the cell of its nearest pivot and visits each cell whose pivot is at
    most 2 eps farther away; by the triangle inequality two close vectors meet where either
    lives. Cells are dealt into blocks of bounded size and compared by matrix products.
    """
    pivots = [np.asarray(r[0], float) for r in vectors.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").select(vector).limit(n_pivots).collect()]
    if not pivots:
        return vectors.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")).limit(0)
    centers = np.stack(pivots)
    kind = vectors.schema["doc_id"].dataType.simpleString()

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack([np.asarray(v, float) for v in pdf["v"]])
            d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (centers * centers).sum(1)[None] - 2 * x @ centers.T, 0))
            home = d.argmin(axis=1)
            row, cell = np.nonzero(d <= d.min(axis=1, keepdims=True) + 2 * eps + 1e-9)
            yield pd.DataFrame({"cell": cell, "home": home[row] == cell, "doc_id": pdf["doc_id"].to_numpy()[row], "v": pdf["v"].to_numpy()[row]})

    cells = vectors.select("doc_id", F.col(vector).cast("array<double>").alias("v")).mapInPandas(deal, f"cell int, home boolean, doc_id {kind}, v array<double>")
    sizes = cells.groupBy("cell").agg(F.count_if("home").alias("homes"), F.count("*").alias("visits"))
    dealt = cells.join(sizes.where("homes > 0"), "cell")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    own = lambda n: F.pmod(F.xxhash64("doc_id"), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    at_home = dealt.where("home").select("cell", "home", "doc_id", "v", own("homes").alias("h"), every("visits").alias("k"))
    visiting = dealt.select("cell", F.lit(False).alias("home"), "doc_id", "v", every("homes").alias("h"), own("visits").alias("k"))

    def compare(_key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf["home"]], pdf[~pdf["home"]]
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": []})
        mx, my = np.stack(list(x["v"])), np.stack(list(y["v"]))
        near = (mx * mx).sum(1)[:, None] + (my * my).sum(1)[None] - 2 * mx @ my.T <= eps * eps + 1e-9
        i, j = np.nonzero(near)
        # the product is only near: settle by the difference
        i, j = (z[((mx[i] - my[j]) ** 2).sum(1) <= eps * eps + 1e-12] for z in (i, j))
        a, b = x["doc_id"].to_numpy()[i], y["doc_id"].to_numpy()[j]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})[a != b].drop_duplicates()

    return at_home.unionByName(visiting).groupBy("cell", "h", "k").applyInPandas(compare, f"a {kind}, b {kind}").distinct()


def dbscan(vectors: DataFrame, min_similarity: float = 0.9, min_samples: int = 10, vector: str = "vec") -> DataFrame:
    """``doc_id``, ``cluster_id`` (least core id; -1 for noise) of unit vectors.

    A core point has ``min_samples`` points within reach, itself included. Components of
    core points are clusters; another point joins the least core point in reach.
    """
    return linkage.dbscan(vectors, sim.euclidean_from_cosine(min_similarity), min_samples, vector)


def similarities(vectors: DataFrame, clusters: DataFrame, vector: str = "vec") -> DataFrame:
    """``doc_id``, ``cluster_id``, ``similarity`` to the centroid, ``cluster_similarity`` (their
    mean) and ``cluster_size``."""
    rows = vectors.select("doc_id", F.col(vector).alias("vec")).join(clusters, "doc_id")
    joined = rows.join(centroids(rows, "cluster_id"), "cluster_id").select("doc_id", "cluster_id", sim.cosine(F.col("vec"), F.col("centroid")).alias("similarity"))
    scratch = Scratch(vectors.sparkSession, "similarity")
    joined = scratch.save(joined, "rows")
    per = scratch.save(joined.groupBy("cluster_id").agg(F.avg("similarity").alias("cluster_similarity"), F.count("*").alias("cluster_size")), "clusters")
    return joined.join(per, "cluster_id").select("doc_id", "cluster_id", "similarity", "cluster_similarity", "cluster_size")


def sparse_centroids(weights: DataFrame, clusters: DataFrame) -> DataFrame:
    """``cluster_id``, ``term``, ``weight``: mean weights over all documents of the cluster."""
    return _centroids(weights, clusters).drop("postings")


def _centroids(weights: DataFrame, clusters: DataFrame) -> DataFrame:
    # the ids are the hashed side, so that the weights are not sorted
    return _means(weights.join(clusters.hint("shuffle_hash"), "doc_id"), clusters)


def _means(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """``cluster_id``, ``term``, ``weight`` and ``postings`` from weights that tell their cluster."""
    sizes = clusters.groupBy("cluster_id").agg(F.count("*").alias("n"))
    sums = rows.groupBy("cluster_id", "term").agg(F.sum("weight").alias("s"), F.count("*").alias("postings"))
    return sums.join(sizes, "cluster_id").select("cluster_id", "term", (F.col("s") / F.col("n")).alias("weight"), "postings")


def sparse_similarities(weights: DataFrame, clusters: DataFrame) -> DataFrame:
    """The same as ``similarities`` over long tables; documents without terms have none. The weights
    are read for the centroids and twice for the products: they are written, not made three times."""
    scratch = Scratch(weights.sparkSession, "sparse")
    rows = scratch.save(weights.join(clusters.hint("shuffle_hash"), "doc_id").select("doc_id", "cluster_id", "term", "weight"), "weights")
    centers = scratch.save(_means(rows, clusters).withColumnRenamed("weight", "m"), "centers")
    c_norm = centers.groupBy("cluster_id").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("c_norm"))
    met = features.looked_up(rows, centers, ["cluster_id", "term"], "postings")
    dots = met.groupBy("doc_id", "cluster_id").agg(F.sum(F.col("weight") * F.col("m")).alias("dot"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    one = dots.join(c_norm, "cluster_id").select("doc_id", "cluster_id", (F.col("dot") / F.nullif(F.col("norm") * F.col("c_norm"), F.lit(0.0))).alias("similarity"))
    one = scratch.save(one, "rows")
    per = one.groupBy("cluster_id").agg(F.avg("similarity").alias("cluster_similarity"), F.count("*").alias("cluster_size"))
    return one.join(per, "cluster_id").select("doc_id", "cluster_id", "similarity", "cluster_similarity", "cluster_size")


def select_top_words(words: Sequence[str], n: int = 10, skip: Sequence[str] = (*ENGLISH, *GIVEN_NAMES, *LABEL_EXTRA)) -> list[str]:
    """The first n words whose stem is new, longer than two and begins with a letter."""
    left_out, stems, out = set(skip), set(), []
    for w in words:
        s = stem(w)
        if len(s) > 2 and s[0].isascii() and s[0].isalpha() and w not in left_out and s not in stems:
            stems.add(s)
            out.append(w)
            if len(out) == n:
                break
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _top_words(words: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([select_top_words(list(w), int(k)) for w, k in zip(words, n, strict=True)])


def ranked_terms(weights: DataFrame, n: int, group: str = "cluster_id") -> DataFrame:
    """The ``n`` most weighted terms per group, ties in alphabetical order, with ``rank``."""
    order = Window.partitionBy(group).orderBy(F.desc("weight"), "term")
    return weights.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def labels(centers: DataFrame, n: int = 10, use_hashing: bool = False) -> DataFrame:
    """``cluster_id``, ``cluster_label``: the leading words of each sparse centroid."""
    reject_hashed(use_hashing)
    top = ranked_terms(centers, MAX_LABEL_TERMS).groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("t"))
    return top.select("cluster_id", F.array_join(_top_words(F.col("t.term"), F.lit(n)), " ").alias("cluster_label"))


def _cut(tree: Sequence[dict], min_similarity: float) -> list[dict]:
    """The highest nodes of a tree that are more similar than asked, or leaves."""
    by_id = {r["cluster_id"]: r for r in tree}
    cut, todo = [], [tree[0]["cluster_id"]] if tree else []
    while todo:
        r = by_id[todo.pop()]
        if r["cluster_similarity"] > min_similarity or not r["children"]:
            cut.append(r)
        else:
            todo += reversed(r["children"])
    return cut


def optimal_sampling(tree: Sequence[dict], min_similarity: float, min_coverage: float) -> list[dict]:
    """One document for each of the largest groups that are similar enough.

    Rows of a tree with cluster_id, children, cluster_size, cluster_similarity, doc_ids and
    similarities: from the root down, a node is taken if it is more similar than asked or a
    leaf; by falling size until the sizes pass the coverage, with the crossing one.
    """
    if not 0 <= min_coverage <= 1:
        raise ValueError("min_coverage lies in [0, 1]")
    out, covered = [], 0
    for r in sorted(_cut(tree, min_similarity), key=lambda r: -r["cluster_size"]):
        best = int(np.argmax(r["similarities"]))
        out.append({"cluster_id": r["cluster_id"], "doc_id": r["doc_ids"][best], "similarity": r["similarities"][best], "cluster_size": r["cluster_size"]})
        covered += r["cluster_size"]
        if covered > tree[0]["cluster_size"] * min_coverage:
            break
    return out


def sample_clusters(members: DataFrame, min_coverage: float) -> DataFrame:
    """The same cut for flat clusters: ``cluster_id``, ``doc_id``, ``cluster_size``. ``members``
    has doc_id, cluster_id, similarity. Only one row per cluster is ordered."""
    per = members.groupBy("cluster_id").agg(F.count("*").alias("cluster_size"), F.max_by("doc_id", F.struct(F.col("similarity"), -F.col("doc_id"))).alias("doc_id"))
    total = per.agg(F.sum("cluster_size").alias("total"))  # one row
    summed = running_sums(per, [F.desc("cluster_size"), "cluster_id"], {"cluster_size": "upto"}).join(total)
    return summed.where(F.col("upto") - F.col("cluster_size") <= F.col("total") * min_coverage).select("cluster_id", "doc_id", "cluster_size")


def cluster_documents(members: DataFrame, index: DataFrame) -> DataFrame:
    """The documents of each cluster: rows of ``similarities`` with their columns of the index. A
    document that the index lacks, or holds twice, is an error."""
    n, found, distinct = members.select("doc_id").join(index.select("doc_id", F.lit(1).alias("one")), "doc_id", "left").agg(F.count("*"), F.count("one"), F.count_distinct("doc_id")).first()
    if not n == found == distinct:
        raise ValueError(f"of {n} cluster members {found} are in the index, and {distinct} are distinct")
    return members.join(index, "doc_id")


def node_similarities(vectors: DataFrame, nodes: DataFrame, members: DataFrame, vector: str = "vec") -> tuple[DataFrame, DataFrame]:
    """Of a hierarchy: ``nodes`` with ``cluster_similarity``, and the ``similarity`` of each document
    to the centroid of every node above it."""
    each = similarities(vectors, birch.node_members(nodes, members), vector)
    per = each.groupBy("cluster_id").agg(F.first("cluster_similarity").alias("cluster_similarity"))
    return nodes.join(per, "cluster_id"), each.select("doc_id", "cluster_id", "similarity")


def cut_hierarchy(nodes: DataFrame, min_similarity: float) -> DataFrame:
    """``cluster_id`` of the highest nodes that are similar enough or have no children. ``nodes`` is a
    result of ``node_similarities``; the cut is joins over the paths of the tree."""
    done = nodes.where((F.col("cluster_similarity") >= min_similarity) | (F.size("children") == 0)).select("cluster_id")
    paths = birch.ancestors(nodes).where("node <> above")
    below = paths.join(done.withColumnRenamed("cluster_id", "above"), "above").select(F.col("node").alias("cluster_id")).distinct()
    return done.join(below, "cluster_id", "left_anti")


def sample_hierarchy(nodes: DataFrame, members: DataFrame, min_similarity: float, min_coverage: float) -> DataFrame:
    """The sample that a cut of a distributed hierarchy gives: of its clusters, largest first, until
    more than a share of the documents is covered, the document nearest to the centroid.
    ``cluster_id``, ``doc_id``, ``cluster_size``; for the results of ``node_similarities``."""
    return sample_clusters(members.join(cut_hierarchy(nodes, min_similarity), "cluster_id", "left_semi"), min_coverage)


def ward(vectors: np.ndarray, n_clusters: int) -> np.ndarray:
    """Ward clusters of data that fits one process."""
    return birch.agglomerate(np.asarray(vectors, float), np.ones(len(vectors)), n_clusters)


