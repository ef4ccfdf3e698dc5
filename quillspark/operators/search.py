"""Search by text or by document over sparse weights or dense vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import similarity as sim
from quillspark.plans.scratch import Scratch

BLOCK_VALUES = 4_000_000


def sparse_scores(query: DataFrame, weights: DataFrame, docs: DataFrame, scale: str = "cosine", unit: bool = False) -> DataFrame:
    """``doc_id``, ``score`` of every document against one query.

    ``query`` has term, weight; ``weights`` has doc_id, term, weight. The join on term is an
    inverted index look-up; documents without a common term score as cosine 0. ``unit`` tells that
    both are of norm 1: dividing by it once more would move scores that lie on a bound.
    """
    q = query.select("term", F.col("weight").alias("q"))
    if unit:
        hit = weights.join(F.broadcast(q), "term").groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("q")).alias("cosine"))
        return _scaled(hit, docs, scale)
    q_norm = q.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("q_norm"))
    # the terms of one query are known to all tasks; each document's terms are read once
    sums = [F.sum(F.col("weight") * F.col("q")).alias("dot"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("d_norm")]
    dots = weights.join(F.broadcast(q), "term", "left").groupBy("doc_id").agg(*sums).where("dot is not null")
    hit = dots.join(F.broadcast(q_norm)).select("doc_id", (F.col("dot") / F.nullif(F.col("d_norm") * F.col("q_norm"), F.lit(0.0))).alias("cosine"))  # one row
    return _scaled(hit, docs, scale)


def _scaled(hit: DataFrame, docs: DataFrame, scale: str) -> DataFrame:
    every = docs.select("doc_id").join(hit, "doc_id", "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))
    return every.select("doc_id", sim.from_cosine(F.col("cosine"), scale).alias("score"))


def dense_scores(query: Column, vectors: DataFrame, scale: str = "cosine", vector: str = "vec") -> DataFrame:
    """The same over one dense vector per document."""
    return vectors.select("doc_id", sim.from_cosine(sim.cosine(query, F.col(vector)), scale).alias("score"))


def sparse_dots(queries: DataFrame, weights: DataFrame) -> DataFrame:
    """``query_id``, ``doc_id``, ``dot`` of every query and document with a common term."""
    q = queries.select("query_id", "term", F.col("weight").alias("q"))
    return weights.join(q, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * F.col("q")).alias("dot"))


def sparse_hits(queries: DataFrame, weights: DataFrame) -> DataFrame:
    """``query_id``, ``doc_id``, ``cosine`` of every query and document with a common term.
    ``queries`` has query_id, term, weight. They are written, so that few are known to all tasks and
    the weights stay where they are; norms are sums by id, which sort nothing."""
    q = Scratch(weights.sparkSession, "queries").save(queries.select("query_id", "term", "weight"), "rows", narrow=True)
    of = lambda rows, key, name: rows.groupBy(key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias(name))
    dots, d, own = sparse_dots(q, weights), of(weights, "doc_id", "d_norm"), of(q, "query_id", "q_norm")
    d, own = d.withColumnRenamed("doc_id", "d"), own.withColumnRenamed("query_id", "q")
    hits = dots.join(d, F.col("doc_id").eqNullSafe(F.col("d"))).join(own, F.col("query_id").eqNullSafe(F.col("q")))
    return hits.select("query_id", "doc_id", (F.col("dot") / F.nullif(F.col("d_norm") * F.col("q_norm"), F.lit(0.0))).alias("cosine"))


def sparse_scores_each(queries: DataFrame, weights: DataFrame, docs: DataFrame, ids: DataFrame, scale: str = "cosine") -> DataFrame:
    """``query_id``, ``doc_id``, ``score`` of every document against every query of ``ids``
    (query_id), also those without a known term."""
    every = docs.select("doc_id").crossJoin(ids.select("query_id").distinct()).join(sparse_hits(queries, weights), ["query_id", "doc_id"], "left")
    return every.select("query_id", "doc_id", sim.from_cosine(F.coalesce("cosine", F.lit(0.0)), scale).alias("score"))


def dense_scores_each(queries: DataFrame, vectors: DataFrame, scale: str = "cosine", vector: str = "vec") -> DataFrame:
    """The same over one dense vector per document; ``queries`` has query_id and the vector.
    The queries travel in blocks of bounded size. A vector of norm 0 has score null."""
    n, width = queries.agg(F.count("*"), F.max(F.size(vector))).first()
    blocks = max(1, -(-(n * (width or 1)) // BLOCK_VALUES))

    def scored(k: int) -> DataFrame:
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k) if blocks > 1 else queries
        block = part.select("query_id", F.col(vector).alias("v")).toPandas()  # at most about BLOCK_VALUES numbers

        def unit(rows: pd.Series) -> np.ndarray:
            x = np.stack([np.asarray(v, float) for v in rows])
            n = np.linalg.norm(x, axis=1, keepdims=True)
            return np.divide(x, n, out=np.full_like(x, np.nan), where=n > 0)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if not len(block):
                return
            own, q = block["query_id"].to_numpy(), unit(block["v"])
            step = max(1, BLOCK_VALUES // len(own))
            for pdf in batches:
                for i in range(0, len(pdf), step):
                    some = pdf.iloc[i : i + step]
                    s = unit(some["v"]) @ q.T
                    yield pd.DataFrame({"query_id": np.tile(own, len(some)), "doc_id": np.repeat(some["doc_id"].to_numpy(), len(own)), "cosine": s.ravel()})

        return vectors.select("doc_id", F.col(vector).alias("v")).mapInPandas(run, "query_id bigint, doc_id bigint, cosine double")

    out = scored(0)
    for k in range(1, blocks):
        out = out.union(scored(k))
    return out.select("query_id", "doc_id", sim.from_cosine(F.when(~F.isnan("cosine"), F.col("cosine")), scale).alias("score"))


def page_each(scores: DataFrame, batch_id: int, batch_size: int) -> DataFrame:
    """One page per query, best first, ties by doc_id; only what precedes it is sorted."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    last = (batch_id + 1) * batch_size
    return scores.withColumn("rank", rank).where((F.col("rank") <= last) & (F.col("rank") > last - batch_size)).drop("rank")


def document_query(weights: DataFrame, doc_id: int) -> DataFrame:
    """A document as a query."""
    return weights.where(F.col("doc_id") == doc_id).select("term", "weight")


def shape(scores: DataFrame, min_score: float | None = -1.0, exclude: int | None = None, subset: DataFrame | None = None, max_results: int = 0) -> DataFrame:
    """Scores over ``min_score`` (strictly), without the query document, of a subset, best
    first, ties by doc_id."""
    out = scores if min_score is None else scores.where(F.col("score") > min_score)
    if exclude is not None:
        out = out.where(F.col("doc_id") != exclude)
    if subset is not None:
        out = out.join(subset.select("doc_id").distinct(), "doc_id", "left_semi")
    out = out.orderBy(F.desc("score"), "doc_id")
    return out.limit(max_results) if max_results > 0 else out
