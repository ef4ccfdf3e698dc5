"""Latent semantic indexing by a randomized range finder (Halko, Martinsson, Tropp 2011).

A terms x components matrix of checked size is held by the driver and each task; for any other
``lsi_blocks`` does the same over tables. Documents never leave the executors. One pass
over the documents multiplies with the matrix and its transpose at once, and the partial
results are summed in blocks of terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import lsi_blocks
from quillspark.operators.features import indexed

OVERSAMPLE, ITERATIONS = 10, 5
MAX_VALUES = 16_000_000
TERM_BLOCK = 4096


def components_for(n_components: int, n_docs: int, n_terms: int, alpha: float = 0.33) -> int:
    """As many components as asked, but no more than a share of documents and terms; 5 at least."""
    return max(5, int(min(n_components, alpha * n_docs, int(alpha * n_terms))))


@dataclass
class LsiModel:
    terms: DataFrame  # term, idx
    v: np.ndarray  # (terms, k)
    sigma: np.ndarray
    explained_variance: float

    @property
    def k(self) -> int:
        return len(self.sigma)

    def transform(self, weights: DataFrame, normalize: bool = True) -> DataFrame:
        """``doc_id``, ``vec``: X V / sigma, rows of unit length. Documents without known terms
        have no row."""
        p = self.v / self.sigma
        return _project(_rows(weights, self.terms), p, normalize)

    def to_terms(self, vectors: DataFrame, vector: str = "vec", key: str = "doc_id") -> DataFrame:
        """``key``, ``term``, ``weight``: vectors back in term space, c V'."""
        v = self.v
        kind = vectors.schema[key].dataType.simpleString()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for k, c in zip(pdf["k"], pdf["c"], strict=True):
                    w = v @ np.asarray(c, float)
                    yield pd.DataFrame({"k": k, "idx": np.arange(len(w)), "weight": w})

        back = vectors.select(F.col(key).alias("k"), F.col(vector).alias("c")).mapInPandas(run, f"k {kind}, idx bigint, weight double")
        return back.join(self.terms, "idx").select(F.col("k").alias(key), "term", "weight")


def _rows(weights: DataFrame, terms: DataFrame) -> DataFrame:
    """One row per document: parallel arrays of term numbers and weights."""
    e = F.struct("idx", "weight")
    rows = weights.join(terms.select("term", "idx"), "term").groupBy("doc_id").agg(F.sort_array(F.collect_list(e)).alias("e"))
    return rows.select("doc_id", F.col("e.idx").alias("i"), F.col("e.weight").alias("w"))


def _product(pdf: pd.DataFrame, m: np.ndarray) -> np.ndarray:
    """Rows of X M for a batch of documents."""
    sizes = pdf["i"].map(len).to_numpy()
    i, w = np.concatenate(pdf["i"].to_list()).astype(np.int64), np.concatenate(pdf["w"].to_list())
    out = np.zeros((len(pdf), m.shape[1]))
    np.add.at(out, np.repeat(np.arange(len(pdf)), sizes), m[i] * w[:, None])
    return out


def _project(rows: DataFrame, p: np.ndarray, normalize: bool) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                y = _product(pdf, p)
                if normalize:
                    n = np.linalg.norm(y, axis=1, keepdims=True)
                    y = np.divide(y, n, out=np.zeros_like(y), where=n > 0)
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "vec": list(y)})

    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, vec array<double>")


def _gram(rows: DataFrame, m: np.ndarray) -> np.ndarray:
    """X' X M, by one pass and one sum per block of terms."""
    n = len(m)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros_like(m)
        for pdf in batches:
            if len(pdf):
                y = _product(pdf, m)
                sizes = pdf["i"].map(len).to_numpy()
                i, w = np.concatenate(pdf["i"].to_list()).astype(np.int64), np.concatenate(pdf["w"].to_list())
                np.add.at(out, i, y[np.repeat(np.arange(len(pdf)), sizes)] * w[:, None])
        starts = range(0, n, TERM_BLOCK)
        yield pd.DataFrame({"block": list(starts), "part": [out[s : s + TERM_BLOCK].tobytes() for s in starts]})

    def total(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        s = sum(np.frombuffer(p) for p in pdf["part"])
        return pd.DataFrame({"block": [key[0]], "part": [s.tobytes()]})

    parts = rows.mapInPandas(run, "block bigint, part binary").groupBy("block").applyInPandas(total, "block bigint, part binary")
    found = parts.orderBy("block").collect()  # terms x components, checked by fit
    return np.concatenate([np.frombuffer(r["part"]).reshape(-1, m.shape[1]) for r in found])


def fit(weights: DataFrame, n_docs: int, n_components: int = 150, alpha: float = 0.33, seed: int = 42) -> LsiModel | lsi_blocks.BlockModel:
    """Truncated SVD of the documents x terms matrix in long form. If the terms x components matrix
    is too large for a task, the model has it as a table."""
    terms = indexed(weights.select("term").distinct()).select("term", "idx").persist()
    n_terms = terms.count()
    if not n_terms:
        raise ValueError("no terms")
    k = min(components_for(n_components, n_docs, n_terms), n_terms)
    width = min(n_terms, k + OVERSAMPLE)
    if n_terms * width > MAX_VALUES:
        terms.unpersist()
        return lsi_blocks.fit(weights, n_docs, k, seed)
    rows = _rows(weights, terms).persist()
    q = np.random.default_rng(seed).standard_normal((n_terms, width))
    for _ in range(ITERATIONS):
        q, _r = np.linalg.qr(_gram(rows, q))
    small = q.T @ _gram(rows, q)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(values)[::-1][:k]
    keep = order[values[order] > 1e-12 * max(values.max(), 1e-300)]
    v, sigma = q @ vectors[:, keep], np.sqrt(values[keep])
    v *= np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1, 1)  # a fixed sign
    of_terms = weights.groupBy("term").agg((F.sum(F.col("weight") ** 2) / n_docs - (F.sum("weight") / n_docs) ** 2).alias("var")).agg(F.sum("var")).first()[0]
    means = _column_means(rows, v, n_docs)
    explained = float(np.sum(np.square(sigma) / n_docs - np.square(means)) / of_terms) if of_terms else 0.0
    rows.unpersist()
    return LsiModel(terms, v, sigma, explained)


def _column_means(rows: DataFrame, v: np.ndarray, n_docs: int) -> np.ndarray:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = np.zeros(v.shape[1])
        for pdf in batches:
            if len(pdf):
                s += _product(pdf, v).sum(axis=0)
        yield pd.DataFrame({"i": np.arange(len(s)), "s": s})

    sums = rows.mapInPandas(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
    return np.array([r["s"] for r in sums]) / n_docs
