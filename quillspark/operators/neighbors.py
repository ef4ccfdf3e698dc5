"""Nearest neighbours and centroids per class, over dense vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import similarity as sim
from quillspark.operators import nearest as by_blocks

BLOCK_VALUES = 4_000_000


def nearest(docs: DataFrame, train: DataFrame, vector: str = "vec") -> DataFrame:
    """Per document and category: ``doc_id``, ``category``, ``score`` (best cosine) and
    ``nn_doc_id``, the least id of the best. ``train`` has doc_id, category and the vector."""
    return by_blocks.nearest(docs, train, vector)


def nearest_others(queries: DataFrame, rows: DataFrame, vector: str = "vec") -> DataFrame:
    """The same of each query among all ``rows`` but those with its doc_id."""
    return by_blocks.nearest(queries, rows, vector, others_only=True)


def centroids(train: DataFrame, label: str = "category", vector: str = "vec") -> DataFrame:
    """Mean vector per label: ``label`` column and ``centroid``."""
    parts = train.select(label, F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x")).groupBy(label, "i").agg(F.avg("x").alias("m"))
    return parts.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def _rows_of(centers: DataFrame, label: str) -> tuple[list, np.ndarray]:
    """Labels and centers in the order of the labels. Their number is fixed by the model; the
    size of what travels with the tasks is checked."""
    n, width = centers.agg(F.count("*"), F.max(F.size("centroid"))).first()
    if n * (width or 1) > BLOCK_VALUES:
        raise ValueError(f"{n} centers of {width} values are too many for a task")
    rows = centers.select(label, "centroid").orderBy(label).collect()
    return [r[0] for r in rows], np.array([r[1] for r in rows], float)


def _distances(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(np.square(x - c).sum(axis=1)) for c in m], axis=1)


def center_distances(docs: DataFrame, centers: DataFrame, vector: str = "vec", label: str = "category") -> DataFrame:
    """``doc_id``, ``label``, Euclidean ``distance`` to every center."""
    names, m = _rows_of(centers, label)
    kinds = [docs.schema["doc_id"].dataType.simpleString(), centers.schema[label].dataType.simpleString()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) and len(names):
                d = _distances(np.stack([np.asarray(v, float) for v in pdf["v"]]), m)
                yield pd.DataFrame({"doc_id": np.repeat(pdf["doc_id"].to_numpy(), len(names)), label: names * len(pdf), "distance": d.ravel()})

    return docs.select("doc_id", F.col(vector).alias("v")).mapInPandas(run, f"doc_id {kinds[0]}, `{label}` {kinds[1]}, distance double")


def nearest_centroid(docs: DataFrame, centers: DataFrame, vector: str = "vec", label: str = "category") -> DataFrame:
    """``doc_id``, the nearest ``label`` and its Euclidean ``distance``; ties to the least label."""
    names, m = _rows_of(centers, label)
    kinds = [docs.schema["doc_id"].dataType.simpleString(), centers.schema[label].dataType.simpleString()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) and len(names):
                d = _distances(np.stack([np.asarray(v, float) for v in pdf["v"]]), m)
                best = d.argmin(axis=1)
                yield pd.DataFrame({"doc_id": pdf["doc_id"], label: [names[k] for k in best], "distance": d[np.arange(len(d)), best]})

    return docs.select("doc_id", F.col(vector).alias("v")).mapInPandas(run, f"doc_id {kinds[0]}, `{label}` {kinds[1]}, distance double")


def centroid_score(docs: DataFrame, centers: DataFrame, vector: str = "vec") -> DataFrame:
    """Decision of the centroid ranker: least distance to any centroid, and its logistic."""
    return nearest_centroid(docs, centers, vector).select("doc_id", F.col("distance").alias("decision"), sim.expit(F.col("distance")).alias("score"))
