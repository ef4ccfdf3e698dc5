"""Fitted models as steps of a store: what ``save`` writes, ``load`` gives back.

Tables go to tables, matrices to rows of a table, Spark's own models to their own folders, and
the rest to the parameters of the step.
"""

from __future__ import annotations

from dataclasses import asdict, fields

import numpy as np
from pyspark.ml.classification import GBTClassificationModel, LinearSVCModel, LogisticRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.categorize import Categorizer
from quillspark.operators.features import FeatureModel, FeatureParams
from quillspark.operators import lsi
from quillspark.operators.lsi import LsiModel
from quillspark.operators.lsi_blocks import BlockModel
from quillspark.plans.store import Step, Store

_FITTED = {"LogisticRegression": LogisticRegressionModel, "LinearSVC": LinearSVCModel, "xgboost": GBTClassificationModel}


def save_features(store: Store, model: FeatureModel, id: str | None = None, mode: str = "w") -> Step:
    """The dataset of a feature model: vocabulary, frozen counts and parameters."""
    step = store.create("vectorizer", {**asdict(model.params), "n_docs": model.n_docs, "pivot": model.pivot}, id=id, mode=mode)
    store.write(step, "vocabulary", model.vocab)
    return step


def load_features(store: Store, step: Step) -> FeatureModel:
    saved = store.params(step)
    given = {f.name: tuple(v) if isinstance(v := saved[f.name], list) else v for f in fields(FeatureParams)}
    return FeatureModel(FeatureParams(**given), store.read(step, "vocabulary"), saved["n_docs"], saved["pivot"])


def save_lsi(store: Store, model: LsiModel | BlockModel, parent: Step, id: str | None = None, mode: str = "w") -> Step:
    """Singular values and the loadings of each term, a row per term."""
    step = store.create("lsi", {"sigma": model.sigma.tolist(), "explained_variance": model.explained_variance}, parent, id, mode)
    if isinstance(model, BlockModel):
        rows = model.v.select("idx", F.col("vec").alias("v"))
    else:
        rows = store.spark.createDataFrame(((i, v.tolist()) for i, v in enumerate(model.v)), "idx bigint, v array<double>")
    store.write(step, "terms", model.terms.select("term", "idx").join(rows, "idx"))
    return step


def load_lsi(store: Store, step: Step) -> LsiModel | BlockModel:
    """A model as it was saved; loadings that are too many for a task stay a table."""
    saved, terms = store.params(step), store.read(step, "terms")
    sigma = np.array(saved["sigma"])
    if terms.count() * len(sigma) > lsi.MAX_VALUES:
        return BlockModel(terms.select("term", "idx"), terms.select("idx", F.col("v").alias("vec")), sigma, saved["explained_variance"])
    rows = terms.select("idx", "v").orderBy("idx").collect()  # at most lsi.MAX_VALUES numbers
    return LsiModel(terms.select("term", "idx"), np.array([r["v"] for r in rows]), sigma, saved["explained_variance"])


def save_categorizer(store: Store, model: Categorizer, parent: Step, id: str | None = None, mode: str = "w") -> Step:
    """Training vectors or centroids of the nearest methods, else a fitted model per category."""
    step = store.create("categorizer", {"method": model.method, "categories": model.categories}, parent, id, mode)
    if isinstance(model.model, DataFrame):
        store.write(step, "model", model.model)
    else:
        for i, (_, fitted) in enumerate(model.model):
            fitted.write().overwrite().save(f"{step.path}/_models/{i:05d}")
    return step


def load_categorizer(store: Store, step: Step) -> Categorizer:
    saved = store.params(step)
    if saved["method"] in _FITTED:
        kind = _FITTED[saved["method"]]
        model = [(c, kind.load(f"{step.path}/_models/{i:05d}")) for i, c in enumerate(saved["categories"])]
    else:
        model = store.read(step, "model")
    return Categorizer(saved["method"], saved["categories"], model)


def append_documents(store: Store, step: Step, docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds documents to a dataset in one go: they are weighted by its frozen features and
    appended to ``features``, projected by each of its LSI models into ``vectors``, and the models
    that the new documents make stale are deleted. An id that is there already is an error."""
    model = load_features(store, step)
    known = store.read(step, "features").select("doc_id").distinct() if store.finished(step, "features") else None
    if known is not None and not known.join(docs.select("doc_id"), "doc_id", "left_semi").isEmpty():
        raise ValueError("documents that the dataset holds already")
    fresh = model.transform(docs, text)
    before = [c for c in store.children(step) if c.kind == "lsi"]
    for child in before:
        store.append(child, "vectors", load_lsi(store, child).transform(fresh))
    out = store.append(step, "features", fresh)
    store.invalidate(step)
    return out


def remove_documents(store: Store, step: Step, ids: DataFrame) -> DataFrame:
    """Takes documents (doc_id) out of a dataset's features and of the vectors of its LSI models,
    and deletes the models that this makes stale."""
    for child in [step, *(c for c in store.children(step) if c.kind == "lsi")]:
        name = "features" if child is step else "vectors"
        if store.finished(child, name):
            left = store.read(child, name).join(ids.select("doc_id").distinct(), "doc_id", "left_anti")
            store.write(child, f"{name}_left", left, "fw")  # a table that is read cannot be replaced
            store.rename(child, f"{name}_left", name)
    store.invalidate(step)
    return store.read(step, "features")


def features_table(store: Store, step: Step, weights: DataFrame) -> DataFrame:
    """Writes the weights of the documents that the features were fitted on."""
    return store.write(step, "features", weights.select(F.col("doc_id"), "term", "weight"))
