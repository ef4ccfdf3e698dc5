"""Categorization: linear models, tree ensembles, neighbours; prediction and explanation."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.similarity import expit
from quillspark.operators import neighbors
from quillspark.operators.lsi import LsiModel
from quillspark.operators.lsi_blocks import BlockModel

METHODS = ("LinearSVC", "LogisticRegression", "xgboost", "NearestCentroid", "NearestNeighbor")
FOLDS = 3


@dataclass
class Categorizer:
    method: str
    categories: list[str]
    model: Any

    def predict(self, docs: DataFrame, vector: str = "vec") -> DataFrame:
        """``doc_id``, ``category``, ``score``, and ``nn_doc_id`` of the neighbour method."""
        if self.method == "NearestNeighbor":
            return neighbors.nearest(docs, self.model, vector)
        if self.method == "NearestCentroid":
            d = neighbors.center_distances(docs, self.model, vector)
            return d.select("doc_id", "category", expit(-F.col("distance")).alias("score"))
        rows = docs.select("doc_id", array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
        scores = [_scores(m.transform(rows), i, c) for i, (c, m) in enumerate(self.model)]
        out = scores[0]
        for s in scores[1:]:
            out = out.unionByName(s)
        return out


def _scores(predicted: DataFrame, i: int, category: str) -> DataFrame:
    if "probability" in predicted.columns:
        score = vector_to_array("probability")[1]
    else:
        score = expit(vector_to_array("rawPrediction")[1])
    return predicted.select("doc_id", F.lit(category).alias("category"), score.alias("score"))


def train(data: DataFrame, method: str = "LinearSVC", cv: str | None = None, vector: str = "vec", seed: int = 0) -> Categorizer:
    """Trains on doc_id, category and a vector. Categories are ordered by name; each has a
    binary model of its own, as liblinear does. ``cv`` 'fast' or 'full' picks the
    regularization by cross-validation."""
    if method not in METHODS:
        raise NotImplementedError(f"{method}; there are {METHODS}")
    if cv not in (None, "fast", "full") or (cv and method.startswith("Nearest")):
        raise ValueError(f"cv={cv} with {method}")
    rows = data.select("doc_id", F.col("category").cast("string").alias("category"), F.col(vector).cast("array<double>").alias("vec"))
    names = [r[0] for r in rows.select("category").distinct().orderBy("category").collect()]
    if method == "NearestNeighbor":
        return Categorizer(method, names, rows)
    if method == "NearestCentroid":
        return Categorizer(method, names, neighbors.centroids(rows))
    if len(names) < 2:
        raise ValueError("at least two categories")
    n = rows.count()
    frame = rows.select(array_to_vector("vec").alias("features"), "category").persist()
    models = []
    for name in names:
        own = frame.select("features", (F.col("category") == name).cast("double").alias("label"))
        models.append((name, _fit(own, method, cv, n, seed)))
    frame.unpersist()
    return Categorizer(method, names, models)


def _fit(rows: DataFrame, method: str, cv: str | None, n: int, seed: int) -> Any:
    if method == "LogisticRegression":
        est: Any = LogisticRegression(regParam=1 / n, standardization=False)
    elif method == "LinearSVC":
        est = LinearSVC(regParam=1 / n, standardization=False)
    else:
        est = GBTClassifier(seed=seed)
    if not cv:
        return est.fit(rows)
    values = (0.1, 1.0, 10.0) if cv == "fast" else (0.01, 0.1, 1.0, 10.0, 100.0)
    grid = ParamGridBuilder().addGrid(est.regParam, [1 / (c * n) for c in values]).build() if method != "xgboost" else ParamGridBuilder().addGrid(est.maxDepth, [3, 5]).build()
    return CrossValidator(estimator=est, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(), numFolds=FOLDS, seed=seed).fit(rows).bestModel


def one_vs_rest(seed: int = 0) -> OneVsRest:
    """The same scheme as a pipeline stage."""
    return OneVsRest(classifier=LogisticRegression(standardization=False))


def shape(scores: DataFrame, max_categories: int = 1, min_score: float | None = None, sort_by: str | None = None, subset: DataFrame | None = None, complement: bool = False) -> DataFrame:
    """``doc_id``, ``best`` and ``scores`` (array of category, score; best first), ordered by the
    best score or by that of the category ``sort_by``."""
    if subset is not None:
        scores = scores.join(subset.select("doc_id").distinct(), "doc_id", "left_anti" if complement else "left_semi")
    w = Window.partitionBy("doc_id")
    ranked = scores.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("score"), "category")), "by": F.max("score").over(w) if sort_by is None else F.max(F.when(F.col("category") == sort_by, F.col("score"))).over(w)})
    kept = ranked.where(F.col("rank") <= max_categories)
    if min_score is not None:
        kept = kept.where(F.col("by") > min_score)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("rank", "category", "score"))), lambda s: F.struct(s["category"].alias("category"), s["score"].alias("score")))
    return kept.groupBy("doc_id").agg(F.first("by").alias("best"), parts.alias("scores")).orderBy(F.desc("best"), "doc_id")


def training_scores(model: Categorizer, data: DataFrame, vector: str = "vec") -> DataFrame:
    """One row of micro-averaged scores of the best category on the training documents."""
    from quillspark.operators.metrics import micro_scores

    best = shape(model.predict(data, vector)).select("doc_id", F.col("scores")[0]["category"].alias("y_pred"))
    return micro_scores(data.select("doc_id", F.col("category").cast("string").alias("y_true")).join(best, "doc_id"))


def coefficients(model: Categorizer, space: LsiModel | BlockModel) -> DataFrame:
    """``category``, ``term``, ``coefficient`` of fitted linear models over semantic vectors, back in
    term space: a model's decision on the vector of a document before it is normalized is the sum
    of term weights times these, and the intercept."""
    rows = [(c, (fitted.coefficients.toArray() / space.sigma).tolist()) for c, fitted in model.model]  # components, not terms
    told = space.to_terms(space.terms.sparkSession.createDataFrame(rows, "category string, vec array<double>"), key="category")
    return told.select("category", "term", F.col("weight").alias("coefficient"))


def term_coefficients(model: Categorizer, space: LsiModel | BlockModel, category: str) -> DataFrame:
    """``term``, ``coefficient`` of one category."""
    own = Categorizer(model.method, [category], [m for m in model.model if m[0] == category])
    return coefficients(own, space).drop("category")


def sensitivity(weights: DataFrame, coefficients: DataFrame) -> DataFrame:
    """``doc_id``, ``term``, ``contribution``: term weight times the linear model's coefficient."""
    return weights.join(coefficients, "term").select("doc_id", "term", (F.col("weight") * F.col("coefficient")).alias("contribution"))
