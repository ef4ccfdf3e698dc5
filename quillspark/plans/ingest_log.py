"""Batched ingest of a dataset, with a record of each batch.

A batch is a folder of its own, ``_documents/batch=<number>``, written whole and then committed by a
record in ``_batches``. A batch that was killed on its way has no record, counts for nothing and is
written anew when it comes again; a committed batch that comes again is left as it is. So
every batch counts once, however often it is sent. What a batch starts at (its offset) is the
number of documents in the committed batches before it, and documents are numbered in the order of
batches and ids. Vectorizing closes the log; afterwards neither a batch nor a second vectorizing is
accepted.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.features import FeatureModel, FeatureParams, fit_transform
from quillspark.operators.running import numbered
from quillspark.plans.models import features_table
from quillspark.plans.scratch import remove_path
from quillspark.plans.store import Step, Store

EMPTY, OPEN, VECTORIZED = "empty", "open", "vectorized"
RECORD = "batch long, n_docs long"


class ClosedError(RuntimeError):
    pass


class IngestLog:
    """The batches of one dataset, a ``vectorizer`` step of a store."""

    def __init__(self, store: Store, step: Step):
        self.store, self.spark, self.step = store, store.spark, step
        self._documents, self._batches = f"{step.path}/_documents", f"{step.path}/_batches"

    def _exists(self, path: str) -> bool:
        fs, p = self.store._fs(path)
        return fs.exists(p)

    @property
    def state(self) -> str:
        """Whether the dataset has no batch yet, takes batches, or has been vectorized."""
        if self._exists(f"{self.step.path}/_vectorized/_SUCCESS"):
            return VECTORIZED
        return OPEN if self.committed() else EMPTY

    def committed(self) -> list[int]:
        """Numbers of the batches that have a whole record."""
        names = [n for n in self.store._names(self._batches) if n.startswith("batch=")]
        return sorted(int(n.removeprefix("batch=")) for n in names if self._exists(f"{self._batches}/{n}/_SUCCESS"))

    def pending(self) -> list[int]:
        """Numbers of batches that were begun and not committed."""
        names = [n for n in self.store._names(self._documents) if n.startswith("batch=")]
        return sorted({int(n.removeprefix("batch=")) for n in names} - set(self.committed()))

    def add(self, number: int, docs: DataFrame) -> bool:
        """Takes in batch ``number`` (doc_id, text and more); whether it was new."""
        if number < 0:
            raise ValueError("batches are numbered from 0")
        if self.state == VECTORIZED:
            raise ClosedError(f"{self.step.id} has been vectorized")
        if number in self.committed():
            return False
        self._write(number, docs)
        self._commit(number)
        return True

    def _write(self, number: int, docs: DataFrame) -> None:
        path = f"{self._documents}/batch={number}"
        remove_path(self.spark, path)  # what a killed attempt has left
        docs.write.parquet(path)

    def _commit(self, number: int) -> None:
        n = self.spark.read.parquet(f"{self._documents}/batch={number}").count()
        record = self.spark.createDataFrame([(json.dumps({"batch": number, "n_docs": n}),)], "value string")
        record.coalesce(1).write.mode("overwrite").text(f"{self._batches}/batch={number}")

    def batches(self) -> DataFrame:
        """``batch``, ``n_docs`` and ``offset`` of the committed batches."""
        paths = [f"{self._batches}/batch={k}" for k in self.committed()]
        if not paths:
            return self.spark.createDataFrame([], f"{RECORD}, offset long")
        told = self.spark.read.text(paths).select(F.from_json("value", RECORD).alias("r")).select("r.*")
        before = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)  # a row per batch
        return told.withColumn("offset", F.coalesce(F.sum("n_docs").over(before), F.lit(0)))

    def documents(self) -> DataFrame:
        """The documents of all committed batches with ``batch`` and ``internal_id``. An id in two of
        them is an error."""
        paths = [f"{self._documents}/batch={k}" for k in self.committed()]
        if not paths:
            raise LookupError(f"{self.step.id} has no documents")
        docs = self.spark.read.option("basePath", self._documents).parquet(*paths).withColumn("batch", F.col("batch").cast("long"))
        twice = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").first()
        if twice is not None:
            raise ValueError(f"document {twice['doc_id']} occurs {twice['n']} times")
        return numbered(docs, ["batch", "doc_id"])

    def vectorize(self, params: FeatureParams, text: str = "text") -> tuple[FeatureModel, DataFrame]:
        """Fits the features on all committed batches, writes vocabulary and weights, and closes
        the log. Batches without a record are an error: they have to come again first."""
        if self.state == VECTORIZED:
            raise ClosedError(f"{self.step.id} has been vectorized")
        if left := self.pending():
            raise ClosedError(f"batches {left} are not complete")
        docs = self.documents()
        model, weights = fit_transform(docs, params, text)
        self.store.write(self.step, "vocabulary", model.vocab, "fw")
        remove_path(self.spark, f"{self.step.path}/_features")  # of a killed attempt
        weights = features_table(self.store, self.step, weights)
        told = json.dumps({"n_docs": model.n_docs, "pivot": model.pivot})
        self.spark.createDataFrame([(told,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.step.path}/_vectorized")
        return model, weights
