"""Datasets and models as folders of tables, with parameters and parents.

A folder ``<root>/<dataset>`` holds tables; ``<root>/<dataset>/<step>/<model>`` a model of a
step over it, and so on below. Everything is read and written through Spark.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quillspark.plans.scratch import remove_path
from quillspark.sources.files import valid_id

DEPENDENT = ("categorizer", "dupdet", "cluster", "threading")
MODES = {"w": "errorifexists", "fw": "overwrite"}


class ModelNotFound(LookupError):
    pass


def new_id() -> str:
    return uuid.uuid4().hex[:16]


@dataclass(frozen=True)
class Step:
    """A dataset or model: its id, kind of step and folder; the parent holds it."""

    id: str
    kind: str
    path: str
    parent: Step | None = None

    def lineage(self) -> list[Step]:
        """From the dataset down to this step; no kind occurs twice."""
        steps = [*(self.parent.lineage() if self.parent else []), self]
        if len({s.kind for s in steps}) < len(steps):
            raise NotImplementedError("two steps of one kind in a pipeline")
        return steps


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def create(self, kind: str, params: Mapping, parent: Step | None = None, id: str | None = None, mode: str = "w") -> Step:
        """A new step with its parameters; ``mode`` 'w' fails if it exists, 'fw' replaces it."""
        id = id or new_id()
        if not valid_id(id):
            raise ValueError(f"invalid id {id!r}")
        if mode not in MODES:
            raise ValueError("mode is 'w' or 'fw'")
        path = f"{self.root}/{id}" if parent is None else f"{parent.path}/{kind}/{id}"
        step = Step(id, kind, path, parent)
        step.lineage()
        fs, p = self._fs(path)
        if fs.exists(p):
            if mode == "w":
                raise FileExistsError(path)
            fs.delete(p, True)
        line = json.dumps({"kind": kind, "params": dict(params)}, sort_keys=True, default=str)
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{path}/_params")
        return step

    def params(self, step: Step) -> dict:
        rows = self.spark.read.text(f"{step.path}/_params").collect()
        return json.loads(rows[0]["value"])["params"]

    def write(self, step: Step, table: str, df: DataFrame, mode: str = "w") -> DataFrame:
        df.write.mode(MODES[mode]).parquet(f"{step.path}/_{table}")
        return self.read(step, table)

    def append(self, step: Step, table: str, df: DataFrame) -> DataFrame:
        """Adds rows to a table of a batched ingest; by columns' names."""
        df.write.mode("append").parquet(f"{step.path}/_{table}")
        return self.read(step, table)

    def read(self, step: Step, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{step.path}/_{table}")

    def rename(self, step: Step, table: str, to: str) -> None:
        """A table under another name, in place of the one that had it."""
        fs, new = self._fs(f"{step.path}/_{to}")
        _, old = self._fs(f"{step.path}/_{table}")
        fs.delete(new, True)
        if not fs.rename(old, new):
            raise OSError(f"{table} cannot be renamed")

    def finished(self, step: Step, table: str) -> bool:
        """Whether a table has been written to its end."""
        fs, p = self._fs(f"{step.path}/_{table}/_SUCCESS")
        return fs.exists(p)

    def datasets(self) -> list[str]:
        return self._names(self.root)

    def children(self, step: Step) -> list[Step]:
        return [Step(i, kind, f"{step.path}/{kind}/{i}", step) for kind in self._names(step.path) if not kind.startswith("_") for i in self._names(f"{step.path}/{kind}")]

    def find(self, id: str) -> Step:
        """The step of an id, anywhere below the root."""
        todo = [Step(d, "vectorizer", f"{self.root}/{d}") for d in self.datasets()]
        while todo:
            step = todo.pop()
            if step.id == id:
                return step
            todo += self.children(step)
        raise ModelNotFound(id)

    def delete(self, step: Step) -> None:
        remove_path(self.spark, step.path)

    def invalidate(self, step: Step) -> None:
        """Deletes the models that documents added to or taken from a dataset make stale."""
        for child in self.children(step):
            if child.kind in DEPENDENT:
                self.delete(child)
            else:
                self.invalidate(child)


class StopWords:
    """Named word lists as tables."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, f"{root.rstrip('/')}/stop_words")

    def save(self, name: str, words: list[str]) -> None:
        step = self.store.create("stop_words", {}, id=name, mode="fw")
        self.store.write(step, "words", self.spark.createDataFrame([(w,) for w in words], "word string"))

    def __contains__(self, name: str) -> bool:
        return name in self.names()

    def names(self) -> list[str]:
        return self.store.datasets()

    def load(self, name: str) -> list[str]:
        if name not in self:
            raise ModelNotFound(name)
        return sorted(r[0] for r in self.store.read(Step(name, "stop_words", f"{self.store.root}/{name}"), "words").collect())

    def delete(self, name: str) -> None:
        if name not in self:
            raise ModelNotFound(name)
        remove_path(self.spark, f"{self.store.root}/{name}")
