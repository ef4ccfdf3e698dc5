"""Scratch tables in the folder that driver and executors share.

A long lineage is cut by writing a table under ``spark.checkpoint.dir`` and reading
it again, so a lost executor costs only the tasks since the last table. The folder
is any Hadoop path; it is only touched through Spark and the Hadoop file system.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_LIVE: dict[str, SparkSession] = {}


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder. Where the setting is unset, as in tests, a temporary one if
    driver and executors are one process; an error on a cluster."""
    root = spark.conf.get(_KEY, None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"set {_KEY} to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set(_KEY, root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def remove_path(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


class Scratch:
    """Tables of one operator call, in a folder of their own.

    ``save`` writes and rereads a table, ``drop`` deletes one that is no longer read.
    What a returned lazy DataFrame still reads stays until the session ends. A ``narrow``
    table (ids, hashes, numbers) that comes from a shuffle gets a few files a core, not one
    for each shuffle partition: starting, committing and reading so many would cost more than
    the rows in them.
    """

    FILES_PER_CORE = 2

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        _LIVE[self.base] = spark

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.base}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
        path = self.path(name)
        if narrow:
            df = df.coalesce(self.FILES_PER_CORE * self.spark.sparkContext.defaultParallelism)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = getattr(df, "_scratch_path", None)
            if path:
                remove_path(self.spark, path)

    def free(self) -> None:
        """Lets Spark delete the shuffle files of tables that have been written. Its cleaner
        follows the driver's garbage collector, which else runs every half hour; what the
        first collection finds is deleted in the background by the second."""
        for _ in range(2):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.5)

    def clear(self) -> None:
        remove_path(self.spark, self.base)
        _LIVE.pop(self.base, None)


@contextlib.contextmanager
def released() -> Iterator[None]:
    """Deletes the tables of all operators that were called within, for callers that write what
    they return before they leave."""
    before = set(_LIVE)
    try:
        yield
    finally:
        for base in set(_LIVE) - before:
            remove_path(_LIVE.pop(base), base)


@atexit.register
def _clear_all() -> None:
    for base, spark in list(_LIVE.items()):
        with contextlib.suppress(Exception):
            remove_path(spark, base)
