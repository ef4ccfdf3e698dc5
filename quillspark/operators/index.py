"""Document index: keys, ordered look-up, subsets, appending and removing, paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.running import numbered

KEYS = (("internal_id",), ("document_id", "rendition_id"), ("document_id",), ("file_path",))


class NotFound(LookupError):
    """A key of a query is not in the index."""


def key_of(columns: Sequence[str]) -> tuple[str, ...]:
    """The key to look up by: the first of the known keys that the columns hold."""
    for key in KEYS:
        if all(k in columns for k in key):
            return key
    raise ValueError(f"none of {KEYS} among {list(columns)}")


def check_unique(index: DataFrame) -> None:
    """``document_id`` is unique, with ``rendition_id`` if there is one."""
    key = [c for c in ("document_id", "rendition_id") if c in index.columns]
    if key and not index.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError(f"{' and '.join(key)} must be unique")


def search(index: DataFrame, query: DataFrame, drop: bool = True, strict: bool = True) -> DataFrame:
    """Rows of ``index`` for the keys of ``query``, one per query row, with ``sort_order``, the
    query's own if it has that column. ``drop`` leaves out other columns of the query."""
    key = key_of([c for c in query.columns if c in index.columns])
    if "sort_order" not in query.columns:
        query = numbered(query.withColumn("__at", F.monotonically_increasing_id()), ["__at"], name="sort_order").drop("__at")
    if strict and not query.join(index, list(key), "left_anti").isEmpty():
        raise NotFound(f"keys {key} that the index lacks")
    more = [] if drop else [c for c in query.columns if c not in index.columns and c != "sort_order"]
    return query.select(*key, "sort_order", *more).join(index, list(key)).select(*index.columns, *more, "sort_order").orderBy("sort_order")


def render(results: DataFrame, index: DataFrame, on: str = "internal_id") -> DataFrame:
    """Results with the columns of the index; results it lacks keep nulls."""
    return results.join(index, on, "left")


def subset(results: DataFrame, ids: DataFrame, on: str = "doc_id", complement: bool = False) -> DataFrame:
    """Results of the given ids, or of all others; unknown ids are ignored."""
    return results.join(ids.select(on).distinct(), on, "left_anti" if complement else "left_semi")


def remove(index: DataFrame, keys: DataFrame, renumber: bool = True) -> DataFrame:
    """The index without the keys; ``internal_id`` is made consecutive again."""
    key = list(key_of([c for c in keys.columns if c in index.columns]))
    left = index.join(keys.select(*key).distinct(), key, "left_anti")
    return _renumbered(left) if renumber and "internal_id" in index.columns else left


def _renumbered(index: DataFrame) -> DataFrame:
    columns = index.columns
    return numbered(index.withColumnRenamed("internal_id", "__old"), ["__old"]).drop("__old").select(*columns)


def append(index: DataFrame, more: DataFrame) -> DataFrame:
    """The index with rows after its last number, in the order of their own number or path."""
    last = index.agg(F.coalesce(F.max("internal_id"), F.lit(-1))).first()[0]
    order = ["internal_id"] if "internal_id" in more.columns else ["file_path"]
    added = numbered(more.withColumnRenamed("internal_id", "__own"), ["__own"] if order == ["internal_id"] else order, offset=last + 1).drop("__own")
    return index.unionByName(added, allowMissingColumns=True)


def infer_document_id(paths: DataFrame, path: str = "file_path") -> DataFrame:
    """``document_id`` from the digits of the file names; if a name has none or two names
    agree, the internal id."""
    digits = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\D", "")
    tried = paths.withColumn("__id", F.when(F.length(digits) > 0, digits.cast("bigint")))
    bad, n, distinct = tried.agg(F.count_if(F.col("__id").isNull()), F.count("*"), F.count_distinct("__id")).first()
    chosen = F.col("__id") if not bad and n == distinct else F.col("internal_id").cast("bigint")
    return tried.withColumn("document_id", chosen).drop("__id")


def sampled(index: DataFrame, names: DataFrame, on: str = "file_path") -> DataFrame:
    """Rows of the index as often as ``names`` holds them."""
    return names.select(on).join(index, on)


def page(results: DataFrame, order: Sequence[str | Column], batch_id: int = 0, batch_size: int | None = None, max_results: int = 0) -> tuple[DataFrame, dict[str, int]]:
    """A page of ordered results and its counts. ``max_results`` of 0 or less means all,
    ``batch_id`` -1 the first page that holds all. ``batch_id_last`` is the quotient of total
    and size, one more than the last page if it divides."""
    ordered = results.orderBy(*order)
    if max_results > 0:
        ordered = ordered.limit(max_results)
    total = ordered.count()
    size = total if batch_id == -1 or not batch_size else batch_size
    start = 0 if batch_id == -1 else batch_id * size
    shown = ordered.offset(start).limit(size) if size else ordered.limit(0)
    info = {"total_response_count": total, "current_response_count": max(0, min(size, total - start)), "batch_id": max(batch_id, 0), "batch_id_last": total // size if size else 0}
    return shown, info
