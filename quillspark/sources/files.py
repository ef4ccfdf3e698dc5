"""Scans of document collections: folders, lists, inline texts, CSV rows, tagged text."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.text import decode_utf8
from quillspark.operators.index import infer_document_id, numbered

_FIELDS = {"internal_id": "bigint", "document_id": "bigint", "rendition_id": "bigint", "file_path": "string", "content": "string"}


def read_folder(spark: SparkSession, data_dir: str, file_pattern: str = ".*", dir_pattern: str = ".*", offset: int = 0, infer_ids: bool = False) -> DataFrame:
    """``internal_id``, ``file_path``, ``text`` of all files below a folder whose name and
    folder match the patterns from their start, in the order of their paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(data_dir)
    path = F.regexp_replace("path", "^file:/*", "/")
    rows = files.select(path.alias("file_path"), decode_utf8(F.col("content")).alias("text"))
    name, folder = F.element_at(F.split("file_path", "/"), -1), F.regexp_replace("file_path", "/[^/]*$", "")
    chosen = rows.where(name.rlike(f"^(?:{file_pattern})") & folder.rlike(f"^(?:{dir_pattern})"))
    out = numbered(chosen, ["file_path"], offset)
    return infer_document_id(out) if infer_ids else out


def from_list(spark: SparkSession, metadata: Sequence[Mapping], offset: int = 0) -> DataFrame:
    """An index from rows with ``file_path`` (sorted by it, paths normalized) or with
    ``content`` (in the order given); all rows need the one or the other. Paths win."""
    rows = [dict(m) for m in metadata]
    by_path = all(r.get("file_path") for r in rows)
    if not rows or not (by_path or all(r.get("content") is not None for r in rows)):
        raise ValueError("all rows need file_path, or all rows need content")
    if by_path:
        rows = sorted(({k: v for k, v in r.items() if k != "content"} | {"file_path": os.path.normpath(r["file_path"])} for r in rows), key=lambda r: r["file_path"])
    names = list(dict.fromkeys(k for r in rows for k in r if k != "internal_id"))
    kinds = {n: _FIELDS.get(n) for n in names}
    if any(isinstance(r.get("document_id"), str) for r in rows):
        kinds["document_id"] = "string"
    fields = [T.StructField("internal_id", T.LongType(), False)]
    for n in names:
        kind = kinds[n] or ("double" if any(isinstance(r.get(n), float) for r in rows) else "bigint" if all(isinstance(r.get(n), (int, type(None))) for r in rows) else "string")
        fields.append(T.StructField(n, T._parse_datatype_string(kind)))
    return spark.createDataFrame([(offset + i, *(r.get(n) for n in names)) for i, r in enumerate(rows)], T.StructType(fields))


def with_text(index: DataFrame) -> DataFrame:
    """The index with the decoded ``text`` of its files, or its inline content."""
    if "content" in index.columns:
        return index.withColumnRenamed("content", "text")
    spark = index.sparkSession
    folders = [r[0] for r in index.select(F.regexp_replace("file_path", "/[^/]*$", "")).distinct().collect()]
    files = spark.read.format("binaryFile").load(folders)
    texts = files.select(F.regexp_replace("path", "^file:/*", "/").alias("file_path"), decode_utf8(F.col("content")).alias("text"))
    return index.join(texts, "file_path", "left")


def read_csv(spark: SparkSession, path: str, column_ids: Sequence[int], separator: str = ",", joiner: str = "") -> DataFrame:
    """One document per row of one file without header: ``document_id`` (row number),
    ``file_path`` (path:row) and ``text``, the chosen columns joined."""
    rows = spark.read.option("sep", separator).option("header", False).csv(path)
    picked = F.concat_ws(joiner, *[F.col(f"_c{i}").cast("string") for i in column_ids])
    out = numbered(rows.select(picked.alias("text")).withColumn("__at", F.monotonically_increasing_id()), ["__at"], name="document_id").drop("__at")
    return out.select("document_id", F.concat(F.lit(f"{path}:"), F.col("document_id").cast("string")).alias("file_path"), "text")


def read_tagged(spark: SparkSession, path: str) -> DataFrame:
    """``document_id``, ``text`` of files of ``.I <id>`` and ``.W`` blocks; lines of a block are
    joined by a space. A file must begin with a tag. Blocks are the records of the scan, so a large
    file is read by many tasks and a task holds a block at a time."""
    read = spark.read.option("lineSep", "\n.I ").text(path)
    records = read.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    first = records.where("start = 0").groupBy("file").agg(F.min_by("value", "at").alias("value"))  # a record per file
    if not first.where(~F.col("value").rlike(r"^\s*\.[A-Z]\b")).isEmpty():
        raise ValueError("the file does not begin with a tag")
    # the scan has taken the tag of all records but the first; what stands before the first block is none
    blocks = records.where(~F.col("value").rlike(r"^\s*\.[A-HJ-Z]\b")).select(F.regexp_replace("value", r"^\s*\.I ", "").alias("b")).where(F.trim("b") != "")
    parts = F.split("b", r"(?m)^\.W\s*$")
    body = F.trim(F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"\s*\n\s*", " "))
    return blocks.select(F.trim(F.regexp_extract("b", r"^\s*(\S+)", 1)).cast("bigint").alias("document_id"), body.alias("text"))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """``file_path``, ``is_relevant`` of lines of two fields."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("file_path"), parts[1].cast("int").alias("is_relevant"))


def example_ids(docs: DataFrame, categories: Sequence[str] | None = None, category: str = "category", train_share: float = 0.5, seed: int = 999998) -> DataFrame:
    """An example dataset: rows of the categories, ``document_id`` the square of
    ``internal_id``, and a reproducible ``is_train`` flag."""
    kept = docs if categories is None else docs.where(F.col(category).isin(list(categories)))
    share = F.pmod(F.xxhash64("internal_id", F.lit(seed)), F.lit(1_000_000)) < int(train_share * 1_000_000)
    return kept.withColumns({"document_id": F.col("internal_id") * F.col("internal_id"), "is_train": share})


def common_root(paths: Sequence[str]) -> str:
    return os.path.commonpath(list(paths)) if paths else ""


def valid_id(name: str) -> bool:
    """Names of stored datasets and models."""
    return bool(re.fullmatch(r"[A-Za-z0-9_\-]{2,50}", name))
