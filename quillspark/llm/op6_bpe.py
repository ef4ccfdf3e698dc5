"""Byte-level BPE encoding and decoding over Arrow batches.

``encode`` adds ids and, if asked, the span of each token in bytes and characters;
``decode`` reverses the byte table over the ids of a whole document, so characters that
are split over tokens come back complete. Both are narrow: no shuffle, no state between
rows. A null text gives no ids, an empty text an empty list, and decoding either gives
an empty result; repeated rows are coded each for itself; other columns pass through
``encode`` unless they have the name of an output column, which replaces them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.batches import bounded
from quillspark.llm.bpe import codec


def encode(docs: DataFrame, path: str, pattern: str | None = None, text: str = "text", offsets: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (array of int), and with ``char_start`` and ``char_end``
    (arrays of long) if ``offsets``."""
    outputs = ["ids", *(["char_start", "char_end"] if offsets else [])]
    kept = [c for c in docs.columns if c not in outputs]
    base = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__qs_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1]), "ids array<int>"])
    schema += ", char_start array<bigint>, char_end array<bigint>" * offsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in bounded(batches, "__qs_text"):
            texts = b.column("__qs_text").to_pylist()
            ids, at = own.encode(texts)
            columns, names = [b.column(i) for i in range(b.num_columns - 1)], b.schema.names[:-1]
            ends = pa.array(at, pa.int32())
            columns.append(pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int32))))
            if offsets:
                spans = [own.char_offsets(ids[i:j]) for i, j in zip(at, at[1:], strict=False)]
                both = np.concatenate(spans) if spans else np.zeros((0, 2), np.int64)
                columns += [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(both[:, k]))) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, [*names, *outputs])

    return base.mapInArrow(run, schema)


def decode(coded: DataFrame, path: str, pattern: str | None = None, ids: str = "ids") -> DataFrame:
    """``coded`` with ``decoded`` (binary). Null ids give empty bytes."""
    base = coded.drop("decoded")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields), "decoded binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            raw = [own.decode(np.array(x or [], dtype=np.int64)) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(raw, pa.binary())], [*b.schema.names, "decoded"])

    return base.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str | None = None, text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_tokens``, ``ids_sha256`` of the decimal ids joined by
    commas, and ``decoded_sha256`` of the bytes decoded from those ids. Encodes and
    decodes within one pass, so no id list leaves the Python worker. A null text counts
    as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in bounded(batches):
            ids, at = own.encode(b.column("text").to_pylist())
            coded, decoded = [], []
            for i, j in zip(at, at[1:], strict=False):
                part = ids[i:j]
                coded.append(hashlib.sha256(",".join(map(str, part.tolist())).encode()).hexdigest())
                decoded.append(hashlib.sha256(own.decode(part)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(at)), pa.array(coded), pa.array(decoded)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    base = docs.select(F.col("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
