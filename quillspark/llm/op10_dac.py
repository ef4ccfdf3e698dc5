"""Token ids in directly addressable codes, with random access to any token.

A dataset is a folder of shard files in a format of its own, and an index of them. The ids of
a shard (one run of documents) are cut into chunks of ``CHUNK`` bits, lowest chunk first.
Level k holds the k-th chunk of every id that has one, as one byte each, and a bitmap with a
set bit where the id goes on in level k + 1. A rank directory per bitmap holds the number of
set bits before each block of ``BLOCK`` bits. Token i is read from level 0 at i; while its bit
is set, it goes on in the next level at rank(i). So one id takes at most three look-ups of a
few bytes each, and no block is decoded.

Shard file, integers little-endian but for the count of ids:

    "DAC2", number of levels (4 bytes), number of ids (8 bytes, big-endian), size of the
    documents section (8 bytes), ids in each level (8 bytes each); documents: an Arrow stream
    of doc_id and n_ids; per level: chunks, bitmap, rank directory (4 bytes each); a newline

The files are raw bytes, written by Spark's text writer with one record a file and read as
binary files, so that any store of the cluster serves and a lost task is written anew. File
names follow ascending doc_id: the input is range partitioned and each task writes its own
shards. ``index`` has a row per file with the number of ids before it.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.batches import bounded
from quillspark.llm.bpe import codec
from quillspark.plans.scratch import Scratch

CHUNK = 8
BLOCK = 512
SHARD_IDS = 1 << 20
MAGIC = b"DAC2"
HEAD = 24
#: Bytes of (compressed) input a task, where that makes more tasks than the session's setting.
TASK_BYTES = 64_000_000
#: What the planner says of tables it has no size of is beyond any size.
UNKNOWN = 1 << 55


def dac_encode(ids: np.ndarray, documents: bytes = b"") -> bytes:
    """The ids (unsigned, 32 bits) as one shard payload."""
    parts, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> CHUNK
        on = more > 0
        bits = np.packbits(on, bitorder="little")
        counts = np.add.reduceat(on, np.arange(0, len(on), BLOCK), dtype=np.int64) if len(on) else np.zeros(0, np.int64)
        directory = np.concatenate([[0], np.cumsum(counts)])[:-1] if len(counts) else counts
        parts.append((len(rest), (rest & 0xFF).astype(np.uint8).tobytes(), bits.tobytes(), directory.astype("<u4").tobytes()))
        rest = more[on]
        if not len(rest):
            break
    head = MAGIC + struct.pack("<I", len(parts)) + struct.pack(">Q", len(ids)) + struct.pack("<Q", len(documents)) + b"".join(struct.pack("<Q", p[0]) for p in parts)
    return head + documents + b"".join(b"".join(p[1:]) for p in parts)


class Dac:
    """Reads a shard in place, by a function that gives n bytes from an offset on, or from bytes."""

    def __init__(self, source: bytes | Callable[[int, int], bytes]):
        self._read = source if callable(source) else lambda at, n: source[at : at + n]
        head = self._read(0, HEAD)
        if head[:4] != MAGIC:
            raise ValueError("not a DAC shard")
        (levels,) = struct.unpack_from("<I", head, 4)
        (self._size,) = struct.unpack_from(">Q", head, 8)
        (documents,) = struct.unpack_from("<Q", head, 16)
        self.documents = HEAD + 8 * levels, documents
        at, self.levels = HEAD + 8 * levels + documents, []
        for n in struct.unpack(f"<{levels}Q", self._read(HEAD, 8 * levels)):
            bits = at + n
            directory = bits + -(-n // 8)
            self.levels.append((at, bits, directory))
            at = directory + 4 * -(-n // BLOCK)

    def __len__(self) -> int:
        return self._size

    def __getitem__(self, i: int) -> int:
        """The id at place i, by at most one rank a level."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value, shift = 0, 0
        for chunks, bits, directory in self.levels:
            value |= self._read(chunks + i, 1)[0] << shift
            if not self._read(bits + (i >> 3), 1)[0] >> (i & 7) & 1:
                break
            i, shift = self._rank(bits, directory, i), shift + CHUNK
        return value

    def _bits(self, bits: int, a: int, b: int) -> np.ndarray:
        raw = np.frombuffer(self._read(bits + (a >> 3), (b + 7 >> 3) - (a >> 3)), np.uint8)
        return np.unpackbits(raw, bitorder="little")[a & 7 :][: b - a]

    def _rank(self, bits: int, directory: int, i: int) -> int:
        block = i // BLOCK
        (before,) = struct.unpack("<I", self._read(directory + 4 * block, 4))
        return before + int(self._bits(bits, block * BLOCK, i).sum()) if i > block * BLOCK else before

    def slice(self, a: int, b: int) -> np.ndarray:
        """The ids at a <= i < b: one rank a level for the first, then a run in each level."""
        out, where, shift = np.zeros(b - a, np.uint32), np.arange(b - a), 0
        for chunks, bits, directory in self.levels:
            if a >= b:
                break
            out[where] |= np.frombuffer(self._read(chunks + a, b - a), np.uint8).astype(np.uint32) << np.uint32(shift)
            on = self._bits(bits, a, b).astype(bool)
            where, shift = where[on], shift + CHUNK
            n = int(on.sum())
            if not n:
                break
            a = self._rank(bits, directory, a)
            b = a + n
        return out


def _documents(keys: pa.Array, sizes: np.ndarray) -> bytes:
    table = pa.RecordBatch.from_arrays([keys, pa.array(sizes, pa.int64())], ["doc_id", "n_ids"])
    out = io.BytesIO()
    with pa.ipc.new_stream(out, table.schema) as stream:
        stream.write_batch(table)
    return out.getvalue()


def write(docs: DataFrame, folder: str, path: str, end_id: int = 0, text: str = "text") -> None:
    """Encodes every whole text, appends ``end_id`` and writes the dataset to ``folder``.

    Null texts count as empty: the end id alone. Ids may be of any type that can be sorted; rows
    of one doc_id stay together, in any order; rows without doc_id come first. An empty table
    writes an empty dataset. Other columns are not read. A shard closes at ``SHARD_IDS`` ids,
    between documents.
    """
    most = SHARD_IDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, keys, counts, size = codec(path), [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held, keys, counts, size
            payload = dac_encode(np.concatenate(held), _documents(pa.concat_arrays(keys), np.concatenate(counts)))
            held, keys, counts, size = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([payload], pa.binary())], ["payload"])

        for b in bounded(batches):
            ids, at = own.encode(b.column("text").to_pylist())
            ids, sizes = np.insert(ids, at[1:], end_id), np.diff(at) + 1
            ends, first = np.cumsum(sizes), 0
            while first < len(sizes):
                begin = int(ends[first] - sizes[first])
                last = min(int(np.searchsorted(ends, begin + most - size)), len(sizes) - 1)  # the document that fills the shard
                held.append(ids[begin : ends[last]])
                keys.append(b.column("doc_id").slice(first, last + 1 - first))
                counts.append(sizes[first : last + 1])
                size += int(ends[last]) - begin
                first = last + 1
                if size >= most:
                    yield flush()
        if size:
            yield flush()

    spark = docs.sparkSession
    base = docs.select("doc_id", F.col(f"`{text}`").alias("text"))
    known = int(str(base._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), known // TASK_BYTES if known < UNKNOWN else 0)
    ordered = base.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    shards = ordered.mapInArrow(run, "payload binary").select(F.col("payload").cast("string").alias("value"))
    shards.write.option("maxRecordsPerFile", 1).text(f"{folder}/shards")
    _index(spark, folder).write.parquet(f"{folder}/index")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """Every shard file: name, number of the task that wrote it, number within, content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/shards").where("length > 0")
    part, nth = (F.regexp_extract("path", r"/part-(\d+)-[^/]*-c(\d+)[^/-]*$", k).cast("long") for k in (1, 2))
    return files.select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), part.alias("part"), nth.alias("nth"), "content")


def _index(spark: SparkSession, folder: str) -> DataFrame:
    """``name``, ``start`` and ``n_ids`` of every shard, from the heads of the files."""
    n = F.conv(F.hex(F.substring("content", 9, 8)), 16, 10).cast("long")
    heads = _files(spark, folder).select("name", "part", "nth", n.alias("n_ids"))
    before = F.sum("n_ids").over(Window.partitionBy("part").orderBy("nth")) - F.col("n_ids")
    # one row per task of the writing job: bounded by the number of tasks, not by rows
    parts = heads.groupBy("part").agg(F.sum("n_ids").alias("total")).select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    return heads.withColumn("before", before).join(parts, "part").select("name", (F.col("base") + F.col("before")).alias("start"), "n_ids")


def read(spark: SparkSession, folder: str, digest: bool = False, id_type: str = "bigint") -> DataFrame:
    """Per document: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and
    ``ids`` as little-endian 32-bit integers, or with ``digest`` their ``ids_crc32`` instead.
    Each file is read by itself; its start joins the rows by its name."""
    last = "ids_crc32 bigint" if digest else "ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                payload = b.column("content")[i].as_buffer()
                dac = Dac(memoryview(payload))
                at, size = dac.documents
                documents = pa.ipc.open_stream(payload.slice(at, size)).read_all().combine_chunks()
                keys, sizes = documents.column("doc_id").chunk(0), documents.column("n_ids").to_numpy()
                begin = np.cumsum(sizes) - sizes
                for k in range(0, len(keys), 2000):
                    p, m = begin[k : k + 2000], sizes[k : k + 2000]
                    ids = dac.slice(int(p[0]), int(p[-1] + m[-1])).astype("<u4")  # documents follow each other
                    raw = [ids[x : x + y].tobytes() for x, y in zip((p - p[0]).tolist(), m.tolist(), strict=True)]
                    out = pa.array([zlib.crc32(r) for r in raw], pa.int64()) if digest else pa.array(raw, pa.binary())
                    name = pa.array([b.column("name")[i].as_py()] * len(p), pa.string())
                    yield pa.RecordBatch.from_arrays([name, keys.slice(k, 2000), pa.array(p), pa.array(m), out], ["name", "doc_id", "place", "n_tokens", last.split()[0]])

    rows = _files(spark, folder).select("name", "content").mapInArrow(run, f"name string, doc_id {id_type}, place bigint, n_tokens bigint, {last}")
    starts = spark.read.schema("name string, start bigint, n_ids bigint").parquet(f"{folder}/index")
    return rows.join(starts, "name").select("doc_id", (F.col("start") + F.col("place")).alias("start"), "n_tokens", last.split()[0])


def token(spark: SparkSession, folder: str, i: int) -> int:
    """Token i of a dataset: the index tells the file, and of that a few bytes are read where
    they lie, through the file system of the cluster."""
    row = spark.read.schema("name string, start bigint, n_ids bigint").parquet(f"{folder}/index").where((F.col("start") <= i) & (F.col("start") + F.col("n_ids") > i)).first()
    if row is None:
        raise IndexError(i)
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/shards/{row['name']}")
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)

    def piece(at: int, n: int) -> bytes:
        stream.seek(at)
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))

    try:
        return Dac(piece)[i - row["start"]]
    finally:
        stream.close()


def store_and_index(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Writes the dataset to the shared scratch folder, reads it back and returns per
    document ``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32``."""
    spark = docs.sparkSession
    folder = Scratch(spark, "dac").path("ids")
    write(docs, folder, path, end_id)
    return read(spark, folder, digest=True, id_type=docs.schema["doc_id"].dataType.simpleString())
