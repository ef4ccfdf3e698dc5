"""Ranked lexical search by WAND over shards of documents.

One pass over the texts writes the postings of the queries' terms, a row per document; statistics
are sums over that table. Each task then reads its part of the table in shards of a bounded number
of postings, turns a shard into lists by term, ascending by document, with the greatest impact of
each list, and goes through all queries. Of a query, the lists are ordered by their maxima; from the
pivot on, the first list at which the sum of maxima reaches the heap's threshold, a list can bring
documents in, and documents that only stand in lists before it are skipped unseen. A document becomes
a pivot and is scored if the maxima of the lists that hold it reach the threshold; the pivots of a
stretch of documents are found at once, and every scored stretch raises the threshold of the next.
The heap of a query goes on from shard to shard of a task, and the heaps of all tasks are merged by
one grouped limit. Scores are exact integers.

The queries' terms travel as a broadcast in slices of bounded size; every slice is a pass over the
texts. Defined results: a null text or one without terms is no document; rows of one doc_id are
documents of their own, equal rows included; of equal scores the least doc_id comes first, null
before all. Equal rows of a query count once, and different texts of one query id are one query.
Empty tables give no rows, texts are read whole, and other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.batches import bounded
from quillspark.operators.running import running_sums
from quillspark.plans.scratch import Scratch

#: Fixed by the contract: a term is a run of ASCII letters and digits or of characters beyond ASCII.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Fixed by the contract: least length factor, weight of the length, and scales of the score.
BASE, SLOPE, SCALE, TF_SCALE, LENGTH_SCALE = 25, 75, 1_000_000_000, 1000, 8
#: (query, term) rows of a slice; one longer query makes a slice of its own.
SLICE_ROWS = 2_000_000
#: Postings and documents of a shard in memory.
SHARD_POSTINGS, SHARD_DOCS = 2_000_000, 8192
#: Pivots that are scored together first; each further stretch is twice as long.
STRETCH = 64


def terms(text: str | None) -> list[str]:
    """The terms of a whole text, only A-Z in lower case."""
    if not text:
        return []
    return TERM.findall(text.lower() if text.isascii() else text.encode().lower().decode())


class Queries:
    """The queries of a slice as parallel arrays: terms by number, with their counts."""

    def __init__(self, rows: list[tuple[int, str, int]]):
        rows = sorted(rows)
        self.vocabulary = {t: i for i, t in enumerate(sorted({r[1] for r in rows}))}
        self.keys = sorted({r[0] for r in rows})
        number = {k: i for i, k in enumerate(self.keys)}
        owner = np.array([number[r[0]] for r in rows], np.int64)
        self.begin = np.searchsorted(owner, np.arange(len(self.keys) + 1))
        self.term = np.array([self.vocabulary[r[1]] for r in rows], np.int64)
        self.times = np.array([r[2] for r in rows], np.int64)

    def __len__(self) -> int:
        return len(self.keys)


class Shard:
    """Inverted lists over some documents: of each term the documents, ascending, their impacts,
    and the greatest of these."""

    def __init__(self, sizes: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int):
        doc = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(term, kind="stable")
        self.doc, self.impact = doc[order], impact[order]
        self.begin = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.most = np.zeros(n_terms, np.int64)
        some = np.flatnonzero(np.diff(self.begin))
        if len(some):
            self.most[some] = np.maximum.reduceat(self.impact, self.begin[some])
        self.bound = np.zeros(len(sizes), np.int64)  # of the query at hand; zero between queries

    def holds(self, t: int, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the documents stand in a list, and their impacts there."""
        a, b = self.begin[t], self.begin[t + 1]
        at = np.minimum(np.searchsorted(self.doc[a:b], docs) + a, b - 1)
        return self.doc[at] == docs, self.impact[at]

    def pivots(self, lists: np.ndarray, most: np.ndarray, before: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents whose lists' maxima reach the threshold, and these sums. ``lists`` ascend by
        their maxima ``most``; ``before`` has the sum of the maxima up to each."""
        pivot = int(np.searchsorted(before, threshold))
        for t, m in zip(lists[pivot:].tolist(), most[pivot:].tolist(), strict=True):
            self.bound[self.doc[self.begin[t] : self.begin[t + 1]]] += m
        docs = np.flatnonzero(self.bound)
        bound = self.bound[docs]
        self.bound[docs] = 0
        for j in range(pivot - 1, -1, -1):
            near = bound + before[j] >= threshold
            docs, bound = docs[near], bound[near]
            if not len(docs):
                break
            bound = bound + np.where(self.holds(int(lists[j]), docs)[0], most[j], 0)
        near = bound >= threshold
        return docs[near], bound[near]

    def best(self, lists: np.ndarray, times: np.ndarray, k: int, floor: int, full: bool) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents with scores that may be among the ``k`` best: all that reach the k-th score,
        and how many were scored. ``floor`` is the k-th score so far if the heap is ``full``."""
        none = np.zeros(0, np.int64)
        known = self.begin[lists + 1] > self.begin[lists]
        lists, times = lists[known], times[known]
        most = self.most[lists] * times
        order = np.argsort(most, kind="stable")
        lists, times, most = lists[order], times[order], most[order]
        before = np.cumsum(most)
        threshold = max(floor, 1) if full else 1
        if not len(lists) or before[-1] < threshold:
            return none, none, 0
        docs, bound = self.pivots(lists, most, before, threshold)
        found, scores, kept, scored, stretch = [], [], none, 0, STRETCH
        while len(docs):
            now = docs[:stretch]
            score = np.zeros(len(now), np.int64)
            for t, c in zip(lists.tolist(), times.tolist(), strict=True):
                there, impact = self.holds(t, now)
                score += np.where(there, impact * c, 0)
            scored += len(now)
            found.append(now)
            scores.append(score)
            kept = np.sort(np.concatenate([kept, score]))[-k:]
            if len(kept) == k:  # k documents of this shard alone reach so much
                threshold = max(threshold, int(kept[0]))
            docs, bound = docs[stretch:], bound[stretch:]
            near = bound >= threshold
            docs, bound = docs[near], bound[near]
            stretch *= 2
        if not found:
            return none, none, scored
        docs, score = np.concatenate(found), np.concatenate(scores)
        near = score >= threshold
        return docs[near], score[near], scored


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What an occurrence of a term adds to a score: its weight by its frequency in the document
    against the document's length."""
    m = BASE + (SLOPE * n * documents) // length
    return weight * ((SCALE * tf) // (TF_SCALE * tf + LENGTH_SCALE * m))


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)


def _postings(docs: DataFrame, told: Broadcast[Queries]) -> DataFrame:
    """Per document with a term: ``doc_id``, ``n`` (its terms with repeats), and the queries' terms in
    it by number, with their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = told.value.vocabulary
        known = number.keys()
        for b in bounded(batches):
            n, sizes, at, tf = [], [], [], []
            for text in b.column("text").to_pylist():
                words = terms(text)
                n.append(len(words))
                counts = Counter(words)
                both = known & counts.keys()
                sizes.append(len(both))
                at.extend(map(number.__getitem__, both))
                tf.extend(map(counts.__getitem__, both))
            n = np.array(n, np.int64)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (at, tf)]
            out = pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), *lists], ["doc_id", "n", "term", "tf"])
            yield out.filter(pa.array(n > 0))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n bigint, term array<int>, tf array<int>")


def _heaps(postings: DataFrame, told: Broadcast[Queries], df: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """``query``, ``doc_id``, ``score``: of each query the best ``k`` of each task."""
    most_postings, most_docs = SHARD_POSTINGS, SHARD_DOCS

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, rows, size = [], 0, 0
        for b in batches:
            lengths = pc.fill_null(pc.list_value_length(b.column("term")), 0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(np.maximum(np.cumsum(lengths) // most_postings, np.arange(1, len(lengths) + 1) // most_docs))) + 1
            for part in (b.slice(x, y - x) for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True)):
                more = len(part.column("term").flatten())
                if held and (size + more > most_postings or rows + part.num_rows > most_docs):
                    yield pa.Table.from_batches(held)
                    held, rows, size = [], 0, 0
                held.append(part)
                rows, size = rows + part.num_rows, size + more
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = told.value
        weight = weights(df, documents)
        heaps: dict[int, pa.Table] = {}
        floor = np.zeros(len(queries), np.int64)
        full = np.zeros(len(queries), bool)
        ids: pa.DataType | None = None
        for table in shards(batches):
            table = table.combine_chunks()
            term, tf = (table.column(c).chunk(0).flatten().to_numpy().astype(np.int64) for c in ("term", "tf"))
            sizes = pc.list_value_length(table.column("term").chunk(0)).to_numpy().astype(np.int64)
            n = np.repeat(table.column("n").to_numpy(), sizes)
            shard = Shard(sizes, term, impacts(weight[term], tf, n, documents, length), len(weight))
            keys = table.column("doc_id")
            ids = keys.type
            for q in range(len(queries)):
                own = slice(queries.begin[q], queries.begin[q + 1])
                docs, score, _ = shard.best(queries.term[own], queries.times[own], k, int(floor[q]), bool(full[q]))
                if not len(docs):
                    continue
                new = pa.table({"doc_id": keys.take(pa.array(docs)), "score": score})
                heaps[q] = heap = _highest(pa.concat_tables([heaps[q], new]) if q in heaps else new, k)
                full[q] = heap.num_rows == k
                floor[q] = heap.column("score")[heap.num_rows - 1].as_py()
        for q, heap in heaps.items():
            heap = heap.combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.array([queries.keys[q]] * heap.num_rows, pa.int64()), heap.column("doc_id").chunk(0).cast(ids), heap.column("score").chunk(0)], ["query", "doc_id", "score"])

    return postings.mapInArrow(run, f"query bigint, doc_id {postings.schema['doc_id'].dataType.simpleString()}, score bigint")


def _highest(rows: pa.Table, k: int) -> pa.Table:
    """The k best rows, of equal scores the least id first, null before all."""
    missing = pc.is_valid(rows.column("doc_id"))
    order = pc.sort_indices(rows.append_column("known", missing.cast(pa.int8())), sort_keys=[("score", "descending"), ("known", "ascending"), ("doc_id", "ascending")])
    return rows.take(order[:k])


def search(docs: DataFrame, queries: DataFrame, k: int = 10, doc_id: str = "doc_id", query_id: str = "query_id", text: str = "text") -> DataFrame:
    """Per query its ``k`` best documents with a score above 0: ``query_id``, ``rank`` from 1,
    ``doc_id``, ``score``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "wand")
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    asked = queries.select(F.col(f"`{query_id}`").alias("query_id"), F.col(f"`{text}`").alias("text")).where("text is not null").distinct()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [Counter(terms(t)) for t in b.column("text").to_pylist()]
            parents = pa.array(np.repeat(np.arange(b.num_rows), [len(c) for c in counts]))
            columns = [b.column("query_id").take(parents), pa.array([t for c in counts for t in c], pa.string()), pa.array([x for c in counts for x in c.values()], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "term", "times"])

    kind = queries.schema[query_id].dataType.simpleString()
    rows = asked.mapInArrow(counted, f"query_id {kind}, term string, times bigint").groupBy("query_id", "term").agg(F.sum("times").alias("times"))
    rows = scratch.save(rows, "queries", narrow=True)
    sizes = scratch.save(rows.groupBy("query_id").agg(F.count("*").alias("size")).withColumn("query", F.monotonically_increasing_id()), "sizes", narrow=True)
    sliced = running_sums(sizes, ["query"], {"size": "upto"}).withColumn("slice", F.floor((F.col("upto") - 1) / SLICE_ROWS))
    sliced = scratch.save(sliced.drop("size", "upto"), "slices", narrow=True)
    numbered = rows.join(sliced, rows["query_id"].eqNullSafe(sliced["query_id"])).select("query", "slice", "term", "times")
    out = None
    for (part,) in sliced.select("slice").distinct().orderBy("slice").collect():  # a row for each slice
        own = Queries([tuple(r) for r in numbered.where(F.col("slice") == part).select("query", "term", "times").collect()])  # at most SLICE_ROWS, or one query
        told = spark.sparkContext.broadcast(own)
        postings = scratch.save(_postings(base, told), "postings")
        documents, length = postings.agg(F.count("*"), F.sum("n")).first()
        if not documents:
            break
        df = np.zeros(len(own.vocabulary), np.int64)
        for t, x in postings.select(F.explode("term").alias("t")).groupBy("t").agg(F.count("*")).collect():  # terms of the slice
            df[t] = x
        heaps = _heaps(postings, told, df, documents, length, k)
        out = heaps if out is None else out.union(heaps)
    if out is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, doc_id {docs.schema[doc_id].dataType.simpleString()}, score bigint")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first()))
    ranked = out.withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.join(sliced.select("query", "query_id"), "query").select("query_id", "rank", "doc_id", "score")
