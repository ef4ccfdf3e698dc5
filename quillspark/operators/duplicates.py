"""Near-duplicates: simhash with banded look-up, I-Match, exact groups, merged clusterings."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.components import connected_components
from quillspark.operators.running import with_group_size
from quillspark.plans.scratch import Scratch

BITS = 64


def simhash(terms: DataFrame, hashed: Column | None = None, bits: int = BITS, distinct: bool = False) -> DataFrame:
    """``doc_id``, ``simhash``: a majority vote of the bits of the hashes of a document's
    distinct terms. ``terms`` has doc_id, term; weights do not count. One aggregation with
    partial sums per bit. ``distinct`` tells that no document has a term twice."""
    h = F.xxhash64("term") if hashed is None else hashed
    rows = terms.select("doc_id", "term")
    rows = (rows if distinct else rows.distinct()).select("doc_id", h.alias("h"))
    votes = [F.sum(F.shiftrightunsigned("h", b).bitwiseAND(F.lit(1)) * 2 - 1).alias(f"b{b}") for b in range(bits)]
    value = reduce(lambda x, b: x.bitwiseOR(F.shiftleft((F.col(f"b{b}") > 0).cast("long"), b)), range(bits), F.lit(0).cast("long"))
    return rows.groupBy("doc_id").agg(*votes).select("doc_id", value.alias("simhash"))


def _tables(distance: int) -> tuple[int, list[tuple[int, ...]]]:
    """The number of blocks, and the sets of them that must agree, one look-up table each: of n blocks any n - distance, so
    that whichever ``distance`` blocks the differing bits lie in, a table spares them."""
    n = max(distance + 1, min(2 * distance, 6), 3 if distance == 1 else 1)
    return n, list(combinations(range(n), n - distance))


def hamming_pairs(hashes: DataFrame, distance: int = 1, bits: int = BITS, scratch: Scratch | None = None) -> DataFrame:
    """``a``, ``b``, ``distance`` of distinct hash values within the distance, a < b.

    Values are cut into blocks, and for each set of blocks that must agree they meet by those:
    for 3 of 64 bits six blocks, twenty tables and keys of 32 bits, so that few values meet by
    chance in any table. A pair is told by the first table in which it meets. The written values are
    few bytes, but dealt to the tables they are many rows: neither side is ever told to all tasks,
    which the driver would have to hold. Documents with equal values are one value here: expand by the hash.
    """
    if not 0 <= distance < bits:
        raise ValueError(f"distance lies in [0, {bits})")
    n, tables = _tables(distance)
    cuts = [bits * k // n for k in range(n + 1)]
    of = lambda chosen: sum(((1 << (cuts[k + 1] - cuts[k])) - 1) << cuts[k] for k in chosen)
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    masks = [F.lit(signed(of(chosen))).cast("long") for chosen in tables]
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col("v").bitwiseAND(mask).alias("x")) for k, mask in enumerate(masks)])
    # written, so that the texts are read and hashed once and the sizes of what is joined are known
    values = (scratch or Scratch(hashes.sparkSession, "hamming")).save(hashes.select(F.col("simhash").alias("v")).distinct(), "distinct", narrow=True)
    dealt = values.select("v", F.explode(keys).alias("key")).select("v", "key.k", "key.x")
    left, right = dealt.withColumnRenamed("v", "a"), dealt.withColumnRenamed("v", "b")
    other = F.col("a").bitwiseXOR(F.col("b"))
    first = F.coalesce(*[F.when(other.bitwiseAND(mask) == 0, F.lit(k)) for k, mask in enumerate(masks)])
    met = left.hint("merge").join(right, ["k", "x"]).where((F.col("a") < F.col("b")) & (F.bit_count(other) <= distance) & (F.col("k") == first))
    return met.select("a", "b", F.bit_count(other).cast("int").alias("distance"))


def simhash_clusters(hashes: DataFrame, distance: int = 1, bits: int = BITS) -> DataFrame:
    """``doc_id``, ``cluster_id`` (least doc_id): components of values within the distance."""
    scratch = Scratch(hashes.sparkSession, "simhash")
    values = scratch.save(hashes.groupBy("simhash").agg(F.min("doc_id").alias("rep")), "values")
    pairs = hamming_pairs(values, distance, bits, scratch)
    of = lambda c: values.select(F.col("simhash").alias(c), F.col("rep").alias(f"rep_{c}"))
    links = pairs.join(of("a"), "a").join(of("b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    labels = connected_components(links, scratch)
    rep = values.join(labels, F.col("rep") == F.col("node"), "left").select("simhash", F.coalesce("label", "rep").alias("cluster_id"))
    return hashes.join(rep, "simhash").select("doc_id", "cluster_id")


def exact_groups(hashes: DataFrame, column: str = "simhash") -> DataFrame:
    """``doc_id``, ``cluster_id``: the least doc_id with the same value."""
    # written, so that a very common value can be split where it is joined
    least = Scratch(hashes.sparkSession, "groups").save(hashes.groupBy(column).agg(F.min("doc_id").alias("cluster_id")), "least")
    return hashes.join(least, column).select("doc_id", "cluster_id")


#: Hex digits of a term's md5 that decide on a lexicon, and lexicons by one md5.
DIGITS, PER_HASH = 3, 10


def in_lexicon(term_hash: Column, j: int, ratio: float) -> Column:
    """Whether a term is in the random lexicon j (from 1), by three digits of its hash."""
    at = 1 + DIGITS * ((j - 1) % PER_HASH)
    return F.substring(term_hash, at, DIGITS) < F.lit(f"{round(16**DIGITS * ratio):0{DIGITS}x}")


def imatch(terms: DataFrame, n_rand_lexicons: int = 1, rand_lexicon_ratio: float = 0.7) -> DataFrame:
    """``doc_id`` and ``h0``, ``h1``...: fingerprints of the ordered distinct terms under the
    whole lexicon and under random ones, which keep a term by digits of its md5, so they are
    reproducible by any engine."""
    if n_rand_lexicons < 1 or not 0 < rand_lexicon_ratio < 1:
        raise ValueError("at least one lexicon, and a ratio within (0, 1)")
    words = terms.select("doc_id", "term").distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list("term")).alias("w"))
    hashes = [F.xxhash64(F.col("w")).alias("h0")]
    rounds = -(-(n_rand_lexicons - 1) // PER_HASH)
    if rounds:
        salted = lambda t, r: F.md5(F.concat(F.lit(f"{r}:"), t) if r else t)
        words = words.select("doc_id", F.transform("w", lambda t: F.struct(t.alias("t"), *[salted(t, r).alias(f"m{r}") for r in range(rounds)])).alias("w"))
        hashes = [F.xxhash64(F.col("w.t")).alias("h0")]

    def within(j: int) -> Column:
        kept = F.filter("w", lambda x: in_lexicon(x[f"m{(j - 1) // PER_HASH}"], j, rand_lexicon_ratio))
        return F.xxhash64(F.transform(kept, lambda x: x["t"]), F.lit(j)).alias(f"h{j}")

    hashes += [within(j) for j in range(1, n_rand_lexicons)]
    return words.select("doc_id", *hashes)


def merged_clusters(columns: DataFrame, names: Sequence[str], id_col: str = "doc_id") -> DataFrame:
    """``doc_id``, ``cluster_id`` (least id): documents that agree in any of the columns,
    directly or through others."""
    scratch = Scratch(columns.sparkSession, "merge")
    rows = scratch.save(columns.select(F.col(id_col).alias("doc_id"), *names), "columns")
    # one long table of (column, value), and the least document of each value that is shared; it is
    # written, so that a very common value can be split where it is joined
    values = rows.select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(n).cast("string").alias("x")) for k, n in enumerate(names)])).alias("e")).select("doc_id", "e.k", "e.x").where("x is not null")
    least = scratch.save(values.groupBy("k", "x").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n"), "least", narrow=True)
    links = values.join(least, ["k", "x"]).select("a", F.col("doc_id").alias("b")).where("a <> b").distinct()
    labels = connected_components(links, scratch)
    return rows.join(labels, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("label", "doc_id").alias("cluster_id"))


def pair_clusters(pairs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc_id``, ``cluster_id`` of linked ids; unlinked ones are their own."""
    labels = connected_components(pairs)
    return ids.select(F.col(id_col).alias("doc_id")).distinct().join(labels, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("label", "doc_id").alias("cluster_id"))


def single_pass_merge(rows: Iterable[Sequence[int]]) -> list[int]:
    """Labels of small data in one pass: a row takes the label of its first value that was
    seen in the same column, else its first value. Not transitive; for parity only."""
    seen: dict[tuple[int, int], int] = {}
    labels = []
    for row in rows:
        keys = list(enumerate(row))
        label = next((seen[k] for k in keys if k in seen), row[0])
        seen.update(dict.fromkeys(keys, label))
        labels.append(label)
    return labels


def duplicate_groups(clusters: DataFrame) -> DataFrame:
    """Clusters of more than one document, with ``n_docs``."""
    return with_group_size(clusters, "cluster_id", "n_docs").where("n_docs > 1")


def duplicate_documents(clusters: DataFrame, vectors: DataFrame, vector: str = "vec") -> DataFrame:
    """The answer to a search for duplicates: a row per document of a group of more than one, with
    ``cluster_id``, ``cluster_size``, its ``similarity`` to the group's centroid and the mean of
    these, ``cluster_similarity``. Documents without a vector are left out."""
    from quillspark.operators.cluster import similarities

    return similarities(vectors, duplicate_groups(clusters).select("doc_id", "cluster_id"), vector).where("cluster_size > 1")
