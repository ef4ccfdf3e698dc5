"""SMART term weighting over long tables, as window expressions.

A scheme is three or four letters: term frequency, document frequency, normalization, and
``p`` for pivoted normalization. Over long tables norms are window sums over a document's terms.
Over rows that hold all terms of a document (``row_stats``, ``row_weights``) nothing is sorted or
shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quillspark.functions.text import let


def _doc() -> WindowSpec:
    return Window.partitionBy("doc_id")


#: By the frequency and, where they are known, the document's greatest and mean frequency.
TF: dict[str, Callable[..., Column]] = {
    "n": lambda tf, most=None, mean=None: tf.cast("double"),
    "l": lambda tf, most=None, mean=None: 1 + F.ln(tf),
    "d": lambda tf, most=None, mean=None: 1 + F.ln(1 + F.ln(tf)),
    "a": lambda tf, most=None, mean=None: 0.5 + 0.5 * tf / (F.max(tf).over(_doc()) if most is None else most),
    "b": lambda tf, most=None, mean=None: F.lit(1.0),
    "L": lambda tf, most=None, mean=None: (1 + F.ln(tf)) / (1 + F.ln(F.avg(tf).over(_doc()) if mean is None else mean)),
}
IDF: dict[str, Callable[[Column, Column], Column]] = {
    "n": lambda df, n: F.lit(1.0),
    "t": lambda df, n: F.ln(n / df) + 1,
    "s": lambda df, n: F.ln((n + 1) / (df + 1)) + 1,
    "p": lambda df, n: F.when(df < n, F.ln((n - df) / df)).otherwise(F.lit(float("-inf"))),
    "d": lambda df, n: F.ln((n + 1 - df) / (df + 1)),
}
NORM: dict[str, Callable[[Column], Column]] = {
    "c": lambda w: F.sqrt(F.sum(w * w).over(_doc())),
    "l": lambda w: F.sum(F.abs(w)).over(_doc()),
    "u": lambda w: F.count(F.lit(1)).over(_doc()).cast("double"),
}
#: Of an array of weights, and of a group of rows.
_plus = lambda x, y: x + y
ROW_NORM: dict[str, Callable[[Column], Column]] = {
    "c": lambda w: F.sqrt(F.aggregate(F.transform(w, lambda x: x * x), F.lit(0.0), _plus)),
    "l": lambda w: F.aggregate(F.transform(w, F.abs), F.lit(0.0), _plus),
    "u": lambda w: F.size(w).cast("double"),
}
GROUP_NORM: dict[str, Callable[[Column], Column]] = {
    "c": lambda w: F.sqrt(F.sum(w * w)),
    "l": lambda w: F.sum(F.abs(w)),
    "u": lambda w: F.count(F.lit(1)).cast("double"),
}


def parse_scheme(scheme: str) -> tuple[str, str, str, bool]:
    """The parts of a scheme; ``ValueError`` for unknown letters, ``NotImplementedError`` for
    byte-size normalization."""
    if not isinstance(scheme, str) or len(scheme) not in (3, 4):
        raise ValueError(f"a weighting has 3 or 4 letters, not {scheme!r}")
    tf, idf, norm, pivot = (*scheme, "")[:4]
    if norm == "b":
        raise NotImplementedError("byte-size normalization")
    if tf not in TF or idf not in IDF or norm not in ("n", *NORM) or pivot not in ("", "p"):
        raise ValueError(f"unknown weighting {scheme!r}")
    if pivot and norm == "n":
        raise ValueError("pivoted normalization needs a norm")
    return tf, idf, norm, bool(pivot)


def raw_weights(tf: DataFrame, df: DataFrame | None, n_docs: Column | int, scheme: str) -> DataFrame:
    """``doc_id``, ``term``, ``w`` before normalization. ``tf`` has doc_id, term, tf; ``df``
    has term, df, and terms it lacks are dropped. A scheme without document frequencies
    goes without ``df`` and keeps all terms."""
    t, i, _, _ = parse_scheme(scheme)
    if df is None:
        if i != "n":
            raise ValueError(f"{scheme} needs document frequencies")
        return tf.select("doc_id", "term", TF[t](F.col("tf")).alias("w"))
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    joined = tf.join(df.select("term", "df"), "term")
    return joined.select("doc_id", "term", (TF[t](F.col("tf")) * IDF[i](F.col("df"), n)).alias("w"))


def document_norms(raw: DataFrame, scheme: str) -> DataFrame:
    """``raw`` with the ``norm`` of each row's document."""
    norm = parse_scheme(scheme)[2]
    return raw.withColumn("norm", NORM[norm](F.col("w")) if norm != "n" else F.lit(1.0))


def pivot_of(raw: DataFrame, n_docs: int, scheme: str) -> float:
    """Mean norm over all documents; those without terms count as 0."""
    norms = document_norms(raw, scheme).groupBy("doc_id").agg(F.first("norm").alias("norm"))
    return (norms.agg(F.sum("norm")).first()[0] or 0.0) / n_docs if n_docs else 0.0


def normalized(raw: DataFrame, scheme: str, alpha: float = 0.75, pivot: float | Column | None = None) -> DataFrame:
    """``doc_id``, ``term``, ``weight``. A zero norm leaves its document unchanged."""
    norm = parse_scheme(scheme)[2]
    if not 0 <= alpha <= 1:
        raise ValueError("alpha lies in [0, 1]")
    if norm == "n":
        return raw.select("doc_id", "term", F.col("w").alias("weight"))
    by = divisor(F.col("norm"), scheme, alpha, pivot)
    return document_norms(raw, scheme).select("doc_id", "term", (F.col("w") / by).alias("weight"))


def divisor(norm: Column, scheme: str, alpha: float = 0.75, pivot: float | Column | None = None) -> Column:
    """What a document's weights are divided by, from its norm."""
    by = F.when(norm == 0, 1.0).otherwise(norm)
    if not parse_scheme(scheme)[3]:
        return by
    if pivot is None:
        raise ValueError("a pivoted weighting needs the pivot")
    return (1 - alpha) * (pivot if isinstance(pivot, Column) else F.lit(pivot)) + alpha * by


def row_stats(terms: Column) -> Column:
    """``most`` and ``mean`` of the frequencies of an array of (term, tf)."""
    tf = F.transform(terms, lambda t: t["tf"])
    mean = F.aggregate(tf, F.lit(0).cast("bigint"), _plus) / F.nullif(F.size(terms), F.lit(0))
    return F.struct(F.array_max(tf).alias("most"), mean.alias("mean"))


def row_raw(terms: Column, scheme: str) -> Column:
    """Array of (term, w) before normalization from one of (term, tf); document frequencies do not count."""
    of = TF[parse_scheme(scheme)[0]]
    one = lambda t, s: F.struct(t["term"].alias("term"), of(t["tf"], s["most"], s["mean"]).alias("w"))
    return let(terms, lambda x: let(row_stats(x), lambda s: F.transform(x, lambda t: one(t, s))))


def row_norm(weighed: Column, scheme: str) -> Column:
    """The norm of an array of (term, w)."""
    norm = parse_scheme(scheme)[2]
    return ROW_NORM[norm](F.transform(weighed, lambda t: t["w"])) if norm != "n" else F.lit(1.0)


def row_weights(terms: Column, scheme: str, alpha: float = 0.75, pivot: float | None = None) -> Column:
    """Array of (term, weight) from one of (term, tf), for schemes without document frequencies."""
    over = lambda n: n if parse_scheme(scheme)[2] == "n" else divisor(n, scheme, alpha, pivot)
    one = lambda t, by: F.struct(t["term"].alias("term"), (t["w"] / by).alias("weight"))
    return let(row_raw(terms, scheme), lambda w: let(over(row_norm(w, scheme)), lambda by: F.transform(w, lambda t: one(t, by))))
