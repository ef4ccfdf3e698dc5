"""Term frequencies, vocabularies and weighted features in long form.

``FeatureModel`` freezes vocabulary, document frequencies, number of documents and pivot
at fit; queries and appended documents are weighted by the frozen state.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.functions import weighting as wt
from quillspark.functions.stopwords import ENGLISH
from quillspark.operators.running import numbered
from quillspark.plans.scratch import Scratch

#: Rows of a table of terms that are told to all tasks, at most.
HEAD = 130_000


@dataclass(frozen=True)
class FeatureParams:
    analyzer: str = "word"
    ngram_range: tuple[int, int] = (1, 1)
    stop_words: str | Sequence[str] | None = None
    min_df: float | int = 1
    max_df: float | int = 1.0
    n_features: int | None = None
    use_hashing: bool = False
    weighting: str = "nnc"
    norm_alpha: float = 0.75
    preprocess: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        wt.parse_scheme(self.weighting)
        if self.analyzer not in ("word", "char", "char_wb"):
            raise ValueError(f"unknown analyzer {self.analyzer!r}")
        if isinstance(self.stop_words, str) and self.stop_words != "english":
            raise ValueError("stop_words: None, 'english' or a list of words")

    @property
    def stop(self) -> tuple[str, ...]:
        return ENGLISH if self.stop_words == "english" else tuple(self.stop_words or ())


def _analyzed(text: Column, params: FeatureParams) -> Column:
    return tx.analyze(tx.preprocess(text, params.preprocess), params.analyzer, params.ngram_range, params.stop)


def document_terms(docs: DataFrame, params: FeatureParams, text: str = "text") -> DataFrame:
    """One row per occurrence: ``doc_id``, ``term``; bucket numbers if hashing is on."""
    terms = _analyzed(F.col(text), params)
    rows = docs.select("doc_id", F.explode(terms).alias("term"))
    if params.use_hashing:
        rows = rows.select("doc_id", bucket(F.col("term"), params.n_features or 100001).cast("string").alias("term"))
    return rows


def bucket(term: Column, n: int) -> Column:
    """Bucket of a term from 0 to n - 1: 60 bits of its md5 modulo n, which any engine can state."""
    return F.pmod(F.conv(F.substring(F.md5(term), 1, 15), 16, 10).cast("long"), F.lit(n))


def by_document(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id`` and the text, dealt by document. The text is several times smaller than the rows
    of its terms, so it is the text that travels; what is then grouped by document, by document
    and term, or windowed by document needs no further exchange."""
    return docs.select("doc_id", text).repartition("doc_id")


def counted(docs: DataFrame, params: FeatureParams | None = None, text: str = "text") -> DataFrame:
    """``doc_id``, ``terms``: a row per document with the array of all its (term, tf), dealt by
    document. Rows of one id are one document. Terms are counted within the row, so a task holds
    texts and the terms of one document, never a table of all pairs of document and term."""
    params = params or FeatureParams()
    texts = by_document(docs, text).groupBy("doc_id").agg(F.collect_list(text).alias("texts"))
    terms = F.flatten(F.transform("texts", lambda t: _analyzed(t, params)))
    if params.use_hashing:
        terms = F.transform(terms, lambda t: bucket(t, params.n_features or 100001).cast("string"))
    return texts.select("doc_id", tx.counts(terms).alias("terms"))


def listed(rows: DataFrame, terms: Column | str = "terms") -> DataFrame:
    """A row per element of the documents' arrays."""
    return rows.select("doc_id", F.inline(terms))


def term_frequencies(docs: DataFrame, params: FeatureParams | None = None, text: str = "text") -> DataFrame:
    """``doc_id``, ``term``, ``tf``, dealt by document."""
    return listed(counted(docs, params, text))


def document_frequencies(tf: DataFrame) -> DataFrame:
    """``term``, ``df`` and the total count ``cf``."""
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def _bound(value: float | int, n_docs: int) -> float:
    """A proportion (float up to 1) or a count."""
    if isinstance(value, float) and value > 1 + 1e-3:
        value = int(value)
    return value * n_docs if isinstance(value, float) else value


def vocabulary(df: DataFrame, n_docs: int, min_df: float | int = 1, max_df: float | int = 1.0, n_features: int | None = None) -> DataFrame:
    """Terms within the document frequency bounds, and the most frequent ``n_features`` of
    these by count, ties in alphabetical order."""
    kept = df.where((F.col("df") >= _bound(min_df, n_docs)) & (F.col("df") <= _bound(max_df, n_docs)))
    return kept.orderBy(F.desc("cf"), "term").limit(n_features) if n_features else kept


def indexed(vocab: DataFrame) -> DataFrame:
    """``vocab`` with ``idx``, the place of the term in alphabetical order, from 0."""
    return numbered(vocab, ["term"], name="idx")


@dataclass
class FeatureModel:
    params: FeatureParams
    vocab: DataFrame  # term, df, cf
    n_docs: int
    pivot: float | None = None
    extra: dict = field(default_factory=dict)

    def transform(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``doc_id``, ``term``, ``weight``; unknown terms are dropped, so a document without
        known terms has no rows."""
        return self.weigh_counted(counted(docs, self.params, text))

    def weigh_counted(self, rows: DataFrame) -> DataFrame:
        """The same for the rows of ``counted``. Terms are looked up by document, norms are added up
        by document first: neither the pairs of document and term nor their sums are sorted, and
        only rare terms travel."""
        scheme, alpha = self.params.weighting, self.params.norm_alpha
        if wt.parse_scheme(scheme)[2] == "n":
            return _raw(rows, self.vocab, self.n_docs, scheme).select("doc_id", "term", F.col("w").alias("weight"))
        scratch = Scratch(rows.sparkSession, "weights")
        rows = rows if hasattr(rows, "_scratch_path") else scratch.save(rows, "counted")
        of, norms = self.extra.get("norms", (None, None))
        if of is not rows:  # else the pivot's
            norms = scratch.save(_norms(_raw(rows, self.vocab, self.n_docs, scheme), scheme), "norms", narrow=True)
        norms = norms.withColumnRenamed("doc_id", "of")
        # the norms are the hashed side, so that the rows of documents are not sorted
        raw = _raw(rows.join(norms.hint("shuffle_hash"), rows["doc_id"].eqNullSafe(norms["of"])), self.vocab, self.n_docs, scheme, "norm")
        return raw.select("doc_id", "term", (F.col("w") / wt.divisor(F.col("norm"), scheme, alpha, self.pivot)).alias("weight"))

    def weigh(self, tf: DataFrame) -> DataFrame:
        raw = wt.raw_weights(tf, self.vocab, self.n_docs, self.params.weighting)
        return wt.normalized(raw, self.params.weighting, self.params.norm_alpha, self.pivot)

    @property
    def n_features(self) -> int:
        return (self.params.n_features or 100001) if self.params.use_hashing else self.vocab.count()


def looked_up(rows: DataFrame, table: DataFrame, on: Sequence[str], often: str) -> DataFrame:
    """``rows`` joined with a written ``table`` of terms, whose column ``often`` tells in how many rows
    each occurs. The most frequent ones, about ``HEAD`` at most, are known to all tasks, so the
    rows of them, which are nearly all, stay where they are; only rows of rare terms travel."""
    n = table.count()
    if n <= HEAD:
        return rows.join(F.broadcast(table), [*on])
    cut = table.agg(F.percentile_approx(often, 1 - HEAD / n, 10_000)).first()[0]
    head = table.where(F.col(often) > cut)
    rare = rows.join(F.broadcast(head.select(*on)), [*on], "left_anti").join(table.where(F.col(often) <= cut), [*on])
    return rows.join(F.broadcast(head), [*on]).unionByName(rare)


def _raw(rows: DataFrame, vocab: DataFrame, n_docs: int, scheme: str, *more: str) -> DataFrame:
    """``doc_id``, ``term``, ``w`` before normalization, and more columns of the rows of ``counted``."""
    t, i, _, _ = wt.parse_scheme(scheme)
    needed = {"a": ["most"], "L": ["mean"]}.get(t, [])
    long = rows.select("doc_id", *more, F.inline("terms"))
    if needed:
        told = rows.select("doc_id", *more, F.inline(F.array(F.struct("terms", wt.row_stats(F.col("terms")).alias("s")))))
        long = told.select("doc_id", *more, *[f"s.{c}" for c in needed], F.inline("terms"))
    of = wt.TF[t](F.col("tf"), F.col("most"), F.col("mean")) * wt.IDF[i](F.col("df"), F.lit(n_docs))
    return looked_up(long, vocab.select("term", "df"), ["term"], "df").select("doc_id", "term", of.alias("w"), *more)


def _norms(raw: DataFrame, scheme: str) -> DataFrame:
    return raw.groupBy("doc_id").agg(wt.GROUP_NORM[wt.parse_scheme(scheme)[2]](F.col("w")).alias("norm"))


def fit(docs: DataFrame, params: FeatureParams | None = None, text: str = "text", tf: DataFrame | None = None, rows: DataFrame | None = None) -> FeatureModel:
    """Freezes vocabulary and document frequencies over ``docs``, whose ``tf`` or ``rows`` of ``counted``
    may be given. The vocabulary is written, so its size is known where it is joined and a small one
    needs no exchange of the terms."""
    params = params or FeatureParams()
    pivoted = wt.parse_scheme(params.weighting)[3]
    if tf is None:
        if rows is None:
            rows = counted(docs, params, text)
            rows = Scratch(docs.sparkSession, "counted").save(rows, "rows") if pivoted else rows
        tf = listed(rows)
    n_docs = docs.count()
    df = document_frequencies(tf)
    vocab = df if params.use_hashing else vocabulary(df, n_docs, params.min_df, params.max_df, params.n_features)
    vocab = Scratch(docs.sparkSession, "vocabulary").save(vocab, "terms", narrow=True)
    model = FeatureModel(params, vocab, n_docs)
    if pivoted and rows is None:
        model = replace(model, pivot=wt.pivot_of(wt.raw_weights(tf, vocab, n_docs, params.weighting), n_docs, params.weighting))
    elif pivoted:
        if _whole_rows(params):
            norms = rows.select(wt.row_norm(wt.row_raw(F.col("terms"), params.weighting), params.weighting).alias("norm"))
        else:
            norms = Scratch(docs.sparkSession, "norms").save(_norms(_raw(rows, vocab, n_docs, params.weighting), params.weighting), "rows", narrow=True)
            model = replace(model, extra={"norms": (rows, norms)})
        total = norms.agg(F.sum("norm")).first()[0]
        model = replace(model, pivot=(total or 0.0) / n_docs if n_docs else 0.0)
    return model


def fit_transform(docs: DataFrame, params: FeatureParams | None = None, text: str = "text") -> tuple[FeatureModel, DataFrame]:
    """The model and the weights of the documents it is fitted on. Without document frequencies
    in the weighting and bounds on the vocabulary, the weights need no look-up."""
    params = params or FeatureParams()
    rows = Scratch(docs.sparkSession, "counted").save(counted(docs, params, text), "rows")
    model = fit(docs, params, text, rows=rows)
    if not _whole_rows(params):
        return model, model.weigh_counted(rows)
    return model, _row_weights(rows, params, model.pivot)


def _whole_rows(params: FeatureParams) -> bool:
    """Whether a document's own row tells its weights: without document frequencies in the weighting
    and bounds on the vocabulary."""
    every = params.min_df in (0, 1) and params.max_df == 1.0 and params.n_features is None
    return wt.parse_scheme(params.weighting)[1] == "n" and (every or params.use_hashing)


def _row_weights(rows: DataFrame, params: FeatureParams, pivot: float | None = None) -> DataFrame:
    return listed(rows, wt.row_weights(F.col("terms"), params.weighting, params.norm_alpha, pivot))


def weight_rows(docs: DataFrame, params: FeatureParams | None = None, text: str = "text") -> DataFrame:
    """``doc_id``, ``terms``: a row per document with the array of all its (term, weight), for weightings that
    a document's own row tells."""
    params = params or FeatureParams()
    if not _whole_rows(params) or wt.parse_scheme(params.weighting)[3]:
        raise ValueError(f"{params.weighting} with bounds on the vocabulary, document frequencies or a pivot is not told by the row of a document")
    return counted(docs, params, text).select("doc_id", wt.row_weights(F.col("terms"), params.weighting, params.norm_alpha).alias("terms"))


def weights(docs: DataFrame, params: FeatureParams | None = None, text: str = "text") -> DataFrame:
    """Weights of documents as ``fit_transform`` gives them; nothing is fitted where none is needed."""
    params = params or FeatureParams()
    if _whole_rows(params) and not wt.parse_scheme(params.weighting)[3]:
        return _row_weights(counted(docs, params, text), params)
    return fit_transform(docs, params, text)[1]


def top_terms(weights: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """Most weighted terms of a set of documents: ``term``, ``weight`` (mean over the set)."""
    size = chosen.select("doc_id").distinct().count()
    # the ids are the hashed side, so that the weights are not sorted
    mean = weights.join(chosen.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_semi").groupBy("term").agg((F.sum("weight") / F.lit(size)).alias("weight"))
    return mean.orderBy(F.desc("weight"), "term").limit(n)
