"""All queries of the document operators over the driver's tables, with their SQL.

Each query applies an operator to whole tables; the SQL states the same in one text for a
second engine. Floats are rounded to six digits on both sides. Operators that SQL cannot
state (decompositions, fitted models, stemming) have no SQL here and are tested against
brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import similarity as sim
from quillspark.functions import text as tx
from quillspark.functions import weighting as wt
from quillspark.functions.stopwords import ENGLISH
from quillspark.operators import birch as birch_nodes
from quillspark.operators import categorize, cluster, duplicates, explain, features, index, lsi, metrics, neighbors, products, search, threads, topk
from quillspark.plans.ingest_log import IngestLog
from quillspark.plans.scratch import Scratch
from quillspark.plans.store import Store
from quillspark.plans.tables import table
from quillspark.sources import files

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "search_text"
WORDS = features.FeatureParams()
VECTOR_TERMS = features.FeatureParams(min_df=2, max_df=0.5, n_features=2000, weighting="ltc")


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("string").alias("category"))


def _rounded(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


# Parts that the SQL texts share

TOKENS = f"tokens AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{tx.TOKEN}')) AS term FROM documents)"
TF = f"{TOKENS}, tf AS (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY doc_id, term)"
DF = f"{TF}, df AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY term), n AS (SELECT count(*)::DOUBLE AS n FROM documents)"
VECTORS = "v AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS vec, label::VARCHAR AS category FROM embeddings)"


# Features


@query(f"WITH {TF} SELECT doc_id, term, tf FROM tf")
def term_frequencies(spark, d):
    return features.term_frequencies(_docs(spark, d))


@query(f"WITH {DF} SELECT term, df, cf FROM df")
def document_frequencies(spark, d):
    return features.document_frequencies(features.term_frequencies(_docs(spark, d)))


@query(f"WITH {TF} SELECT doc_id, sum(tf)::BIGINT AS length, count(*) AS n_unique, max(tf) AS max_tf, round(avg(tf), 6) AS mean_tf FROM tf GROUP BY doc_id")
def document_statistics(spark, d):
    tf = features.term_frequencies(_docs(spark, d))
    return tf.groupBy("doc_id").agg(F.sum("tf").alias("length"), F.count("*").alias("n_unique"), F.max("tf").alias("max_tf"), F.round(F.avg("tf"), 6).alias("mean_tf"))


@query(f"WITH {DF} SELECT term, df, cf FROM df, n WHERE df >= 5 AND df <= 0.5 * n")
def vocabulary_by_frequency(spark, d):
    docs = _docs(spark, d)
    return features.vocabulary(features.document_frequencies(features.term_frequencies(docs)), docs.count(), 5, 0.5)


@query(f"WITH {DF} SELECT term, df, cf FROM df ORDER BY cf DESC, term LIMIT 500")
def vocabulary_top(spark, d):
    docs = _docs(spark, d)
    return features.vocabulary(features.document_frequencies(features.term_frequencies(docs)), docs.count(), n_features=500)


@query(f"WITH {DF} SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx FROM df")
def vocabulary_index(spark, d):
    return features.indexed(features.document_frequencies(features.term_frequencies(_docs(spark, d)))).select("term", "idx")


_STOP = ", ".join(f"'{w}'" for w in ENGLISH)


@query(
    f"WITH {TOKENS}, w AS (SELECT doc_id, regexp_extract_all(lower(text), '{tx.TOKEN}') AS all_words FROM documents),"
    f" k AS (SELECT doc_id, list_filter(all_words, lambda x: x NOT IN ({_STOP})) AS words FROM w),"
    " g AS (SELECT unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS term FROM k)"
    " SELECT term, count(*) AS n FROM g GROUP BY term"
)
def word_bigrams(spark, d):
    params = features.FeatureParams(ngram_range=(2, 2), stop_words="english")
    return features.document_terms(_docs(spark, d), params).groupBy("term").agg(F.count("*").alias("n"))


@query(
    "WITH t AS (SELECT regexp_replace(lower(text), '\\s\\s+', ' ', 'g') AS t FROM documents),"
    " g AS (SELECT unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS term FROM t)"
    " SELECT term, count(*) AS n FROM g GROUP BY term"
)
def char_trigrams(spark, d):
    params = features.FeatureParams(analyzer="char", ngram_range=(3, 3))
    return features.document_terms(_docs(spark, d), params).groupBy("term").agg(F.count("*").alias("n"))


@query(
    "WITH w AS (SELECT unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM documents), p AS (SELECT ' ' || w || ' ' AS w FROM w WHERE w <> ''),"
    " g AS (SELECT unnest(CASE WHEN length(w) >= 4 THEN list_transform(range(1, length(w) - 2), lambda i: substr(w, i, 4)) ELSE [w] END) AS term FROM p)"
    " SELECT term, count(*) AS n FROM g GROUP BY term"
)
def char_word_ngrams(spark, d):
    params = features.FeatureParams(analyzer="char_wb", ngram_range=(4, 4))
    return features.document_terms(_docs(spark, d), params).groupBy("term").agg(F.count("*").alias("n"))


@query(f"WITH {TOKENS} SELECT doc_id, (('0x' || substr(md5(term), 1, 15))::BIGINT % 4096)::VARCHAR AS term, count(*) AS tf FROM tokens GROUP BY ALL")
def hashed_frequencies(spark, d):
    return features.term_frequencies(_docs(spark, d), features.FeatureParams(use_hashing=True, n_features=4096))


@query(
    "WITH m AS (SELECT conv_id, turn, 'From: ' || role || chr(10) || '  Date: today' || chr(10) || 'Subject: s' || chr(10) || text AS text FROM conversations)"
    " SELECT conv_id, turn, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^\\s*(To|From|Date|Cc|Sent):')), chr(10)) AS text FROM m"
)
def header_lines_dropped(spark, d):
    m = table(spark, d, "conversations").withColumn("text", F.concat(F.lit("From: "), "role", F.lit("\n  Date: today\nSubject: s\n"), "text"))
    return m.select("conv_id", "turn", tx.preprocess(F.col("text"), ("emails_ignore_header",)).alias("text"))


@query("SELECT doc_id, text FROM documents")
def decoded_bytes(spark, d):
    return _docs(spark, d).select("doc_id", tx.decode_utf8(F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF")))).alias("text"))


@query(
    "SELECT page_id, trim(regexp_replace(regexp_replace(html, '<script\\b.*?</script>|<style\\b.*?</style>', ' ', 'gs'), '<[^>]*>', ' ', 'g'), ' ') AS text FROM pages"
)
def tags_stripped(spark, d):
    return table(spark, d, "pages").select("page_id", tx.strip_tags(F.col("html")).alias("text"))


# SMART weighting

_TF_SQL = {"n": "tf::DOUBLE", "l": "1 + ln(tf)", "d": "1 + ln(1 + ln(tf))", "a": "0.5 + 0.5 * tf / max(tf) OVER d", "b": "1.0::DOUBLE", "L": "(1 + ln(tf)) / (1 + ln(avg(tf) OVER d))"}
_IDF_SQL = {"n": "1.0", "t": "ln(n / df) + 1", "s": "ln((n + 1) / (df + 1)) + 1", "p": "CASE WHEN df < n THEN ln((n - df) / df) END", "d": "ln((n + 1 - df) / (df + 1))"}
_NORM_SQL = {"n": "1.0", "c": "sqrt(sum(w * w) OVER d)", "l": "sum(abs(w)) OVER d", "u": "count(*) OVER d"}
SCHEMES = ("nnc", "nnn", "ntc", "lsl", "dtu", "asc", "bpc", "Ldl", "lncp", "ltup", "nslp", "Ltcp")


def smart_sql(scheme: str, alpha: float = 0.75) -> str:
    t, i, norm, pivoted = wt.parse_scheme(scheme)
    by = f"(1 - {alpha}) * (SELECT coalesce(sum(k), 0) / (SELECT n FROM n) FROM (SELECT any_value(norm) AS k FROM m GROUP BY doc_id)) + {alpha} * norm" if pivoted else "norm"
    return (
        f"WITH {DF}, raw AS (SELECT doc_id, term, ({_TF_SQL[t]}) * ({_IDF_SQL[i]}) AS w FROM tf JOIN df USING (term), n"
        f" WHERE {'df < n' if i == 'p' else 'true'} WINDOW d AS (PARTITION BY doc_id)),"
        f" m AS (SELECT doc_id, term, w, {_NORM_SQL[norm]} AS norm FROM raw WINDOW d AS (PARTITION BY doc_id))"
        f" SELECT doc_id, term, round(w / (CASE WHEN norm = 0 THEN 1 ELSE {by} END), 6) AS weight FROM m"
    )


def smart(scheme: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        docs = _docs(spark, d)
        params = features.FeatureParams(weighting=scheme)
        if scheme[1] != "p":
            return features.weights(docs, params).select("doc_id", "term", *_rounded("weight"))
        rows = features.counted(docs, params)
        model = features.fit(docs, params, rows=rows)
        model.vocab = model.vocab.where(F.col("df") < model.n_docs)  # a term of all documents weighs minus infinity
        return model.weigh_counted(rows).select("doc_id", "term", *_rounded("weight"))

    return run


for _s in SCHEMES:
    query(smart_sql(_s), f"smart_{_s}")(smart(_s))


# Search

_NNC = f"{DF}, x AS MATERIALIZED (SELECT doc_id, term, tf::DOUBLE / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)) AS w FROM tf)"
_QUERY_0 = f"q AS (SELECT term, count(*)::DOUBLE AS q FROM (SELECT unnest(regexp_extract_all(lower(text), '{tx.TOKEN}')) AS term FROM benchmark WHERE item_id = 0) GROUP BY term)"
_SCORED = (
    f"WITH {_NNC}, {_QUERY_0}, k AS (SELECT q.term, q FROM q JOIN df USING (term)), s AS (SELECT doc_id, sum(w * q) / (SELECT sqrt(sum(q * q)) FROM k) AS c FROM x JOIN k USING (term) GROUP BY doc_id),"
    " scored AS (SELECT doc_id, coalesce(c, 0) AS score FROM documents LEFT JOIN s USING (doc_id))"
)


def _text_scores(spark: SparkSession, d: str, scale: str = "cosine") -> DataFrame:
    docs = _docs(spark, d)
    model, x = features.fit_transform(docs, WORDS)
    asked = model.transform(table(spark, d, "benchmark").where("item_id = 0").select(F.col("item_id").alias("doc_id"), "text"))
    return search.sparse_scores(asked.select("term", "weight"), x, docs, scale)


@query(f"{_SCORED} SELECT doc_id, round(score, 6) AS score FROM scored")
def search_text(spark, d):
    return _text_scores(spark, d).select("doc_id", *_rounded("score"))


@query(
    f"{_SCORED} SELECT doc_id, round(score / (2 - score), 6) AS jaccard, round((score + 1) / 2, 6) AS cosine_norm, round((3 * (score / (2 - score)) + 1) / 4, 6) AS jaccard_norm, round(greatest(score, 0), 6) AS positive FROM scored"
)
def search_scales(spark, d):
    s = _text_scores(spark, d)
    names = {"jaccard": "jaccard", "cosine_norm": "cosine_norm", "jaccard_norm": "jaccard_norm", "cosine-positive": "positive"}
    return s.select("doc_id", *[F.round(sim.from_cosine(F.col("score"), k), 6).alias(v) for k, v in names.items()])


@query(
    f"WITH {_NNC}, q AS (SELECT term, w AS q FROM x WHERE doc_id = 7), s AS (SELECT doc_id, sum(w * q) AS c FROM x JOIN q USING (term) GROUP BY doc_id)"
    " SELECT doc_id, round(coalesce(c, 0), 6) AS score FROM documents LEFT JOIN s USING (doc_id) WHERE doc_id <> 7 AND coalesce(c, 0) > 0.05"
)
def search_document(spark, d):
    docs = _docs(spark, d)
    x = features.weights(docs, WORDS)
    scores = search.sparse_scores(search.document_query(x, 7), x, docs, unit=True)
    return search.shape(scores, min_score=0.05, exclude=7).select("doc_id", *_rounded("score"))


@query(f"{_SCORED} SELECT doc_id, round(score, 6) AS score FROM scored WHERE doc_id IN (SELECT doc_id FROM labels) ORDER BY round(score, 6) DESC, doc_id LIMIT 25 OFFSET 50")
def search_subset_page(spark, d):
    scores = _text_scores(spark, d).select("doc_id", *_rounded("score"))
    kept = search.shape(scores, min_score=None, subset=table(spark, d, "labels"))
    return index.page(kept, [F.desc("score"), "doc_id"], batch_id=2, batch_size=25)[0]


@query(
    f"WITH {VECTORS}, q AS (SELECT vec AS qv FROM v WHERE doc_id = 3) SELECT doc_id, round(list_cosine_similarity(vec, qv), 6) AS score FROM v, q"
)
def search_dense(spark, d):
    v = _vectors(spark, d)
    q = v.where("doc_id = 3").select("vec").first()[0]
    return search.dense_scores(F.array(*[F.lit(float(x)) for x in q]), v).select("doc_id", *_rounded("score"))


# The same searches by every id divisible by 100, against all rows

_QUERIES = f"qt AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{tx.TOKEN}')) AS term FROM benchmark WHERE item_id % 100 = 0), q AS (SELECT query_id, term, count(*)::DOUBLE AS q FROM qt GROUP BY query_id, term)"
_SCORED_ALL = (
    f"WITH {_NNC}, {_QUERIES}, k AS (SELECT query_id, q.term, q FROM q JOIN df USING (term)), kn AS (SELECT query_id, sqrt(sum(q * q)) AS n FROM k GROUP BY query_id),"
    " s AS (SELECT query_id, doc_id, sum(w * q) / any_value(kn.n) AS c FROM x JOIN k USING (term) JOIN kn USING (query_id) GROUP BY query_id, doc_id),"
    " ids AS (SELECT DISTINCT item_id AS query_id FROM benchmark WHERE item_id % 100 = 0),"
    " scored AS (SELECT query_id, doc_id, coalesce(c, 0) AS score FROM (SELECT query_id, doc_id FROM ids, documents) LEFT JOIN s USING (query_id, doc_id))"
)


def _text_scores_all(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    model, x = features.fit_transform(docs, WORDS)
    items = table(spark, d, "benchmark").where("item_id % 100 = 0")
    asked = model.transform(items.select(F.col("item_id").alias("doc_id"), "text")).withColumnRenamed("doc_id", "query_id")
    return search.sparse_scores_each(asked, x, docs, items.select(F.col("item_id").alias("query_id")))


@query(f"{_SCORED_ALL} SELECT query_id, doc_id, round(score, 6) AS score FROM scored")
def search_text_all(spark, d):
    return _text_scores_all(spark, d).select("query_id", "doc_id", *_rounded("score"))


@query(
    f"{_SCORED_ALL.replace(' WHERE item_id % 100 = 0', '')} SELECT query_id, doc_id, round(score / (2 - score), 6) AS jaccard, round((score + 1) / 2, 6) AS cosine_norm, round((3 * (score / (2 - score)) + 1) / 4, 6) AS jaccard_norm, round(greatest(score, 0), 6) AS positive FROM scored"
)
def search_scales_all(spark, d):
    """By every item of the benchmark, against all documents."""
    docs, items = _docs(spark, d), table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    times = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").cast("int").alias("n"))
    rows = features.weight_rows(docs, WORDS).join(times.hint("shuffle_hash"), "doc_id").withColumn("k", F.explode(F.array_repeat(F.lit(0), F.col("n")))).select("doc_id", "terms")
    asked = features.weight_rows(items, features.FeatureParams(weighting="nnn")).withColumnRenamed("doc_id", "query_id")
    # rows without an id match nothing, but are rows
    ids, own = items.select(F.col("doc_id").alias("query_id")).distinct(), docs.select("doc_id")
    unmatched = own.where("doc_id is null").crossJoin(ids).unionByName(own.where("doc_id is not null").crossJoin(ids.where("query_id is null")))
    scores = products.cosines(rows, asked).unionByName(unmatched.withColumn("cosine", F.lit(0.0))).withColumnRenamed("cosine", "score")
    names = {"jaccard": "jaccard", "cosine_norm": "cosine_norm", "jaccard_norm": "jaccard_norm", "cosine-positive": "positive"}
    return scores.select("query_id", "doc_id", *[F.round(sim.from_cosine(F.col("score"), k), 6).alias(v) for k, v in names.items()])


@query(
    f"WITH {_NNC}, q AS (SELECT doc_id AS query_id, term, w AS q FROM x WHERE doc_id % 100 = 0), s AS (SELECT query_id, doc_id, sum(w * q) AS c FROM x JOIN q USING (term) GROUP BY query_id, doc_id)"
    " SELECT query_id, doc_id, round(c, 6) AS score FROM s WHERE doc_id <> query_id AND c > 0.05"
)
def search_document_all(spark, d):
    docs = _docs(spark, d)
    # the weights are of norm 1: dividing by it once more would move scores that lie on the bound
    asked = features.weight_rows(docs.where("doc_id % 100 = 0"), WORDS).withColumnRenamed("doc_id", "query_id")
    hits = products.pairs(features.weight_rows(docs, WORDS), asked, 0.05)
    return hits.where("doc_id <> query_id").select("query_id", "doc_id", F.round("dot", 6).alias("score"))


@query(
    f"{_SCORED_ALL}, r AS (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS n FROM scored WHERE doc_id IN (SELECT doc_id FROM labels))"
    " SELECT query_id, doc_id, score FROM r WHERE n > 50 AND n <= 75"
)
def search_subset_page_all(spark, d):
    scores = _text_scores_all(spark, d).select("query_id", "doc_id", *_rounded("score"))
    kept = scores.join(table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    return search.page_each(kept, batch_id=2, batch_size=25).select("query_id", "doc_id", "score")


@query(
    f"WITH {VECTORS} SELECT q.doc_id AS query_id, v.doc_id, round(list_cosine_similarity(v.vec, q.vec), 6) AS score FROM v, v q WHERE q.doc_id % 100 = 0"
)
def search_dense_all(spark, d):
    v = _vectors(spark, d)
    return search.dense_scores_each(v.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "vec"), v).select("query_id", "doc_id", *_rounded("score"))


# The 100 best of the same queries, from an index ordered by impact

_BEST = "r AS (SELECT query_id, doc_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM hits) SELECT query_id, rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 100"


@query(f"{_SCORED_ALL}, hits AS (SELECT query_id, doc_id, c AS score FROM s), {_BEST}")
def search_text_top(spark, d):
    asked = table(spark, d, "benchmark").where("item_id % 100 = 0").select(F.col("item_id").alias("doc_id"), "text")
    asked = features.term_frequencies(asked, WORDS).select(F.col("doc_id").alias("query_id"), "term", F.col("tf").alias("weight"))
    found = topk.search(asked, topk.build(features.weights(_docs(spark, d), WORDS), unit=True), 100)
    return found.select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", *_rounded("score"))


_DOCUMENTS_ALL = f"WITH {_NNC}, q AS (SELECT doc_id AS query_id, term, w AS q FROM x WHERE doc_id % 100 = 0), s AS (SELECT query_id, doc_id, sum(w * q) AS c FROM x JOIN q USING (term) GROUP BY query_id, doc_id)"


@query(f"{_DOCUMENTS_ALL}, hits AS (SELECT query_id, doc_id, c AS score FROM s WHERE doc_id <> query_id), {_BEST}")
def search_document_top(spark, d):
    docs = _docs(spark, d)
    asked = features.weight_rows(docs.where("doc_id % 100 = 0"), WORDS).withColumnRenamed("doc_id", "query_id")
    found = products.search(features.weight_rows(docs, WORDS), asked, 100, others_only=True)
    return found.select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", *_rounded("score"))


@query(f"{_SCORED_ALL}, hits AS (SELECT query_id, doc_id, c AS score FROM s WHERE round(c, 9) > 0.02 AND doc_id IN (SELECT doc_id FROM labels)), {_BEST}")
def search_subset_top(spark, d):
    asked = table(spark, d, "benchmark").where("item_id % 100 = 0").select(F.col("item_id").alias("doc_id"), "text")
    asked = features.term_frequencies(asked, WORDS).select(F.col("doc_id").alias("query_id"), "term", F.col("tf").alias("weight"))
    found = topk.search(asked, topk.build(features.weights(_docs(spark, d), WORDS), unit=True), 100, min_score=0.02, subset=table(spark, d, "labels"))
    return found.select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", *_rounded("score"))


@query(f"WITH {_NNC} SELECT term, round(sum(w) / (SELECT count(*) FROM documents WHERE lang = 'es'), 6) AS weight FROM x JOIN documents USING (doc_id) WHERE lang = 'es' GROUP BY term ORDER BY sum(w) DESC, term LIMIT 50")
def top_terms(spark, d):
    docs = _docs(spark, d)
    x = features.weights(docs, WORDS)
    return features.top_terms(x, docs.where("lang = 'es'"), 50).select("term", *_rounded("weight"))


# Index operations


def _index(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).select(F.concat(F.lit("docs/file"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"), (F.col("doc_id") * 3 + 1).alias("document_id"))
    return index.numbered(docs, ["file_path"])


_INDEX = "idx AS (SELECT row_number() OVER (ORDER BY 'docs/file' || doc_id || '.txt') - 1 AS internal_id, 'docs/file' || doc_id || '.txt' AS file_path, doc_id * 3 + 1 AS document_id FROM documents)"


@query(f"WITH {_INDEX} SELECT * FROM idx")
def index_numbering(spark, d):
    return _index(spark, d).select("internal_id", "file_path", "document_id")


@query(f"WITH {_INDEX}, q AS (SELECT 3 * doc_id + 1 AS document_id, row_number() OVER (ORDER BY quality, doc_id DESC) - 1 AS sort_order FROM labels) SELECT internal_id, file_path, idx.document_id, sort_order FROM q JOIN idx USING (document_id)")
def index_search(spark, d):
    asked = index.numbered(table(spark, d, "labels").select((F.col("doc_id") * 3 + 1).alias("document_id"), "quality"), ["quality", F.desc("document_id")], name="sort_order")
    return index.search(_index(spark, d), asked.select("document_id", "sort_order"), strict=False).select("internal_id", "file_path", "document_id", "sort_order")


@query(
    f"WITH {_INDEX}, k AS (SELECT * FROM idx WHERE document_id NOT IN (SELECT 3 * doc_id + 1 FROM labels WHERE quality = 0)) SELECT file_path, document_id, row_number() OVER (ORDER BY internal_id) - 1 AS internal_id FROM k"
)
def index_remove(spark, d):
    gone = table(spark, d, "labels").where("quality = 0").select((F.col("doc_id") * 3 + 1).alias("document_id"))
    return index.remove(_index(spark, d), gone).select("file_path", "document_id", "internal_id")


@query(
    f"WITH {_INDEX} SELECT internal_id, file_path, document_id FROM idx UNION ALL SELECT (SELECT count(*) FROM documents) + row_number() OVER (ORDER BY 'pages/p' || page_id) - 1, 'pages/p' || page_id, page_id + 1000000000 FROM pages"
)
def index_append(spark, d):
    more = table(spark, d, "pages").select(F.concat(F.lit("pages/p"), F.col("page_id").cast("string")).alias("file_path"), (F.col("page_id") + 1000000000).alias("document_id"))
    return index.append(_index(spark, d), more).select("internal_id", "file_path", "document_id")


@query("SELECT 'docs/file' || doc_id || '.txt' AS file_path, doc_id AS document_id FROM documents")
def index_inferred_ids(spark, d):
    return index.infer_document_id(_index(spark, d).drop("document_id")).select("file_path", "document_id")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def subset_train(spark, d):
    return index.subset(_docs(spark, d), table(spark, d, "labels")).select("doc_id", "n_chars")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def subset_test(spark, d):
    return index.subset(_docs(spark, d), table(spark, d, "labels"), complement=True).select("doc_id", "n_chars")


@query("SELECT doc_id, n_chars, quality FROM documents LEFT JOIN labels USING (doc_id)")
def rendered_results(spark, d):
    return index.render(_docs(spark, d).select("doc_id", "n_chars"), table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


@query("SELECT d.doc_id, d.n_chars FROM documents d JOIN (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE toxic = 1) s ON d.doc_id = s.doc_id")
def sampled_dataset(spark, d):
    names = table(spark, d, "labels")
    return index.sampled(_docs(spark, d), names.select("doc_id").union(names.where("toxic = 1").select("doc_id")), "doc_id").select("doc_id", "n_chars")


@query("SELECT lang, count(*) AS n FROM (SELECT lang FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT lang FROM documents WHERE doc_id % 2 = 1) GROUP BY lang")
def batches_united(spark, d):
    docs = _docs(spark, d)
    return docs.where("doc_id % 2 = 0").unionByName(docs.where("doc_id % 2 = 1")).groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT doc_id AS document_id, trim(regexp_replace(text, '\\s*\\n\\s*', ' ', 'g')) AS text FROM documents")
def tagged_text(spark, d):
    """The documents as files of tagged blocks, read back record by record."""
    path = Scratch(spark, "tagged").path("files")
    _docs(spark, d).select(F.concat(F.lit(".I "), F.col("doc_id").cast("string"), F.lit("\n.W\n"), "text").alias("value")).write.text(path)
    return files.read_tagged(spark, path)


@query(
    "WITH b AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 0 WHEN lang = 'de' THEN 1 ELSE 2 END AS batch FROM documents)"
    " SELECT doc_id, batch, row_number() OVER (ORDER BY batch, doc_id) - 1 AS internal_id, (SELECT count(*) FROM b x WHERE x.batch < b.batch) AS batch_offset FROM b"
)
def ingest_batches(spark, d):
    """Three batches, of which the last comes first, the second is killed before its record is written
    and sent again, and the first is sent twice."""
    docs = _docs(spark, d).withColumn("of", F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).otherwise(2))
    parts = [docs.where(F.col("of") == k).drop("of") for k in range(3)]
    store = Store(spark, Scratch(spark, "ingest").path("store"))
    log = IngestLog(store, store.create("vectorizer", {}))
    log.add(2, parts[2])
    log._write(1, parts[1].where("n_chars < 1000"))  # and no record
    for k in (0, 1, 0):
        log.add(k, parts[k])
    return log.documents().join(log.batches(), "batch").select("doc_id", "batch", "internal_id", F.col("offset").alias("batch_offset"))


# Metrics

_JUDGED = "r AS (SELECT l.doc_id, l.quality AS y_true, d.n_chars::DOUBLE AS score, (d.n_chars > 1500)::INT AS y_pred FROM labels l JOIN documents d USING (doc_id))"
_GROUPED = "r AS (SELECT lang AS a, source AS b FROM documents), c AS (SELECT a, b, count(*)::DOUBLE AS n FROM r GROUP BY a, b)"


def _judged(spark: SparkSession, d: str) -> DataFrame:
    truth = table(spark, d, "labels").select("doc_id", F.col("quality").alias("y_true"))
    return metrics.matched(truth, _docs(spark, d).select("doc_id", F.col("n_chars").cast("double").alias("score"), (F.col("n_chars") > 1500).cast("int").alias("y_pred")))


@query(
    f"WITH {_JUDGED}, k AS (SELECT sum((y_true = 1 AND y_pred = 1)::INT) AS tp, sum((y_true <> 1 AND y_pred = 1)::INT) AS fp, sum((y_true = 1 AND y_pred <> 1)::INT) AS fn FROM r)"
    " SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM k"
)
def metric_precision_recall(spark, d):
    return metrics.precision_recall_f1(_judged(spark, d)).select(*_rounded("precision", "recall", "f1"))


@query(f"WITH {_JUDGED} SELECT round(avg((y_true = y_pred)::INT), 6) AS precision, round(avg((y_true = y_pred)::INT), 6) AS recall, round(avg((y_true = y_pred)::INT), 6) AS f1 FROM r")
def metric_micro(spark, d):
    return metrics.micro_scores(_judged(spark, d)).select(*_rounded("precision", "recall", "f1"))


@query(
    f"WITH {_JUDGED}, k AS (SELECT y_true, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk FROM r)"
    " SELECT round((sum(rk) FILTER (WHERE y_true = 1) - count(*) FILTER (WHERE y_true = 1) * (count(*) FILTER (WHERE y_true = 1) + 1) / 2) / (count(*) FILTER (WHERE y_true = 1) * count(*) FILTER (WHERE y_true <> 1)), 6) AS roc_auc FROM k"
)
def metric_roc_auc(spark, d):
    return metrics.roc_auc(_judged(spark, d)).select(*_rounded("roc_auc"))


@query(
    f"WITH {_JUDGED}, k AS (SELECT y_true, sum((y_true = 1)::INT) OVER w AS tp, count(*) OVER w AS n FROM r WINDOW w AS (ORDER BY score DESC))"
    " SELECT round(sum(tp / n) FILTER (WHERE y_true = 1) / count(*) FILTER (WHERE y_true = 1), 6) AS average_precision FROM k"
)
def metric_average_precision(spark, d):
    return metrics.average_precision(_judged(spark, d)).select(*_rounded("average_precision"))


@query(
    f"WITH {_JUDGED}, k AS (SELECT y_true, row_number() OVER (ORDER BY score DESC, doc_id DESC) AS rn, count(*) OVER () AS n FROM r)"
    " SELECT round(sum((y_true = 1 AND rn <= floor(0.2 * n))::INT) / sum((y_true = 1)::INT), 6) AS recall_at_k FROM k"
)
def metric_recall_at_k(spark, d):
    return metrics.recall_at_k(_judged(spark, d), 0.2).select(*_rounded("recall_at_k"))


@query(
    "WITH r AS (SELECT l.doc_id, l.quality AS y_true, (d.n_chars > 1500)::INT AS y_pred, (d.n_chars - 1500)::DOUBLE / 1000 AS score FROM labels l JOIN documents d USING (doc_id)),"
    " a AS (SELECT sum((y_true = 1 AND y_pred = 1)::INT) AS tp, sum((y_true = 0 AND y_pred = 1)::INT) AS fp, sum((y_true = 1 AND y_pred = 0)::INT) AS fn FROM r),"
    " k AS (SELECT y_true, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk FROM r),"
    " u AS (SELECT (sum(rk) FILTER (WHERE y_true = 1) - count(*) FILTER (WHERE y_true = 1) * (count(*) FILTER (WHERE y_true = 1) + 1) / 2) / (count(*) FILTER (WHERE y_true = 1) * count(*) FILTER (WHERE y_true <> 1)) AS roc_auc FROM k),"
    " c AS (SELECT y_true, sum((y_true = 1)::INT) OVER w AS tp, count(*) OVER w AS n FROM r WINDOW w AS (ORDER BY score DESC)),"
    " p AS (SELECT sum(tp / n) FILTER (WHERE y_true = 1) / count(*) FILTER (WHERE y_true = 1) AS average_precision FROM c)"
    " SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision FROM a, u, p"
)
def metric_response(spark, d):
    """Metrics of an answer that tells the best category and its score; long texts stand for quality 1."""
    truth = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("category"))
    best = _docs(spark, d).select("doc_id", (F.col("n_chars") > 1500).cast("int").cast("string").alias("category"), (F.abs(F.col("n_chars") - 1500) / 1000).alias("score"))
    return metrics.response_scores(truth, best).select(*_rounded("precision", "recall", "f1", "roc_auc", "average_precision"))


@query(
    f"WITH {_GROUPED}, s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS ab, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM c GROUP BY a)) AS sa,"
    " (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM c GROUP BY b)) AS sb, (SELECT sum(n) FROM c) AS t)"
    " SELECT round((ab - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 6) AS ari FROM s"
)
def metric_adjusted_rand(spark, d):
    return metrics.adjusted_rand(_docs(spark, d), "lang", "source").select(*_rounded("ari"))


@query(
    f"WITH {_GROUPED}, t AS (SELECT sum(n) AS t FROM c), ha AS (SELECT -sum(m / t * ln(m / t)) AS h FROM (SELECT sum(n) AS m FROM c GROUP BY a), t),"
    " hb AS (SELECT -sum(m / t * ln(m / t)) AS h FROM (SELECT sum(n) AS m FROM c GROUP BY b), t), hab AS (SELECT -sum(n / t * ln(n / t)) AS h FROM c, t),"
    " s AS (SELECT (ha.h + hb.h - hab.h) / ha.h AS ho, (ha.h + hb.h - hab.h) / hb.h AS co FROM ha, hb, hab)"
    " SELECT round(ho, 6) AS homogeneity, round(co, 6) AS completeness, round(2 * ho * co / (ho + co), 6) AS v_measure FROM s"
)
def metric_v_measure(spark, d):
    return metrics.v_measure(_docs(spark, d), "lang", "source").select(*_rounded("homogeneity", "completeness", "v_measure"))


@query(
    f"WITH {_GROUPED}, t AS (SELECT sum(n) AS t FROM c), a AS (SELECT sum(n)::BIGINT AS x FROM c GROUP BY a), b AS (SELECT sum(n)::BIGINT AS y FROM c GROUP BY b),"
    " p AS (SELECT x, y, t::BIGINT AS n, unnest(range(greatest(1, x + y - t::BIGINT), least(x, y) + 1)) AS k FROM a, b, t),"
    " ex AS (SELECT sum(k / n * ln(n * k / (x * y)) * exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(n - x + 1) + lgamma(n - y + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(x - k + 1) - lgamma(y - k + 1) - lgamma(n - x - y + k + 1))) AS e FROM (SELECT x::DOUBLE AS x, y::DOUBLE AS y, n::DOUBLE AS n, k::DOUBLE AS k FROM p)),"
    " ha AS (SELECT -sum(x / t * ln(x / t)) AS h FROM a, t), hb AS (SELECT -sum(y / t * ln(y / t)) AS h FROM b, t), hab AS (SELECT -sum(n / t * ln(n / t)) AS h FROM c, t)"
    " SELECT round((ha.h + hb.h - hab.h - e) / (greatest(ha.h, hb.h) - e), 6) AS ami FROM ha, hb, hab, ex"
)
def metric_adjusted_mutual_information(spark, d):
    return metrics.adjusted_mutual_information(_docs(spark, d), "lang", "source").select(*_rounded("ami"))


@query(
    f"WITH {_GROUPED}, t AS (SELECT sum(n) AS t FROM c), ha AS (SELECT -sum(m / t * ln(m / t)) AS h FROM (SELECT sum(n) AS m FROM c GROUP BY a), t),"
    " hb AS (SELECT -sum(m / t * ln(m / t)) AS h FROM (SELECT sum(n) AS m FROM c GROUP BY b), t), hab AS (SELECT -sum(n / t * ln(n / t)) AS h FROM c, t)"
    " SELECT round(ha.h + hb.h - hab.h, 6) AS mi, round(ha.h, 6) AS ha, round(hb.h, 6) AS hb FROM ha, hb, hab"
)
def metric_mutual_information(spark, d):
    return metrics.mutual_information(_docs(spark, d), "lang", "source").select(*_rounded("mi", "ha", "hb"))


@query("SELECT round(1 - abs(x - y) / greatest(x, y), 6) AS ratio_duplicates FROM (SELECT count(*) - count(DISTINCT md5(text)) AS x, count(*) - count(DISTINCT n_chars) AS y FROM documents)")
def metric_ratio_duplicates(spark, d):
    return metrics.ratio_duplicates(_docs(spark, d).select(F.md5("text").alias("x"), F.col("n_chars").alias("y"))).select(*_rounded("ratio_duplicates"))


@query(
    "WITH f AS (SELECT count(*) OVER (PARTITION BY md5(text)) > 1 AS t, count(*) OVER (PARTITION BY n_chars) > 1 AS p FROM documents)"
    " SELECT round(2 * sum((t AND p)::INT) / (2 * sum((t AND p)::INT) + sum((t <> p)::INT)), 6) AS f1_same_duplicates FROM f"
)
def metric_same_duplicates(spark, d):
    return metrics.f1_same_duplicates(_docs(spark, d).select(F.md5("text").alias("x"), F.col("n_chars").alias("y"))).select(*_rounded("f1_same_duplicates"))


@query(
    "WITH f AS (SELECT count(*) OVER (PARTITION BY md5(text)) AS x, count(*) OVER (PARTITION BY n_chars) AS y FROM documents)"
    " SELECT round(avg(1 - abs(x - y) / greatest(x, y)), 6) AS mean_duplicates_count FROM f WHERE x > 1 OR y > 1"
)
def metric_mean_duplicates(spark, d):
    return metrics.mean_duplicates_count(_docs(spark, d).select(F.md5("text").alias("x"), F.col("n_chars").alias("y"))).select(*_rounded("mean_duplicates_count"))


@query("SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY n_chars) = 1 THEN -1 ELSE n_chars END AS label FROM documents")
def labels_noisy(spark, d):
    return metrics.noisy_from_unique(_docs(spark, d).select("doc_id", F.col("n_chars").alias("label")))


# Neighbours, categories, clusters

_PAIRED = f"{VECTORS}, p AS (SELECT a.doc_id, b.category, b.doc_id AS nn, round(list_cosine_similarity(a.vec, b.vec), 12) AS s FROM v a, v b WHERE b.doc_id % 5 = 0)"


@query(f"WITH {_PAIRED} SELECT doc_id, category, round(max(s), 6) AS score, arg_max(nn, (s, -nn)) AS nn_doc_id FROM p GROUP BY doc_id, category")
def nearest_neighbors(spark, d):
    v = _vectors(spark, d)
    return neighbors.nearest(v, v.where("doc_id % 5 = 0")).select("doc_id", "category", *_rounded("score"), "nn_doc_id")


@query(
    f"WITH {_PAIRED}, b AS (SELECT doc_id, category, round(max(s), 6) AS score FROM p GROUP BY doc_id, category),"
    " k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, category) AS rank FROM b)"
    " SELECT doc_id, category, score, rank FROM k WHERE rank <= 3"
)
def top_categories(spark, d):
    v = _vectors(spark, d)
    scores = neighbors.nearest(v, v.where("doc_id % 5 = 0")).select("doc_id", "category", *_rounded("score"))
    shaped = categorize.shape(scores, max_categories=3)
    return shaped.select("doc_id", F.posexplode("scores").alias("rank", "s")).select("doc_id", "s.category", "s.score", (F.col("rank") + 1).cast("bigint").alias("rank"))


# The same of the ids divisible by 100 among all other rows

_PAIRED_ALL = f"{VECTORS}, p AS (SELECT a.doc_id, b.category, b.doc_id AS nn, round(list_cosine_similarity(a.vec, b.vec), 12) AS s FROM v a, v b WHERE a.doc_id % 100 = 0 AND a.doc_id <> b.doc_id)"


def _nearest_all(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return neighbors.nearest_others(v.where("doc_id % 100 = 0"), v).select("doc_id", "category", *_rounded("score"), "nn_doc_id")


@query(f"WITH {_PAIRED_ALL} SELECT doc_id, category, round(max(s), 6) AS score, arg_max(nn, (s, -nn)) AS nn_doc_id FROM p GROUP BY doc_id, category")
def nearest_neighbors_all(spark, d):
    return _nearest_all(spark, d)


@query(
    f"WITH {_PAIRED_ALL}, b AS (SELECT doc_id, category, round(max(s), 6) AS score FROM p GROUP BY doc_id, category),"
    " k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, category) AS rank FROM b)"
    " SELECT doc_id, category, score, rank FROM k WHERE rank <= 3"
)
def top_categories_all(spark, d):
    shaped = categorize.shape(_nearest_all(spark, d).drop("nn_doc_id"), max_categories=3)
    return shaped.select("doc_id", F.posexplode("scores").alias("rank", "s")).select("doc_id", "s.category", "s.score", (F.col("rank") + 1).cast("bigint").alias("rank"))


_CENTERS = f"{VECTORS}, e AS (SELECT category, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM v), m AS (SELECT category, i, avg(x) AS m FROM e GROUP BY category, i), c AS (SELECT category, list(m ORDER BY i) AS centroid FROM m GROUP BY category)"


@query(f"WITH {_CENTERS} SELECT category, i - 1 AS i, round(m, 6) AS m FROM m")
def centroids(spark, d):
    return neighbors.centroids(_vectors(spark, d)).select("category", F.posexplode("centroid").alias("i", "m")).select("category", F.col("i").cast("bigint").alias("i"), *_rounded("m"))


@query(f"WITH {_CENTERS}, p AS (SELECT doc_id, c.category, list_distance(vec, centroid) AS dist FROM v, c) SELECT doc_id, arg_min(category, dist) AS category, round(min(dist), 6) AS distance FROM p GROUP BY doc_id")
def nearest_centroid(spark, d):
    v = _vectors(spark, d)
    return neighbors.nearest_centroid(v, neighbors.centroids(v)).select("doc_id", "category", *_rounded("distance"))


@query(f"WITH {_CENTERS} SELECT doc_id, c.category, round(list_distance(vec, centroid), 6) AS distance FROM v, c")
def center_distances(spark, d):
    v = _vectors(spark, d)
    return neighbors.center_distances(v, neighbors.centroids(v)).select("doc_id", "category", *_rounded("distance"))


@query(
    f"WITH {_NNC}, y AS (SELECT doc_id, lang AS cluster_id, term, w FROM x JOIN documents USING (doc_id)), k AS (SELECT lang AS cluster_id, count(*) AS k FROM documents GROUP BY lang),"
    " c AS (SELECT cluster_id, term, sum(w) / any_value(k) AS m FROM y JOIN k USING (cluster_id) GROUP BY cluster_id, term), cn AS (SELECT cluster_id, sqrt(sum(m * m)) AS cn FROM c GROUP BY cluster_id),"
    " s AS (SELECT doc_id, cluster_id, sum(w * m) / (sqrt(sum(w * w)) * any_value(cn)) AS s FROM y JOIN c USING (cluster_id, term) JOIN cn USING (cluster_id) GROUP BY doc_id, cluster_id)"
    " SELECT doc_id, cluster_id, round(s, 6) AS similarity, round(avg(s) OVER w, 6) AS cluster_similarity, count(*) OVER w AS cluster_size FROM s WINDOW w AS (PARTITION BY cluster_id)"
)
def cluster_similarity_sparse(spark, d):
    docs = _docs(spark, d)
    x = features.weights(docs, WORDS)
    s = cluster.sparse_similarities(x, docs.select("doc_id", F.col("lang").alias("cluster_id")))
    return s.select("doc_id", "cluster_id", *_rounded("similarity", "cluster_similarity"), "cluster_size")


_SIMILAR = f"{_CENTERS}, s AS (SELECT doc_id, v.category AS cluster_id, list_cosine_similarity(vec, centroid) AS similarity FROM v JOIN c USING (category))"


@query(f"WITH {_SIMILAR} SELECT doc_id, cluster_id, round(similarity, 6) AS similarity, round(avg(similarity) OVER w, 6) AS cluster_similarity, count(*) OVER w AS cluster_size FROM s WINDOW w AS (PARTITION BY cluster_id)")
def cluster_similarity(spark, d):
    v = _vectors(spark, d)
    return cluster.similarities(v, v.select("doc_id", F.col("category").alias("cluster_id"))).select("doc_id", "cluster_id", *_rounded("similarity", "cluster_similarity"), "cluster_size")


@query(
    f"WITH {_SIMILAR}, p AS (SELECT cluster_id, count(*) AS cluster_size, arg_max(doc_id, (round(similarity, 9), -doc_id)) AS doc_id FROM s GROUP BY cluster_id),"
    " k AS (SELECT *, coalesce(sum(cluster_size) OVER (ORDER BY cluster_size DESC, cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(cluster_size) OVER () AS total FROM p)"
    " SELECT cluster_id, doc_id, cluster_size FROM k WHERE before <= 0.5 * total"
)
def cluster_sampling(spark, d):
    v = _vectors(spark, d)
    s = cluster.similarities(v, v.select("doc_id", F.col("category").alias("cluster_id")))
    return cluster.sample_clusters(s.withColumn("similarity", F.round("similarity", 9)), 0.5)


@query(
    f"WITH {_NNC}, s AS (SELECT lang AS cluster_id, term, sum(w) / any_value(k) AS weight FROM x JOIN documents USING (doc_id) JOIN (SELECT lang, count(*) AS k FROM documents GROUP BY lang) USING (lang) GROUP BY lang, term),"
    " r AS (SELECT cluster_id, term, round(weight, 6) AS weight, row_number() OVER (PARTITION BY cluster_id ORDER BY round(weight, 9) DESC, term) AS rank FROM s)"
    " SELECT cluster_id, term, weight, rank FROM r WHERE rank <= 20"
)
def cluster_terms(spark, d):
    docs = _docs(spark, d)
    x = features.weights(docs, WORDS)
    centers = cluster.sparse_centroids(x, docs.select("doc_id", F.col("lang").alias("cluster_id"))).withColumn("weight", F.round("weight", 9))
    return cluster.ranked_terms(centers, 20).select("cluster_id", "term", *_rounded("weight"), F.col("rank").cast("bigint").alias("rank"))


@query(
    f"WITH {_SIMILAR}, {_INDEX}, z AS (SELECT *, count(*) OVER (PARTITION BY cluster_id) AS cluster_size FROM s)"
    " SELECT cluster_id, internal_id, file_path, document_id, round(similarity, 6) AS similarity, cluster_size FROM z JOIN idx ON idx.document_id = 3 * z.doc_id + 1"
)
def cluster_documents(spark, d):
    """Clusters with their documents, as the index knows them."""
    v = _vectors(spark, d)
    members = cluster.similarities(v, v.select("doc_id", F.col("category").alias("cluster_id")))
    known = _index(spark, d).withColumn("doc_id", F.expr("(document_id - 1) div 3"))
    members = members.join(known.select("doc_id"), "doc_id", "left_semi")  # the tables hold vectors of other ids too
    return cluster.cluster_documents(members, known).select("cluster_id", "internal_id", "file_path", "document_id", *_rounded("similarity"), "cluster_size")


@query()
def cluster_labels(spark, d):
    docs = _docs(spark, d)
    x = features.weights(docs, WORDS)
    return cluster.labels(cluster.sparse_centroids(x, docs.select("doc_id", F.col("lang").alias("cluster_id"))), 10)


_UNIT = "u AS (SELECT vec_id AS doc_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS vec FROM embeddings)"


def _unit(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return v.withColumn("n", sim.norm(F.col("vec"))).select("doc_id", F.transform("vec", lambda x: x / F.col("n")).alias("vec"))


@query(
    f"WITH RECURSIVE {_UNIT}, p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a, u b WHERE a.doc_id <> b.doc_id AND list_distance(a.vec, b.vec) <= sqrt(2 * (1 - 0.6))),"
    " core AS (SELECT a AS id FROM p GROUP BY a HAVING count(*) + 1 >= 5), e AS (SELECT a, b FROM p WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),"
    " reach(id, to_id) AS (SELECT id, id FROM core UNION SELECT r.id, e.b FROM reach r JOIN e ON r.to_id = e.a),"
    " lab AS (SELECT id, min(to_id) AS cluster_id FROM reach GROUP BY id),"
    " border AS (SELECT p.a AS id, arg_min(lab.cluster_id, p.b) AS cluster_id FROM p JOIN lab ON p.b = lab.id GROUP BY p.a)"
    " SELECT u.doc_id, coalesce(lab.cluster_id, border.cluster_id, -1) AS cluster_id FROM u LEFT JOIN lab ON u.doc_id = lab.id LEFT JOIN border ON u.doc_id = border.id"
)
def dbscan(spark, d):
    return cluster.dbscan(_unit(spark, d), 0.6, 5)


@query()
def kmeans(spark, d):
    return cluster.kmeans(_vectors(spark, d), 10, seed=42)


@query()
def birch(spark, d):
    return cluster.birch_clusters(_unit(spark, d), 0.6, n_clusters=10)[0]


@query(f"WITH {_UNIT}, e AS (SELECT unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM u) SELECT i - 1 AS i, round(sum(x), 6) AS total, count(*) AS n FROM e GROUP BY i")
def birch_sums(spark, d):
    """Clustering features lose nothing: sizes and sums of all leaves are those of the rows."""
    centers = birch_nodes.fit_distributed(_unit(spark, d), sim.euclidean_from_cosine(0.6))
    parts = centers.select("size", F.posexplode("centroid").alias("i", "c"))
    return parts.groupBy(F.col("i").cast("bigint").alias("i")).agg(F.round(F.sum(F.col("c") * F.col("size")), 6).alias("total"), F.sum("size").alias("n"))


@query("SELECT true AS root_holds_all, true AS parents_hold_children, true AS every_document_once, true AS cut_holds_all_once, true AS sample_covers, count(*) AS n FROM embeddings")
def hierarchy_sampling(spark, d):
    """A hierarchy, its cut and the sample of it, by what must hold of them."""
    v = _unit(spark, d)
    nodes, members = birch_nodes.hierarchy(v, 0.8, 20)
    nodes, each = cluster.node_similarities(v, nodes, members)
    n = members.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))
    root = nodes.where("parent_id is null").agg(F.sum("cluster_size").alias("held"))
    kids = nodes.where("parent_id is not null").groupBy(F.col("parent_id").alias("of")).agg(F.sum("cluster_size").alias("below"))
    parents = nodes.join(kids, nodes["cluster_id"] == kids["of"]).agg(F.coalesce(F.bool_and(F.col("cluster_size") == F.col("below")), F.lit(True)).alias("equal"))
    cut = each.join(cluster.cut_hierarchy(nodes, 0.5), "cluster_id", "left_semi").agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("cut"))
    sample = cluster.sample_hierarchy(nodes, each, 0.5, 0.5).agg(F.sum("cluster_size").alias("covered"))
    told = n.crossJoin(root).crossJoin(parents).crossJoin(cut).crossJoin(sample)  # one row each
    return told.select(
        (F.col("held") == F.col("n")).alias("root_holds_all"), F.col("equal").alias("parents_hold_children"), (F.col("n") == F.col("documents")).alias("every_document_once"),
        ((F.col("rows") == F.col("n")) & (F.col("cut") == F.col("n"))).alias("cut_holds_all_once"), (F.col("covered") > 0.5 * F.col("n")).alias("sample_covers"), "n",
    )


@query()
def birch_tree(spark, d):
    return birch_nodes.hierarchy(_unit(spark, d), 0.8, 20)[0]


@query()
def categorize_training_scores(spark, d):
    v = _vectors(spark, d)
    return categorize.training_scores(categorize.train(v, "NearestCentroid"), v)


@query()
def lsi_appended(spark, d):
    """Documents that arrive later are projected with the frozen model."""
    docs = _docs(spark, d)
    old = docs.where("doc_id % 10 <> 0")
    tf = features.term_frequencies(old, VECTOR_TERMS)
    model = features.fit(old, VECTOR_TERMS, tf=tf)
    x = model.weigh(tf).persist()
    space = lsi.fit(x, old.count(), 10)
    return space.transform(x).unionByName(space.transform(model.transform(docs.where("doc_id % 10 = 0"))))


@query()
def lsi_vectors(spark, d):
    docs = _docs(spark, d)
    x = features.weights(docs, VECTOR_TERMS).persist()
    return lsi.fit(x, docs.count(), 20).transform(x)


@query("SELECT unnest(range(20)) AS component, 1.0::DOUBLE AS length, 0.0::DOUBLE AS overlap")
def lsi_components(spark, d):
    """Documents in semantic space before they are scaled to length one: over all documents each
    component has length 1 and none overlaps with another."""
    docs = _docs(spark, d)
    x = features.weights(docs, VECTOR_TERMS).persist()
    rows = lsi.fit(x, docs.count(), 20).transform(x, normalize=False)
    parts = rows.select("doc_id", F.col("vec").alias("v"), F.posexplode("vec").alias("component", "c"))
    products = parts.select("component", F.posexplode(F.transform("v", lambda y: y * F.col("c"))).alias("other", "p")).groupBy("component", "other").agg(F.sum("p").alias("p"))
    own, least = F.col("component") == F.col("other"), F.when(F.col("component") != F.col("other"), F.abs("p"))
    told = products.groupBy(F.col("component").cast("bigint").alias("component")).agg(F.round(F.max(F.when(own, F.sqrt("p"))), 6).alias("length"), F.round(F.max(least), 5).alias("overlap"))
    x.unpersist()
    return told


@query("SELECT count(*) AS n_groups, 0::BIGINT AS n_split FROM (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)")
def duplicates_dbscan(spark, d):
    """Duplicates by density in semantic space. What must hold of them: copies share a cluster."""
    docs = _docs(spark, d)
    x = features.weights(docs, VECTOR_TERMS).persist()
    found = cluster.dbscan(lsi.fit(x, docs.count(), 20).transform(x), 0.95, 2)
    x.unpersist()
    # a document without a known term has no vector, and so no cluster
    told = docs.select("doc_id", F.sha2("text", 256).alias("h")).join(found, "doc_id", "left").groupBy("h").agg(F.count("*").alias("n"), F.count_distinct(F.coalesce("cluster_id", F.lit(-1))).alias("clusters"))
    return told.where("n > 1").agg(F.count("*").alias("n_groups"), F.count_if(F.col("clusters") > 1).alias("n_split"))


@query()
def categorize_logistic(spark, d):
    v = _vectors(spark, d)
    return categorize.shape(categorize.train(v.where("doc_id % 2 = 0"), "LogisticRegression").predict(v)).select("doc_id", F.round("best", 6).alias("best"), F.col("scores")[0]["category"].alias("category"))


@query(
    f"WITH {_NNC}, l AS MATERIALIZED (SELECT doc_id, 2 * toxic - 1 AS sign FROM labels), k AS MATERIALIZED (SELECT term, w * sign AS part FROM x JOIN l USING (doc_id)),"
    " c AS MATERIALIZED (SELECT term, sum(part) AS coefficient FROM k GROUP BY term)"
    " SELECT doc_id, term, round(w * coefficient, 6) AS contribution FROM x JOIN c USING (term)"
)
def sensitivity(spark, d):
    docs = _docs(spark, d)
    x = features.weights(docs, WORDS)
    signed = F.when(F.col("toxic") == 1, F.col("weight")).otherwise(-F.col("weight"))
    c = x.join(table(spark, d, "labels"), "doc_id").groupBy("term").agg(F.sum(signed).alias("coefficient"))
    return categorize.sensitivity(x, c).select("doc_id", "term", *_rounded("contribution"))


@query("SELECT DISTINCT lang AS category, 0.0::DOUBLE AS difference FROM documents")
def sensitivity_fitted(spark, d):
    """What each term of a document adds to the decision of a model over semantic vectors; with the
    intercept these are the decision itself."""
    docs = _docs(spark, d)
    x = features.weights(docs, VECTOR_TERMS).persist()
    space = lsi.fit(x, docs.count(), 20)
    vectors = space.transform(x, normalize=False)
    model = categorize.train(vectors.join(docs.select("doc_id", F.col("lang").alias("category")), "doc_id"), "LogisticRegression")

    told = x.join(categorize.coefficients(model, space), "term").groupBy("doc_id", "category").agg(F.sum(F.col("weight") * F.col("coefficient")).alias("told"))
    each = [F.struct(F.lit(c).alias("category"), F.array(*[F.lit(float(v)) for v in fitted.coefficients.toArray()]).alias("w")) for c, fitted in model.model]
    decision = F.aggregate(F.zip_with("vec", F.col("m.w"), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    decided = vectors.select("doc_id", "vec", F.explode(F.array(*each)).alias("m")).select("doc_id", "m.category", decision.alias("decision"))
    gap = F.max(F.abs(F.col("decision") - F.coalesce("told", F.lit(float("inf")))))
    return decided.join(told, ["doc_id", "category"], "left").groupBy("category").agg(F.round(gap, 6).alias("difference"))


@query()
def highlighted(spark, d):
    return _docs(spark, d).select("doc_id", explain.highlighted(F.col("text"), {"license": 1.0, "the": -0.4}).alias("html"))


# Near-duplicates


def _term_hash() -> Column:
    return F.conv(F.substring(F.md5("term"), 1, 16), 16, -10).cast("bigint")


_VOTES = " + ".join(f"(CASE WHEN sum(2 * ((h >> {b}) & 1)::BIGINT - 1) > 0 THEN {-(1 << b) if b == 63 else 1 << b}::HUGEINT ELSE 0 END)" for b in range(64))
_SIMHASH = f"{TOKENS}, h AS (SELECT DISTINCT doc_id, term, ('0x' || substr(md5(term), 1, 16))::UBIGINT AS h FROM tokens), sh AS (SELECT doc_id, ({_VOTES})::BIGINT AS simhash FROM h GROUP BY doc_id)"


def _simhash(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.simhash(features.term_frequencies(_docs(spark, d), WORDS), _term_hash(), distinct=True)


@query(f"WITH {_SIMHASH} SELECT doc_id, simhash FROM sh")
def simhash(spark, d):
    return _simhash(spark, d)


@query(
    f"WITH {_SIMHASH}, u AS (SELECT DISTINCT simhash AS v FROM sh) SELECT x.v AS a, y.v AS b, bit_count(xor(x.v, y.v))::INT AS distance FROM u x, u y WHERE x.v < y.v AND bit_count(xor(x.v, y.v)) <= 3"
)
def simhash_pairs(spark, d):
    return duplicates.hamming_pairs(_simhash(spark, d), 3)


@query(
    f"WITH RECURSIVE {_SIMHASH}, u AS (SELECT simhash AS v, min(doc_id) AS rep FROM sh GROUP BY simhash), e AS (SELECT x.rep AS a, y.rep AS b FROM u x, u y WHERE x.v <> y.v AND bit_count(xor(x.v, y.v)) <= 1),"
    " reach(id, to_id) AS (SELECT rep, rep FROM u UNION SELECT r.id, e.b FROM reach r JOIN e ON r.to_id = e.a), lab AS (SELECT id, min(to_id) AS cluster_id FROM reach GROUP BY id)"
    " SELECT sh.doc_id, cluster_id FROM sh JOIN u ON sh.simhash = u.v JOIN lab ON lab.id = u.rep"
)
def simhash_clusters(spark, d):
    return duplicates.simhash_clusters(_simhash(spark, d))


@query(f"WITH {TOKENS}, s AS (SELECT doc_id, list(DISTINCT term ORDER BY term) AS w FROM tokens GROUP BY doc_id) SELECT doc_id, min(doc_id) OVER (PARTITION BY w) AS cluster_id FROM s")
def imatch(spark, d):
    return duplicates.exact_groups(duplicates.imatch(features.document_terms(features.by_document(_docs(spark, d)), WORDS)), "h0")


_LEXICONS = " UNION ALL ".join(
    f"SELECT doc_id, {j} AS j, " + ("w" if j == 0 else f"list_filter(w, lambda t: substr(md5(t), {3 * j - 2}, 3) < 'e66')") + " AS w FROM s" for j in range(10)
)


@query(
    f"WITH RECURSIVE {TOKENS}, s AS MATERIALIZED (SELECT doc_id, list(DISTINCT term ORDER BY term) AS w FROM tokens GROUP BY doc_id), k AS MATERIALIZED ({_LEXICONS}),"
    " e AS MATERIALIZED (SELECT DISTINCT doc_id AS a, least_id AS b FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY j, w) AS least_id FROM k) WHERE doc_id <> least_id),"
    " f AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),"
    " reach(id, to_id) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.id, f.b FROM reach r JOIN f ON r.to_id = f.a)"
    " SELECT id AS doc_id, min(to_id) AS cluster_id FROM reach GROUP BY id"
)
def imatch_lexicons(spark, d):
    hashes = duplicates.imatch(features.document_terms(features.by_document(_docs(spark, d)), WORDS), 10, 0.9)
    return duplicates.merged_clusters(hashes, [f"h{j}" for j in range(10)])


@query(
    "SELECT * FROM (SELECT doc_id, min(doc_id) OVER w AS cluster_id, count(*) OVER w AS n_docs FROM documents WINDOW w AS (PARTITION BY text)) WHERE n_docs > 1"
)
def exact_duplicates(spark, d):
    groups = duplicates.exact_groups(_docs(spark, d).select("doc_id", F.sha2("text", 256).alias("simhash")))
    return duplicates.duplicate_groups(groups)


@query(
    f"WITH {VECTORS}, g AS (SELECT doc_id, min(doc_id) OVER w AS category, count(*) OVER w AS n, vec FROM (SELECT v.doc_id, d.text, v.vec FROM v JOIN documents d USING (doc_id)) WINDOW w AS (PARTITION BY lang_key))".replace("lang_key", "length(text) // 400")
    + ", e AS (SELECT category, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM g WHERE n > 1), m AS (SELECT category, i, avg(x) AS m FROM e GROUP BY category, i), c AS (SELECT category, list(m ORDER BY i) AS centroid FROM m GROUP BY category)"
    " SELECT doc_id, category AS cluster_id, n AS cluster_size, round(list_cosine_similarity(vec, centroid), 6) AS similarity, round(avg(list_cosine_similarity(vec, centroid)) OVER (PARTITION BY category), 6) AS cluster_similarity FROM g JOIN c USING (category)"
)
def duplicate_documents(spark, d):
    """The answer to a search for duplicates; here texts of about one length stand for them."""
    v = _vectors(spark, d)
    docs = _docs(spark, d).join(v.select("doc_id"), "doc_id", "left_semi")
    groups = duplicates.exact_groups(docs.select("doc_id", F.floor(F.length("text") / 400).alias("simhash")))
    return duplicates.duplicate_documents(groups, v).select("doc_id", "cluster_id", "cluster_size", *_rounded("similarity", "cluster_similarity"))


@query(
    "WITH RECURSIVE r AS (SELECT c_custkey AS id, c_nationkey * 1000 + (c_custkey % 37) AS x, c_custkey // 5 AS y FROM customer),"
    " e AS (SELECT a, b FROM (SELECT id AS a, min(id) OVER (PARTITION BY x) AS b FROM r UNION SELECT id, min(id) OVER (PARTITION BY y) FROM r)), f AS (SELECT a, b FROM e UNION SELECT b, a FROM e),"
    " reach(id, to_id) AS (SELECT id, id FROM r UNION SELECT q.id, f.b FROM reach q JOIN f ON q.to_id = f.a)"
    " SELECT id AS doc_id, min(to_id) AS cluster_id FROM reach GROUP BY id"
)
def merged_clusterings(spark, d):
    r = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), (F.col("c_nationkey") * 1000 + F.col("c_custkey") % 37).alias("x"), F.floor(F.col("c_custkey") / 5).alias("y"))
    return duplicates.merged_clusters(r, ["x", "y"])


# Threads


@query(
    "WITH RECURSIVE m AS (SELECT conv_id * 1000 + turn AS message_idx, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent_idx FROM conversations),"
    " t AS (SELECT message_idx, parent_idx, message_idx AS root_idx, 0::BIGINT AS depth FROM m WHERE parent_idx IS NULL"
    " UNION ALL SELECT m.message_idx, m.parent_idx, t.root_idx, t.depth + 1 FROM m JOIN t ON m.parent_idx = t.message_idx) SELECT * FROM t"
)
def email_threads(spark, d):
    c = table(spark, d, "conversations")
    mid = lambda n: F.concat(F.lit("<"), F.col("conv_id").cast("string"), F.lit("."), n.cast("string"), F.lit(">"))
    messages = c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("message_idx"),
        mid(F.col("turn")).alias("message_id"),
        F.lit(None).cast("string").alias("in_reply_to"),
        F.when(F.col("turn") > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("turn") - 1, F.lit(0))), mid)).alias("references"),
        F.substring("text", 1, 20).alias("subject"),
    )
    return threads.threads(threads.parents(messages))
