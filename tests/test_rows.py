"""Weights by document rows: nothing is sorted, rare terms travel alone, scores on a bound are those of the SQL."""

import math
import random

import pytest

from quillspark.operators import cluster, features, search, topk
from quillspark.plans import catalogue
from tests.comparing import assert_same, sql_rows

SCHEMES = ("asc", "Ldl", "Ltcp", "ntn")


def documents(spark, n=60):
    rng = random.Random(3)
    texts = [" ".join(f"w{int(40 * rng.random() ** 2)}" for _ in range(rng.randrange(0, 30))) for _ in range(n)]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(5, "w1 w1 again"), (None, "w1 nobody"), (n, None), (n + 1, "x")], "doc_id long, text string")


def rows(df):
    return {(r["doc_id"], r["term"]): pytest.approx(r["weight"], rel=1e-9, abs=1e-12) for r in df.collect()}


@pytest.mark.parametrize("scheme", SCHEMES)
@pytest.mark.parametrize("head", [1, 5, 130_000])
def test_weights_do_not_depend_on_what_is_known_to_all_tasks(spark, monkeypatch, scheme, head):
    docs, params = documents(spark), features.FeatureParams(weighting=scheme)
    tf = features.term_frequencies(docs, params)
    plain = features.fit(docs, params, tf=tf).weigh(tf)
    monkeypatch.setattr(features, "HEAD", head)
    got = features.weights(docs, params)
    assert {(r["doc_id"], r["term"]): r["weight"] for r in got.collect()} == rows(plain)


def test_terms_are_counted_within_documents(spark):
    got = features.term_frequencies(documents(spark)).collect()
    assert len({(r["doc_id"], r["term"]) for r in got}) == len(got)
    assert {r["term"]: r["tf"] for r in got if r["doc_id"] == 5}["w1"] >= 2
    assert {r["term"]: r["tf"] for r in got if r["doc_id"] is None} == {"w1": 1, "nobody": 1}


@pytest.mark.parametrize("scheme", ["nnc", "lnl", "anc", "Lnu", "lncp", "ltc", "Ltcp"])
def test_no_task_sorts_or_holds_pairs_of_document_and_term(spark, scheme):
    docs = documents(spark)
    x = features.weights(docs, features.FeatureParams(weighting=scheme))
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
    assert not any(line.lstrip(" :+-").startswith("Aggregate") and "term" in line.split("]")[0] for line in plan.splitlines())


def test_searches_and_index_sort_nothing(spark):
    docs = documents(spark)
    x = features.weights(docs, catalogue.WORDS)
    asked = x.where("doc_id = 7").select("doc_id", "term", "weight").withColumnRenamed("doc_id", "query_id")
    for df in (search.sparse_hits(asked, x), search.sparse_scores(search.document_query(x, 7), x, docs)):
        assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString()
    index = topk.build(x)
    norms = {}
    for r in index.postings.collect():
        norms[r["doc_id"]] = norms.get(r["doc_id"], 0) + r["impact"] ** 2
    assert all(v == pytest.approx(1) for v in norms.values())


@pytest.mark.parametrize("head", [1, 7])
def test_sparse_similarities_by_rare_terms(spark, monkeypatch, head):
    docs = documents(spark).where("doc_id is not null and doc_id <> 5")
    x = features.weights(docs, catalogue.WORDS)
    clusters = docs.selectExpr("doc_id", "doc_id % 3 as cluster_id")
    of = lambda: {r["doc_id"]: (r["cluster_id"], pytest.approx(r["similarity"]), pytest.approx(r["cluster_similarity"]), r["cluster_size"]) for r in cluster.sparse_similarities(x, clusters).collect()}
    plain = of()
    monkeypatch.setattr(features, "HEAD", head)
    got = cluster.sparse_similarities(x, clusters).collect()
    assert len(got) == len(plain) and all((r["cluster_id"], r["similarity"], r["cluster_similarity"], r["cluster_size"]) == plain[r["doc_id"]] for r in got)


def test_scores_on_the_bound_are_those_of_the_sql(spark, tmp_path):
    """Cosines of 1/20, by one or two common words of documents whose norms multiply to 20 or 40."""
    texts, k = {}, 0
    for common in (1, 2):
        square = (20 * common) ** 2
        for a in range(common, square + 1):
            b = square // a
            if a * b == square and a != b and common <= min(a, b) and max(a, b) <= 400:
                k += 1
                of = lambda side, n: " ".join([f"k{k}c{i}" for i in range(common)] + [f"k{k}{side}{i}" for i in range(n - common)])  # noqa: B023, E731
                texts |= {100 * k: of("x", a), 100 * k + 1: of("y", b)}
    assert math.isclose(k, 20, abs_tol=20) and k > 5
    d = str(tmp_path)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{d}/documents.parquet")
    import duckdb

    frames = {"documents": duckdb.connect().sql(f"SELECT * FROM read_parquet('{d}/documents.parquet/*.parquet')").df()}
    columns, told = sql_rows(catalogue.ORACLES["search_document_all"], frames=frames)
    assert_same(catalogue.QUERIES["search_document_all"](spark, d), columns, told)


def test_simhash_values_are_written_once(spark, sf_dir):
    """Both sides of the join read a table of values, not the texts."""
    plan = catalogue.QUERIES["simhash_pairs"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation" in plan and "text" not in plan and "bit" in plan


def test_norms_of_the_pivot_are_added_up_once_and_documents_are_not_sorted(spark, monkeypatch):
    docs, params = documents(spark), features.FeatureParams(weighting="nslp")
    calls, plain = [], features._norms
    monkeypatch.setattr(features, "_norms", lambda raw, scheme: calls.append(scheme) or plain(raw, scheme))
    with_size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        x = features.weights(docs, params)
        plan = x._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_size)
    assert calls == ["nslp"]
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    tf = features.term_frequencies(docs, params)
    assert {(r["doc_id"], r["term"]): r["weight"] for r in x.collect()} == rows(features.fit(docs, params, tf=tf).weigh(tf))


@pytest.fixture
def no_broadcast(spark):
    with_size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_size)


def by_documents_unsorted(df):
    """Whether the plan sorts no rows by document, neither for a join nor for a window."""
    lines = df._jdf.queryExecution().sparkPlan().toString().splitlines()
    return not any("Window" in x or ("SortMergeJoin" in x and "doc_id" in x) for x in lines)


def test_similarities_to_sparse_centroids_sort_no_weights(spark, monkeypatch, no_broadcast):
    docs = documents(spark).where("doc_id is not null and doc_id <> 5")
    met, plain = [], features.looked_up
    monkeypatch.setattr(features, "looked_up", lambda rows, *more: met.append(rows) or plain(rows, *more))
    cluster.sparse_similarities(features.weights(docs, catalogue.WORDS), docs.selectExpr("doc_id", "doc_id % 3 as cluster_id")).collect()
    assert len(met) == 1 and by_documents_unsorted(met[0])


def test_sparse_centroids_sort_no_weights(spark, no_broadcast):
    docs = documents(spark)
    centers = cluster.sparse_centroids(features.weights(docs, catalogue.WORDS), docs.selectExpr("doc_id", "doc_id % 3 as cluster_id"))
    assert by_documents_unsorted(centers)


def test_top_terms_sort_no_weights(spark, no_broadcast):
    docs = documents(spark)
    assert by_documents_unsorted(features.top_terms(features.weights(docs, catalogue.WORDS), docs.where("doc_id < 9"), 5))


def test_similarities_to_sparse_centroids_make_the_weights_once(spark, monkeypatch):
    docs = documents(spark).where("doc_id is not null and doc_id <> 5")
    met, plain = [], features.looked_up
    monkeypatch.setattr(features, "looked_up", lambda rows, *more: met.append(rows) or plain(rows, *more))
    cluster.sparse_similarities(features.weights(docs, catalogue.WORDS), docs.selectExpr("doc_id", "doc_id % 3 as cluster_id")).collect()
    plan = met[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation" in plan and "Join" not in plan and "collect_list" not in plan
