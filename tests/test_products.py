"""Ranked search by blocks of documents and queries against scoring every document."""

import pytest

from pyspark.sql import functions as F
from quillspark.operators import products
from quillspark.plans import catalogue
from tests.comparing import assert_same, sql_rows
from tests.test_topk import corpus, long, ranked


def unit_rows(spark, weights, key):
    """A row per id with the array of its weights, scaled to norm 1."""
    rows = long(spark, weights, key).where("weight <> 0")
    norm = rows.groupBy(key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return rows.join(norm, key).groupBy(key).agg(F.collect_list(F.struct("term", (F.col("weight") / F.col("norm")).alias("weight"))).alias("terms"))


@pytest.mark.parametrize(("seed", "signed", "k", "others_only"), [(1, False, 10, False), (2, True, 10, False), (3, False, 3, True), (6, False, 1000, True)])
@pytest.mark.parametrize("limits", [{}, {"POSTINGS": 60, "SHARE": 2, "CHUNK": 7, "HELD": 20}, {"ROWS": 3, "SHARE": 1, "DENSE": 0.2, "DENSE_TERMS": 2}, {"DENSE_TERMS": 0}])
def test_the_best_are_those_of_a_full_scan(spark, monkeypatch, seed, signed, k, others_only, limits):
    for name, value in limits.items():
        monkeypatch.setattr(products, name, value)
    docs, queries = corpus(seed, 300, 120, signed)
    known = {t for w in docs.values() for t, x in w.items() if x}
    queries = {q: {t: x for t, x in w.items() if t in known and x} for q, w in queries.items()}
    queries = {q: w for q, w in queries.items() if w}
    got = products.search(unit_rows(spark, docs, "doc_id"), unit_rows(spark, queries, "query_id"), k, others_only).collect()
    told = [(q, n, d, pytest.approx(s, abs=2e-9)) for q, n, d, s in ranked(docs, queries, k, others_only=others_only)]
    assert sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in got) == told


def test_no_partial_score_is_shuffled(spark, sf_dir):
    """What is shuffled is texts and the best of each task; before, a row per query and document with a common term."""
    df = catalogue.QUERIES["search_document_top"](spark, sf_dir)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "MapInArrow" in plan
    assert_same(df, *sql_rows(catalogue.ORACLES["search_document_top"], sf_dir))


def test_empty_sides(spark):
    docs, _ = corpus(1, 20, 10)
    d = unit_rows(spark, docs, "doc_id")
    q = d.withColumnRenamed("doc_id", "query_id")
    assert products.search(d.limit(0), q, 5).count() == 0
    assert products.search(d, q.limit(0), 5).count() == 0
