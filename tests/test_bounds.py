"""Searches whose scores lie on the bound of their SQL, and searches that hold all pairs in no shuffle."""

import math
import random

import duckdb
import pyarrow.parquet as pq
import pytest

from quillspark.operators import duplicates, products
from quillspark.plans import catalogue
from tests.comparing import assert_same, sql_rows


def write_documents(spark, d, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{d}/documents.parquet")
    return duckdb.connect().sql(f"SELECT * FROM read_parquet('{d}/documents.parquet/*.parquet')").df()


@pytest.mark.parametrize("common", [1, 2])
@pytest.mark.parametrize("own", [1, 2, 4, 5, 8, 10, 16, 20])
def test_search_document_on_the_bound(spark, tmp_path, common, own):
    """Cosines of 1/20 between document 7 and another one: c common words, and c * c * 400 = words x words."""
    n, square = common * own, (20 * common) ** 2
    assert square % n == 0
    words = lambda side, k: " ".join([f"c{i}" for i in range(common)] + [f"{side}{i}" for i in range(k - common)])
    texts = [(7, words("x", n)), (8, words("y", square // n)), (9, words("z", square // n - 1)), (10, "apart")]
    frames = {"documents": write_documents(spark, str(tmp_path), texts)}
    columns, told = sql_rows(catalogue.ORACLES["search_document"], frames=frames)
    assert math.isclose(told[0][1], 0.05, abs_tol=0.01)
    assert_same(catalogue.QUERIES["search_document"](spark, str(tmp_path)), columns, told)


@pytest.mark.parametrize(("distance", "bits"), [(0, 64), (1, 64), (3, 64), (2, 16)])
def test_hamming_pairs_without_broadcast(spark, distance, bits):
    """Each pair once, and no side in the driver, however few bytes the written values take."""
    rng = random.Random(4)
    values = {rng.getrandbits(bits) for _ in range(60)}
    for v in list(values):
        values |= {v ^ sum(1 << b for b in rng.sample(range(bits), k)) for k in (1, 2, 3)}
    values = sorted(v - (1 << 64) if v >= 1 << 63 else v for v in values)
    df = duplicates.hamming_pairs(spark.createDataFrame([(v,) for v in values], "simhash long"), distance, bits)
    of = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    told = [(a, b, of(a, b)) for i, a in enumerate(values) for b in values[i + 1 :] if of(a, b) <= distance]
    assert sorted(map(tuple, df.collect())) == told
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_search_document_all_shuffles_no_pairs(spark, sf_dir):
    """Before, a row per query, document and common term was shuffled."""
    df = catalogue.QUERIES["search_document_all"](spark, sf_dir)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("limits", [{}, {"POSTINGS": 60, "CHUNK": 7, "HELD": 20}, {"ROWS": 3, "DENSE": 0.2, "DENSE_TERMS": 2}])
@pytest.mark.parametrize("above", [None, 0.3])
def test_pairs_are_those_of_a_full_scan(spark, monkeypatch, limits, above):
    for name, value in limits.items():
        monkeypatch.setattr(products, name, value)
    rng = random.Random(8)
    of = lambda n: [(i, {f"t{int(30 * rng.random() ** 2)}": rng.random() for _ in range(rng.randrange(0, 6))}) for i in range(n)]
    docs, queries = of(80) + [(3, {"t1": 0.9})], of(25)
    frame = lambda rows, key: spark.createDataFrame([(i, list(w.items())) for i, w in rows], f"{key} long, terms array<struct<term:string,weight:double>>")
    got = products.pairs(frame(docs, "doc_id"), frame(queries, "query_id"), above).collect()
    dots = [(q, i, sum(x * w.get(t, 0) for t, x in v.items())) for q, v in queries for i, w in docs]
    told = sorted(x for x in dots if above is None or x[2] > above)
    assert sorted(map(tuple, got)) == [(q, i, pytest.approx(s)) for q, i, s in told]


def test_search_scales_all_asks_every_item(spark, tmp_path):
    """Before, only items divisible by 100. Rows without an id, text or known word are rows too, repeated documents rows each."""
    d = str(tmp_path)
    texts = [(1, "red red blue"), (2, "blue green"), (3, None), (4, "x"), (5, "red"), (5, "green green"), (None, "red blue"), (None, None)]
    items = spark.createDataFrame([(0, "red blue"), (7, "green unknown"), (7, "blue"), (8, "unknown"), (9, None), (None, "red")], "item_id long, text string")
    items.coalesce(1).write.parquet(f"{d}/benchmark.parquet")
    write_documents(spark, d, texts)
    frames = {t: pq.read_table(f"{d}/{t}.parquet") for t in ("documents", "benchmark")}
    columns, told = sql_rows(catalogue.ORACLES["search_scales_all"], frames=frames)
    assert len(told) == 8 * 5
    assert_same(catalogue.QUERIES["search_scales_all"](spark, d), columns, told)
