import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import birch, categorize, cluster, duplicates, explain, features, index, linkage, lsi, metrics, nearest, neighbors, search, threads
from quillspark.operators.components import connected_components


def labels(df, key="doc_id", value="cluster_id"):
    return {r[key]: r[value] for r in df.collect()}


# Index


def test_ordered_lookup(spark):
    rng = random.Random(1)
    ids = rng.sample(range(1000), 40)
    idx = spark.createDataFrame([(i, f"mails/{d:04d}.eml", d) for i, d in enumerate(ids)], "internal_id long, file_path string, document_id long")
    ask = lambda c, v: [r["internal_id"] for r in index.search(idx, spark.createDataFrame([(x,) for x in v], f"{c} long")).collect()]
    asked = [rng.choice(ids) for _ in range(15)]
    assert ask("document_id", asked) == [ids.index(d) for d in asked]
    assert ask("internal_id", [30, 2, 30, 0]) == [30, 2, 30, 0]
    with pytest.raises(index.NotFound):
        ask("document_id", [1001])
    gone = set(ids[::7])
    left = index.remove(idx, spark.createDataFrame([(d,) for d in gone], "document_id long")).orderBy("internal_id").collect()
    assert [(r["internal_id"], r["document_id"]) for r in left] == list(enumerate(d for d in ids if d not in gone))


def test_composite_keys(spark):
    idx = spark.createDataFrame([(0, 1, 0), (1, 1, 1), (2, 2, 0)], "internal_id long, document_id long, rendition_id long")
    index.check_unique(idx)
    with pytest.raises(ValueError):
        index.check_unique(idx.drop("rendition_id"))
    with pytest.raises(ValueError):
        index.key_of(["other"])


@pytest.mark.parametrize(("names", "expected"), [(["file1", "file2", "file4"], [1, 2, 4]), (["a", "file2", "b"], [0, 1, 2]), (["x1", "y1", "z2"], [0, 1, 2])])
def test_inferred_ids(spark, names, expected):
    idx = spark.createDataFrame(list(enumerate(names)), "internal_id long, file_path string")
    assert [r["document_id"] for r in index.infer_document_id(idx).orderBy("internal_id").collect()] == expected


def test_paging(spark):
    rows = spark.range(530).select(F.col("id").alias("doc_id"), F.rand(1).alias("score"))
    best = [r["doc_id"] for r in rows.orderBy(F.desc("score"), "doc_id").collect()]
    for batch, size in ((0, 100), (5, 100), (6, 100), (1, 265), (2, 265), (0, 1000), (-1, 100)):
        page, info = index.page(rows, [F.desc("score"), "doc_id"], batch, size)
        expected = best if batch == -1 else best[batch * size : (batch + 1) * size]
        assert [r["doc_id"] for r in page.collect()] == expected and info["current_response_count"] == len(expected)
        assert info["total_response_count"] == 530 and info["batch_id_last"] == (1 if batch == -1 else 530 // size)


# Search and LSI

# The worked example of Grossman and Frieder's textbook on information retrieval, whose
# singular vectors and cosines are published, so that the projection can be held against them.
DOCS = [(0, "Shipment of gold damaged in aa fire."), (1, "Delivery of silver arrived in aa silver truck."), (2, "Shipment of gold arrived in aa truck.")]


def test_lsi_book_example(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    params = features.FeatureParams(weighting="nnn")
    tf = features.term_frequencies(docs, params)
    assert tf.agg(F.sum("tf"), F.count_distinct("term")).first()[:] == (22, 11)
    model = features.fit(docs, params, tf=tf)
    full = lsi.fit(model.weigh(tf), 3, 5)
    assert full.k == 3 and full.sigma[:2] == pytest.approx([4.0989, 2.3616], abs=1e-3)
    two = lsi.LsiModel(full.terms, full.v[:, :2], full.sigma[:2], 0)
    asked = two.transform(model.transform(spark.createDataFrame([(0, "gold silver truck")], "doc_id long, text string")), normalize=False).first()["vec"]
    assert np.abs(asked) == pytest.approx([0.2140, 0.1821], abs=1e-3)
    q = F.array(*[F.lit(float(x)) for x in asked])
    scores = labels(search.dense_scores(q, two.transform(model.weigh(tf))), value="score")
    assert scores[0] == pytest.approx(-0.05, abs=1e-2) and scores[1] == pytest.approx(0.9910, abs=1e-2)


def test_component_rule():
    assert lsi.components_for(200, 10000, 100000) == 200
    assert lsi.components_for(200, 500, 100000) == 165
    assert lsi.components_for(2, 500, 1000) == 5


def test_document_query_equals_text_query(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    tf = features.term_frequencies(docs)
    model = features.fit(docs, tf=tf)
    x = model.weigh(tf)
    by_id = labels(search.sparse_scores(search.document_query(x, 1), x, docs), value="score")
    by_text = labels(search.sparse_scores(model.transform(docs.where("doc_id = 1")), x, docs), value="score")
    assert by_id == pytest.approx(by_text) and by_id[1] == pytest.approx(1)
    nothing = search.sparse_scores(x.where("false"), x, docs)
    assert set(labels(nothing, value="score").values()) == {0.0}


def test_every_query_is_answered(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    tf = features.term_frequencies(docs)
    x = features.fit(docs, tf=tf).weigh(tf)
    ids = [r["doc_id"] for r in docs.collect()]
    asked = spark.createDataFrame([(i,) for i in [*ids, 99]], "query_id long")
    out = search.sparse_scores_each(x.withColumnRenamed("doc_id", "query_id"), x, docs, asked).collect()
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in out}
    assert len(out) == len(got) == len(ids) * (len(ids) + 1) and {got[99, i] for i in ids} == {0.0}
    for i in ids:
        one = labels(search.sparse_scores(search.document_query(x, i), x, docs), value="score")
        assert {k: got[i, k] for k in ids} == pytest.approx(one)
    first = search.page_each(spark.createDataFrame(out), 0, 1).collect()
    assert {r["query_id"]: r["doc_id"] for r in first} == {q: max(ids, key=lambda d, q=q: (got[q, d], -d)) for q in [*ids, 99]}

    v = spark.createDataFrame([(i, [float(i % 3), i - 4.0]) for i in range(9)], "doc_id long, vec array<double>")
    q = v.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "query_id")
    for size in (search.BLOCK_VALUES, 4):
        monkeypatch.setattr(search, "BLOCK_VALUES", size)
        dense = search.dense_scores_each(q, v).collect()
        assert len(dense) == 45
        for k, vec in q.collect():
            one = labels(search.dense_scores(F.array(*[F.lit(e) for e in vec]), v), value="score")
            assert {r["doc_id"]: r["score"] for r in dense if r["query_id"] == k} == pytest.approx(one)


# Metrics


def two(spark, a, b):
    return spark.createDataFrame([(i, *x) for i, x in enumerate(zip(a, b, strict=True))], "doc_id long, x long, y long")


def test_duplicate_metrics(spark):
    rng = random.Random(2)
    a, b = ([rng.randrange(25) for _ in range(40)] for _ in range(2))
    rows, of_a, of_b = two(spark, a, b), Counter(a), Counter(b)
    extra = 40 - len(of_a), 40 - len(of_b)
    assert metrics.ratio_duplicates(rows).first()[0] == pytest.approx(1 - abs(extra[0] - extra[1]) / max(extra))
    pairs = [(of_a[x], of_b[y]) for x, y in zip(a, b, strict=True)]
    hit = sum(p > 1 and q > 1 for p, q in pairs)
    assert metrics.f1_same_duplicates(rows).first()[0] == pytest.approx(2 * hit / (sum(p > 1 for p, _ in pairs) + sum(q > 1 for _, q in pairs)))
    shared = [1 - abs(p - q) / max(p, q) for p, q in pairs if p > 1 or q > 1]
    assert metrics.mean_duplicates_count(rows).first()[0] == pytest.approx(sum(shared) / len(shared))
    same = two(spark, a, [x + 100 for x in a])
    assert [metrics.ratio_duplicates(same).first()[0], metrics.f1_same_duplicates(same).first()[0], metrics.mean_duplicates_count(same).first()[0]] == [1, 1, 1]


def test_metrics_without_duplicates_are_null(spark):
    rows = two(spark, [0, 1], [2, 3])
    assert metrics.ratio_duplicates(rows).first()[0] is None and metrics.mean_duplicates_count(rows).first()[0] is None


def test_cluster_metrics(spark):
    """Against the definitions, pair by pair and table by table."""
    rng = random.Random(3)
    for groups in (2, 5):
        a = [rng.randrange(groups) for _ in range(30)]
        b = [x if rng.random() < 0.6 else rng.randrange(4) for x in a]
        rows, n, pairs = two(spark, a, b), 30, list(combinations(range(30), 2))
        in_a, in_b = ([x[i] == x[j] for i, j in pairs] for x in (a, b))
        both, sa, sb = sum(p and q for p, q in zip(in_a, in_b, strict=True)), sum(in_a), sum(in_b)
        by_chance = sa * sb / len(pairs)
        assert metrics.adjusted_rand(rows, "x", "y").first()[0] == pytest.approx((both - by_chance) / ((sa + sb) / 2 - by_chance))
        ca, cb, cab = Counter(a), Counter(b), Counter(zip(a, b, strict=True))
        ha, hb = (-sum(k / n * math.log(k / n) for k in c.values()) for c in (ca, cb))
        mi = sum(k / n * math.log(n * k / (ca[x] * cb[y])) for (x, y), k in cab.items())
        v = metrics.v_measure(rows, "x", "y").first()
        assert (v["homogeneity"], v["completeness"], v["v_measure"]) == pytest.approx((mi / ha, mi / hb, 2 * mi / (ha + hb)))
        expected = sum(
            k / n * math.log(n * k / (x * y)) * math.comb(x, k) * math.comb(n - x, y - k) / math.comb(n, y)
            for x in ca.values() for y in cb.values() for k in range(max(1, x + y - n), min(x, y) + 1)
        )
        assert metrics.adjusted_mutual_information(rows, "x", "y").first()["ami"] == pytest.approx((mi - expected) / (max(ha, hb) - expected))


@pytest.mark.parametrize("k", [0, 1, 4, 9, 50, 0.1, 0.35, 1.0])
def test_recall_at_k(spark, k):
    rng = random.Random(4)
    truth, score = [int(rng.random() < 0.3) for _ in range(40)], rng.sample(range(100), 40)
    rows = spark.createDataFrame([(i, t, float(x)) for i, (t, x) in enumerate(zip(truth, score, strict=True))], "doc_id long, y_true int, score double")
    most = round(k * 40) if isinstance(k, float) else k
    best = sorted(range(40), key=lambda i: -score[i])[:most]
    assert metrics.recall_at_k(rows, k).first()[0] == pytest.approx(sum(truth[i] for i in best) / sum(truth))


def test_categorization_score(spark):
    rng = random.Random(5)
    truth, score = [int(rng.random() < 0.4) for _ in range(30)], [x / 10 for x in rng.sample(range(-60, 60), 30)]
    rows = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(zip(truth, score, strict=True))], "doc_id long, y_true int, score double")
    found = metrics.categorization_score(rows)
    yes, hit = sum(x > 0 for x in score), sum(t and x > 0 for t, x in zip(truth, score, strict=True))
    assert found["recall"] == pytest.approx(hit / sum(truth)) and found["precision"] == pytest.approx(hit / yes)
    pairs = [(x, y) for t, x in zip(truth, score, strict=True) for u, y in zip(truth, score, strict=True) if t and not u]
    assert found["roc_auc"] == pytest.approx(sum(x > y for x, y in pairs) / len(pairs))
    ranked = sorted(range(30), key=lambda i: -score[i])
    assert found["average_precision"] == pytest.approx(sum(sum(truth[j] for j in ranked[: k + 1]) / (k + 1) for k, i in enumerate(ranked) if truth[i]) / sum(truth))
    assert set(metrics.categorization_score(rows.where("false")).values()) == {-1.0}


def test_noisy_labels(spark):
    given = [4, -1, 4, 2, -1, 2, 2, -1, -1]
    noisy = spark.createDataFrame(list(enumerate(given)), "doc_id long, label long")
    unique = labels(metrics.unique_from_noisy(noisy), value="label")
    assert len(set(unique.values())) == 6 and unique[0] == unique[2] and unique[3] == unique[5] == unique[6]
    back = metrics.noisy_from_unique(metrics.unique_from_noisy(noisy))
    assert labels(back, value="label") == dict(enumerate(given))


# Duplicates


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(200, 260)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = labels(connected_components(spark.createDataFrame(pairs, "a long, b long")), "node", "label")
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pair_clusters(spark):
    found = labels(duplicates.pair_clusters(spark.createDataFrame([(8, 0), (3, 8), (4, 11), (11, 6)], "a long, b long"), spark.range(12).withColumnRenamed("id", "doc_id")))
    assert found == {i: {3: 0, 8: 0, 6: 4, 11: 4}.get(i, i) for i in range(12)}


def test_both_ways_of_merging(spark):
    a, b = [7, 7, 8, 9, 8], [1, 2, 2, 3, 4]
    assert duplicates.single_pass_merge(zip(a, b, strict=True)) == [7, 7, 7, 9, 7]
    a, b = [7, 8, 7], [1, 2, 2]  # the third row joins two groups that are made already
    assert duplicates.single_pass_merge(zip(a, b, strict=True)) == [7, 8, 7]
    assert set(labels(duplicates.merged_clusters(two(spark, a, b), ["x", "y"])).values()) == {0}


PROSE = (
    "every spring the ferry to the outer island starts a week after the ice has left the sound and the first to cross are the bakers with their flour and the"
    " teacher who spends the winter on the mainland and brings back a box of letters that nobody could deliver before"
).split()


def test_simhash_and_imatch(spark):
    texts = [" ".join(PROSE), " ".join([*PROSE, "as", "told", "by", "neighbours"]), "as told by the neighbours of another town", " ".join(PROSE)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    terms = features.document_terms(docs, features.FeatureParams(ngram_range=(2, 2)))
    h = labels(duplicates.simhash(terms), value="simhash")
    bits = lambda i, j: bin((h[i] ^ h[j]) & (2**64 - 1)).count("1")
    assert bits(0, 3) == 0 and bits(0, 1) <= 20 and bits(1, 2) >= 20
    for n in (1, 5, 20):
        found = labels(duplicates.merged_clusters(duplicates.imatch(terms, n, 0.7), [f"h{j}" for j in range(n)]))
        assert found[0] == found[3] != found[2]
    with pytest.raises(ValueError):
        duplicates.imatch(terms, 1, 1.5)


def test_registered_simhash_has_64_bits(spark, sf_dir):
    from hashlib import md5

    from quillspark.plans import catalogue

    terms = features.document_terms(spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 20"), catalogue.WORDS)
    words = {}
    for r in terms.collect():
        words.setdefault(r["doc_id"], set()).add(int(md5(r["term"].encode()).hexdigest()[:16], 16))
    vote = {d: sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) for d, hs in words.items()}
    got = {r["doc_id"]: r["simhash"] % 2**64 for r in catalogue.QUERIES["simhash"](spark, sf_dir).where("doc_id < 20").collect()}
    assert got == vote and max(got.values()) >= 2**63


def test_hamming_pairs_are_complete(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**63), 2**63 - 1, 40)
    values = sorted({int(b) ^ int(sum(1 << int(k) for k in set(rng.integers(0, 63, n)))) for b in base for n in (0, 1, 2, 3, 5)})
    df = spark.createDataFrame(list(enumerate(values)), "doc_id long, simhash long")
    for d in (0, 1, 3):
        exact = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= d}
        assert {(r["a"], r["b"]) for r in duplicates.hamming_pairs(df, d).collect()} == exact
    with pytest.raises(ValueError):
        duplicates.hamming_pairs(df, 64)


# Clusters


def vectors(spark, m, extra=None):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "doc_id long, vec array<double>")


POINTS = [(2, 0), (2.2, 0.1), (1.9, -0.2), (-2, 0), (-2.1, 0.2), (-1.8, 0)]


def test_birch(spark):
    tree = birch.fit_tree(np.array(POINTS), threshold=0.5)
    assert sorted(sorted(f.ids) for f in tree.leaves()) == [[0, 1, 2], [3, 4, 5]]
    found, _ = cluster.birch_clusters(vectors(spark, POINTS), 0.875, n_clusters=2)
    by = labels(found)
    assert len({by[i] for i in range(3)}) == 1 and len({by[i] for i in range(6)}) == 2
    rng = np.random.default_rng(42)
    m = rng.normal(size=(400, 8))
    rows = birch.tree_rows(birch.fit_tree(m, threshold=0.9, branching=20))
    assert rows[0]["doc_ids"] == list(range(400)) and rows == birch.tree_rows(birch.fit_tree(m, threshold=0.9, branching=20))
    for r in rows:
        kids = [rows[c] for c in r["children"]]
        assert not kids or sorted(i for k in kids for i in k["doc_ids"]) == r["doc_ids"]
        assert len(kids) != 1
    frame = birch.tree_frame(spark, birch.fit_tree(m, threshold=0.9, branching=20))
    cut = birch.limit_depth(frame, 1)
    assert cut.agg(F.max("depth")).first()[0] == 1 and cut.where("depth = 1 and size(children) > 0").isEmpty()


def test_distributed_hierarchy(spark):
    rng = np.random.default_rng(6)
    m = np.concatenate([rng.normal(c, 0.1, (40, 3)) for c in ((0, 0, 0), (3, 0, 0), (0, 3, 3))])
    nodes, members = birch.hierarchy(vectors(spark, m).repartition(3), 0.4, 5)
    rows = {r["cluster_id"]: r for r in nodes.collect()}
    assert rows[0]["cluster_size"] == 120 and members.count() == 120
    for r in rows.values():
        assert not r["children"] or r["cluster_size"] == sum(rows[c]["cluster_size"] for c in r["children"])
    by = labels(members)
    assert all(len({by[i] for i in range(k, k + 40)} & {by[i] for i in range(j, j + 40)}) == 0 for k, j in ((0, 40), (0, 80), (40, 80)))


def test_within_is_exact(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(150, 3))
    d = np.sqrt(((m[:, None] - m[None]) ** 2).sum(2))
    exact = {(i, j) for i in range(150) for j in range(i + 1, 150) if d[i, j] <= 0.6}
    assert {(r["a"], r["b"]) for r in cluster.within(vectors(spark, m), 0.6, n_pivots=9).collect()} == exact


def test_ward_and_dendrogram():
    assert cluster.ward(np.array(POINTS), 2).tolist() == [0, 0, 0, 1, 1, 1]
    assert birch.dendrogram_leaves([(0, 1), (4, 2), (5, 3)], 4, 5) == [0, 1, 2]


def test_top_words():
    assert cluster.select_top_words(["engine", "engines", "bridge", "to"], 2) == ["engine", "bridge"]
    assert cluster.select_top_words(["the", "1st", "com", "_x_", "peter", "go", "ox"], 5) == []


def test_optimal_sampling():
    tree = [
        {"cluster_id": 0, "children": [1, 2], "cluster_size": 6, "cluster_similarity": 0.1, "doc_ids": [], "similarities": []},
        {"cluster_id": 1, "children": [], "cluster_size": 2, "cluster_similarity": 0.2, "doc_ids": [5, 6], "similarities": [0.1, 0.9]},
        {"cluster_id": 2, "children": [], "cluster_size": 4, "cluster_similarity": 0.8, "doc_ids": [1, 2, 3, 4], "similarities": [0.5, 0.7, 0.6, 0.1]},
    ]
    assert [r["doc_id"] for r in cluster.optimal_sampling(tree, 0.5, 0.5)] == [2]
    assert [r["doc_id"] for r in cluster.optimal_sampling(tree, 0.5, 1.0)] == [2, 6]
    with pytest.raises(ValueError):
        cluster.optimal_sampling(tree, 0.5, 2)
    with pytest.raises(NotImplementedError):
        cluster.reject_hashed(True)


# Categories


@pytest.mark.parametrize("method", categorize.METHODS)
def test_categorizers_separate_blobs(spark, method):
    rng = np.random.default_rng(3)
    m = np.concatenate([rng.normal(-2, 0.5, (30, 4)), rng.normal(2, 0.5, (30, 4))])
    v = vectors(spark, m).withColumn("category", F.when(F.col("doc_id") < 30, "a").otherwise("b"))
    model = categorize.train(v.where("doc_id % 2 = 0"), method)
    best = {r["doc_id"]: r["scores"][0]["category"] for r in categorize.shape(model.predict(v)).collect()}
    assert best == {i: "a" if i < 30 else "b" for i in range(60)}


def test_sensitivity_of_a_fitted_model(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.col("lang").alias("category"))
    x = features.weights(docs, features.FeatureParams(min_df=2, n_features=200)).cache()
    space = lsi.fit(x, docs.count(), 6)
    model = categorize.train(space.transform(x).join(docs.select("doc_id", "category"), "doc_id"), "LogisticRegression")
    parts = categorize.sensitivity(x, categorize.term_coefficients(model, space, "en"))
    got = {r["doc_id"]: r["s"] for r in parts.groupBy("doc_id").agg(F.sum("contribution").alias("s")).collect()}
    c = dict(model.model)["en"].coefficients.toArray()
    raw = {r["doc_id"]: float(np.dot(c, r["vec"])) for r in space.transform(x, normalize=False).collect()}
    assert got == pytest.approx(raw, abs=1e-9) and len(got) > 150


def test_categorizer_guards(spark):
    v = vectors(spark, POINTS).withColumn("category", F.lit("a"))
    with pytest.raises(NotImplementedError):
        categorize.train(v, "MLP")
    with pytest.raises(ValueError):
        categorize.train(v, "NearestNeighbor", cv="fast")
    with pytest.raises(ValueError):
        categorize.train(v, "LinearSVC")
    assert neighbors.nearest(v, v).where("abs(score - 1) > 1e-9").isEmpty()


def test_nearest_others_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4))
    x[41] = x[7] = x[20]
    kinds = [None if i == 33 else "abc"[i % 3] for i in range(60)]
    kinds[10] = "own"  # a category of the query alone
    v = spark.createDataFrame([(i, x[i].tolist(), kinds[i]) for i in range(60)], "doc_id long, vec array<double>, category string").repartition(3)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    expected = {}
    for a in range(0, 60, 10):
        for b in range(60):
            s = round(float(u[a] @ u[b]), 9)
            if a != b and (s, -b) > expected.get((a, kinds[b]), (-2.0, 0)):
                expected[a, kinds[b]] = s, -b
    for rows_of_block, values, chunk, small in ((2048, 4_000_000, 16_384, 500_000), (2048, 4_000_000, 16_384, 0), (9, 40, 2, 0)):
        monkeypatch.setattr(nearest, "SMALL_VALUES", small)
        monkeypatch.setattr(nearest, "BLOCK_ROWS", rows_of_block)
        monkeypatch.setattr(nearest, "VALUES", values)
        monkeypatch.setattr(nearest, "CHUNK", chunk)
        rows = neighbors.nearest_others(v.where("doc_id % 10 = 0"), v).collect()
        assert {(r["doc_id"], r["category"]): (round(r["score"], 9), -r["nn_doc_id"]) for r in rows} == expected and len(rows) == len(expected)


# Threads and explanation


def test_thread_tree(spark):
    refs = [[], ["<1>"], ["<0>", "<1>"], ["<1>", "<9>", "<3>"], ["<3>"]]
    rows = [(i, f"<{i + 1}>", None, r, "s") for i, r in enumerate(refs)] + [(7, "<x>", "<y>", [], "t"), (8, "<y>", "<x>", [], "t")]
    tree = threads.parents(spark.createDataFrame(rows, "message_idx long, message_id string, in_reply_to string, references array<string>, subject string"))
    found = {r["message_idx"]: (r["parent_idx"], r["root_idx"], r["depth"]) for r in threads.threads(tree).collect()}
    assert found == {0: (None, 0, 0), 1: (0, 0, 1), 2: (0, 0, 1), 3: (2, 0, 2), 4: (2, 0, 2), 7: (None, 7, 0), 8: (7, 7, 1)}
    # 20 and 21 answer one absent message, 22 another that 21 names too; 30 alone answers an absent one
    more = [(20, "<a>", None, ["<gone>"], "Re: plan"), (21, "<b>", "<lost>", ["<gone>"], "plan"), (22, "<c>", "<lost>", [], "other"), (23, "<d>", None, ["<b>"], "x"), (30, "<e>", "<void>", [], "RE: Fwd: Plan"), (31, "<f>", None, [], "")]
    loose = threads.parents(spark.createDataFrame(more, "message_idx long, message_id string, in_reply_to string, references array<string>, subject string"))
    assert labels(threads.threads(loose), "message_idx", "root_idx") == {20: 20, 21: 20, 22: 20, 23: 20, 30: 30, 31: 31}
    assert labels(threads.threads(loose, by_subject=True), "message_idx", "root_idx") == {20: 20, 21: 20, 22: 20, 23: 20, 30: 20, 31: 31}
    forest = threads.nested([r.asDict() for r in tree.where("message_idx < 5").collect()])
    assert len(forest) == 1 and [c["id"] for c in forest[0]["children"]] == [1, 2]


def test_spans():
    assert explain.longest_spans([(3, 9), (3, 14), (10, 14)]) == [(3, 14)]
    assert explain.longest_spans([(0, 20), (5, 8), (30, 33), (30, 41), (50, 51)]) == [(0, 20), (30, 41), (50, 51)]


def test_agglomeration_against_plain_version():
    rng = np.random.default_rng(8)
    for n in (2, 15, 40):
        x, w = rng.normal(size=(n, 3)), rng.integers(1, 6, n).astype(float)
        parts = {i: ([i], x[i], w[i]) for i in range(n)}
        while len(parts) > 3:
            cost = lambda p, q: float(np.square(p[1] - q[1]).sum() * p[2] * q[2] / (p[2] + q[2]))
            i, j = min(combinations(parts, 2), key=lambda ij: cost(parts[ij[0]], parts[ij[1]]))
            (a, c, s), (b, d, t) = parts[i], parts.pop(j)
            parts[i] = a + b, (c * s + d * t) / (s + t), s + t
        expected = {frozenset(p) for p, _, _ in parts.values()}
        found = birch.agglomerate(x, w, 3)
        assert {frozenset(np.flatnonzero(found == k).tolist()) for k in set(found)} == expected
        assert found[0] == 0 and sorted(set(found.tolist())) == list(range(min(n, 3)))


def test_dbscan_counts_equal_vectors(spark):
    v = vectors(spark, [(1, 0)] * 4 + [(0.999, 0.0447)] + [(0, 1)] * 2 + [(-1, 0)])
    assert labels(cluster.dbscan(v, 0.9, 5)) == {**dict.fromkeys(range(5), 0), 5: -1, 6: -1, 7: -1}
    assert labels(cluster.dbscan(v, 0.9, 2)) == {**dict.fromkeys(range(5), 0), 5: 5, 6: 5, 7: -1}


def test_hierarchical_sampling(spark):
    rng = np.random.default_rng(6)
    m = np.concatenate([rng.normal(c, 0.05, (k, 3)) for c, k in (((1, 0, 0), 50), ((0, 1, 0), 30), ((0, 0, 1), 10))])
    v = vectors(spark, m)
    nodes, members = birch.hierarchy(v.repartition(3), 0.3, 5)
    nodes, each = cluster.node_similarities(v, nodes, members)
    rows = {r["cluster_id"]: r for r in nodes.collect()}
    of = {}
    for r in each.collect():
        of.setdefault(r["cluster_id"], {})[r["doc_id"]] = r["similarity"]
    assert len(of[0]) == 90 and all(len(of[k]) == r["cluster_size"] and r["cluster_similarity"] == pytest.approx(np.mean(list(of[k].values()))) for k, r in rows.items())
    tree = [{**r.asDict(), "doc_ids": sorted(of[k]), "similarities": [of[k][d] for d in sorted(of[k])]} for k, r in sorted(rows.items())]
    for coverage in (0.3, 0.7, 1.0):
        plain = cluster.optimal_sampling(tree, 0.9, coverage)
        assert {(r["cluster_id"], r["doc_id"]) for r in plain} == {(r["cluster_id"], r["doc_id"]) for r in cluster.sample_hierarchy(nodes, each, 0.9, coverage).collect()}


def test_cluster_documents_need_the_index(spark):
    v = vectors(spark, POINTS)
    members = cluster.similarities(v, v.selectExpr("doc_id", "doc_id div 3 as cluster_id"))
    idx = spark.createDataFrame([(i, f"p{i}") for i in range(6)], "doc_id long, file_path string")
    assert {(r["cluster_id"], r["file_path"]) for r in cluster.cluster_documents(members, idx).collect()} == {(i // 3, f"p{i}") for i in range(6)}
    with pytest.raises(ValueError):
        cluster.cluster_documents(members, idx.where("doc_id > 0"))
    with pytest.raises(ValueError):
        cluster.cluster_documents(members, idx.union(idx.where("doc_id = 1")))


def test_duplicates_on_semantic_vectors(spark):
    """Near copies by DBSCAN over LSI vectors, and the documents of each group."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice("red green blue iron wood glass sea hill road lamp".split()) + str(rng.randrange(4)) for _ in range(60)) for _ in range(12)]
    docs = spark.createDataFrame(list(enumerate([*texts, texts[3] + " more0", texts[3], texts[7] + " more1"])), "doc_id long, text string")
    vec = lsi.fit(x := features.weights(docs), 15, 8).transform(x)
    found = cluster.dbscan(vec, 0.97, 2)
    assert {k: v for k, v in labels(found).items() if v >= 0} == {3: 3, 12: 3, 13: 3, 7: 7, 14: 7}
    groups = duplicates.duplicate_documents(found.where("cluster_id >= 0"), vec).collect()
    assert {(r["doc_id"], r["cluster_size"]) for r in groups} == {(3, 3), (12, 3), (13, 3), (7, 2), (14, 2)} and all(r["similarity"] > 0.95 for r in groups)


def test_highlight(spark):
    out = explain.highlight("A <b> Gold\nnothing", {"gold": 2.0, "zz": -1.0})
    assert out == 'A &lt;b&gt; <span style="background-color: rgba(255, 0, 0, 0.2)">Gold</span><br/>nothing'
    assert explain.colormap(0.2, 0.5)(0.1)[3] == 0.0
    with pytest.raises(ValueError):
        explain.colormap(filter_ratio=2)
    assert explain.random_weights(["a"], 1) == explain.random_weights(["a"], 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_are_left_out_only_where_they_cannot_hold_the_nearest(spark, monkeypatch, seed):
    """Clustered vectors, copies, a vector of norm 0 and one missing; most blocks are never met."""
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 20)
    monkeypatch.setattr(nearest, "SMALL_VALUES", 0)
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, 8))
    x = centers[rng.integers(0, 12, 900)] + 0.03 * rng.normal(size=(900, 8))
    x[5] = 0
    x[100:160] = x[100]
    kinds = [("a", "b", None)[i % 3] for i in range(900)]
    v = spark.createDataFrame([(i, x[i].tolist() if i != 7 else None, kinds[i]) for i in range(900)], "doc_id long, vec array<double>, category string").repartition(4)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    expected = {}
    for a in range(0, 900, 50):
        for b in range(900):
            s = round(float(unit[a] @ unit[b]), 9)
            if b != 7 and (s, -b) > expected.get((a, kinds[b]), (-2.0, 0)):
                expected[a, kinds[b]] = s, -b
    met, plain = [], nearest._met

    def counting(visits, train, *rest):
        met.append((visits.count(), train.select("block").distinct().count()))
        return plain(visits, train, *rest)

    monkeypatch.setattr(nearest, "_met", counting)
    rows = neighbors.nearest(v.where("doc_id % 50 = 0"), v).collect()
    assert {(r["doc_id"], r["category"]): (round(r["score"], 9), -r["nn_doc_id"]) for r in rows} == expected
    assert met[0][0] == 18 * 3 and met[1][0] < 0.6 * 18 * met[1][1]
    assert neighbors.nearest(v, v.limit(0)).count() == 0 and neighbors.nearest(v.limit(0), v).count() == 0


def test_features_merge_within_bounds(spark, monkeypatch):
    """Many partitions and a small bound: thresholds rise, and sums and sizes stay exact."""
    monkeypatch.setattr(birch, "MAX_FEATURES", 12)
    monkeypatch.setattr(birch, "FAN", 2)
    rng = np.random.default_rng(8)
    m = rng.normal(size=(300, 3))
    leaves = birch.condensed(vectors(spark, m).repartition(7), 0.2, 4).collect()
    assert len(leaves) <= 12 and len({r["part"] for r in leaves}) <= 7 and max(r["threshold"] for r in leaves) > 0.2
    assert sum(r["n"] for r in leaves) == 300 and np.allclose(sum(np.array(r["ls"]) for r in leaves), m.sum(axis=0))
    assert sum(r["ss"] for r in leaves) == pytest.approx((m**2).sum())
    centers = birch.fit_distributed(vectors(spark, m).repartition(7), 0.2, 4, n_clusters=3).collect()
    assert len(centers) == 3 and sum(r["size"] for r in centers) == 300
    assert np.allclose(sum(r["size"] * np.array(r["centroid"]) for r in centers), m.sum(axis=0))
    assert birch.fit_distributed(vectors(spark, m).limit(0)).count() == 0


def test_paths_of_a_tree(spark):
    parent = {0: None, 1: 0, 2: 0, 3: 1, 4: 3, 5: 4, 6: 5, 7: 6}
    depth = {k: 0 for k in parent}
    for k, p in parent.items():
        depth[k] = 0 if p is None else depth[p] + 1
    nodes = spark.createDataFrame([(k, p, depth[k]) for k, p in parent.items()], "cluster_id int, parent_id int, depth int")
    expected = set()
    for k in parent:
        above = k
        while above is not None:
            expected.add((k, above))
            above = parent[above]
    rows = birch.ancestors(nodes).collect()
    assert {(r["node"], r["above"]) for r in rows} == expected and len(rows) == len(expected)


def plain_dbscan(m, reach, least):
    d = np.sqrt(((m[:, None] - m[None]) ** 2).sum(2)) <= reach
    core = d.sum(1) >= least
    label = np.full(len(m), -1)
    for i in np.flatnonzero(core):
        if label[i] < 0:
            todo, label[i] = [i], i
            while todo:
                k = todo.pop()
                new = np.flatnonzero(d[k] & core & (label < 0))
                label[new] = i
                todo += new.tolist()
    for i in np.flatnonzero(~core):
        near = np.flatnonzero(d[i] & core)
        if len(near):
            label[i] = label[near[0]]
    return dict(enumerate(label.tolist()))


@pytest.mark.parametrize(("seed", "reach", "least", "block"), [(1, 0.25, 4, 1024), (2, 0.25, 4, 16), (3, 0.6, 12, 32), (4, 0.1, 2, 16), (5, 1.5, 30, 64)])
def test_dbscan_against_a_plain_version(spark, monkeypatch, seed, reach, least, block):
    monkeypatch.setattr(linkage, "BLOCK", block)
    monkeypatch.setattr(linkage, "BLOCKS_OF_CELL", 1)
    rng = np.random.default_rng(seed)
    m = np.concatenate([rng.normal(c, 0.15, (60, 2)) for c in ((0, 0), (1, 0), (0, 2))] + [rng.uniform(-2, 3, (60, 2)), np.zeros((9, 2))])
    m = rng.permutation(m)
    assert labels(linkage.dbscan(vectors(spark, m).repartition(3), reach, least)) == plain_dbscan(m, reach, least)


def test_points_in_reach_of_each_other_make_few_links(spark):
    """A dense group of m points is about a node a block, and none of its pairs is a row."""
    from quillspark.plans.scratch import Scratch

    rng = np.random.default_rng(4)
    m = rng.normal(0, 0.01, (3000, 3))
    points = vectors(spark, m).select(F.col("doc_id").alias("point"), F.lit(1).cast("bigint").alias("n"), "vec")
    scratch = Scratch(spark, "test")
    cells = linkage._cells(points, 64 * 4 * 1024, 1.0, scratch)
    balls = linkage._balls(cells, 1.0)
    placed = cells.where("home").join(balls, "point").select("cell", "point", F.col("ball").alias("node"), "v")
    links = linkage._compared(placed, cells.join(balls, "point").select("cell", "point", F.col("ball").alias("node"), "v"), 1.0, linkage._forest, "a long, b long")
    assert links.count() < 3 * linkage.PIVOTS * linkage.PIVOTS
    found = linkage.dbscan(vectors(spark, m), 1.0, 10)
    assert {r["cluster_id"] for r in found.collect()} == {0}


def test_answers_in_the_order_of_one_category(spark):
    rows = [(1, "a", 0.9), (1, "b", 0.1), (2, "a", 0.2), (2, "b", 0.8), (3, "a", 0.5), (3, "b", 0.4)]
    scores = spark.createDataFrame(rows, "doc_id long, category string, score double")
    told = lambda **k: [(r["doc_id"], round(r["best"], 9), [s["category"] for s in r["scores"]]) for r in categorize.shape(scores, **k).collect()]
    assert told() == [(1, 0.9, ["a"]), (2, 0.8, ["b"]), (3, 0.5, ["a"])]
    assert told(sort_by="b") == [(2, 0.8, ["b"]), (3, 0.4, ["a"]), (1, 0.1, ["a"])]
    assert told(max_categories=2, sort_by="a", min_score=0.3) == [(1, 0.9, ["a", "b"]), (3, 0.5, ["a", "b"])]


def test_centroid_ranker_tells_the_least_distance(spark):
    v = vectors(spark, [(0, 0), (0, 2), (4, 0)])
    centers = spark.createDataFrame([("x", [0.0, 0.0]), ("y", [4.0, 1.0])], "category string, centroid array<double>")
    got = {r["doc_id"]: (r["decision"], r["score"]) for r in neighbors.centroid_score(v, centers).collect()}
    assert got == {i: (d, pytest.approx(1 / (1 + np.exp(-d)))) for i, d in ((0, 0.0), (1, 2.0), (2, 1.0))}


def test_scores_of_an_answer(spark):
    """The second category by name is positive; scores for the first count with their sign turned."""
    truth = [(1, "ham"), (2, "spam"), (3, "spam"), (4, "ham"), (5, "spam")]
    best = [(1, "ham", 0.9), (2, "spam", 0.8), (3, "ham", 0.1), (4, "spam", 0.3), (5, "spam", 0.6)]
    frames = spark.createDataFrame(truth, "doc_id long, category string"), spark.createDataFrame(best, "doc_id long, category string, score double")
    row = metrics.response_scores(*frames).first()
    # signed: 2: 0.8, 5: 0.6, 4: 0.3, 3: -0.1, 1: -0.9
    assert row["precision"] == pytest.approx(2 / 3) and row["recall"] == pytest.approx(2 / 3) and row["roc_auc"] == pytest.approx(5 / 6)
    assert row["average_precision"] == pytest.approx((1 + 1 + 3 / 4) / 3)
    three = metrics.response_scores(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, category string"), frames[1].withColumn("category", F.lit("a"))).first()
    assert three["precision"] == pytest.approx(1 / 3) and np.isnan(three["roc_auc"])


def test_coefficients_over_a_table_model(spark, sf_dir, monkeypatch, tmp_path):
    """A model whose loadings are a table explains, is stored and comes back as one of the driver's."""
    from quillspark.plans import models
    from quillspark.plans.store import Store

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").where("doc_id % 4 = 0")
    x = features.weights(docs, features.FeatureParams(min_df=3, max_df=0.5, n_features=200, weighting="ltc")).persist()
    monkeypatch.setattr(lsi, "MAX_VALUES", 10)
    space = lsi.fit(x, docs.count(), 5)
    vec = space.transform(x, normalize=False)
    model = categorize.train(vec.join(docs.select("doc_id", F.col("lang").alias("category")), "doc_id"), "LogisticRegression")
    name, fitted = model.model[0]
    told = categorize.sensitivity(x, categorize.term_coefficients(model, space, name)).groupBy("doc_id").agg(F.sum("contribution").alias("s"))
    told = {r["doc_id"]: r["s"] for r in told.collect()}
    decided = {r["doc_id"]: float(np.dot(r["vec"], fitted.coefficients.toArray())) for r in vec.collect()}
    assert decided.keys() == told.keys() and all(abs(decided[d] - told[d]) < 1e-8 for d in told)
    store = Store(spark, str(tmp_path / "store"))
    parent = store.create("vectorizer", {})
    step = models.save_lsi(store, space, parent)
    again = {r["doc_id"]: r["vec"] for r in models.load_lsi(store, step).transform(x, normalize=False).collect()}
    monkeypatch.setattr(lsi, "MAX_VALUES", 10_000_000)
    held = models.load_lsi(store, step)
    assert isinstance(held, lsi.LsiModel)
    here = {r["doc_id"]: r["vec"] for r in held.transform(x, normalize=False).collect()}
    before = {r["doc_id"]: r["vec"] for r in vec.collect()}
    assert all(np.allclose(again[d], before[d]) and np.allclose(here[d], before[d]) for d in before) and len(again) == len(here) == len(before)
    x.unpersist()
