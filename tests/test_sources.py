import pytest
from pyspark.sql import functions as F

from quillspark.operators import categorize, features, lsi
from quillspark.plans import models
from quillspark.plans.store import ModelNotFound, StopWords, Store
from quillspark.sources import email, files
from quillspark.streaming.ingest import weigh_stream


def test_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/file2.txt").write_bytes("zwei \xff".encode("latin-1"))
    (tmp_path / "a/file1.txt").write_text("eins")
    (tmp_path / "note.md").write_text("no")
    rows = files.read_folder(spark, str(tmp_path), r".*\d\.txt", infer_ids=True).orderBy("internal_id").collect()
    assert [(r["internal_id"], r["document_id"], r["text"]) for r in rows] == [(0, 1, "eins"), (1, 2, "zwei ")]


def test_lists(spark, tmp_path):
    (tmp_path / "x.txt").write_text("hallo")
    by_path = files.from_list(spark, [{"file_path": f"{tmp_path}/z.txt", "document_id": 9}, {"file_path": f"{tmp_path}/./x.txt", "document_id": 3}])
    assert [(r["internal_id"], r["document_id"]) for r in by_path.orderBy("internal_id").collect()] == [(0, 3), (1, 9)]
    assert files.with_text(by_path).where("document_id = 3").first()["text"] == "hallo"
    inline = files.from_list(spark, [{"content": "b", "document_id": "a100"}, {"content": "a", "document_id": "a2"}], offset=5)
    assert [tuple(r) for r in files.with_text(inline).orderBy("internal_id").select("internal_id", "document_id", "text").collect()] == [(5, "a100", "b"), (6, "a2", "a")]
    with pytest.raises(ValueError):
        files.from_list(spark, [{"content": "x"}, {"document_id": 1}])


def test_csv_tagged_truth(spark, tmp_path):
    (tmp_path / "t.csv").write_text("1;ab;2;cd\n2;ef;3;gh\n")
    rows = files.read_csv(spark, f"{tmp_path}/t.csv", [1, 3], ";").orderBy("document_id").collect()
    assert [(r["document_id"], r["text"]) for r in rows] == [(0, "abcd"), (1, "efgh")] and rows[1]["file_path"].endswith("t.csv:1")
    (tmp_path / "s").write_text(".I 26187\n.W\naa bb\ncc\n.I 26188\n.W\ndd\n")
    assert [tuple(r) for r in files.read_tagged(spark, f"{tmp_path}/s").orderBy("document_id").collect()] == [(26187, "aa bb cc"), (26188, "dd")]
    (tmp_path / "bad").write_text("no tag\n.I 1\n.W\nx\n")
    with pytest.raises(ValueError):
        files.read_tagged(spark, f"{tmp_path}/bad")
    (tmp_path / "g").write_text("a.txt 1\nb.txt  0\n\n")
    assert [tuple(r) for r in files.read_ground_truth(spark, f"{tmp_path}/g").orderBy("file_path").collect()] == [("a.txt", 1), ("b.txt", 0)]


def test_email_headers(spark):
    text = "Message-ID: <b@x>\r\nReferences: <r@x>\r\n <a@x>\r\nIn-Reply-To: <a@x>\r\nSubject: Re:\r\n two lines\r\n\r\nbody\nMessage-ID: <no>"
    rows = email.read_headers(spark.createDataFrame([(0, text), (1, None)], "internal_id long, text string")).orderBy("message_idx").collect()
    assert tuple(rows[0]) == (0, "<b@x>", "<a@x>", ["<r@x>", "<a@x>"], "Re: two lines")
    assert tuple(rows[1]) == (1, None, None, [], None)


def test_example_ids(spark):
    docs = spark.range(50).select(F.col("id").alias("internal_id"), (F.col("id") % 3).cast("string").alias("category"))
    out = files.example_ids(docs, ["0", "1"])
    assert out.where("document_id <> internal_id * internal_id or category = '2'").isEmpty() and 5 < out.where("is_train").count() < 30


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    data = store.create("vectorizer", {"weighting": "nnc"}, id="data-1")
    store.append(data, "documents", spark.range(3))
    assert store.append(data, "documents", spark.range(2)).count() == 5 and store.finished(data, "documents")
    model = store.create("lsi", {"k": 5}, data)
    child = store.create("cluster", {}, model, id="cl")
    assert store.params(data) == {"weighting": "nnc"} and store.datasets() == ["data-1"]
    assert [s.kind for s in store.find("cl").lineage()] == ["vectorizer", "lsi", "cluster"]
    with pytest.raises(FileExistsError):
        store.create("vectorizer", {}, id="data-1")
    with pytest.raises(NotImplementedError):
        store.create("lsi", {}, child)
    with pytest.raises(ValueError):
        store.create("lsi", {}, data, id="a b")
    store.invalidate(data)
    with pytest.raises(ModelNotFound):
        store.find("cl")
    assert store.find(model.id).id == model.id
    store.delete(data)
    assert store.datasets() == []
    words = StopWords(spark, f"file://{tmp_path}/words")
    words.save("mine", ["b", "a"])
    assert words.load("mine") == ["a", "b"] and "mine" in words and "other" not in words
    words.delete("mine")
    assert words.names() == []


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = features.fit(docs.where("doc_id < 100"))
    docs.where("doc_id >= 100").write.parquet(f"{tmp_path}/in")
    out = f"{tmp_path}/out"
    stream = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in")
    weigh_stream(stream, model, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), f"{tmp_path}/cp").awaitTermination()
    got = {(r["doc_id"], r["term"]): r["weight"] for r in spark.read.parquet(out).collect()}
    assert got == pytest.approx({(r["doc_id"], r["term"]): r["weight"] for r in model.transform(docs.where("doc_id >= 100")).collect()})


def test_models_come_back(spark, sf_dir, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    old = docs.where("doc_id < 150")
    params = features.FeatureParams(weighting="ltcp", min_df=2, n_features=300, stop_words=("der", "die"), ngram_range=(1, 2))
    model, x = features.fit_transform(old, params)
    step = models.save_features(store, model, id="mails")
    models.features_table(store, step, x)
    again = models.load_features(store, store.find("mails"))
    assert again.params == params and (again.n_docs, again.pivot) == (150, model.pivot)
    rows = lambda df: {tuple(r)[:2]: r[2] for r in df.collect()}
    assert rows(again.transform(docs)) == pytest.approx(rows(model.transform(docs)))
    space = lsi.fit(x, 150, 6)
    child = models.save_lsi(store, space, step)
    vec = lambda m, w: {r["doc_id"]: r["vec"] for r in m.transform(w).collect()}
    vectors = space.transform(x)
    store.write(child, "vectors", vectors)
    kept, back = vec(space, x), vec(models.load_lsi(store, store.find(child.id)), x)
    assert kept.keys() == back.keys() and all(kept[d] == pytest.approx(back[d]) for d in kept)
    named = vectors.join(docs.select("doc_id", docs["lang"].alias("category")), "doc_id")
    for method in ("LogisticRegression", "NearestCentroid"):
        fitted = categorize.train(named, method)
        saved = models.save_categorizer(store, fitted, child)
        found = models.load_categorizer(store, saved)
        assert found.categories == fitted.categories and rows(found.predict(named)) == pytest.approx(rows(fitted.predict(named)))

    # more documents: weighted and projected by the frozen models, categorizers are stale
    more = docs.where("doc_id >= 150")
    models.append_documents(store, step, more)
    assert rows(store.read(step, "features")) == pytest.approx(rows(x.unionByName(model.transform(more))))
    assert {r["doc_id"] for r in store.read(child, "vectors").collect()} == {r["doc_id"] for r in store.read(step, "features").select("doc_id").distinct().collect()}
    assert not store.children(child)
    with pytest.raises(ValueError):
        models.append_documents(store, step, more)
    # and fewer
    models.save_categorizer(store, fitted, child)
    models.remove_documents(store, step, docs.where("doc_id % 2 = 0").select("doc_id"))
    for table, of in (("features", step), ("vectors", child)):
        assert not store.read(of, table).isEmpty() and store.read(of, table).where("doc_id % 2 = 0").isEmpty()
    assert not store.children(child)


def test_a_tagged_file_is_read_by_many_tasks(spark, tmp_path):
    """Blocks over the borders of splits are read once and whole."""
    blocks = {i: [f"word{i * k} line {k}" for k in range(i % 7)] for i in range(3000)}
    (tmp_path / "big").write_text("\n".join(f".I {i}\n.W\n" + "\n".join(x) for i, x in blocks.items()) + "\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.text(f"{tmp_path}/big").rdd.getNumPartitions() > 20
        rows = files.read_tagged(spark, f"{tmp_path}/big").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r["document_id"]: r["text"] for r in rows} == {i: " ".join(x) for i, x in blocks.items()} and len(rows) == 3000
    (tmp_path / "prelude").write_text(".X\nfirst\n.I 4\n.W\nbody\n")
    assert [tuple(r) for r in files.read_tagged(spark, f"{tmp_path}/prelude").collect()] == [(4, "body")]
