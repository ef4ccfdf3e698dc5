"""Batches of an ingest: killed, repeated, out of order, and after the end."""

import pytest

from quillspark.operators.features import FeatureParams
from quillspark.plans.ingest_log import EMPTY, OPEN, VECTORIZED, ClosedError, IngestLog
from quillspark.plans.store import Store


@pytest.fixture
def log(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    return IngestLog(store, store.create("vectorizer", {}, id="letters"))


def batch(spark, first, n):
    return spark.createDataFrame([(i, f"word{i % 5} common text number{i}") for i in range(first, first + n)], "doc_id long, text string")


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_each_batch_counts_once(spark, log):
    assert log.state == EMPTY and log.batches().count() == 0
    with pytest.raises(LookupError):
        log.documents()
    assert log.add(1, batch(spark, 100, 4)) and log.state == OPEN
    log._write(0, batch(spark, 0, 2))  # killed before its record
    assert log.pending() == [0] and log.committed() == [1]
    assert rows(log.batches(), "batch", "n_docs", "offset") == [(1, 4, 0)]
    assert rows(log.documents(), "doc_id") == [(100,), (101,), (102,), (103,)]
    with pytest.raises(ClosedError):
        log.vectorize(FeatureParams())
    assert log.add(0, batch(spark, 0, 3)) and not log.add(0, batch(spark, 500, 9)) and not log.add(1, batch(spark, 100, 4))
    assert rows(log.batches(), "batch", "n_docs", "offset") == [(0, 3, 0), (1, 4, 3)] and log.pending() == []
    assert rows(log.documents(), "internal_id", "doc_id", "batch") == [(0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 100, 1), (4, 101, 1), (5, 102, 1), (6, 103, 1)]


def test_a_log_is_found_again_and_closes(spark, log):
    log.add(0, batch(spark, 0, 6))
    log.add(1, batch(spark, 10, 6))
    again = IngestLog(log.store, log.store.find("letters"))
    assert again.committed() == [0, 1]
    model, weights = again.vectorize(FeatureParams())
    assert model.n_docs == 12 and weights.select("doc_id").distinct().count() == 12 and log.state == VECTORIZED
    assert log.store.read(log.step, "vocabulary").where("term = 'common'").first()["df"] == 12
    for act in (lambda: log.vectorize(FeatureParams()), lambda: log.add(2, batch(spark, 50, 1)), lambda: log.add(0, batch(spark, 0, 6))):
        with pytest.raises(ClosedError):
            act()


def test_a_document_in_two_batches_is_an_error(spark, log):
    log.add(0, batch(spark, 0, 3))
    log.add(1, batch(spark, 2, 3))
    with pytest.raises(ValueError):
        log.documents()
    with pytest.raises(ValueError):
        log.add(-1, batch(spark, 90, 1))


def test_an_empty_batch(spark, log):
    log.add(0, batch(spark, 0, 1).limit(0))
    log.add(1, batch(spark, 0, 2))
    assert rows(log.batches(), "batch", "n_docs", "offset") == [(0, 0, 0), (1, 2, 0)] and log.documents().count() == 2
