"""The decomposition over tables against a dense one, and against the one that the driver holds."""

import random

import numpy as np
import pytest

from quillspark.operators import lsi, lsi_blocks


def sparse(spark, seed, n_docs, n_terms, rank):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n_docs, rank)) * 0.5 ** np.arange(rank)) @ rng.normal(size=(rank, n_terms))
    x[:, ::7] *= rng.random((n_docs, 1)) < 0.5
    rows = [(int(d), f"t{t:04d}", float(x[d, t])) for d, t in zip(*np.nonzero(x), strict=True)]
    random.Random(seed).shuffle(rows)
    return x, spark.createDataFrame(rows, "doc_id long, term string, weight double")


@pytest.mark.parametrize(("values", "weights"), [(4_000_000, 2_000_000), (300, 700)])
def test_as_a_dense_decomposition(spark, monkeypatch, values, weights):
    """In one tile, and in many blocks of both sides."""
    monkeypatch.setattr(lsi_blocks, "BLOCK_VALUES", values)
    monkeypatch.setattr(lsi_blocks, "BLOCK_WEIGHTS", weights)
    monkeypatch.setattr(lsi_blocks, "STEP_VALUES", 200)
    x, rows = sparse(spark, 5, 60, 90, 14)
    model = lsi_blocks.fit(rows, 60, 6)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(model.sigma, s[:6], rtol=1e-6)
    v = np.zeros((90, 6))
    names = {r["idx"]: int(r["term"][1:]) for r in model.terms.collect()}
    for r in model.v.collect():
        v[names[r["idx"]]] = r["vec"]
    assert np.allclose(np.abs((v * vt[:6].T).sum(axis=0)), 1, atol=1e-5) and np.allclose(v.T @ v, np.eye(6), atol=1e-9)
    assert (v[np.abs(v).argmax(axis=0), range(6)] > 0).all()
    centred = x @ v
    assert model.explained_variance == pytest.approx(centred.var(axis=0).sum() / x.var(axis=0).sum(), rel=1e-9)
    got = {r["doc_id"]: r["vec"] for r in model.transform(rows, normalize=False).collect()}
    assert len(got) == 60 and all(np.allclose(got[d], x[d] @ v / model.sigma, atol=1e-9) for d in got)
    for r in model.transform(rows).collect():
        assert np.linalg.norm(r["vec"]) == pytest.approx(1)
    # back in term space
    some = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (2, [0.0, 2.0, 0.0, 0.0, 0.0, -1.0])], "doc_id long, vec array<double>")
    back = {(r["doc_id"], int(r["term"][1:])): r["weight"] for r in model.to_terms(some).collect()}
    assert len(back) == 180 and all(abs(back[1, t] - v[t, 0]) < 1e-12 and abs(back[2, t] - 2 * v[t, 1] + v[t, 5]) < 1e-12 for t in range(90))


def test_taken_where_the_matrix_is_too_large(spark, monkeypatch):
    x, rows = sparse(spark, 7, 50, 70, 12)
    small = lsi.fit(rows, 50, 5)
    monkeypatch.setattr(lsi, "MAX_VALUES", 100)
    large = lsi.fit(rows, 50, 5)
    assert isinstance(large, lsi_blocks.BlockModel) and large.k == small.k
    assert np.allclose(large.sigma, small.sigma, rtol=1e-6) and large.explained_variance == pytest.approx(small.explained_variance, rel=1e-6)
    a, b = ({r["doc_id"]: np.array(r["vec"]) for r in m.transform(rows).collect()} for m in (small, large))
    assert a.keys() == b.keys() and all(np.allclose(a[d], b[d], atol=1e-4) for d in a)


def test_fewer_terms_than_components_and_none(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0), (2, "b", 2.0)], "doc_id long, term string, weight double")
    model = lsi_blocks.fit(rows, 2, 5)
    assert np.allclose(model.sigma, np.linalg.svd([[1, 0], [1, 2]])[1])
    with pytest.raises(ValueError):
        lsi_blocks.fit(rows.limit(0), 2, 5)
