"""DBSCAN by tiles of large blocks, and how often a point travels."""

import numpy as np
import pyarrow as pa
import pytest

from quillspark.operators import linkage


def found(spark, x):
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "doc_id long, vec array<double>")
    return {r["doc_id"]: r["cluster_id"] for r in linkage.dbscan(df, 0.35, 4).collect()}


@pytest.mark.parametrize(("block", "tile"), [(64, 16), (32_768, 7), (32_768, 2048)])
def test_tiles_find_the_same_clusters(spark, monkeypatch, block, tile):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.2, (40, 3)) for c in ((0, 0, 0), (2, 0, 0), (0, 1.2, 0))] + [rng.uniform(-3, 3, (60, 3))])
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= 0.35**2
    core = near.sum(1) >= 4
    label = np.where(core, np.arange(len(x)), len(x))
    for _ in range(len(x)):
        label = np.where(core, np.where(near & core[None], label[None], len(x)).min(1), len(x))
    first = np.where(near & core[None], np.arange(len(x))[None], len(x)).min(1)
    told = {i: int(label[i]) if core[i] else int(label[first[i]]) if first[i] < len(x) else -1 for i in range(len(x))}
    monkeypatch.setattr(linkage, "BLOCK", block)
    monkeypatch.setattr(linkage, "TILE", tile)
    assert found(spark, x) == told


def test_blocks_are_large(spark):
    """A point is sent once for each block that it meets: 2 here, 49 with blocks of 1024."""
    assert -(-50_000 // linkage.BLOCK) <= 2 and linkage.TILE**2 * 8 <= 64_000_000


def test_tiles_that_lie_apart_are_not_compared(spark, monkeypatch):
    """Before, every tile met every other one: 64 comparisons of the tiles of eight groups, and of each kind."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 0.05, (64, 3)) + [5 * g, 0, 0] for g in range(8)])
    order = rng.permutation(len(x))
    monkeypatch.setattr(linkage, "TILE", 64)
    table = pa.table({"point": np.arange(len(x)), "n": np.ones(len(x)), "v": [list(v) for v in x[order]]})
    met, plain = [], linkage._near
    monkeypatch.setattr(linkage, "_near", lambda *args: met.append(1) or plain(*args))
    around = pa.concat_tables(linkage._told(table, table, 0.5, linkage._counts)).group_by("point").aggregate([("around", "sum")])
    assert len(met) == 8
    told = (((x[order][:, None] - x[order][None]) ** 2).sum(2) <= 0.25).sum(1)
    assert dict(zip(around["point"].to_pylist(), around["around_sum"].to_pylist())) == dict(enumerate(told))
