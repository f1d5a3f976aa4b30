"""The vector index: recall, exactness, hot cells, favourite cells, and rows that are added."""

import numpy as np
import pytest

from lectern.operators import vectorindex as V
from lectern.sources.stored import fresh_path

SCHEMA = "vec_id long, embedding array<double>"


def clustered(n, seed=1, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(99).normal(size=(20, 16))
    return centres[rng.integers(0, 20, n)] + rng.normal(size=(n, 16)) * spread


def brute(x, queries, top=20):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return {int(q): [int(i) for i in np.lexsort((np.arange(len(x)), -np.round(u @ u[q], 6)))[:top]] for q in queries}


def got(df):
    out = {}
    for r in df.orderBy("query_id", "score", "vec_id").collect():
        out.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    return {q: [i for _, i in sorted(v)] for q, v in out.items()}


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(c) for c in v]) for i, v in enumerate(x)], SCHEMA)


def recall(found, want):
    return np.mean([len(set(found.get(q, [])) & set(w)) / len(w) for q, w in want.items()])


def test_recall_and_exact_search(spark):
    x = clustered(1500)
    e, want = table(spark, x), brute(x, range(0, 1500, 100))
    index = V.build(e, fresh_path(spark, "v"))
    asked, probes = e.filter("vec_id % 100 = 0"), V.calibrated(index)
    assert probes < len(index.centroids) / 3
    assert recall(got(V.search(index, asked, probes=probes)), want) >= 0.9
    assert got(V.search(index, asked, probes=1, exact=True)) == want


def test_recall_without_clusters(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    x = np.array([r.embedding for r in e.orderBy("vec_id").collect()], float)
    index = V.build(e, fresh_path(spark, "v"))
    found = got(V.search(index, e.filter("vec_id % 100 = 0"), probes=V.calibrated(index)))
    assert recall(found, brute(x, range(0, len(x), 100))) >= 0.9


def test_hot_cells_and_favourite_ones_are_split(spark, monkeypatch):
    monkeypatch.setattr(V, "CELL_ROWS", 40)
    monkeypatch.setattr(V, "QUERY_ROWS", 7)
    x = np.concatenate([clustered(100), np.tile(clustered(1, 5), (300, 1)) + np.random.default_rng(3).normal(size=(300, 16)) * 1e-3])
    e = table(spark, x)
    index = V.build(e, fresh_path(spark, "v"), cells=5)
    assert index.pieces.max() >= 5
    assert got(V.search(index, e, top=5, probes=2, exact=True)) == brute(x, range(400), 5)


def test_added_rows_are_found(spark):
    x = clustered(400)
    path = fresh_path(spark, "v")
    index = V.build(table(spark, x[:200]), path)
    assert V.add(index, table(spark, x[200:], 200)).n.sum() == 400
    again = V.opened(spark, path)
    assert got(V.search(again, table(spark, x).filter("vec_id % 100 = 0"), exact=True)) == brute(x, range(0, 400, 100))


@pytest.mark.parametrize("rows", [[], [(1, None), (None, [1.0, 2.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, []), (5, [1.0, None])]])
def test_nothing_to_index(spark, rows):
    t = spark.createDataFrame(rows, SCHEMA)
    assert V.build(t, fresh_path(spark, "v")) is None and V.nearest(t, t).count() == 0


def test_lengths_and_repeated_rows(spark):
    t = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.6, 0.8]), (4, None)], SCHEMA)
    rows = sorted(map(tuple, V.nearest(t.filter("vec_id IN (2, 3, 4)"), t).collect()))
    assert rows == [(2, 2, 1.0), (3, 1, 0.6), (3, 1, 0.6), (3, 3, 1.0)]
