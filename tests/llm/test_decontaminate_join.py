"""Decontamination end to end: recall of edited items, without the pre-filter, repeated ids, short and odd items, small limits."""

import numpy as np
import pytest
from test_llm import edited

from lectern.llm import decontaminate as D

SF = "/root/testdata/sf0.001"
FILLER = "lorem ipsum dolor sit amet consectetur adipiscing "


def found(docs, items, **kw):
    return {(r.doc_id, r.item_id): r.edits for r in D.contamination(docs, items, **kw).collect()}


@pytest.fixture(scope="module")
def items(spark):
    return [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]


def frame(spark, rows, path):
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS class", "3 AS keys").write.parquet(str(path))
    return spark.read.parquet(str(path))


def brute(rows, items):
    out = {}
    for i, t in rows:
        for k, item in items:
            x, y = D.normalise(item), D.normalise(t or "")
            n = D.distance(x, y)[0]
            if x and n <= D.edits_allowed(len(x)):
                out[i, k] = n
    return out


@pytest.mark.parametrize("share", [0.05, 0.08])
def test_recall_end_to_end(spark, items, tmp_path, share):
    """Items edited within and at the limit, six times each, inside other text: 95 in 100 are found, and nothing that brute force doesn't find."""
    rng = np.random.default_rng(5)
    rows = [(100 * i + k, FILLER * 3 + edited(share)(D.normalise(t), rng).decode(errors="replace") + " " + FILLER * 2) for i, t in items for k in range(6)]
    got, want = found(frame(spark, rows, tmp_path / "d"), spark.createDataFrame(items, "item_id long, text string")), brute(rows, items)
    assert len(want) > 100 and all(want[k] <= v for k, v in got.items()) and got.keys() <= want.keys()
    assert len(got) / len(want) > (0.99 if share < 0.08 else 0.95)


def test_without_prefilter_and_without_broadcast(spark, items, tmp_path, monkeypatch):
    rng = np.random.default_rng(9)
    some = items[:6]
    rows = [(i, FILLER + edited(0.04)(D.normalise(t), rng).decode(errors="replace") + " " + FILLER) for i, t in some] + [(900, FILLER), (901, None), (902, "")]
    docs, table = frame(spark, rows, tmp_path / "d"), spark.createDataFrame(some, "item_id long, text string")
    want = brute(rows, some)
    assert found(docs, table) == want and len(want) >= 5
    whole = found(docs, table, prefilter=False)
    assert whole.keys() <= want.keys() and len(whole) >= len(want) - 1
    monkeypatch.setattr(D, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(D, "PIECE_BLOCK", 7)
    monkeypatch.setattr(D, "CHUNK", 100)
    assert found(docs, table) == want


def test_odd_items(spark, tmp_path):
    long = "The quick brown fox jumps over the lazy dog and then some more words follow here"
    rows = [(1, "a Tiny, thing " + long), (2, "tinything"), (None, long), (None, long), (3, None), (4, long.replace("lazy", "lazi") * 2)]
    items = [(7, "tiny"), (8, long), (8, "tiny thing"), (9, ""), (10, "!!!"), (None, long), (11, None), (12, "x" * 40_000)]
    got = [tuple(r) for r in D.contamination(frame(spark, rows, tmp_path / "d"), spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(1, 7, 0), (1, 8, 0), (None, 8, 0), (None, 8, 0), (4, 8, 1)], key=str)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(docs, items).count() == 0 and D.contamination(docs, spark.createDataFrame([(1, "some words of an item")], "item_id long, text string")).count() == 0
    assert D.contamination(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items).count() == 0
