"""The retrieval operators on whole texts and tables: against brute force."""

import math

import numpy as np
import pytest

from lectern.operators import business as B
from lectern.operators import documents as D
from lectern.operators.vectorindex import nearest

ITEM = "The quick brown fox jumps over the lazy dog."


def brute(items, docs, least=0.3):
    grams = lambda t: {t[k : k + 3] for k in range(max(1, len(t) - 2))} if t else set()
    plain = lambda t: " ".join((t or "").lower().split())
    out = {}
    for i, a in items:
        for d, b in docs:
            x, y = grams(plain(a)), grams(plain(b))
            if x and y and len(x & y) / len(x | y) >= least:
                out[i, d] = pytest.approx(len(x & y) / len(x | y), abs=1e-6)
    return out


def test_alike_takes_whole_texts(spark):
    items = [(1, ITEM), (2, "ab"), (3, None), (4, " \n"), (5, "x" * 400 + ITEM)]
    docs = [(10, "So " + ITEM), (11, "ab"), (12, None), (13, ""), (14, "x" * 500 + " " + ITEM), (15, "  THE quick\nbrown fox"), (16, "other words")]
    want = brute(items, docs)
    assert {(1, 10), (2, 11), (1, 14), (5, 14), (1, 15)} <= set(want)
    for block in (1, 2, 100):
        rows = D.alike(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"), item_block=block).collect()
        assert {(r.item_id, r.doc_id): r.similarity for r in rows} == want and len(rows) == len(want)


def test_hops_over_all_orders(spark):
    edges = [(1, 10), (1, 10), (2500, 10), (2500, 11), (9000, 11), (9000, 12), (9001, 12), (None, 10), (3, None)]
    got = B.hops(spark.createDataFrame(edges, "o long, s long"), 2).collect()
    assert sorted((r.order, r.hops) for r in got) == [(1, 0), (2500, 1), (9000, 2)]


def test_nearest_answers_every_query(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 8)]) for i in range(350)] + [(350, [0.0] * 8), (351, None), (352, [1.0, 2.0]), (500, [1.0] * 8)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    want = set()
    for q, a in rows:
        if q % 100 == 0:
            of = [(round(float(np.dot(a, b)) / math.sqrt(np.dot(a, a) * np.dot(b, b)), 6), i) for i, b in rows if b and len(b) == 8 and any(b)]
            want |= {(q, i) for _, i in sorted(of, key=lambda x: (-x[0], x[1]))[:20]}
    got = nearest(e.filter("vec_id % 100 = 0"), e).collect()
    assert {(r.query_id, r.vec_id) for r in got} == want and len(got) == 5 * 20


def test_mmr_compares_whole_texts(spark):
    head, tail, other = "same head " * 40, "a passage that comes late " * 40, "quite something else, of zebras and jukeboxes " * 40
    docs = spark.createDataFrame([(1, head + tail), (2, "x" * 330 + tail), (3, head + other)], "doc_id long, text string")
    got = D.mmr_of(spark.createDataFrame([(1, 3.0), (2, 2.0), (3, 1.0)], "doc_id long, score double"), docs).orderBy("rank").collect()
    like = lambda a, b: len(D.trigrams(a) & D.trigrams(b)) / len(D.trigrams(a) | D.trigrams(b))
    texts = {1: (head + tail).strip(), 2: ("x" * 330 + tail).strip(), 3: (head + other).strip()}
    value = {d: 0.7 / k - 0.3 * like(texts[1], texts[d]) for k, d in ((2, 2), (3, 3))}
    best = max(value, key=value.get)
    assert [r.doc_id for r in got][:2] == [1, best] and got[1].score == pytest.approx(value[best])
