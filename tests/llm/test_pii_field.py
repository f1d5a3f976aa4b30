"""The skip-chain field: masked distant supervision, planted variants, secrets, and messages on a graph with loops."""

import itertools
import re

import numpy as np
import pytest

from lectern.llm import pii


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").filter("text RLIKE '[0-9@]' AND length(text) < 20000").collect()
    return [r.text for r in sorted(rows)]


def test_planted_variants_are_found_and_little_else(texts):
    """Trained on half of the documents, tested on the others with variants planted in them."""
    field, rng = pii.fit(texts[::2]), np.random.default_rng(8)
    held = [pii.planted(t, rng) for t in texts[1::2] for _ in range(4)]
    found = pii.spans_of([t for t, _ in held], field)
    wanted = hits = extra = added = 0
    for (t, want), spans in zip(held, found, strict=True):
        wanted += len(want)
        hits += sum(any(k == x and y < b and a < z for x, y, z, _ in spans) for k, a, b in want)
        for k, a, b, base in spans:
            if not base:
                added += 1
                plain = k == "secret" and re.search("token = \"?$", t[:a]) or k == "card" and re.fullmatch("[0-9]{16}", t[a:b])
                extra += not plain and not any(a < z and y < b for _, y, z in want)
    assert wanted > 60 and hits / wanted > 0.9 and added > 60 and extra / added < 0.1


def test_the_field_adds_spans_on_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pii.digests(pii.find(docs, pii.train(docs))).collect()
    assert sum(r.n_added for r in rows) > 0 and all(r.n_spans == r.n_added + r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows)
    assert sum(r.n_spans == 0 for r in rows) > 0.9 * len(rows)


def test_messages_on_a_loop_are_near_the_exact_marginals():
    rng = np.random.default_rng(1)
    node, pair, edges = rng.normal(size=(4, 3)), 0.4 * rng.normal(size=(2, 3, 3)), np.array([[0, 1, 0], [1, 2, 0], [2, 3, 0], [0, 3, 1], [0, 2, 1]])
    exact = np.zeros((4, 3))
    for y in itertools.product(range(3), repeat=4):
        p = np.exp(sum(node[i, v] for i, v in enumerate(y)) + sum(pair[t, y[a], y[b]] for a, b, t in edges))
        for i, v in enumerate(y):
            exact[i, v] += p
    exact /= exact.sum(axis=1, keepdims=True)
    assert np.abs(np.exp(pii.propagate(node, edges, pair, 50)[0]) - exact).max() < 0.05


def test_mentions_without_digits_and_long_texts():
    text = "Mail maria.lopez@example.com now. " + "filler words " * 20_000 + "maria.lopez again"
    g = pii.Graph([text])
    assert [text[a:b] for _, a, b in g.nodes] == ["maria.lopez@example.com", "maria.lopez"] and g.edges.tolist() == [[0, 1, 1]]
    many = " ".join("+1 (743) 555-3824 or 743 555 3824;" for _ in range(2_000))
    assert len(pii.Graph([many]).edges) < 12 * len(pii.Graph([many]).nodes)


def test_empty_and_null(spark):
    field = pii.fit([])
    d = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string").selectExpr("*", "1 AS spans", "2 AS n_email")
    assert [r.n_spans for r in pii.digests(pii.find(d, field)).collect()] == [0, 0]
    empty = d.limit(0)
    assert pii.digests(pii.find(empty, pii.train(empty))).count() == 0
