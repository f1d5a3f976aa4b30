"""Skip edges decide what a mention itself leaves open: the same forms with and without something in the document that answers to them."""

import time

import numpy as np
import pytest

from lectern.llm import pii

#: What is named in full, a mention of it, and a look-alike of that mention.
CASES = [
    ("card", "4539578763621486", "453957876362", "718264930175"),
    ("card", "5500 0055 5555 5559", "5500.0055.5555.5559", "8137.2946.6018.2745"),
    ("phone", "+1 (743) 555-3824", "7435553824", "2917640853"),
    ("phone", "+44 20 7946 0958", "442079460958", "718264930175"),
    ("ip", "97.51.17.173", "97-51-17-173", "42-86-31-194"),
    ("email", "maria.lopez@example.com", "maria.lopez@example", "pedro.ramos@example"),
    ("secret", 'token = "269b1cea0846965f2d3ecb5cdb87c0edc7a7a587"', '"269b1cea0846965f2d3ecb5cdb87c0edc7a7a587"', '"f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"'),
]
FRAMES = ["Write {0} down first. Between these there are many words of no use at all. Later it reads {1} and also {2} in the list.", "See {2} or {1} here.\nMuch later comes {0} in full."]


@pytest.fixture(scope="module")
def field(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def _marked(field, skip):
    hits = wrong = 0
    for kind, whole, cut, other in CASES:
        for frame in FRAMES:
            t = frame.format(whole, cut, other)
            spans = pii.spans_of([t], field, skip=skip)[0]
            put = {k: len(frame[: frame.index(k)].format(whole, cut, other)) for k in ("{1}", "{2}")}
            over = lambda k, w: {x for x, a, b, base in spans if not base and a < put[k] + len(w) and put[k] < b}  # noqa: B023, E731
            hits += kind in over("{1}", cut)
            wrong += bool(over("{2}", other))
    return hits, wrong


def test_only_a_distant_tie_tells_a_mention_from_its_look_alike(field):
    hits, wrong = _marked(field, True)
    assert hits >= 0.9 * 2 * len(CASES) and wrong <= 1
    hits, wrong = _marked(field, False)
    assert hits <= 2


def test_held_out_mentions_with_and_without_skip_edges(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("text RLIKE '[0-9@]' AND length(text) < 20000").select("text").collect()
    texts = sorted(r.text for r in rows)
    field, rng = pii.fit(texts[::2]), np.random.default_rng(8)
    held = [pii.contested(t, [], rng) for t in texts[1::2] if pii.base_spans(t)]
    got = {}
    for skip in (True, False):
        found = pii.spans_of([t for t, _ in held], field, skip=skip)
        marks = [
            (kind, {k for k, y, z, base in spans if not base and y < b and a < z})
            for (t, put), spans in zip(held, found, strict=True)
            for kind, a, b in put
            if not pii.base_spans(t[a:b])
        ]
        wanted, others = [(k, m) for k, m in marks if k != "outside"], [m for k, m in marks if k == "outside"]
        assert len(wanted) > 150 and len(others) > 150
        got[skip] = sum(k in m for k, m in wanted) / len(wanted), sum(map(bool, others)) / len(others)
    assert got[True][0] > 0.9 and got[True][1] < 0.03 and got[False][0] < 0.3


def test_texts_that_share_a_graph_do_not_change_each_other(field, monkeypatch):
    texts = [f.format(whole, cut, other) for _, whole, cut, other in CASES for f in FRAMES] + [" ".join(c[2] for c in CASES)]
    together = pii.spans_of(texts, field)
    assert together == [pii.spans_of([t], field)[0] for t in texts]
    monkeypatch.setattr(pii, "GRAPH_CHARS", 100)
    assert together == pii.spans_of(texts, field)
    assert pii.spans_of([], field) == [] and pii.spans_of(["", "no"], field) == [[], []]


def test_time_is_linear_in_the_addresses(field):
    def seconds(n):
        start = time.perf_counter()
        assert len(pii.spans_of([" ".join(f"user{i}.name@host{i % 97}.example.com" for i in range(n))], field)[0]) == n
        return time.perf_counter() - start

    seconds(500)
    assert seconds(16_000) < 16 * max(seconds(2_000), 0.02)
