"""The word index against brute force: ranks with skipped segments, phrases, statistics, odd texts, and added documents."""

import math
import random
from collections import Counter

import pytest

from lectern.functions import columns as C
from lectern.operators import wordindex
from lectern.operators.wordindex import WordIndex
from lectern.sources import snapshots
from lectern.sources.stored import fresh_path

SCHEMA = "doc_id long, text string"


def tokens(t):
    return wordindex.words((t or "").lower())


def plain(docs, asked, top):
    sets = [(i, tokens(t)) for i, t in docs]
    mean, out = sum(len(t) for _, t in sets) / len(sets), []
    df = {w: sum(w in t for _, t in sets) for w in asked}
    for i, t in sets:
        n = Counter(t)
        if any(n[w] for w in asked):
            s = sum(math.log(1 + (len(sets) - df[w] + 0.5) / (df[w] + 0.5)) * n[w] * 2.2 / (n[w] + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in asked)
            out.append((round(s, 6), i))
    return sorted(out, key=lambda x: (-x[0], x[1]))[:top]


def texts(n, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["Éte", "ete", "AÑO", "x9"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    return [(k, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(80)))) for k in range(n)]


ODD = [(900, None), (901, ""), (902, " .,; "), (903, "w1 " * 3000), (904, "w1"), (None, "w1 w2 w3"), (7, "w1 w2 twice the id"), (7, "w1 w2 twice the id"), (905, "中文 w2, w3. W4!")]


@pytest.mark.parametrize("docs_a_segment,first", [(1024, 64), (16, 2), (1, 3)])
def test_ranks(spark, monkeypatch, docs_a_segment, first):
    monkeypatch.setattr(wordindex, "SEGMENT_DOCS", docs_a_segment)
    monkeypatch.setattr(wordindex, "FIRST", first)
    docs = texts(300) + [d for d in ODD if d[0] is not None]
    index = WordIndex(spark, fresh_path(spark, "w")).add(spark.createDataFrame(docs, SCHEMA).repartition(3))
    for asked in (("w0", "w30"), ("w59",), ("ete", "ano"), ("nothing",), ("w1", "w1", "w5")):
        got = [(r.score, r.doc_id) for r in index.bm25(asked, 10).collect()]
        want = plain(docs, asked, 10)
        assert [s for s, _ in got] == pytest.approx([s for s, _ in want], abs=2e-6) and len(got) == len(want)
        assert {i for s, i in got if s > want[-1][0] + 2e-6} == {i for s, i in want if s > want[-1][0] + 2e-6} if want else not got


def test_phrases_and_statistics(spark, monkeypatch):
    monkeypatch.setattr(wordindex, "SEGMENT_DOCS", 20)
    docs = texts(200, 2) + ODD
    index = WordIndex(spark, fresh_path(spark, "w")).add(spark.createDataFrame(docs, SCHEMA))
    for said in (["w0", "w1"], ["w1", "w1", "w1"], ["w2", "w3", "w4"], ["w0"], ["w0", "nothing"], []):
        want = Counter()
        for i, t in docs:
            x = tokens(t)
            n = sum(x[k : k + len(said)] == said for k in range(len(x))) if said else 0
            if n:
                want[i, n] += 1
        assert Counter((r.doc_id, r.n) for r in index.phrase(said).collect()) == want
    df, cf = Counter(), Counter()
    for _, t in docs:
        df.update(set(tokens(t)))
        cf.update(tokens(t))
    assert {r.term: (r.df, r.cf) for r in index.terms().collect()} == {w: (df[w], cf[w]) for w in df}


def test_added_documents_count(spark, monkeypatch):
    docs = texts(120, 3)
    path = fresh_path(spark, "w")
    WordIndex(spark, path).add(spark.createDataFrame(docs[:50], SCHEMA))
    index = WordIndex(spark, path).add(spark.createDataFrame(docs[50:], SCHEMA))
    want = plain(docs, ("w3", "w7"), 10)
    assert [r.score for r in index.bm25(("w3", "w7"), 10).collect()] == pytest.approx([s for s, _ in want], abs=2e-6)
    assert len(index.compact().generations()) == 1
    assert [r.score for r in index.bm25(("w3", "w7"), 10).collect()] == pytest.approx([s for s, _ in want], abs=2e-6)
    assert len(index.add(spark.createDataFrame([(500, "w3 only")], SCHEMA)).generations()) == 2 and index.phrase(["w3", "only"]).collect() == [(500, 1)]
    want = plain([*docs, (500, "w3 only")], ("w3", "w7"), 10)
    monkeypatch.setattr(snapshots.Ledger, "create", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        index.add(spark.createDataFrame(docs, SCHEMA))
    monkeypatch.undo()
    assert len(index.generations()) == 2 and [r.score for r in index.bm25(("w3", "w7"), 10).collect()] == pytest.approx([s for s, _ in want], abs=2e-6)


def test_no_documents(spark):
    empty = WordIndex(spark, fresh_path(spark, "w"))
    assert empty.bm25(("a",), 5).count() == 0 and empty.phrase(["a"]).count() == 0 and empty.terms().count() == 0
    index = empty.add(spark.createDataFrame([], SCHEMA))
    assert index.bm25(("a",), 5).count() == 0 and index.terms().count() == 0


def test_searches_read_no_text(spark):
    sf = "/root/testdata/sf0.001"
    plan = wordindex.bm25_topk(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "In(term" in plan and C.ACCENTED not in plan
