"""Near-duplicates by weighted shingles: brute force, ids with several texts, recall at the threshold, small broadcast limits."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lectern.llm import dartminhash, queries

SF = "/root/testdata/sf0.001"


def classes_of(rows, weighted=True, threshold=0.8):
    """Brute force over (id, text): all pairs, equal texts, and equal ids."""
    sets = [dartminhash.shingles(t or "") for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] == rows[b][0] or (rows[a][1] or "") == (rows[b][1] or "") or dartminhash.jaccard(sets[a], sets[b], weighted) >= threshold:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, least[find(k)]) for k, (i, _) in enumerate(rows))


def got(frame, **kw):
    return sorted((r[0], r[1]) for r in dartminhash.near_duplicates(frame, **kw).collect())


def changed(words, share, rng):
    return [f"x{rng.random()}" if rng.random() < share else w for w in words]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    a, b = [f"a{rng.randrange(400)}" for _ in range(300)], [f"b{rng.randrange(400)}" for _ in range(300)]
    c = ["again and again one line of it"] * 30 + [f"c{k}" for k in range(60)]
    d = ["again and again one line of it"] * 12 + [f"c{k}" for k in range(60)]  # the same set of shingles, but other counts
    e = [f"e{k}" for k in range(200)]
    return [
        (3, " ".join(a)), (5, " ".join(a)), (5, " ".join(b)), (7, " ".join([*b[:-1], "end"])), (9, " ".join(c)), (11, " ".join(d)),
        (13, " ".join(e)), (17, " ".join([*e[:198], "u", "v"])), (17, " ".join([*e[:198], "u", "v"])), (19, None), (23, ""), (29, "two words"),
    ]


def test_ids_with_several_texts_and_counts(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS class", "2 AS id", "'x' AS digest", "0 AS least")
    want = classes_of(rows)
    assert got(d, weighted=True) == want
    by = dict(want)
    assert by[3] == by[5] == by[7] == 3 and by[9] != by[11] and dict(got(d))[11] == 9


def test_without_broadcasts(spark, rows, monkeypatch):
    monkeypatch.setattr(dartminhash, "BROADCAST_NODES", 0)
    monkeypatch.setattr(dartminhash, "REMEMBERED", 1)
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), weighted=True) == classes_of(rows)


def test_the_query_equals_weighted_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((r.doc_id, r.class_id) for r in queries.op3_dart_minhash(spark, SF).collect()) == classes_of(rows)


def test_recall_at_the_threshold(spark):
    """Of more than 100 pairs (200 documents) between 0.8 and 0.85, at least 95 in 100 are joined; of pairs below 0.8, none."""
    rng, rows, near = random.Random(1), [], []
    for k in range(600):
        words = [f"w{k}_{rng.randrange(150)}" for _ in range(220)]
        other = changed(words, rng.uniform(0.018, 0.03), rng)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        near.append(dartminhash.jaccard(*[dartminhash.shingles(t) for _, t in rows[-2:]], True))
    near = np.array(near)
    by = dict(got(spark.createDataFrame(rows, "doc_id long, text string"), weighted=True))
    joined = np.array([by[2 * k + 1] == 2 * k for k in range(600)])
    at = (near >= 0.8) & (near < 0.85)
    assert at.sum() > 100 and joined[at].mean() > 0.95 and joined[near >= 0.8].mean() > 0.98 and not joined[near < 0.8].any()


def test_one_each_keeps_the_least_text(spark):
    d = spark.createDataFrame([(1, "b", "en"), (1, "a", "fr"), (1, "a", "de"), (2, None, None), (None, "x", "en"), (None, "x", "en")], "doc_id long, text string, lang string")
    assert sorted(map(tuple, dartminhash.one_each(d).collect()), key=str) == sorted([(1, "a", "de"), (2, None, None), (None, "x", "en"), (None, "x", "en")], key=str)


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert dartminhash.near_duplicates(d, weighted=True).count() == 0 and corpus_pipeline.near_duplicates(spark, d, SF).count() == 0


def test_a_short_text_takes_no_more_steps_than_a_long_one(monkeypatch):
    """The darts of a text are thrown together: a set of one element, which needs them all from it, took a step for each."""
    steps, mix = [], dartminhash.mix

    def counted(*args):
        steps.append(1)
        return mix(*args)

    monkeypatch.setattr(dartminhash, "mix", counted)
    for n in (1, 10, 400, 5000):
        steps.clear()
        dartminhash.signatures([(np.arange(n, dtype=np.uint64), np.ones(n))])
        assert len(steps) < 150, n


def test_a_signature_depends_on_its_set_alone():
    rng = np.random.default_rng(5)
    sets = [(rng.integers(0, 2**63, n).astype(np.uint64), rng.integers(1, w, n)) for n in (1, 2, 30, 700, 9000) for w in (2, 3, 40, 100_000)]
    sets.insert(3, (np.empty(0, np.uint64), np.empty(0, np.int64)))
    sig = dartminhash.signatures(sets)
    assert not sig[3].any() and all((dartminhash.signatures([s])[0] == row).all() for s, row in zip(sets, sig, strict=True))
    with pytest.raises(ValueError):
        dartminhash.signatures([(np.array([1], np.uint64), np.array([0.01]))])


@pytest.mark.parametrize("n,most", [(1, 2), (1, 1000), (20, 2), (300, 9), (4000, 60), (30_000, 2)])
def test_signatures_agree_as_often_as_the_sets_do(n, most):
    """Sets of few and of many elements, of small and of large weights, over many draws: within four standard errors of their similarity."""
    rng, off, spread = np.random.default_rng(n + most), [], []
    for r in range(40):
        items, w = rng.integers(0, 2**63, n).astype(np.uint64), rng.integers(1, most, n)
        v = np.where(rng.random(n) < 0.2, np.maximum(1, w // 2), w)
        want = float(np.minimum(w, v).sum() / np.maximum(w, v).sum())
        if n > 1:  # elements of one side alone
            a, b = (items[n // 10 :], w[n // 10 :]), (items, v)
            want = float(np.minimum(a[1], v[n // 10 :]).sum() / (np.maximum(a[1], v[n // 10 :]).sum() + v[: n // 10].sum()))
        else:
            a, b = (items, w), (items, v)
        s = dartminhash.signatures([a, b], seed=r)
        off.append((s[0] == s[1]).mean() - want)
        spread.append(want * (1 - want) / s.shape[1])
    assert abs(np.mean(off)) <= 4 * np.sqrt(np.sum(spread)) / len(off)


def test_shingles_of_texts_together_are_those_of_each():
    given = ["", "one", "a b c d", "A b\tc d E", "a b c d e f a b c d e f", "  ", "x " * 400, " ".join(f"w{k}" for k in range(3000)), "é É é"]
    for text, (x, n) in zip(given, dartminhash.shingle_sets(given), strict=True):
        words = text.encode().lower().split()
        runs = [tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))] if words else []
        alone = dartminhash.shingles(text)
        assert (alone[0] == x).all() and (alone[1] == n).all() and sorted(n) == sorted(Counter(runs).values())
    assert dartminhash.shingle_sets([]) == []
