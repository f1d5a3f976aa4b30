"""The answer cache: exact questions first, recall at the threshold, isolation keys, ties and odd rows."""

import numpy as np

from lectern.operators.answercache import ALIKE, answers

SCHEMA = "id long, isolation string, question string, v array<double>"


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 32))
    cosine = rng.uniform(0.88, 0.99, 400)
    noise = rng.normal(size=x.shape)
    noise -= x * (np.einsum("ij,ij->i", noise, x) / np.einsum("ij,ij->i", x, x))[:, None]
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    y = unit(x) * cosine[:, None] + unit(noise) * np.sqrt(1 - cosine**2)[:, None]
    key = [f"s{k % 3}" for k in range(400)]
    cache = spark.createDataFrame([(k, key[k], f"q{k}", v.tolist()) for k, v in enumerate(x)], SCHEMA)
    asked = spark.createDataFrame([(1000 + k, key[k], f"other {k}", v.tolist()) for k, v in enumerate(y)], SCHEMA)
    near = unit(y) @ unit(x).T
    want = {}
    for k in range(400):
        own = [(-round(near[k, j], 6), j) for j in range(400) if key[j] == key[k] and round(near[k, j], 6) >= ALIKE]
        if own:
            want[1000 + k] = min(own)[1]
    got = {r.id: r.key for r in answers(asked, cache).collect()}
    assert set(got) <= set(want) and all(got[i] == want[i] for i in got)
    assert len(got) >= 0.97 * len(want) and len(want) > 200


def test_exact_questions_isolation_and_odd_rows(spark):
    v, w = [1.0, 0.0, 0.2], [0.0, 1.0, 0.0]
    cache = [(1, "a", "How  much?", w), (2, "a", "how much? ", v), (3, "b", "how much?", v), (4, None, "null key", v), (5, "a", None, v), (6, "a", "zero", [0.0] * 3), (7, "a", "none", None), (8, "a", "short", [1.0, 0.0]), (9, "a", "again", v)]
    asked = [(10, "a", "HOW MUCH?", v), (11, "a", "another", v), (12, "c", "how much?", v), (13, None, "x", v), (14, "a", "y", None), (15, "a", None, w), (16, "a", "z", [0.0] * 3), (17, "", "null key", v)]
    got = sorted(map(tuple, answers(spark.createDataFrame(asked, SCHEMA), spark.createDataFrame(cache, SCHEMA)).collect()))
    assert got == [(10, 1, "exact", 1.0), (11, 2, "meaning", 1.0), (13, 4, "meaning", 1.0), (15, 1, "meaning", 1.0)]
    assert answers(spark.createDataFrame([], SCHEMA), spark.createDataFrame(cache, SCHEMA)).count() == 0
    assert answers(spark.createDataFrame(asked, SCHEMA), spark.createDataFrame([], SCHEMA)).count() == 0
