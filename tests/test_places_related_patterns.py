"""Nearest anchors, related documents and many patterns, against brute force."""

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from lectern.operators import business, extraction, patterns, places
from lectern.operators.related import Links, Peers, related


def anchors_of(spark, entities, anchors, kind="double"):
    e = spark.createDataFrame(entities, f"plan long, entity long, x {kind}, y {kind}")
    return places.nearest_anchors(e, spark.createDataFrame(anchors, f"plan long, anchor long, x {kind}, y {kind}"))


def test_a_plan_of_many_entities(spark):
    rng = np.random.default_rng(1)
    a = np.concatenate([rng.normal(size=(1500, 2)) * 0.01, rng.uniform(-50, 50, (300, 2)), [[200, 200]]])
    e = np.concatenate([rng.uniform(-60, 60, (9000, 2)), rng.normal(size=(3000, 2)) * 0.02, [[1000, -1000], [200, 190]]])
    rows = anchors_of(spark, [(1, i, *map(float, p)) for i, p in enumerate(e)], [(1, i, *map(float, p)) for i, p in enumerate(a)])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    got = {r.entity: r for r in rows.collect()}
    for at in range(0, len(e), 500):
        d = np.sqrt(np.square(e[at : at + 500, None] - a[None]).sum(2))
        for k, (near, which) in enumerate(zip(d.min(1), d.argmin(1), strict=True)):
            assert got[at + k].anchor == which and abs(got[at + k].distance - near) < 1e-9 * max(1, near)
    assert [got[i].rank for i in sorted(got, key=lambda i: (got[i].distance, i))] == list(range(1, len(e) + 1))


def test_ties_nulls_and_plans_without_anchors(spark):
    e = [(1, 10, 0.0, 0.0), (1, 11, None, 1.0), (1, 12, float("nan"), 1.0), (2, 13, 5.0, 5.0), (1, 14, 3.0, 0.0), (3, 15, 1.0, 1.0), (1, 10, 0.0, 0.0)]
    a = [(1, 7, 1.0, 0.0), (1, 5, -1.0, 0.0), (1, 6, 0.0, 1.0), (1, 3, 3.0, 0.0), (1, 2, 3.0, 0.0), (1, 9, None, 0.0), (3, 1, 1.0, 1.0)]
    got = sorted((r.plan, r.rank, r.entity, r.anchor, r.distance) for r in anchors_of(spark, e, a).collect())
    assert got == [(1, 1, 14, 2, 0.0), (1, 2, 10, 5, 1.0), (1, 3, 10, 5, 1.0), (1, 4, 11, None, None), (1, 5, 12, None, None), (2, 1, 13, None, None), (3, 1, 15, 1, 0.0)]
    assert anchors_of(spark, [], a).count() == 0 and {r.anchor for r in anchors_of(spark, e, []).collect()} == {None}


def brute_related(seeds, kinds, hops):
    """kinds: [(name, links or None, members or None, cap, steps)]."""
    out = {}
    for seed in set(seeds):
        reached, frontier = {seed}, {seed: ()}
        for depth in range(1, hops + 1):
            ways = defaultdict(list)
            for k, (name, links, members, cap, steps) in enumerate(kinds):
                if links is None and depth > steps:
                    continue
                for node, path in frontier.items():
                    if links is not None:
                        to = {b for a, b in links if a == node and b is not None and b != node}
                    else:
                        to = set()
                        for of in {o for d, o in members if d == node and o is not None}:
                            to |= set(sorted({d for d, o in members if o == of and d != node}, reverse=True)[:cap])
                    for x in to:
                        ways[x].append((k, (*path, f"{name}:{x}")))
            frontier = {x: min(w) for x, w in ways.items() if x not in reached}
            for x, (k, path) in frontier.items():
                out[seed, x] = (kinds[k][0], depth, " > ".join(path))
            reached |= set(frontier)
            frontier = {x: path for x, (_, path) in frontier.items()}
    return out


def test_related_documents_equal_brute_force(spark):
    rng = random.Random(2)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(50)] + [(1, None), (None, 2), (3, 3)]
    back = [(b, a) for a, b in links]
    clients = [(d, d % 5 if d % 7 else None) for d in range(60)] + [(d, 99) for d in range(60)]  # 99 holds all
    folders = [(d, d // 3) for d in range(60)] + [(4, 1), (4, 2)]
    pairs = lambda rows, a, b: spark.createDataFrame(rows, f"{a} long, {b} long")
    kinds = [Links("next", pairs(links, "src", "dst")), Links("previous", pairs(back, "src", "dst")), Peers("client", pairs(clients, "doc", "of"), 4), Peers("folder", pairs(folders, "doc", "of"), 2, steps=2)]
    seeds = [0, 1, 5, 5, 17, 33, 59, 1000]
    want = brute_related(seeds, [("next", links, None, 0, 0), ("previous", back, None, 0, 0), ("client", None, clients, 4, 1), ("folder", None, folders, 2, 2)], 3)
    got = related(pairs([(s, s) for s in seeds], "doc", "n"), kinds, 3).collect()
    assert {(r.doc, r.related): (r.relation, r.depth, r.path) for r in got} == want and len(got) == len(want)
    assert related(pairs([], "doc", "n"), kinds).count() == 0


def test_many_patterns_equal_the_join(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcñ") for _ in range(rng.randrange(1, 6))) for _ in range(3000)] + ["ABC", "Ñ", "a b", None, "zz", "zz"]
    texts = [(k, "".join(rng.choice("abcñÑABC xyz") for _ in range(rng.randrange(80)))) for k in range(60)] + [(100, None), (101, ""), (0, "abc twice the key")]
    d, w = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(x,) for x in words], "word string")
    want = sorted((k, x) for k, t in texts if t is not None for x in {y.lower() for y in words if y is not None} if x in t.lower())
    for block in (500, 10**6):
        assert sorted(map(tuple, patterns.found(d, "id", "text", w, block).collect())) == want
    assert patterns.found(d, "id", "text", w.limit(0)).count() == 0
    every = spark.createDataFrame([("",)], "word string")
    assert sorted(r.id for r in patterns.found(d, "id", "text", every).collect()) == sorted(k for k, t in texts if t is not None)


def test_a_hundred_thousand_learned_rules(spark):
    pages = spark.createDataFrame([(k, f"n{k}.html", f"f{k % 7}/", "html", "") for k in range(50)], "page_id long, name string, folder string, extension string, text string")
    rules = spark.range(100_000).select(F.lit("product").alias("type"), F.concat(F.lit("n"), F.col("id").cast("string"), F.lit(".")).alias("word"), F.lit(0.3).alias("weight"))
    got = {r.page_id: (r.type, r.confidence) for r in extraction.classified(pages, "page_id", rules=(), settled=(), learned=rules).collect()}
    assert got == {k: ("product", 0.4) for k in range(50)}


def test_dimensions_against_the_scale(spark):
    rows = [(1, 5.0, 0.0, 0.0, 1181.1, 4.0, 300.0, 50.0, 0.8), (2, 5.0, 0.0, 0.0, 600.0, 4.0, 300.0, 50.0, 0.8), (3, 5.0, None, 0.0, 600.0, 4.0, 300.0, 50.0, 0.8), (4, 5.0, 0.0, 0.0, 2.0, 3.0, 300.0, 50.0, 0.8), (5, 0.0, 0.0, 0.0, 600.0, 4.0, 300.0, 50.0, 0.8), (6, 5.0, 0.0, 0.0, 600.0, 4.0, None, 50.0, 0.8), (7, 5.0, 0.0, 0.0, 600.0, 4.0, 300.0, 0.0, 0.8), (8, 5.0, 9.0, 1200.0, 0.0, 0.0, 300.0, 50.0, None)]
    dims = spark.createDataFrame(rows, "id int, value_m double, x0 double, y0 double, x1 double, y1 double, dpi double, scale double, confidence double")
    got = {r.id: (r.expected_m and round(r.expected_m, 3), r.needs_review, r.confidence) for r in places.checked_dimensions(dims).collect()}
    assert got == {1: (5.0, False, 0.8), 2: (2.54, True, 0.4), 3: (None, False, 0.8), 4: (None, False, 0.8), 5: (2.54, False, 0.8), 6: (None, False, 0.8), 7: (None, False, 0.8), 8: (5.08, False, None)}


def test_documents_with_very_many_references(spark):
    rng = random.Random(8)
    mentions = [(d, rng.randrange(40)) for d in range(40) for _ in range(rng.randrange(12))] + [(d, r) for d in (100, 101, 5) for r in range(500 * (d == 100) + 30)] + [(7, None), (None, 3)]
    sets = defaultdict(set)
    for d, r in mentions:
        if d is not None and r is not None:
            sets[d].add(r)
    want = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 2}
    rows = spark.createDataFrame(mentions, "doc long, ref long")
    for few in (0, 5, 20, 1000):
        got = business.sharing(rows, few).collect()
        assert {(r.a, r.b): r.shared for r in got} == want and len(got) == len(want)
