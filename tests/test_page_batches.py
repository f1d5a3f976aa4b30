"""Pages read many at once, against one at a time."""

import random

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lectern.operators import layout

WORDS = ["Ref", "Descripcion", "Cantidad", "cant", "Precio unidad", "Total", "importe", "ud", "x", "perno 3", "12", "1,5", "sin", " total ", "1.234,50", "-", "7 a"]


def pages(seed, n):
    r = random.Random(seed)
    tops = [0.0, 1.0, 5.9, 6.0, 6.1, 12.0, 20.0, 25.0, 40.0, 41.0]
    out = []
    for _ in range(n):
        x = [r.choice([0.0, 10.0, 10.0, 50.0, 90.0]) for _ in range(r.randint(0, 14))]
        out.append((r.choice([100.0, 200.0, 400.0]), [(r.choice(WORDS), a, r.choice(tops), a + r.choice([5.0, 10.0, 30.0]), 0.0) for a in x]))
    return out


def test_many_pages_at_once_equal_one_at_a_time():
    for seed in range(60):
        p = pages(seed, 40)
        flat = [(k, *b) for k, (_, blocks) in enumerate(p) for b in blocks]
        col = lambda i, kind: np.array([f[i] for f in flat], kind)  # noqa: B023, E731
        at, item, fields = layout.batch_items(col(0, int), col(1, object), col(2, float), col(3, float), col(4, float), np.array([h for h, _ in p]))
        got = list(zip(at, item, *fields, strict=True))
        want = [(k, i, *[x.get(f) for f in layout._FIELDS]) for k, (h, blocks) in enumerate(p) for i, x in enumerate(layout.page_items(blocks, h))]
        assert got == want
    assert layout.batch_items(*[np.zeros(0, int)] * 1, np.zeros(0, object), *[np.zeros(0)] * 3, np.zeros(0)) == ([], [], [[] for _ in layout._FIELDS])


def test_pages_that_cross_batches(spark):
    p = pages(7, 300)
    flat = [(k if k % 50 else None, h, *b) for k, (h, blocks) in enumerate(p) for b in blocks if k % 50 or k == 100] + [(5, p[5][0], None, 0.0, 0.0, 1.0, 0.0)]
    kept = {None if k == 100 else k: (h, blocks) for k, (h, blocks) in enumerate(p) if k % 50 or k == 100}
    d = spark.createDataFrame(flat, "page long, height double, text string, x1 double, y1 double, x2 double, y2 double").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
        got = {(r.page, r.item): (r.reference, r.description) for r in layout.items_of_pages(d).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    # blocks in the same place come in no set order
    sure = {k: v for k, v in kept.items() if len({(b[1], b[2]) for b in v[1]}) == len(v[1]) and len({b[1] for b in v[1]}) == len(v[1])}
    want = {(k, i): (x.get("reference"), x.get("description")) for k, (h, blocks) in kept.items() for i, x in enumerate(layout.page_items(blocks, h))}
    assert {k: v for k, v in got.items() if k[0] in sure} == {k: v for k, v in want.items() if k[0] in sure} and got.keys() == want.keys()


def test_page_items_are_laid_out_once_and_not_gathered(spark):
    plan = entry.queries()["page_table_items"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_extendedprice") and "collect_list" not in plan and "Union" not in plan
