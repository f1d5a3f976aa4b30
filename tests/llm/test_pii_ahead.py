"""The skip-chain field reaches mentions that come before the recognised one."""

from lectern.llm import pii

CUT, WHOLE = "jan.kowalski.77@mail4", "jan.kowalski.77@mail4.example.com"


def test_mentions_before_the_recognised_one(spark):
    model = pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    for n in (1, 3, 40):
        text = " ".join([f"Then {CUT} wrote."] * n + [f"Write to {WHOLE} now."])
        spans = pii.spans_of([text], model)[0]
        assert [(k, text[a:b], base) for k, a, b, base in spans] == [("email", CUT, False)] * n + [("email", WHOLE, True)]


def test_edges_are_linear_and_distinct():
    words = [CUT if k % 3 else WHOLE for k in range(300)]
    g = pii.Graph([" and ".join(words), " and ".join(words)])
    pairs = [tuple(sorted(e[:2])) for e in g.edges.tolist()]
    assert len(set(pairs)) == len(pairs) <= 6 * len(g.nodes)
    seen = {n for n, o in enumerate(g.observed) if o}
    tied = {x for a, b in pairs for x, y in ((a, b), (b, a)) if y in seen}
    assert tied == set(range(len(g.nodes))) and all(g.nodes[a][0] == g.nodes[b][0] for a, b in pairs)
