"""Roots by pointer jumping, and threads of replies."""

import random

from lectern.operators import forest


def plain(parents):
    out = {}
    for n in parents:
        seen, at = [], n
        while at not in seen and parents.get(at) in parents:
            seen.append(at)
            at = parents[at]
        out[n] = min(seen[seen.index(at) :]) if at in seen else at
    return out


def test_roots_of_chains_trees_and_cycles(spark):
    rng = random.Random(1)
    parents = {k: k - 1 if k % 50 else None for k in range(200)}  # chains of 50
    parents |= {200 + k: 200 if k else None for k in range(60)}  # a star
    parents |= {300: 301, 301: 302, 302: 300, 303: 302, 304: 303, 310: 310, 311: 999}  # a ring with a tail, itself, and a parent that isn't there
    parents |= {400 + k: 400 + rng.randrange(80) for k in range(80)}
    rows = spark.createDataFrame(list(parents.items()), "node long, parent long")
    assert {r.node: r.root for r in forest.roots(rows).collect()} == plain(parents)


def test_roots_of_nothing(spark):
    assert forest.roots(spark.createDataFrame([], "node long, parent long")).count() == 0


def mails(spark, rows):
    return spark.createDataFrame(rows, "id long, message_id string, in_reply_to string, subject_key string, project string")


def test_a_chain_of_ten_is_one_thread(spark):
    rows = [(k, f"<{k}>", f"<{k - 1}>" if k else None, f"subject {k}", "p") for k in range(10)]
    rows += [(20, "<20>", "<unknown>", "subject 3", "p"), (21, None, None, "subject 0", "p"), (22, None, "<21>", "subject 0", "q"), (23, "<5>", None, "other", "p"), (24, "<24>", "<5>", None, None), (25, None, None, None, "p"), (26, None, None, None, "p")]
    rows += [(30, "<30>", "<31>", "late", None), (31, "<31>", None, "early", None), (32, None, None, "early", None)]
    got = {r.id: r.thread for r in forest.threads(mails(spark, rows), "id", "project").collect()}
    want = dict.fromkeys(range(10), 0) | {20: 20, 21: 0, 22: 22, 23: 0, 24: 0, 25: 25, 26: 26, 30: 30, 31: 30, 32: 30}
    assert got == want


def test_mails_that_answer_each_other_are_one_thread(spark):
    got = {r.id: r.thread for r in forest.threads(mails(spark, [(1, "<1>", "<2>", "a", None), (2, "<2>", "<1>", "b", None), (3, "<3>", "<3>", "c", None)]), "id", "project").collect()}
    assert got == {1: 1, 2: 1, 3: 3}
