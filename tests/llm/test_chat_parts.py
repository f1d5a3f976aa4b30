"""Rows of a rendering hold a bounded number of messages whatever the turns are, and give the whole dialogue in order."""

import collections
import random

import pytest

from lectern.llm import chat


@pytest.mark.parametrize("broadcast", [0, 100])
def test_rows_are_bounded_and_whole(spark, monkeypatch, broadcast):
    pieces = chat.pieces
    monkeypatch.setattr(chat, "pieces", lambda t, most: pieces(t, most, broadcast))
    random.seed(0)
    rows = [(1, None, random.choice("ab"), f"m{random.randint(0, 40)}") for _ in range(500)]  # no turns at all
    rows += [(2, 5, "a", "same")] * 300 + [(2, 200, "b", "late")]  # equal messages at one turn
    rows += [(None, k % 3, "c", str(k)) for k in range(150)]  # no conversation
    rows += [(3, k, "ab"[k % 2], "x") for k in range(130)]  # as it should be
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).collect()
    assert max(r.n_messages for r in got) <= chat.PART_TURNS
    said = collections.defaultdict(list)
    for c, turn, role, text in rows:
        said[c].append((-1 if turn is None else turn, role, text))
    by = collections.defaultdict(list)
    for r in got:
        by[r.conv_id, r.perspective].append(r)
    assert set(by) == {(c, m[1]) for c, ms in said.items() for m in ms}
    for (c, who), parts in by.items():
        parts.sort(key=lambda r: r.offset)
        text = "".join(r.text for r in parts)
        assert text == "".join(("<|assistant|>\n" if role == who else f"<|user|>{role}\n") + t + "<|end|>\n" for _, role, t in sorted(said[c]))
        assert [r.part for r in parts] == sorted(r.part for r in parts)
        at = 0
        for r in parts:
            assert r.offset == at
            at += len(r.text)
            for span in filter(None, r.mask.split(",")):
                a, b = map(int, span.split(":"))
                assert r.text[:a].endswith("<|assistant|>\n") and r.text[a:b].endswith("<|end|>\n")
    assert sorted(r.part for r in got if r.conv_id == 3 and r.perspective == "a") == [0, 1, 2]
