"""Blocks: runs of documents of bounded size, so that words and values cross the network once a block, not once an occurrence.

A block is what one task reads, up to BLOCK_CHARS characters. Its distinct keys (words, n-grams) go to a global shuffle by
key; what comes back for them meets the block's compressed text in one bounded task. No key has more rows than there are
blocks, so frequent words make no hot task. A block's name is a digest of its place, ids and texts: if documents are not
dealt alike in both readings, its text finds no keys and the job stops, rather than give wrong rows. Read documents from
files or from a checkpoint, which Spark always splits alike.
"""

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

BLOCK_CHARS = 32_000_000

OTHERWISE = "the documents were dealt otherwise in another reading; read them from files or a checkpoint"

PAYLOAD_SCHEMA = "block long, ids array<long>, lens binary, payload binary"


class Numbers(dict):
    """Numbers keys in the order in which they come."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def _cut(frames: Iterator[pd.DataFrame], most: int):
    """(block, ids, texts) of a task's (doc_id, text) frames; ids are ints or None."""
    pid, k, ids, texts, chars = TaskContext.get().partitionId(), 0, [], [], 0

    def close():
        nonlocal k, ids, texts, chars
        h = xxhash.xxh3_64(f"{pid} {k} {ids}".encode())
        for t in texts:
            h.update(t.encode())
            h.update(b"\xff")
        out = (int(np.uint64(h.intdigest()).astype(np.int64)), ids, texts)
        k, ids, texts, chars = k + 1, [], [], 0
        return out

    for f in frames:
        for i, t in zip(f["doc_id"].astype(object), f["text"], strict=True):
            ids.append(None if pd.isna(i) else int(i))
            texts.append(t)
            chars += len(t)
            if chars >= most:
                yield close()
    if ids:
        yield close()


def dealt(frames: Iterator[pd.DataFrame], most: int = BLOCK_CHARS):
    """(block, rows) of a task's (doc_id, text) frames; rows yields (id or None, text) and is to be used up before the next block.

    Blocks are numbered by task and place, for callers that check their content themselves.
    """
    pid, k = TaskContext.get().partitionId(), 0

    def each():
        nonlocal k
        chars = 0
        for f in frames:
            for i, t in zip(f["doc_id"].astype(object), f["text"], strict=True):
                if chars >= most:
                    k, chars = k + 1, 0
                chars += len(t)
                yield k, None if pd.isna(i) else int(i), t

    for k_, rows in groupby(each(), key=lambda x: x[0]):
        yield (pid << 16) + k_, ((i, t) for _, i, t in rows)


def keys(docs: DataFrame, of: Callable[[list, list[str]], pd.DataFrame], schema: str, most: int = BLOCK_CHARS) -> DataFrame:
    """of(ids, texts) gives a block's distinct keys, numbered by the column local; each row gets its block. docs: (doc_id, text)."""

    def run(frames):
        for block, ids, texts in _cut(frames, most):
            out = of(ids, texts).assign(block=block)
            for at in range(0, len(out), 50_000):
                yield out.iloc[at : at + 50_000]

    return docs.mapInPandas(run, schema + ", block long")


def payloads(docs: DataFrame, most: int = BLOCK_CHARS) -> DataFrame:
    """One row a block: its ids and its compressed text."""

    def run(frames):
        for block, ids, texts in _cut(frames, most):
            raw = [t.encode() for t in texts]
            lens = np.array([len(r) for r in raw], "<u4").tobytes()
            yield pd.DataFrame({"block": [block], "ids": [ids], "lens": [lens], "payload": [zstandard.ZstdCompressor(level=3).compress(b"".join(raw))]})

    return docs.mapInPandas(run, PAYLOAD_SCHEMA)


def unpack(row) -> list[bytes]:
    """The texts of a payload row, UTF-8."""
    raw = zstandard.ZstdDecompressor().decompress(row.payload, max_output_size=1 << 31)
    ends = np.cumsum(np.frombuffer(row.lens, "<u4").astype(np.int64))
    return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def meet(payload: DataFrame, values: DataFrame, of: Callable[[int, list, list[bytes], pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """of(block, ids, texts, the block's value rows) for every block."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) != 1:
            raise RuntimeError(OTHERWISE)
        row = left.iloc[0]
        return of(int(row.block), [None if pd.isna(i) else int(i) for i in row.ids], unpack(row), right)

    return payload.groupBy("block").cogroup(values.groupBy("block")).applyInPandas(run, schema)
