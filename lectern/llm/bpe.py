"""Byte-level BPE by a global distinct-word shuffle.

Documents are split into pre-tokens; every block's distinct pre-tokens are shuffled by word, each distinct word is encoded
once, and its ids go back to the blocks it came from, where the pre-tokens of each text, in order, are replaced by ids.
Decoding looks ids up in the tokenizer's table of token bytes, which is as large as its vocabulary, whatever the corpus.
"""

import base64
import re
import zlib
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import blocks
from lectern.llm.common import texts

#: For texts of ASCII and Latin letters, where Python's own classes agree with the Unicode properties of the usual pattern.
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_ODD = re.compile("[^\x00-\x1b\x20-\x7fÀ-ɏ]")
#: The pattern that _PLAIN stands for.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def splitter(pattern: str):
    """A function from a text to its pre-tokens."""
    slow = regex.compile(pattern).findall
    if pattern != PATTERN:
        return slow
    return lambda t: slow(t) if _ODD.search(t) else _PLAIN.findall(t)


@cache
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def token_bytes(path: str) -> list[bytes]:
    """Id to token bytes."""
    r = ranks(path)
    out = [b""] * (max(r.values()) + 1)
    for k, v in r.items():
        out[v] = k
    return out


def merge(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of least rank, leftmost first, merges until none has a rank."""
    if (whole := rank.get(word)) is not None:
        return [whole]
    if len(word) > 128:
        return _merge_long(word, rank)
    parts = [word[i : i + 1] for i in range(len(word))]
    none = len(rank) + 1
    pairs = [rank.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while pairs and (least := min(pairs)) != none:
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = rank.get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = rank.get(parts[i] + parts[i + 1], none)
    return [rank[p] for p in parts]


def _merge_long(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """merge() with a heap, for very long pre-tokens."""
    import heapq

    n = len(word)
    part, after, before = [word[i : i + 1] for i in range(n)], list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i]
        if part[i] is None or j >= n or len(part[i]) + len(part[j]) != size:
            continue
        part[i], part[j] = part[i] + part[j], None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (r := rank.get(both := part[a] + part[b])) is not None:
                heapq.heappush(heap, (r, a, len(both)))
    return [rank[p] for p in part if p is not None]


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers below 2^32, byte by byte of their significance, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(x: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(x, max_output_size=1 << 31), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4")[:, 0]


def _small(x: np.ndarray) -> tuple[int, bytes]:
    """Whole numbers in as few bytes each as the largest takes."""
    width = 1 if not len(x) or x.max() < 1 << 8 else 2 if x.max() < 1 << 16 else 4
    return width, x.astype(f"<u{width}").tobytes()


def encode(docs: DataFrame, ranks_path: str, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text", block_chars: int = blocks.BLOCK_CHARS) -> DataFrame:
    """(doc_id, ids array<int>, decoded binary) of every row; a null or empty text has no ids; repeated rows and null ids stay.

    decoded is what the ids stand for, looked up in the table of token bytes in the task that holds them anyway.

    Other columns are left out, whatever their names. Special tokens are ordinary text. ranks_path is read on the executors
    and has to be there on each, as an installed package is. Each document goes out as its words' numbers within its block
    (its positions), and each block's distinct words as (word, block, number); only their ids come back.
    """
    d = texts(docs, id_col, text_col)

    def block_words(frames):
        split = splitter(pattern)
        for block, rows in blocks.dealt(frames, block_chars):
            seen = {}
            for _, t in rows:
                seen.update(dict.fromkeys(split(t)))
            words, at = list(seen), (block << 24) + np.arange(len(seen), dtype=np.int64)
            del seen
            for a in range(0, len(words), 50_000):
                yield pd.DataFrame({"word": words[a : a + 50_000], "at": at[a : a + 50_000]})

    words = d.mapInPandas(block_words, "word string, at long").repartition("word").sortWithinPartitions("word")

    def encode_words(frames):
        rank, last, last_ids = ranks(ranks_path), None, []
        for f in frames:
            codes, distinct = pd.factorize(f["word"])
            coded = [last_ids if w == last else merge(w.encode(), rank) for w in distinct]
            if coded:
                last, last_ids = distinct[-1], coded[-1]
            sizes = np.array([len(c) for c in coded], np.int64)
            starts, flat = np.cumsum(sizes) - sizes, np.array(list(chain.from_iterable(coded)), np.int64)
            at, rows = f["at"].to_numpy(), []
            order = np.argsort(at)
            block = at[order] >> 24
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(order)]
            for a, b in zip(edges, edges[1:], strict=False):
                own = order[a:b]
                if len(own):
                    n = sizes[codes[own]]
                    where = np.repeat(starts[codes[own]] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    rows.append((block[a], (at[own] & 0xFFFFFF).astype("<u4").tobytes(), *_small(n), *_small(flat[where])))
            yield pd.DataFrame(rows, columns=["block", "numbers", "size_width", "sizes", "id_width", "ids"])

    coded = words.mapInPandas(encode_words, "block long, numbers binary, size_width int, sizes binary, id_width int, ids binary")

    def positions(frames):
        split = splitter(pattern)
        for block, rows in blocks.dealt(frames, block_chars):
            number, ids, out = blocks.Numbers(), [], []
            for i, t in rows:
                own = split(t)
                ids.append(i)
                out.append(np.fromiter(map(number.__getitem__, own), np.uint32, len(own)))
            check = zlib.crc32("".join(number).encode())
            sizes = _packed(np.array([len(x) for x in out]))
            yield pd.DataFrame({"block": [block], "doc_ids": [ids], "n_words": [len(number)], "check": [check], "lens": [sizes], "positions": [_packed(np.concatenate(out))]})

    dealt = d.mapInPandas(positions, "block long, doc_ids array<long>, n_words long, check long, lens binary, positions binary")

    # words' ids and positions meet in order of block, the ids first, so that a task streams its blocks and holds one at a time
    # positions come first in the union: blocks are named by a task's number, which counts from there
    both = dealt.withColumn("last", F.lit(True)).unionByName(coded.withColumn("last", F.lit(False)), allowMissingColumns=True)
    both = both.repartition("block").sortWithinPartitions("block", "last")

    def put_together(frames):
        table, values, now = token_bytes(ranks_path), [], None
        for f in frames:
            for row in f.itertuples():
                if row.block != now:
                    if values:
                        raise RuntimeError(blocks.OTHERWISE)
                    now = row.block
                if not row.last:
                    size, flat = np.frombuffer(row.sizes, f"<u{int(row.size_width)}"), np.frombuffer(row.ids, f"<u{int(row.id_width)}")
                    values.append((np.frombuffer(row.numbers, "<u4"), size, flat))
                    continue
                starts, sizes, flat = _table(values, int(row.n_words), int(row.check), table)
                values = []
                tokens, at, ids, out = _unpacked(row.positions), 0, [], []
                for i, n in zip(row.doc_ids, _unpacked(row.lens).tolist(), strict=True):
                    own = tokens[at : at + n]
                    at += n
                    k = sizes[own]
                    ids.append(None if pd.isna(i) else int(i))
                    out.append(flat[np.repeat(starts[own] - np.cumsum(k) + k, k) + np.arange(k.sum())])
                    if len(out[-1]) > 20_000 or len(out) == 256:
                        yield _decoded(ids, out, table)
                        ids, out = [], []
                if out:
                    yield _decoded(ids, out, table)

    return both.mapInPandas(put_together, "doc_id long, ids array<int>, decoded binary")


def _table(values: list, n_words: int, check: int, table: list[bytes]):
    """(starts, sizes, ids) by a block's word numbers; an error unless they are the words that the positions are of."""
    number, size, flat = (np.concatenate([np.empty(0, np.uint32), *x]).astype(np.int64) for x in zip(*values, strict=True)) if values else [np.empty(0, np.int64)] * 3
    if len(number) != n_words or (n_words and number.max() >= n_words):
        raise RuntimeError(blocks.OTHERWISE)
    starts, sizes = np.zeros(n_words, np.int64), np.full(n_words, -1, np.int64)
    starts[number], sizes[number] = np.cumsum(size) - size, size
    if (sizes < 0).any():
        raise RuntimeError(blocks.OTHERWISE)
    order = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    if zlib.crc32(b"".join([table[i] for i in flat[order].tolist()])) != check:
        raise RuntimeError(blocks.OTHERWISE)
    return starts, sizes, flat.astype(np.int32)


def _decoded(ids: list, out: list[np.ndarray], table: list[bytes]) -> pd.DataFrame:
    return pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "ids": out, "decoded": [b"".join([table[i] for i in x.tolist()]) for x in out]})


def decode(ids: str | Column, ranks_path: str) -> Column:
    """The bytes that a column of ids stands for; null for null; an id outside the table is an error."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        table = token_bytes(ranks_path)
        return pd.Series([None if x is None else b"".join([table[i] for i in x.tolist()]) for x in s], dtype=object)

    return run(ids)


def decoded(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, decoded) of rows (doc_id, ids), by a join of every position with the table of token bytes; the join that encode() does by index.

    The table is as large as the vocabulary, so it is broadcast; a row's tokens are put together by position, so a row, as in any
    column of ids, is to fit a task. Rows without ids give empty bytes, null ids null; an id outside the table is an error. An empty table gives no rows.
    """
    spark = encoded.sparkSession
    table = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(token_bytes(ranks_path))], "token int, bytes binary")
    rows = encoded.select(F.monotonically_increasing_id().alias("row"), "doc_id", "ids")
    one = rows.select("row", "doc_id", F.col("ids").isNull().alias("unknown"), F.posexplode_outer("ids").alias("at", "id"))
    met = one.join(F.broadcast(table), F.col("id") == F.col("token"), "left")
    bytes_ = F.when(F.col("id").isNotNull() & F.col("token").isNull(), F.raise_error(F.lit("an id isn't in the table"))).otherwise(F.hex("bytes"))
    parts = met.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("unknown").alias("unknown"), F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("at", bytes_.alias("b"))))).alias("parts"))
    return parts.select("doc_id", F.when(~F.col("unknown"), F.unhex(F.array_join(F.transform("parts", lambda p: p["b"]), ""))).alias("decoded"))


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode()'s rows."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
