"""Context-tree weighting over bytes: code length of texts under a mixture of all context depths.

Each byte is eight binary decisions, each in the context of the bits before it in its byte and of 0 to DEPTH bytes before.
A node (context, bits so far) holds counts of zeros and ones and a Krichevsky-Trofimov estimator; a node's weighted
probability is half its own estimate's plus half the product of its children's, and what a node predicts mixes its own
estimate with its child's by that posterior. Counts come from the training documents; then the tree is fixed.

How it runs: n-grams of DEPTH + 1 bytes are counted once per task, summed by a shuffle, and dealt by the three newest
context bytes, so that all deeper contexts of one of these are together (at most 256^2 contexts of 256 bytes each, however
large the corpus). Depths from 3 down are weighted there, depth 2, of at most 65,536 contexts, by tasks of its own, depths 1 and 0, of 257 contexts, by the driver. The
log probability of every n-gram that occurs, in training or not, is then worked out from its path, and texts are scored by
looking up their n-grams: from a broadcast table while it has at most BROADCAST_GRAMS rows, else by a shuffle of each
block's distinct n-grams. Both give the same sums.
"""

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm import blocks
from lectern.llm.common import cut, texts

DEPTH = 5
#: 16 bytes each in every Python worker, and about 40 more for the index.
BROADCAST_GRAMS = 4_000_000
#: Bytes handled at a time; n-grams take about 60 times as many.
CHUNK = 1 << 20
PARTS, HELD_OUT = 5, 1
HALF = np.log(0.5)


def training_row(doc_id: str = "doc_id"):
    """True for documents to learn from: crc32 of the id as text, modulo 5, is not 1. A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % PARTS != HELD_OUT


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after a shift to 8 and above."""
    x = np.asarray(x, float)
    low = x < 8
    y = np.where(low, x + 8, x)
    s = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * y * y)) / (y * y)) / (y * y)) / y
    if low.any():
        z = x[low]
        s[low] -= np.log(z * (z + 1) * (z + 2) * (z + 3)) + np.log((z + 4) * (z + 5) * (z + 6) * (z + 7))
    return s


def kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability of n0 zeros and n1 ones under the Krichevsky-Trofimov estimator; it doesn't depend on their order."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - np.log(np.pi) - log_gamma(n0 + n1 + 1.0)


def weigh(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    return HALF + np.logaddexp(own, below)


def grams_of(text: list[bytes]) -> np.ndarray:
    """n-grams of texts, ASCII lower-cased, each with DEPTH zero bytes before and one behind: newest context byte first, then the coded byte."""
    pad = bytes(DEPTH)
    raw = np.frombuffer(b"".join([pad + t.lower() + b"\0" for t in text]), np.uint8)
    sizes = np.array([len(t) + 1 for t in text], np.int64)
    at = np.arange(sizes.sum()) + np.repeat(np.arange(1, len(text) + 1) * DEPTH, sizes)
    g = raw[at].astype(np.int64)
    for d in range(1, DEPTH + 1):
        g |= raw[at - d].astype(np.int64) << (8 * (DEPTH + 1 - d))
    return g


def _pieces(text: list[bytes]):
    """Runs of texts of about CHUNK bytes; a longer text is a run of its own."""
    run, size = [], 0
    for t in text:
        run.append(t)
        size += len(t)
        if size > CHUNK:
            yield run
            run, size = [], 0
    if run:
        yield run


class _Tally:
    """Counts of n-grams, merged as they come; memory follows the distinct ones."""

    def __init__(self):
        self.done, self.parts, self.size = (np.empty(0, np.int64), np.empty(0, np.int64)), [], 0

    def add(self, g: np.ndarray, weight: int) -> None:
        u, n = np.unique(g, return_counts=True)
        self.parts.append((u, n * weight))
        self.size += len(u)
        if self.size > 2_000_000:
            self.merge()

    def merge(self):
        u, at = np.unique(np.concatenate([self.done[0], *(p[0] for p in self.parts)]), return_inverse=True)
        n = np.bincount(at, np.concatenate([self.done[1], *(p[1] for p in self.parts)]), len(u)).astype(np.int64)
        self.done, self.parts, self.size = (u, n), [], 0
        return self.done


def count_grams(docs: DataFrame) -> DataFrame:
    """(ctx3, gram, n) of (text, train), n from training rows only, sorted within partitions dealt by ctx3, the three newest bytes."""

    def run(frames):
        tally = _Tally()
        for f in frames:
            for flag in (False, True):
                own = [t.encode() for t in f["text"][f["train"] == flag]]
                for piece in _pieces(own):
                    tally.add(grams_of(piece), int(flag))
        u, n = tally.merge()
        for at in range(0, len(u), 100_000):
            yield pd.DataFrame({"ctx3": u[at : at + 100_000] >> 24, "gram": u[at : at + 100_000], "n": n[at : at + 100_000]})

    rows = docs.select("text", "train").mapInPandas(run, "ctx3 long, gram long, n long")
    return rows.repartition("ctx3").groupBy("ctx3", "gram").agg(F.sum("n").alias("n")).sortWithinPartitions("gram")


def _whole(frames, key: str):
    """Frames sorted by key, cut so that no value of key is in two."""
    rest = None
    for f in frames:
        f = f if rest is None else pd.concat([rest, f])
        k = f[key].to_numpy()
        if not len(k):
            continue
        end = np.searchsorted(k, k[-1])
        if end and len(f) > 50_000:
            yield f.iloc[:end]
            f = f.iloc[end:]
        rest = f
    if rest is not None and len(rest):
        yield rest


def _nodes(g: np.ndarray, n: np.ndarray, k: int):
    """For bit k of the coded byte, depths DEPTH down to 3: [(row of each gram's node, n0, n1, log weighted, contexts' keys)]."""
    bit = (g >> (7 - k)) & 1
    key = g >> (8 - k)
    out, below = [], None
    for depth in range(DEPTH, 2, -1):
        drop = 8 * (DEPTH - depth)
        at_key = ((key >> (k + drop)) << k) | (key & ((1 << k) - 1))
        u, inv = np.unique(at_key, return_inverse=True)
        n1, n0 = np.bincount(inv, n * bit, len(u)), np.bincount(inv, n * (1 - bit), len(u))
        own = kt(n0, n1)
        if below is None:
            lw = own
        else:
            child_inv, child_lw = below
            first = np.zeros(len(child_lw), np.int64)
            first[child_inv] = inv  # each child's parent
            lw = weigh(own, np.bincount(first, child_lw, len(u)))
        out.append((inv, n0, n1, own, lw, u))
        below = inv, lw
    return out


def _deep(grams: DataFrame) -> DataFrame:
    """(ctx2, node, n0, n1, below): sums over the depth-3 nodes of each depth-2 node; node is 1, then the bits so far."""

    def run(frames):
        for f in _whole(frames, "ctx3"):
            g, n = f["gram"].to_numpy(), f["n"].to_numpy()
            for k in range(8):
                _, n0, n1, _, lw, u = _nodes(g, n, k)[-1]
                yield pd.DataFrame({"ctx2": u >> (k + 8), "node": (u & ((1 << k) - 1)) | (1 << k), "n0": n0, "n1": n1, "below": lw})

    rows = grams.mapInPandas(run, "ctx2 long, node long, n0 double, n1 double, below double")
    return rows.groupBy("ctx2", "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("below").alias("below"))


def _weighted(n0: np.ndarray, n1: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log weighted, share, p1) of nodes above depth DEPTH: what a node predicts is share of p1 and the rest of what its child does."""
    own = kt(n0, n1)
    lw = weigh(own, below)
    return lw, np.exp(HALF + own - lw), (n1 + 0.5) / (n0 + n1 + 1)


def _step(a, b, parent, t: pd.DataFrame, row, rows: int):
    """The shares a, b of a depth from its parents': t has the nodes (node, n0, n1, below) of the contexts named by row."""
    share, p1 = np.full((rows, 256), 0.5), np.full((rows, 256), 0.5)
    _, share[row, t["node"]], p1[row, t["node"]] = _weighted(*(t[c].to_numpy() for c in ("n0", "n1", "below")))
    a, b = a[parent], b[parent]
    return a + b * share * p1, b * (1 - share)


def _shallow(deep: DataFrame):
    """Depths 2 to 0: (row of each two-byte context, shares a, b by row and node). What a node predicts is a + b * what its subtree below depth 2 predicts.

    Depth 2, of at most 65,536 contexts of 255 nodes, is weighted by tasks; the driver sees its sums by one-byte context (at most
    65,280 rows) and, of each two-byte context that training saw, one packed row of 4 KB, streamed.
    """
    spark = deep.sparkSession
    deep = cut(deep)

    def run(frames):
        for f in frames:
            lw = _weighted(*(f[c].to_numpy() for c in ("n0", "n1", "below")))[0]
            yield pd.DataFrame({"ctx1": f["ctx2"] // 256, "node": f["node"], "n0": f["n0"], "n1": f["n1"], "below": lw})

    sums = deep.mapInPandas(run, "ctx1 long, node long, n0 double, n1 double, below double").groupBy("ctx1", "node").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "below")])
    one = sums.toArrow().to_pandas()
    zero = one.assign(below=_weighted(*(one[c].to_numpy() for c in ("n0", "n1", "below")))[0]).groupby("node", as_index=False)[["n0", "n1", "below"]].sum()
    a, b = _step(np.zeros((1, 256)), np.ones((1, 256)), np.zeros(1, int), zero, np.zeros(len(zero), int), 1)
    a, b = _step(a, b, np.zeros(256, int), one, one["ctx1"].to_numpy(), 256)
    above = spark.sparkContext.broadcast((a, b))

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        ctx2 = int(f["ctx2"].iloc[0])
        a1, b1 = above.value
        a2, b2 = _step(a1, b1, np.array([ctx2 >> 8]), f, np.zeros(len(f), int), 1)
        return pd.DataFrame({"ctx2": [ctx2], "a": [a2.tobytes()], "b": [b2.tobytes()]})

    seen, a2, b2 = [], [], []
    for r in deep.groupBy("ctx2").applyInPandas(pack, "ctx2 long, a binary, b binary").toLocalIterator():
        seen.append(r["ctx2"])
        a2.append(np.frombuffer(r["a"]))
        b2.append(np.frombuffer(r["b"]))
    # below a two-byte context that training never saw, half of what is left is its own estimate of one half
    row = np.repeat(np.arange(256), 256) + len(seen)
    row[seen] = np.arange(len(seen))
    return row, np.vstack([*a2, a + b * 0.25]), np.vstack([*b2, b * 0.5])


def gram_logs(grams: DataFrame) -> DataFrame:
    """(gram, logp): log10 probability of each n-gram's last byte after the others. grams: count_grams(), from a checkpoint."""
    shallow = grams.sparkSession.sparkContext.broadcast(_shallow(_deep(grams)))

    def run(frames):
        row, a2, b2 = shallow.value
        for f in _whole(frames, "ctx3"):
            g, n = f["gram"].to_numpy(), f["n"].to_numpy()
            at, total = row[g >> 32], np.zeros(len(g))
            for k in range(8):
                node = (1 << k) | ((g & 255) >> (8 - k))
                a, b = a2[at, node], b2[at, node]
                for inv, n0, n1, own, lw, u in reversed(_nodes(g, n, k)):
                    share = np.exp(HALF + own - lw)
                    p1 = (n1 + 0.5) / (n0 + n1 + 1)
                    a, b = a + b * (share * p1)[inv], b * (1 - share)[inv]
                a = a + b * p1[inv]  # at the last depth a node is its own estimate alone
                bit = ((g >> (7 - k)) & 1) == 1
                total += np.log10(np.where(bit, a, 1 - a))
            yield pd.DataFrame({"gram": g, "logp": total})

    return grams.mapInPandas(run, "gram long, logp double")


def word_values(docs: DataFrame) -> DataFrame:
    """(block, locals, counts, new_words, block_n): for each block's words, by number, their counts in all training rows.

    new_words adds up to the distinct training words, block_n to all training words. docs: (doc_id, text, train). The blocks
    are those of payloads() of (doc_id, text).
    """

    def block_words(ids, block_texts):
        seen, train = {}, Counter()
        for i, t in zip(ids, block_texts, strict=True):
            own = t.encode().lower().split()
            seen.update(dict.fromkeys(own))
            if _trains(i):
                train.update(own)
        return pd.DataFrame({"word": list(seen), "local": np.arange(len(seen), dtype=np.int32), "n": [train[w] for w in seen]})

    rows = blocks.keys(docs.select("doc_id", "text"), block_words, "word binary, local int, n long")
    word = W.partitionBy("word")
    each = rows.select("block", "local", F.sum("n").over(word).alias("c"), F.row_number().over(word.orderBy("block", "local")).alias("k"))

    def pack(frames):
        for f in frames:
            out = []
            for block, g in f.groupby("block"):
                out.append((block, g["local"].to_numpy().astype("<u4").tobytes(), g["c"].to_numpy().astype("<i8").tobytes(), int(((g["k"] == 1) & (g["c"] > 0)).sum()), int(g["c"][g["k"] == 1].sum())))
            yield pd.DataFrame(out, columns=["block", "locals", "counts", "new_words", "block_n"])

    return each.mapInPandas(pack, "block long, locals binary, counts binary, new_words long, block_n long")


def _trains(doc_id) -> bool:
    """training_row() for one id."""
    import zlib

    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % PARTS != HELD_OUT


def _scorer(n: int, v: int, ends: int, table):
    """For blocks.meet(): both scores of a block's texts; score is left at 0 without a table."""

    def run(block, ids, raw, values):
        number, texts_words = blocks.Numbers(), []
        for r in raw:  # numbers take a tenth of the memory of words
            own = r.lower().split()
            texts_words.append(np.fromiter(map(number.__getitem__, own), np.uint32, len(own)))
        counts = np.full(len(number), -1, np.int64)
        for row in values.itertuples():
            counts[np.frombuffer(row.locals, "<u4")] = np.frombuffer(row.counts, "<i8")
        if (counts < 0).any():
            raise RuntimeError("a block's words lack counts")
        del number
        logs, known = np.log10((counts + 0.5) / (n + 0.5 * (v + 1))), counts > 0
        end = np.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
        out = []
        for at in texts_words:
            out.append((len(at) + 1, int(known[at].sum()) + (ends > 0), logs[at].sum() + end))
        got = np.zeros(len(raw)) if table is None else _look_up(raw, _index(table.value[0]), table.value[1])
        out = pd.DataFrame(out, columns=["n_tokens", "n_known", "base_score"])
        return out.assign(block=block, place=np.arange(len(out)), doc_id=pd.array(ids, dtype="Int64"), score=got, n_bytes=[len(r) for r in raw])[SCORED]

    return run


SCORED = ["block", "place", "doc_id", "n_tokens", "n_known", "base_score", "score", "n_bytes"]
SCORED_SCHEMA = "block long, place long, doc_id long, n_tokens long, n_known long, base_score double, score double, n_bytes long"


def _look_up(raw: list[bytes], index: pd.Index, logp: np.ndarray) -> np.ndarray:
    """Sums of the logs of each text's n-grams."""
    got = [np.empty(0)]
    for piece in _pieces(raw):
        sizes = np.array([len(t) + 1 for t in piece])
        where = index.get_indexer(grams_of(piece))
        if (where < 0).any():
            raise RuntimeError("an n-gram lacks its probability")
        got.append(np.add.reduceat(logp[where], np.cumsum(sizes) - sizes))
    return np.concatenate(got)


_INDEX: dict = {}


def _index(grams: np.ndarray) -> pd.Index:
    """The broadcast table's index, built once a worker."""
    key = (len(grams), int(grams[0]) if len(grams) else 0, int(grams[-1]) if len(grams) else 0, int(grams.sum()))
    if key not in _INDEX:
        _INDEX.clear()
        _INDEX[key] = pd.Index(grams)
    return _INDEX[key]


def _joined(docs: DataFrame, logs: DataFrame) -> DataFrame:
    """(block, place, score) without a broadcast: each block's distinct n-grams are joined to their logs, then meet the block's text.

    place numbers the rows of a block, so that repeated ids keep apart.
    """

    def block_grams(ids, block_texts):
        tally = _Tally()
        for piece in _pieces([t.encode() for t in block_texts]):
            tally.add(grams_of(piece), 1)
        return pd.DataFrame({"gram": tally.merge()[0]})

    d = docs.select("doc_id", "text")
    rows = blocks.keys(d, block_grams, "gram long").join(logs, "gram").select("block", "gram", "logp")

    def of(block, ids, raw, values):
        got = _look_up(raw, pd.Index(values["gram"].to_numpy()), values["logp"].to_numpy())
        return pd.DataFrame({"block": block, "place": np.arange(len(got)), "score": got})

    return blocks.meet(blocks.payloads(d), rows, of, "block long, place long, score double")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = BROADCAST_GRAMS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte of every whole text.

    score is the log10 probability of the text's bytes, A-Z lower-cased, and of its end. base_score is a smoothed unigram
    model of words and an end. A null text is empty: its one token is the end. Repeated rows are scored and learnt from
    again. With no training rows every estimate is its prior. An empty table gives no rows.
    """
    d = texts(docs, id_col, text_col).withColumn("train", training_row())
    grams = cut(count_grams(d))
    logs = cut(gram_logs(grams))
    table = None
    if logs.count() <= most:
        t = logs.toArrow()  # Rows would take some hundred bytes each
        table = docs.sparkSession.sparkContext.broadcast((t["gram"].to_numpy(), t["logp"].to_numpy()))
        del t
    words = cut(word_values(d))
    sums = words.agg(F.sum("new_words").alias("v"), F.sum("block_n").alias("n")).first()
    v, n_words = sums.v or 0, sums.n or 0
    ends = d.filter("train").count()
    n, v = n_words + ends, v + bool(ends)
    payload = blocks.payloads(d.select("doc_id", "text"))
    values = words.select("block", "locals", "counts")
    scored = blocks.meet(payload, values, _scorer(n, v, ends, table), SCORED_SCHEMA)
    if table is None:
        scored = scored.drop("score").join(_joined(d, logs), ["block", "place"])
    return scored.select(
        "doc_id",
        (~training_row()).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        "n_bytes",
        (-F.col("score") * float(np.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
