"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

A text holds a benchmark item if some stretch of it is within EDIT_SHARE of the item's length in edits, both normalised.

1. Windows. Each text is read once for PIECE_BLOCK pieces (some 200,000 items), and gives windows of the items' sizes. They begin at the
   starts of words, or, with the pre-filter, only where a window within the edits allowed can begin: an item with at most e edits,
   cut into e + 1 pieces, has a piece left whole (pigeonhole), so the first SEED bytes of some piece stand in the text, and the window begins
   there, less the piece's place in its item. The pre-filter knows places and sizes, not items. It loses nothing that
   verification would keep, and spares hundreds of windows for each one that it leaves.
2. CGK. Windows and items are embedded by the same random walks: each step writes the current byte and goes on to the
   next if the walk's bit for (step, byte) says so. Few edits become few differing steps.
3. LSH. Each of TABLES repetitions has a walk of its own and samples BITS of its steps; the sampled steps are a bucket's key. A join of
   windows and items by (size class, repetition, key) gives the candidates: a window meets all items that fall into one of its buckets.
4. Verification. Exact edit distance of the item to the best stretch around the window, by bit-parallel dynamic programming.

recall() measures the share of edited items that meet theirs in the LSH, tests the share found end to end. Items of fewer than
SEED bytes have no windows: they are found where they stand word for word.
"""

from functools import cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut, texts

EDIT_SHARE, SEED = 0.08, 12
TABLES, BITS = 32, 4
#: Pieces of items (24 bytes each, some ten an item) that are sent to the executors at a time, and bytes of text looked at a time.
PIECE_BLOCK, CHUNK = 2_000_000, 1 << 22
#: Rows of item keys that are broadcast at most (40 bytes each); beyond, windows and items are shuffled by bucket.
BROADCAST_KEYS = 1_000_000
SCHEMA = "doc_id long, item_id long, edits long"
_KEEP = bytes(c if chr(c).isalnum() and c < 128 else (c if c >= 128 else 32) for c in range(256))


def normalise(text: str) -> bytes:
    """Lower case, ASCII punctuation and white space to single spaces, UTF-8."""
    return b" ".join(text.lower().encode().translate(_KEEP).split())


def edits_allowed(size: int, share: float = EDIT_SHARE) -> int:
    """At most share of the size, and few enough that pieces are as long as a seed."""
    return max(0, min(int(size * share), size // SEED - 1))


def distance(item: bytes, text: bytes) -> tuple[int, int]:
    """Least edits from the item to any stretch of the text, and where that stretch ends (bit-parallel; both ends of the text are free)."""
    m = len(item)
    if not m:
        return 0, 0
    top, full = 1 << (m - 1), (1 << m) - 1
    eq: dict[int, int] = {}
    for i, c in enumerate(item):
        eq[c] = eq.get(c, 0) | 1 << i
    pv, mv, score = full, 0, m
    best, at = m, 0
    for j, c in enumerate(text, 1):
        e = eq.get(c, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        if score < best:
            best, at = score, j
    return best, at


class Walks:
    """TABLES random walks and the steps sampled of each, for strings of up to a size."""

    def __init__(self, size: int, tables: int = TABLES, bits: int = BITS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.size = size
        # sampled within the steps that any string of three quarters the size still fills
        self.steps = [np.sort(rng.choice(max(bits, 3 * size // 2), bits, replace=False)) for _ in range(tables)]
        self.bits = [rng.integers(0, 2, (max(bits, 3 * size // 2), 256), dtype=np.uint8) for _ in range(tables)]

    def keys(self, strings: list[bytes]) -> np.ndarray:
        """(strings, tables) hashes of the sampled steps of each embedding; a walk past a string's end writes zero."""
        n = len(strings)
        width = max(map(len, strings), default=0) + 1
        x = np.zeros((n, width), np.uint8)
        for i, s in enumerate(strings):
            x[i, : len(s)] = np.frombuffer(s, np.uint8)
        rows, out = np.arange(n), np.zeros((n, len(self.steps)), np.uint64)
        for t, (steps, bits) in enumerate(zip(self.steps, self.bits, strict=True)):
            at, key, wanted = np.zeros(n, int), np.zeros(n, np.uint64), set(steps.tolist())
            for j in range(int(steps[-1]) + 1):
                c = x[rows, np.minimum(at, width - 1)]
                if j in wanted:
                    key = key * np.uint64(257) + c.astype(np.uint64) + np.uint64(1)
                at += bits[j][c]
            out[:, t] = key
        return out


def size_class(n: int) -> int:
    """Items and windows are embedded with others of about their size: classes a half octave wide."""
    return int(2 * np.log2(max(n, 1)))


class Items:
    """Items ready to be met by windows of their own size; for measuring the LSH alone."""

    def __init__(self, rows: list[tuple[int, str]], share: float = EDIT_SHARE):
        made = [(i, normalise(t or "")) for i, t in rows]
        made = [(i, t) for i, t in made if len(t) >= SEED]
        self.ids, self.texts = [i for i, _ in made], [t for _, t in made]
        self.keys = {}
        for c in {size_class(len(t)) for t in self.texts}:
            own = [k for k, t in enumerate(self.texts) if size_class(len(t)) == c]
            self.keys[c] = walks(c).keys([self.texts[k] for k in own]), np.array(own)

    def candidates(self, of: np.ndarray, windows: list[bytes]) -> np.ndarray:
        """For windows and items: whether the two agree in a repetition."""
        out = np.zeros(len(windows), bool)
        size = np.array([size_class(len(self.texts[k])) for k in of.tolist()], int)
        for c in np.unique(size):
            at = np.flatnonzero(size == c)
            keys, own = self.keys[c]
            row = np.searchsorted(own, of[at])
            for a in range(0, len(at), 4096):
                b = at[a : a + 4096]
                out[b] = (walks(c).keys([windows[i] for i in b]) == keys[row[a : a + 4096]]).any(axis=1)
        return out


@cache
def walks(c: int) -> Walks:
    """The walks of a size class, the same in every task."""
    return Walks(int(2 ** (c / 2)))


def _slot(x: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def _pair(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """One number for a seed's first and last eight bytes; a chance clash costs a look at one more window."""
    with np.errstate(over="ignore"):
        return (head * np.uint64(0x9E3779B97F4A7C15)) ^ (tail * np.uint64(0xC2B2AE3D27D4EB4F))


class Seeds:
    """The pre-filter: where pieces of items begin, and, for each seed, the size classes and places in the item that it stands for.

    t has the columns head, tail (a seed's first and last eight bytes), class and place. classes gives for each class the greatest
    size of its items and the most edits that one of them may have.
    """

    def __init__(self, t: pd.DataFrame, classes: dict[int, tuple[int, int]]):
        self.classes = classes
        t = t.drop_duplicates()
        heads = t["head"].to_numpy().view(np.uint64)
        pair = _pair(heads, t["tail"].to_numpy().view(np.uint64))
        order = np.argsort(pair, kind="stable")
        self.seeds, self.first = np.unique(pair[order], return_index=True)
        self.first = np.append(self.first, len(order))
        self.of_class, self.place = t["class"].to_numpy()[order], t["place"].to_numpy()[order]
        self.bits = max(16, min(28, int(np.log2(max(1, len(t)))) + 8))
        self.bitmap = np.zeros(1 << self.bits, bool)
        self.bitmap[_slot(heads, self.bits)] = True

    def hits(self, buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places in the buffer where a seed begins, and which seed."""
        places, which, raw = [], [], np.frombuffer(buffer, np.uint8)
        for shift in range(8 if len(self.seeds) else 0):
            n = (len(buffer) - shift) // 8
            if n <= 0:
                continue
            v = np.frombuffer(buffer, "<u8", n, shift)
            hit = np.flatnonzero(self.bitmap[_slot(v, self.bits)])
            hit = hit[hit * 8 + shift + SEED <= len(buffer)]
            if len(hit):
                tail = raw[(hit * 8 + shift + SEED - 8)[:, None] + np.arange(8)].view("<u8")[:, 0]
                pair = _pair(v[hit], tail)
                s = np.searchsorted(self.seeds, pair)
                s[s == len(self.seeds)] = 0
                same = self.seeds[s] == pair
                places.append(hit[same] * 8 + shift)
                which.append(s[same])
        return (np.concatenate(places), np.concatenate(which)) if places else (np.empty(0, int), np.empty(0, int))

    def windows(self, raw: list[bytes]) -> pd.DataFrame:
        """(text, class, start) of the windows that can be within the edits allowed of an item; start may be before the text's."""
        buffer = (b"\0" * SEED).join(raw)
        starts = np.cumsum([0, *[len(r) + SEED for r in raw]])
        at, which = self.hits(buffer)
        n = self.first[which + 1] - self.first[which]
        row = np.repeat(np.arange(len(at)), n)
        entry = np.repeat(self.first[which] - np.cumsum(n) + n, n) + np.arange(n.sum())
        doc = (np.searchsorted(starts, at, "right") - 1)[row]
        out = pd.DataFrame({"text": doc, "class": self.of_class[entry], "start": at[row] - self.place[entry] - starts[doc]})
        return out.drop_duplicates()


def word_windows(raw: list[bytes], classes: dict[int, tuple[int, int]]) -> pd.DataFrame:
    """(text, class, start) of windows of every class at the start of every word."""
    rows = [(d, c, p) for d, r in enumerate(raw) for p in [0, *(np.flatnonzero(np.frombuffer(r, np.uint8) == 32) + 1).tolist()] for c in classes]
    return pd.DataFrame(rows, columns=["text", "class", "start"])


def _normalised(items: DataFrame, share: float, id_col: str, text_col: str) -> DataFrame:
    """(key, item_id, item, class, most) of items with an id and a text that isn't empty; key tells repeated ids apart."""

    def run(frames):
        for f in frames:
            item = [normalise(t) for t in f["text"]]
            size = [len(t) for t in item]
            yield pd.DataFrame({"item_id": f["item_id"], "item": item, "class": [size_class(n) for n in size], "most": [edits_allowed(n, share) for n in size]}).loc[np.array(size, int) > 0]

    rows = items.select(items[id_col].cast("long").alias("item_id"), items[text_col].cast("string").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    return cut(rows.mapInPandas(run, "item_id long, item binary, class int, most int").withColumn("key", F.monotonically_increasing_id()))


def pieces(item: bytes, edits: int) -> list[bytes]:
    """The item cut into one piece more than the edits allowed."""
    return [item[k * len(item) // (edits + 1) : (k + 1) * len(item) // (edits + 1)] for k in range(edits + 1)]


def _seeds(made: DataFrame) -> DataFrame:
    """(head, tail, class, place) of every piece of every item."""

    def run(frames):
        for f in frames:
            rows = []
            for t, c, e in zip(f["item"], f["class"], f["most"], strict=True):
                for k in range(e + 1):
                    o = k * len(t) // (e + 1)
                    seed = t[o : o + SEED]
                    if len(seed) == SEED:
                        rows.append((int.from_bytes(seed[:8], "little", signed=True), int.from_bytes(seed[-8:], "little", signed=True), c, o))
            yield pd.DataFrame(rows, columns=["head", "tail", "class", "place"])

    return made.select("item", "class", "most").mapInPandas(run, "head long, tail long, class int, place int")


def _keys(strings: DataFrame, column: str, keep: list[str], schema: str) -> DataFrame:
    """keep, class and keys, a bucket key for each repetition, of the strings in a column."""

    def run(frames):
        for f in frames:
            for c, own in f.groupby("class"):
                for a in range(0, len(own), 4096):
                    part = own.iloc[a : a + 4096]
                    keys = walks(int(c)).keys(part[column].tolist()).astype(np.int64)
                    yield part[keep].assign(**{"class": np.int32(c), "keys": list(keys)})

    return strings.mapInPandas(run, f"{schema}, class int, keys array<long>")


def _windows(docs: DataFrame, sent, classes: dict[int, tuple[int, int]]) -> DataFrame:
    """(window, row, doc_id, class, keys, around): every window of the texts with its bucket keys and the stretch around it; cut from its lineage.

    row tells the rows of docs apart. sent: broadcast Seeds, or None for windows at the starts of words.
    """

    def run(frames):
        pid, row, made = TaskContext.get().partitionId() << 33, 0, 0
        for f in frames:
            ids, raw, size, at = f["doc_id"].astype("Int64"), [], 0, 0
            for i, t in enumerate(f["text"]):
                raw.append(normalise(t))
                size += len(raw[-1])
                if size <= CHUNK and i + 1 < len(f):
                    continue
                w = word_windows(raw, classes) if sent is None else sent.value.windows(raw)
                for c, own in w.groupby("class"):
                    most, e = classes[int(c)]
                    for a in range(0, len(own), 4096):
                        part = own.iloc[a : a + 4096]
                        d, start = part["text"].to_numpy(), part["start"].to_numpy()
                        pieces = [raw[x][max(0, s) : max(0, s + most)] for x, s in zip(d, start, strict=True)]
                        yield pd.DataFrame({
                            "window": pid + made + np.arange(len(part)), "row": pid + row + at + d, "doc_id": ids.iloc[at + d].to_numpy(), "class": np.int32(c), "keys": list(walks(int(c)).keys(pieces).astype(np.int64)),
                            "around": [raw[x][max(0, s - e) : max(0, s + most + e)] for x, s in zip(d, start, strict=True)],
                        })
                        made += len(part)
                raw, size, at = [], 0, i + 1
            row += len(f)

    return cut(docs.mapInPandas(run, "window long, row long, doc_id long, class int, keys array<long>, around binary"))


def _verified(candidates: DataFrame) -> DataFrame:
    """(row, doc_id, item_id, edits) of (row, doc_id, item_id, item, most, around) within most edits."""

    def run(frames):
        known: dict[tuple[bytes, bytes], int] = {}
        for f in frames:
            edits = []
            for item, around, e in zip(f["item"], f["around"], f["most"].tolist(), strict=True):
                if item in around:
                    edits.append(0)
                    continue
                if not any(p in around for p in pieces(item, e)):  # no piece left whole: more than e edits, so the distance needn't be worked out
                    edits.append(e + 1)
                    continue
                if (n := known.get((item, around))) is None:
                    known = {} if len(known) >= 10_000 else known
                    n = known[item, around] = distance(item, around)[0]
                edits.append(n)
            out = f[["row", "doc_id", "item_id"]].assign(edits=edits)
            yield out.loc[np.array(edits, int) <= f["most"].to_numpy()]

    return candidates.select("row", "doc_id", "item_id", "item", "most", "around").mapInPandas(run, "row long, doc_id long, item_id long, edits long")


def _short(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(row, doc_id, item_id, edits) of items of fewer than SEED bytes where they stand word for word; no row twice. items: (item, item_id), PIECE_BLOCK at most."""
    names: dict[bytes, set[int]] = {}
    for r in items.toLocalIterator():
        names.setdefault(bytes(r["item"]), set()).add(r["item_id"])
    sent, sizes = docs.sparkSession.sparkContext.broadcast(names), sorted({len(x.split()) for x in names})

    def run(frames):
        pid, row = TaskContext.get().partitionId() << 33, 0
        for f in frames:
            out = []
            for i, t in zip(f["doc_id"].astype(object), f["text"], strict=True):
                words = normalise(t).split()
                found = {b" ".join(words[k : k + n]) for n in sizes for k in range(len(words) - n + 1)} & sent.value.keys()
                out += [(pid + row, None if pd.isna(i) else int(i), item, 0) for x in found for item in sent.value[x]]
                row += 1
            yield pd.DataFrame(out, columns=["row", "doc_id", "item_id", "edits"]).astype({"row": "int64", "doc_id": "Int64", "item_id": "int64", "edits": "int64"})

    return docs.mapInPandas(run, "row long, doc_id long, item_id long, edits long")


def contamination(docs: DataFrame, items: DataFrame, share: float = EDIT_SHARE, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", prefilter: bool = True) -> DataFrame:
    """(doc_id, item_id, edits): each item that each row's whole text holds within its edits, with the least edits found.

    Null texts are empty. Null items, and items and texts without letters or digits, match nothing; an item id that repeats stands
    for all its texts. Repeated rows give repeated matches; rows with a null id stay. Empty tables give no rows. Other columns
    are left out, whatever their names. Items of fewer than SEED bytes are found word for word.

    docs is to be read from files or a checkpoint: once for each PIECE_BLOCK pieces of items (and once for short items, if there are any).
    Without the pre-filter, windows begin at every word, which costs hundreds of times more.
    """
    spark = docs.sparkSession
    d = texts(docs, id_col, text_col)
    made = _normalised(items, share, item_id, item_text)
    n, pieces = made.agg(F.count("*"), F.coalesce(F.sum(F.col("most") + 1), F.lit(0))).first()
    blocks, out = -(-pieces // PIECE_BLOCK), spark.createDataFrame([], SCHEMA)
    for k in range(blocks):
        block = made if blocks == 1 else made.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        long, brief = block.filter(F.octet_length("item") >= SEED), block.filter(F.octet_length("item") < SEED)
        found = _short(d, brief.select("item", "item_id")) if brief.limit(1).count() else None
        classes = {r["class"]: (r["size"], r["most"]) for r in long.groupBy("class").agg(F.max(F.octet_length("item")).alias("size"), F.max("most").alias("most")).collect()}
        if classes:
            sent = spark.sparkContext.broadcast(Seeds(_seeds(long).toArrow().to_pandas(), classes)) if prefilter else None
            windows = _windows(d, sent, classes)
            keys = _keys(long.select("key", "item", "class"), "item", ["key"], "key long").select("key", "class", F.posexplode("keys").alias("repetition", "bucket"))
            keys = F.broadcast(keys) if n * TABLES <= BROADCAST_KEYS else keys
            met = windows.select("window", "class", F.posexplode("keys").alias("repetition", "bucket")).join(keys, ["class", "repetition", "bucket"]).select("window", "key").distinct()
            candidates = met.join(windows.select("window", "row", "doc_id", "around"), "window").join(long.select("key", "item_id", "item", "most"), "key")
            near = _verified(candidates)
            found = near if found is None else found.unionByName(near)
        if found is not None:
            out = out.unionByName(found.groupBy("row", "doc_id", "item_id").agg(F.min("edits").alias("edits")).select("doc_id", "item_id", "edits"))
    return out


def recall(rows: list[tuple[int, str]], edits_of, seed: int = 1) -> float:
    """Share of items, each edited once by edits_of(item bytes, rng), that meet their item in the LSH."""
    items, rng = Items(rows), np.random.default_rng(seed)
    made = [edits_of(t, rng)[: len(t)] for t in items.texts]
    return float(items.candidates(np.arange(len(made)), made).mean())
