"""DartMinHash near-duplicates: weighted signatures by hashed darts, banded joining, exact verification, classes.

Every element (a hashed shingle) owns a strip of the weight-rank plane, as wide as its weight; darts fall on the plane as a
Poisson process that depends on the element alone. The darts below a rank that lets a document expect T = K ln K + K hits
are thrown; each goes to one of K coordinates by its hash, and the earliest (least rank) of each coordinate is kept. While a
coordinate has none, the darts of the ranks that follow, 2 K more hits, are thrown too. Two documents agree in a coordinate with the probability of their weighted Jaccard
similarity. A document costs its length plus about T darts, however long or short it is.
"""

import math
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut, texts, written
from lectern.llm.components import ROWS_A_PART, components

SHINGLE, THRESHOLD = 5, 0.8
#: A pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8^7)^32 = 0.9995.
BANDS, ROWS = 32, 7
#: Rounds in which each bucket is compared with one of its members, before what is left is compared pair by pair.
STAR_ROUNDS = 2
#: Members of a bucket in a block, and characters of their texts; every two blocks of what is left of a bucket meet in one task.
BLOCK, BLOCK_CHARS = 512, 8_000_000
#: What is left is verified if at least this share of all coordinates agree: 0.8 less 3.4 standard deviations, so 1 in 3,000
#: pairs of just 0.8 isn't, as few as share no band.
AGREE = 0.71

#: Digests that a task remembers, and rows that are broadcast at most (40 bytes each); beyond, joins with them shuffle.
REMEMBERED, BROADCAST_NODES = 500_000, 500_000

_GOLD, _M1, _M2 = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_30, _27, _31 = np.uint64(30), np.uint64(27), np.uint64(31)

#: Characters, and texts, that are hashed at once at most, or one text of more.
CHARS_AT_ONCE, TEXTS_AT_ONCE = 60_000, 64
#: Elements that are signed at once, or one text of more; a text counts as DARTS at least, its darts.
CELLS, DARTS = 120_000, 1_500


def _at_least(mean: float = 1.0) -> list[np.uint64]:
    """The hashes from which on a Poisson number of this mean is at least 1, 2, 3, ..."""
    out, below, n = [], 0.0, 0
    while (below := below + math.exp(-mean) * mean**n / math.factorial(n)) < 1 - 2.0**-50:
        out.append(np.uint64(int(below * 2**64)))
        n += 1
    return out


_AT_LEAST = _at_least()


def mix(x: np.ndarray, salt) -> np.ndarray:
    """splitmix64 of x and a salt, a number or an array."""
    if isinstance(salt, int):
        z = x + np.uint64((salt + 1) * _GOLD % 2**64)
    else:
        z = salt.astype(np.uint64)
        z += np.uint64(1)
        z *= np.uint64(_GOLD)
        z += x
    t = z >> _30
    z ^= t
    z *= _M1
    np.right_shift(z, _27, out=t)
    z ^= t
    z *= _M2
    np.right_shift(z, _31, out=t)
    z ^= t
    return z


def _rolled(x: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of so many word hashes."""
    out = np.zeros(len(x) - size + 1, np.uint64)
    for k in range(size):
        out = mix(out ^ x[k : k + len(out)], k)
    return out


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of x, ascending, and how often each occurs; x isn't empty."""
    x = np.sort(x)
    first = np.flatnonzero(x[1:] != x[:-1])
    ends = np.append(first, len(x) - 1)
    return x[ends], np.diff(ends, prepend=-1)


def shingle_sets(texts: list[str], size: int = SHINGLE) -> list[tuple[np.ndarray, np.ndarray]]:
    """shingles() of each text, hashed together."""
    words = [t.encode().lower().split() for t in texts]
    x = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, chain.from_iterable(words))), ">u8").astype(np.uint64)
    rolled = _rolled(x, size) if len(x) >= size else x
    out, at = [], 0
    for w in map(len, words):
        if w >= size:
            out.append(_counted(rolled[at : at + w - size + 1]))
        elif w:
            out.append(_counted(_rolled(x[at : at + w], w)))
        else:
            out.append((np.empty(0, np.uint64), np.empty(0, np.int64)))
        at += w
    return out


def shingles(text: str, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct word shingles of a text, A-Z lower-cased, and how often each occurs. A text of fewer words is one shingle; one without words has none."""
    return shingle_sets([text], size)[0]


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int = BANDS * ROWS, seed: int = 0) -> np.ndarray:
    """A row of k dart hashes for each (elements, weights); weights are positive, a set's sum to 1 or more. A set without elements gets zeros.

    Weights are cut into layers [0, 1), [1, 2), [2, 4), ..., ranks, layer by layer, into slabs that make a cell of one element, layer
    and slab expect one dart. A cell's hash gives the number of its darts and the first of them, the others have hashes of their own;
    so no document waits for another's darts, and ranks that were too few go on where they ended. A dart counts where its place in the
    layer is below the weight. Its lower 32 bits give its coordinate and its name, the 16 above its rank in the slab. Rank (in 1 / 65,536)
    and name are kept as one number, the least of which a coordinate keeps; equal ranks are settled by the names.
    """
    n, half, own_bits, dart_bits, unset = len(sets), np.uint64(32), np.uint64(0xFFFFFFFF), np.uint64(2**48 - 1), np.uint64(2**64 - 1)
    best = np.full(n * k, unset, np.uint64)
    sizes = np.array([len(s[0]) for s in sets], np.int64)
    total = np.array([float(np.sum(s[1])) for s in sets])
    if (total[sizes > 0] < 1).any():
        raise ValueError("the weights of a set sum to less than 1")
    hits, done = k * (np.log(k) + 1), np.zeros(n, np.int64)
    todo = np.flatnonzero(sizes)
    while len(todo):
        upto = np.ceil(hits * 65536 / total[todo]).astype(np.int64)
        upto = np.where(upto < 65536, upto, -(-upto >> 16) << 16)  # whole slabs, where a document has them
        owner = np.repeat(np.arange(len(todo)), sizes[todo])
        items = np.concatenate([sets[i][0] for i in todo])
        weights = np.concatenate([np.asarray(sets[i][1], np.float32) for i in todo])
        low, layer = 0.0, 0
        while len(items):
            width, level = low or 1.0, max(0, layer - 1)  # a layer is 2**level wide
            full = bool((weights >= low + width).all())  # then every dart of the layer counts
            first = (done[todo] << level) >> 16
            slabs = (-((-upto << level) >> 16) - first)[owner]
            ends = np.cumsum(slabs)
            cells = np.repeat(np.arange(len(items)), slabs)
            slab = np.arange(len(cells))
            slab -= (ends - slabs - first[owner])[cells]
            z = mix(mix(items, seed * 64 + layer)[cells], slab)
            rank = slab.view(np.uint64) << np.uint64(48)
            to = (todo[owner] * k).astype(np.uint64)
            for j, least in enumerate(_AT_LEAST):
                keep = np.flatnonzero(z >= least)
                if not len(keep):
                    break
                z, cells, rank = z[keep], cells[keep], rank[keep]
                h = mix(z, j) if j else z
                name = h & own_bits
                dart = (h & dart_bits) | rank
                if level:
                    dart = (dart >> np.uint64(32 + level) << half) | name
                name *= np.uint64(k)
                name >>= half
                name += to[cells]
                if not full:
                    hit = low + width * ((mix(h, 63) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)) < weights[cells]
                    name, dart = name[hit], dart[hit]
                np.minimum.at(best, name.view(np.int64), dart)
            low, layer = low + width, layer + 1
            more = np.flatnonzero(weights > low)
            items, owner, weights = items[more], owner[more], weights[more]
        done[todo] = upto
        todo = todo[((best.reshape(n, k)[todo] >> half) >= upto[:, None].astype(np.uint64)).any(axis=1)]
        hits += 2 * k
    out = best.reshape(n, k) & own_bits
    out[sizes == 0] = 0
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One hash a band."""
    out = np.zeros((len(sig), bands), np.uint64)
    for r in range(rows):
        out = mix(out ^ sig[:, r::rows][:, :bands], r)
    return out.astype(np.int64)


def jaccard(a: tuple, b: tuple, weighted: bool = False) -> float:
    """Similarity of two shingles() results: of the sets, or weighted, of the counts."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if weighted:
        both = np.minimum(a[1][i], b[1][j]).sum()
        return float(both / (a[1].sum() + b[1].sum() - both))
    return len(common) / (len(a[0]) + len(b[0]) - len(common))


def _signed(docs: DataFrame, weighted: bool) -> DataFrame:
    """(digest, doc_id, bands, low) of every row; low has the lowest byte of each coordinate; bands is empty for texts without words.

    Of the rows of one text that a task reads only the first is signed (it remembers so many digests, then begins anew); the
    others have null bands, so that a large group of copies costs a signature a task.
    """

    def run(frames):
        seen = set()
        for f in frames:
            at, unread, sets, chars, size, again = [], [], [], 0, 0, []
            ids, digests, whole = f["doc_id"].to_numpy(), f["digest"].to_numpy(), f["text"].to_numpy()

            def close(at, sets):
                keys = low = [None] * len(at)
                if sets:
                    sig = signatures(sets)
                    low = [x.astype(np.uint8).tobytes() for x in sig]
                    keys = [k if len(s[0]) else k[:0] for k, s in zip(band_keys(sig), sets, strict=True)]
                return pd.DataFrame({"digest": digests[at], "doc_id": ids[at], "bands": keys, "low": low})

            def hashed(unread):
                got = shingle_sets(unread)
                return (got if weighted else [(s[0], np.ones(len(s[0]))) for s in got]), sum(max(len(s[0]), DARTS) for s in got)

            for i, (digest, t) in enumerate(zip(digests, whole, strict=True)):
                if digest in seen:
                    again.append(i)
                    continue
                seen = {digest} if len(seen) >= REMEMBERED else seen
                seen.add(digest)
                at.append(i)
                unread.append(t)
                chars += len(t)
                if chars > CHARS_AT_ONCE or len(unread) >= TEXTS_AT_ONCE:
                    more, cells = hashed(unread)
                    sets, size, unread, chars = sets + more, size + cells, [], 0
                    if size > CELLS:
                        yield close(at, sets)
                        at, sets, size = [], [], 0
            if at:
                yield close(at, sets + hashed(unread)[0])
            if again:
                yield close(again, [])

    return docs.mapInPandas(run, "digest binary, doc_id long, bands array<long>, low binary")


def _small(df: DataFrame, most: int | None = None) -> DataFrame:
    """df (a checkpoint), to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= (BROADCAST_NODES if most is None else most) else df


def _texts_of(ids: DataFrame, reps: DataFrame, docs: DataFrame, parts: int) -> DataFrame:
    """(id, text) of nodes (id, distinct; in so many parts): texts are read again, and only theirs are shuffled."""
    want = _small(cut(ids.join(reps.select("id", "least", "digest"), "id").coalesce(parts)))
    got = docs.select("doc_id", "text").join(want, F.col("doc_id") == F.col("least")).filter(F.unhex(F.md5("text")) == F.col("digest"))
    return got.groupBy("id").agg(F.first("text").alias("text"))


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, threshold: float, weighted: bool, parts: int) -> DataFrame:
    """Those (a, b) of pairs whose texts are similar."""
    own = _texts_of(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), reps, docs, parts)
    left = own.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = own.select(F.col("id").alias("b"), F.col("text").alias("tb"))

    def run(frames):
        known, size = {}, 0  # of the last texts, of two million shingles at most

        def of(i, text):
            nonlocal known, size
            if (got := known.get(i)) is None:
                got = shingles(text)
                if size > 2_000_000:
                    known, size = {}, 0
                known[i] = got
                size += len(got[0])
            return got

        for f in frames:
            keep = []
            for a, b, ta, tb in zip(f["a"], f["b"], f["ta"], f["tb"], strict=True):
                keep.append(jaccard(of(a, ta), of(b, tb), weighted) >= threshold)
            yield f.loc[keep, ["a", "b"]]

    return pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb").mapInPandas(run, "a long, b long")


def _dealt(placed: DataFrame, chars: DataFrame) -> DataFrame:
    """(id, band, bucket, class, own, lo, hi): each member of a bucket once for every two blocks of it that its own is one of.

    A bucket's members are dealt to blocks by hash, as many as keep a block within BLOCK members and about BLOCK_CHARS
    (chars: id, chars). Only numbers are joined by bucket here; texts and signatures come to these rows by node.
    """
    full = F.greatest(F.count("*") / BLOCK, F.sum("chars") / BLOCK_CHARS)
    sizes = placed.join(chars, "id").groupBy("bucket").agg(F.ceil(full).cast("int").alias("blocks"))
    rows = placed.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.select("id", "band", "bucket", "class", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return rows.select("id", "band", "bucket", "class", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))


def _left(placed: DataFrame, reps: DataFrame, docs: DataFrame, threshold: float, weighted: bool, parts: int) -> DataFrame:
    """(a, b): links that join the components of a bucket which similar texts join.

    placed: (id, band, bucket, class); docs: (doc_id, text) by those ids, each once. Every two blocks of a bucket are compared in one task, so no task holds more
    than about two blocks however large a bucket is. A pair is compared in its first common band
    alone: by signature, then by text, the likeliest first. Members that a task's links have joined need no more comparing, so it
    emits fewer links than it has members, and no pairs that aren't links.
    """
    text = docs.select(F.col("doc_id").alias("id"), "text")
    rows = _dealt(placed, text.select("id", F.length("text").alias("chars"))).join(text.join(reps.select("id", "bands", "low"), "id"), "id")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        ids, cls, own, text = (f[c].to_numpy().copy() for c in ("id", "class", "own", "text"))
        low = np.frombuffer(b"".join(f["low"]), np.uint8).reshape(len(f), -1)
        bands = np.stack(f["bands"].to_numpy())
        lo, hi, band = int(f["lo"].iloc[0]), int(f["hi"].iloc[0]), int(f["band"].iloc[0])
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        known, out = {}, []

        def of(i):
            if i not in known:
                known[i] = shingles(text[i])
            return known[i]

        for i in left.tolist():
            at = right[cls[right] != cls[i]]
            at = at[ids[at] > ids[i]] if lo == hi else at
            agree = (low[at] == low[i]).mean(axis=1)
            at = at[np.argsort(-agree, kind="stable")][: int((agree >= AGREE).sum())]
            at = at[(bands[at] == bands[i]).argmax(axis=1) == band]
            for k in at.tolist():
                if cls[k] != cls[i] and jaccard(of(i), of(k), weighted) >= threshold:
                    out.append((min(ids[i], ids[k]), max(ids[i], ids[k])))
                    cls[cls == cls[k]] = cls[i]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return rows.groupBy("bucket", "lo", "hi").applyInPandas(run, "a long, b long").distinct().coalesce(parts)


def _one_id(docs: DataFrame, reps: DataFrame) -> DataFrame | None:
    """(a, b): links between the texts of ids that have several; None if there are none. Ids are found by pre-aggregated hashes of their texts."""
    h = F.xxhash64("text")
    several = cut(docs.groupBy("doc_id").agg(F.min(h).alias("lo"), F.max(h).alias("hi")).filter("lo <> hi").select("doc_id"))
    if not several.limit(1).count():
        return None
    rows = docs.join(_small(several), "doc_id", "left_semi").select("doc_id", "digest").distinct().join(reps.select("digest", "id"), "digest")
    lead = rows.groupBy("doc_id").agg(F.min("id").alias("a"))
    return cut(rows.join(lead, "doc_id").filter("a <> id").select("a", F.col("id").alias("b")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, weighted: bool = False) -> DataFrame:
    """(doc_id, class) of every row: class is the least doc_id linked to it by texts of the similarity, by equal texts, or by one id.

    Similarity is the Jaccard of the sets of five-word shingles, or with weighted, of their counts; element weights of the
    signatures are 1 or the counts. Texts without words are alike only if equal (a null text is the empty one). Repeated rows
    stay; all texts under one id are one class; rows with a null id stay, their class null. An empty table gives no rows.
    Other columns are left out, whatever their names.

    A node is a distinct text, by digest, and is signed once a task at most. A bucket (band, key) isn't paired off: each round compares all of its
    members with one of them, first the one with the most collisions in all, and links those that are similar. Members of one
    component need no more comparing. After STAR_ROUNDS all pairs across the components of a bucket are compared, by signature,
    then by text. So no link that could join two classes is left out, but for those that MinHash itself misses.
    """
    d = texts(docs, id_col, text_col).withColumn("digest", F.unhex(F.md5("text")))
    known = d.filter("doc_id IS NOT NULL")
    reps = _signed(known, weighted).groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("bands", True).alias("bands"), F.first("low", True).alias("low"))
    reps = written(reps.withColumn("id", F.monotonically_increasing_id()), "signatures")
    hits = reps.select("id", F.posexplode("bands").alias("band", "key")).select("id", "band", F.xxhash64("band", "key").alias("bucket"))
    sizes = hits.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    hits = hits.join(sizes, "bucket")
    hub = hits.groupBy("id").agg(F.sum("n").alias("hub"))
    hits = cut(hits.select("id", "band", "bucket").join(hub, "id"))
    parts = 1 + hits.count() // ROWS_A_PART
    hits = hits.coalesce(parts)
    seen, links = None, _one_id(known, reps)
    own = hits.select("id").distinct().select("id", F.col("id").alias("class"))
    for r in range(STAR_ROUNDS + 1):
        placed = hits.join(own, "id") if r else hits.withColumn("class", F.col("id"))
        if r:  # only buckets that more than one component is in; the first round has seen all of a bucket of two
            several = placed.groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count("*").alias("n")).filter("lo <> hi AND n > 2").select("bucket")
            placed = cut(placed.join(several, "bucket").coalesce(parts))
            if not placed.limit(1).count():
                break
        last = r == STAR_ROUNDS
        if last:
            own_text = written(_texts_of(placed.select("id").distinct(), reps, known, parts).withColumnRenamed("id", "doc_id"), "texts")
            found = cut(_left(placed, reps, own_text, threshold, weighted, parts))
        else:
            rank = F.struct(F.col("hub"), -F.col("id")) if not r else F.struct(F.xxhash64("id", F.lit(r)), -F.col("id"))
            lead = placed.groupBy("bucket").agg(F.max_by(F.struct(F.col("id").alias("lead"), F.col("class").alias("lead_class")), rank).alias("l")).select("bucket", "l.*")
            pairs = placed.join(lead, "bucket").filter("id <> lead AND class <> lead_class").select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()
            if seen is not None:
                pairs = pairs.join(seen, ["a", "b"], "left_anti")
            pairs = cut(pairs.coalesce(parts))
            found = cut(_verified(pairs, reps, known, threshold, weighted, parts))
            seen = pairs if seen is None else seen.union(pairs)
        links = found if links is None else links.union(found)
        classes = components(links)
        if last:
            break
        own = hits.select("id").distinct().join(classes, "id", "left").select("id", F.coalesce("class", "id").alias("class"))
    members = classes.join(reps.select("id", "least"), "id")
    label = members.groupBy("class").agg(F.min("least").alias("label"))
    members = members.join(label, "class").select("id", "label")
    by_digest = reps.select("digest", "id", "least").join(members, "id", "left").select("digest", F.coalesce("label", "least").alias("class"))
    rows = d.select("doc_id", "digest")
    return rows.join(by_digest, "digest", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class")).alias("class"))


def one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without repeats of an id: the row of the least text stays, then of the least other columns; a null id stays.

    Only ids that repeat are counted out, and only their rows are shuffled by id, pre-aggregated.
    """
    many = docs.groupBy(id_col).agg(F.count("*").alias("n")).filter("n > 1").select(id_col)
    order = [text_col, *[c for c in docs.columns if c != text_col]]
    again = docs.join(many, id_col, "left_semi").groupBy(F.col(id_col).alias("_id")).agg(F.min(F.struct(*order)).alias("row"))
    return docs.join(many, id_col, "left_anti").unionByName(again.select("row.*").select(*docs.columns))
