"""Source divergence audit: which words each source of a language uses more than the language does, and how sources differ.

Words are counted by sorting pointers to where they start. A task takes the bytes of its texts as they lie in Arrow's
buffers, shard by shard: pointers to word starts are sorted by multikey quicksort (eight bytes as one character: slices part
in less, equal and more than a pivot, equal ones go on to the next eight bytes), so that equal words form runs; the pointers
of a run say which documents hold the word, and so its document frequency and its count in each source. No word becomes a
Python object.

What shards counted is added up by (lang, source, term); a term has a row for each source from then on. Pairs of sources
are compared over tables of terms by sources, PAIR_ROWS rows at a time, each giving one sum a pair.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import written

#: Documents of a language that a kept term is in at least; terms listed for each group; what shares are multiples of.
MIN_DOCS, TERM_RANKS, UNIT = 3, 200, 1_000_000_000
#: Bytes of text sorted at a time (a longer text is cut between words), and pointers of a slice that is sorted at once.
SHARD_BYTES, SLICE = 8 << 20, 1 << 16
#: Rows of (term, source) that are compared in one group, and cells of a table of them.
PAIR_ROWS, CELLS = 400_000, 2_000_000

_BYTES = np.arange(256)
#: Bytes of words: letters, and all of UTF-8's bytes of characters beyond ASCII. Only A-Z are lower-cased.
IS_WORD = ((_BYTES >= 0x41) & (_BYTES <= 0x5A)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
#: The first k of eight bytes.
_FIRST = np.array([0, *[(2**64 - 1) ^ (2 ** (64 - 8 * k) - 1) for k in range(1, 9)]], np.uint64)


def pointers(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the words in data; ends: where its texts end."""
    word = IS_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    before = np.r_[False, word[:-1]] & ~edge[:-1] if len(data) else word
    after = np.r_[word[1:], False] & ~edge[1:] if len(data) else word
    starts, stops = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return starts, stops - starts


def runs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run of each pointer, a pointer of each run): pointers to equal words share a run. data: lower-cased bytes.

    Words hold no zero byte, so one that ends within eight bytes is less than any that goes on.
    """
    eight = np.ndarray(len(data) + 1, "<u8", np.r_[data, np.zeros(8, np.uint8)].tobytes(), strides=(1,))
    run, heads, n = np.empty(len(starts), np.int64), [], 0

    def digits(ids, depth):
        at = np.minimum(starts[ids] + 8 * depth, len(data))
        return eight[at].byteswap() & _FIRST[np.clip(lengths[ids] - 8 * depth, 0, 8)]

    stack = [(np.arange(len(starts)), 0)] if len(starts) else []
    while stack:
        ids, depth = stack.pop()
        key = digits(ids, depth)
        if len(ids) > SLICE:
            pivot = np.sort(key[:: max(1, len(key) // 9)])[4]
            parts = [(ids[key < pivot], depth), (ids[key == pivot], depth + 1), (ids[key > pivot], depth)]
            if not int(pivot) & 0xFF:  # equal, and ended
                run[parts[1][0]] = n
                heads.append(parts[1][0][:1])
                n, parts = n + 1, [parts[0], parts[2]]
            stack += [p for p in parts if len(p[0])]
            continue
        group = np.zeros(len(ids), np.int64)
        while len(ids):
            order = np.argsort(key) if not group.any() else np.lexsort((key, group))
            ids, key, group = ids[order], key[order], group[order]
            new = np.r_[True, (key[1:] != key[:-1]) | (group[1:] != group[:-1])]
            at = np.cumsum(new) - 1
            sizes = np.bincount(at)
            ended = ((key & np.uint64(0xFF)) == 0) | (sizes[at] == 1)
            done = at[ended]
            name = np.full(len(sizes), -1)
            own = np.unique(done)
            name[own] = n + np.arange(len(own))
            run[ids[ended]] = name[done]
            heads.append(ids[np.flatnonzero(new)[own]])
            n, ids, group, depth = n + len(own), ids[~ended], at[~ended], depth + 1
            key = digits(ids, depth)
    return run, np.concatenate(heads) if heads else np.empty(0, np.int64)


def _strings(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Slices of data as an Arrow array of strings."""
    ends = np.cumsum(lengths)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.r_[0, ends].astype(np.int32).tobytes()), pa.py_buffer(data[at].tobytes()))


def tally(data: np.ndarray, ends: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, term, occurrences, documents) of texts that lie in data one behind the other; groups: each text's own."""
    starts, lengths = pointers(data, ends)
    data = LOWER[data]
    run, heads = runs(data, starts, lengths)
    # a run's pointers by document, then its documents by group
    both, n = np.unique(run * len(ends) + np.searchsorted(ends, starts, "right"), return_counts=True)
    key = both // len(ends) * (int(groups.max(initial=0)) + 1) + groups[both % len(ends)]
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    head = heads[key[at] // (int(groups.max(initial=0)) + 1)]
    sums = np.add.reduceat(n, at) if len(at) else n
    return key[at] % (int(groups.max(initial=0)) + 1), _strings(data, starts[head], lengths[head]), sums, np.diff(np.r_[at, len(key)])


def _long(data: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(term, occurrences) of one long text, cut between words into pieces of about SHARD_BYTES."""
    found, at = {}, 0
    while at < len(data):
        stop = min(len(data), at + SHARD_BYTES)
        while stop < len(data) and IS_WORD[data[stop]]:
            rest = np.flatnonzero(~IS_WORD[data[stop : stop + SHARD_BYTES]])
            stop = stop + int(rest[0]) if len(rest) else min(len(data), stop + SHARD_BYTES)
        _, term, n, _ = tally(data[at:stop], np.array([stop - at]), np.zeros(1, np.int64))
        for t, k in zip(term.to_pylist(), n.tolist(), strict=True):
            found[t] = found.get(t, 0) + k
        at = stop
    return pa.array(list(found), pa.string()), np.array(list(found.values()), np.int64)


COUNTS = "lang string, source string, term string, n long, docs long"


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of (lang, source, text): what each shard counted, and, with a null term, each group it saw."""

    def rows(names, group, term, n, df):
        for at in range(0, len(group), 50_000):
            lang, source = ([names[g][k] for g in group[at : at + 50_000]] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), term[at : at + 50_000], pa.array(n[at : at + 50_000], pa.int64()), pa.array(df[at : at + 50_000], pa.int64())], ["lang", "source", "term", "n", "docs"])

    def shard(parts):
        """parts: [(lang, source, bytes)] of a shard; each of several texts."""
        numbers: dict = {}
        group = np.array([numbers.setdefault(g, len(numbers)) for langs, sources, _, _ in parts for g in zip(langs, sources, strict=True)])
        names = list(numbers)
        yield from rows(names, np.arange(len(names)), pa.nulls(len(names), pa.string()), np.zeros(len(names), np.int64), np.zeros(len(names), np.int64))
        sizes = np.concatenate([np.diff(o) for _, _, o, _ in parts])
        data = np.concatenate([d[o[0] : o[-1]] for _, _, o, d in parts])
        if len(sizes) == 1 and len(data) > SHARD_BYTES:
            term, n = _long(data)
            yield from rows(names, np.zeros(len(term), int), term, n, np.ones(len(term), np.int64))
        else:
            yield from rows(names, *tally(data, np.cumsum(sizes), group))

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            text = batch.column(2).cast(pa.large_string())
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            langs, sources, at = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            while at < len(text):
                stop = int(np.searchsorted(offsets, offsets[at] + SHARD_BYTES - held, "right")) - 1
                if stop > at:
                    parts.append((langs[at:stop], sources[at:stop], offsets[at : stop + 1], data))
                    held, at = held + int(offsets[stop] - offsets[at]), stop
                if at < len(text):  # the next text doesn't fit
                    if parts:
                        yield from shard(parts)
                    else:
                        yield from shard([(langs[at : at + 1], sources[at : at + 1], offsets[at : at + 2], data)])
                        at += 1
                    parts, held = [], 0
            parts = [(a, b, o, d.copy() if d.base is not None else d) for a, b, o, d in parts]  # the batch's buffers don't outlive it
        if parts:
            yield from shard(parts)

    return docs.mapInArrow(run, COUNTS)


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + terms)), in decimals, as the product can pass 64 bits."""
    return F.expr(f"1 + (CAST({UNIT} AS DECIMAL(38, 0)) * ({n} + 1)) DIV CAST({total} + {terms} AS DECIMAL(38, 0))")


def compare_pairs(rows: DataFrame, groups: DataFrame, shards: int) -> DataFrame:
    """(lang, source, item, value): for every two sources of a language, floor((p - q)^2 / q) summed over its kept terms.

    rows: (lang, source, term, p); groups: (lang, source, p0), p0 for terms a source doesn't have. Terms are dealt over
    shards, and the sources of a language (as many as it has pairs of, by each) come to every shard.
    """
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(shards)))
    sources = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select("lang", "source", "p0", F.col("shard").cast("long").alias("shard"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = left["source"].to_pylist()
        order = sorted(range(len(names)), key=names.__getitem__)
        names, k = [names[i] for i in order], len(order)
        i, j = np.nonzero(~np.eye(k, dtype=bool)) if len(right) or k and not left["shard"][0].as_py() else (np.empty(0, int),) * 2
        total = np.zeros((k, k), np.int64)
        if len(i) and len(right):
            p0 = left["p0"].to_numpy()[order]
            at = pc.index_in(right["source"], pa.array(names, pa.string())).to_numpy()
            term = pc.index_in(right["term"], pc.unique(right["term"])).to_numpy()
            by, p, n_terms = np.argsort(term, kind="stable"), right["p"].to_numpy(), int(term.max()) + 1
            term, at, p = term[by], at[by], p[by]
            step = max(1, CELLS // k)
            for low in range(0, n_terms, step):
                a, b = np.searchsorted(term, [low, low + step])
                cells = np.repeat(p0[None], min(step, n_terms - low), 0)
                cells[term[a:b] - low, at[a:b]] = p[a:b]
                for c in range(k):
                    q = cells[:, c : c + 1]
                    total[:, c] += (np.square(cells - q) // q).sum(0)
        lang = left["lang"][0].as_py() if k else ""
        pick = pa.array(names, pa.string())
        return pa.table([pa.array([lang] * len(i), pa.string()), pick.take(pa.array(i)), pick.take(pa.array(j)), pa.array(total[i, j], pa.int64())], ["lang", "source", "item", "value"])

    parts = sources.groupBy("lang", "shard").cogroup(rows.select("lang", "source", "term", "p", "shard").groupBy("lang", "shard")).applyInArrow(run, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, term_ranks: int = TERM_RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group (lang, source), part "pair" ranks the other sources of its
    language by their distance, part "term" the terms that it uses more than its language does.

    Null texts, languages and sources are empty ones. Rows count as documents, also repeated ones. A group without terms has its pairs. An
    empty table gives no rows. Other columns are left out, whatever their names.
    """
    blank = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    found = counts(docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"), blank(text_col).alias("text")))
    found = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = W.partitionBy("lang", "term")
    found = found.select("lang", "source", "term", "n", F.sum("docs").over(by_term).alias("df"), F.sum("n").over(by_term).alias("n_lang"), (F.row_number().over(by_term.orderBy("source")) == 1).alias("first"))
    kept = written(found.filter(F.col("term").isNull() | (F.col("df") >= min_docs)).drop("df"), "terms")
    langs = kept.groupBy("lang").agg(F.sum("n").alias("in_lang"), F.sum(F.when(F.col("term").isNotNull() & F.col("first"), 1).otherwise(0)).alias("terms"))
    groups = written(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")).join(langs, "lang"), "groups")
    rows = kept.filter(F.col("term").isNotNull()).join(groups, ["lang", "source"]).withColumn("p", share("n", "total", "terms"))

    q = share("n_lang", "in_lang", "terms")
    more = rows.withColumn("q", q).filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) DIV q").alias("value"))
    by_group = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    listed = more.withColumn("rank", F.row_number().over(by_group)).filter(F.col("rank") <= term_ranks)

    shards = 1 + kept.count() // PAIR_ROWS
    bare = groups.select("lang", "source", F.when(F.col("terms") > 0, share("0", "total", "terms")).otherwise(1).cast("long").alias("p0"))
    pairs = compare_pairs(rows, bare, shards).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return pairs.withColumn("rank", F.row_number().over(by_group)).unionByName(listed)


AUDIT_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= {MIN_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, coalesce(sum(k.n), 0)::HUGEINT AS total, count(k.term) AS terms FROM (SELECT DISTINCT lang FROM d) LEFT JOIN k USING (lang) GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + {UNIT}::HUGEINT * (coalesce(c.n, 0) + 1) // (g.total + l.terms) AS p, 1 + {UNIT}::HUGEINT * (k.n + 1) // (l.total + l.terms) AS q
      FROM g JOIN l USING (lang) JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
a AS (SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(v.value, 0)::BIGINT AS value FROM g JOIN g o ON g.lang = o.lang AND g.source <> o.source
      LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) v
      ON v.lang = g.lang AND v.source = g.source AND v.item = o.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM a
QUALIFY part = 'pair' OR rank <= {TERM_RANKS}
"""
