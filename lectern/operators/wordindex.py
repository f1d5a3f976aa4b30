"""A stored index of words: ranked search and phrases without reading a text.

Documents are inverted in segments of SEGMENT_DOCS. A row of the index is a block: one term in one segment, with the segment's places and ids
that hold it, how often, how long these documents are, and where in the segment the term stands; and the greatest count and least length, which
bound what any document of the block can score. So no term's rows are larger than a segment, however common it is. Places of words run on over a
segment's documents, with one left out between two, so that the words of a phrase are found by places alone; the row of the empty term has all of a segment's
documents and where each begins. What a task inverts it writes, sorted by term, without a shuffle, so a search reads the row groups of its words alone;
compact() puts a large index in ranges of terms, so that it opens few files as well.

A top-k search scores the segments with the greatest bounds first; segments whose bound is below the k-th score so far are left
out. New documents are another generation of blocks; a ledger names the generations that count, so one half written isn't seen.
"""

import json
import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import columns as C
from lectern.operators.business import count
from lectern.operators.documents import WORDS, _bm25_sql
from lectern.operators.registry import Registry
from lectern.sources.snapshots import Ledger
from lectern.sources.stored import fingerprint, shared_dir
from lectern.sources.tables import spread, table

query = Registry()

#: Documents and characters of a segment at most (a longer text is a segment of its own), and segments scored first.
SEGMENT_DOCS, SEGMENT_CHARS, FIRST = 1_024, 8_000_000, 64
#: Raised when blocks change, so that an index of an earlier form isn't read.
FORMAT = 3
BLOCK = "term string, segment long, n int, most int, shortest int, slots array<int>, ids array<long>, counts array<int>, lengths array<int>, positions array<int>"
_WORD = re.compile("[a-z0-9]+")
_FOLD = str.maketrans(C.ACCENTED, C.PLAIN)


def words(text: str) -> list[str]:
    """Words of a text in lower case, accents folded."""
    return _WORD.findall(text.translate(_FOLD))


def _blocks(ids: list, texts: list[str], segment: int) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """The row of all documents of a segment, and its blocks, sorted by term."""
    numbers, of, lengths = {}, [], []
    for t in texts:
        w = words(t)
        of += [numbers.setdefault(x, len(numbers)) for x in w]
        lengths.append(len(w))
    of, lengths = np.array(of, np.int64), np.array(lengths, np.int64)
    names = list(numbers)
    rank = np.empty(len(names), np.int64)
    rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    term = rank[of]
    slot = np.repeat(np.arange(len(texts)), lengths)
    bases = np.cumsum(lengths) - lengths + np.arange(len(lengths))
    place = np.arange(len(of)) + slot
    order = np.argsort(term, kind="stable")  # documents and places stay in order within a term
    term, slot, place = term[order], slot[order], place[order]
    first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (slot[1:] != slot[:-1])]) if len(term) else np.empty(0, np.int64)
    counts = np.diff(np.r_[first, len(term)])
    holder, block = slot[first], term[first]
    starts = np.searchsorted(block, np.arange(len(names)))
    ends = np.r_[starts, len(block)].astype(np.int32)
    own = np.array([0 if i is None else i for i in ids], np.int64)
    missing = np.array([i is None for i in ids])

    def lists(values, null=None):
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, mask=null))

    def all_(values, kind):
        return pa.array([values], pa.list_(kind))

    places = np.r_[first, len(term)][ends].astype(np.int32)
    n = len(names)
    held = pa.RecordBatch.from_arrays(
        [
            pa.array(sorted(names), pa.string()), pa.array(np.full(n, segment), pa.int64()), pa.array(np.diff(ends), pa.int32()),
            pa.array(np.maximum.reduceat(counts, starts) if n else counts, pa.int32()), pa.array(np.minimum.reduceat(lengths[holder], starts) if n else counts, pa.int32()),
            lists(holder.astype(np.int32)), lists(own[holder], missing[holder]), lists(counts.astype(np.int32)), lists(lengths[holder].astype(np.int32)),
            pa.ListArray.from_arrays(pa.array(places), pa.array(place.astype(np.int32))),
        ], _NAMES)
    whole = pa.RecordBatch.from_arrays(
        [
            pa.array([""]), pa.array([segment], pa.int64()), pa.array([len(texts)], pa.int32()), pa.array([0], pa.int32()), pa.array([int(lengths.min(initial=0))], pa.int32()),
            all_(list(range(len(texts))), pa.int32()), all_(list(ids), pa.int64()), all_([0] * len(texts), pa.int32()), all_(lengths.tolist(), pa.int32()), all_(bases.tolist(), pa.int32()),
        ], _NAMES)
    return whole, held


_NAMES = [c.split()[0] for c in BLOCK.split(", ")]


def _inverted(docs: DataFrame, generation: int, key: str, text: str) -> DataFrame:
    most, chars = SEGMENT_DOCS, SEGMENT_CHARS

    def run(batches):
        from pyspark import TaskContext

        place, k, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (len(ids) >= most or size + len(t) > chars):
                    yield from _blocks(ids, texts, (generation << 48) + (place << 24) + k)
                    k, ids, texts, size = k + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)
        if ids:
            yield from _blocks(ids, texts, (generation << 48) + (place << 24) + k)

    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.lower(F.col(text)), F.lit("")).alias("text"))
    return rows.mapInArrow(run, BLOCK)


@dataclass
class WordIndex:
    spark: SparkSession
    path: str

    @property
    def ledger(self) -> Ledger:
        return Ledger(self.spark, f"{self.path}/ledger")

    def generations(self) -> list[str]:
        names = [n for n in self.ledger.names() if n.endswith(".json") and not n.startswith(".")]
        return json.loads(self.ledger.read(names[-1]))["folders"] if names else []

    def add(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> "WordIndex":
        """The index with more documents (key, text), each row being one; a null text has no words. Rows of documents that it has are added again."""
        had = self.generations()
        number = len(self.ledger.names())  # of a generation: rises with every commit, so segments stay distinct
        folder = f"g{number}-{uuid.uuid4().hex}"
        _inverted(spread(docs.select(key, text)), number, key, text).sortWithinPartitions("term", "segment").write.parquet(f"{self.path}/{folder}")
        return self._commit([*had, folder])

    def _commit(self, folders: list[str]) -> "WordIndex":
        number = sum(n.endswith(".json") and not n.startswith(".") for n in self.ledger.names())
        if not self.ledger.create(f"{number:010d}.json", json.dumps({"folders": folders})):
            raise RuntimeError(f"another writer has written to {self.path}; begin again")
        return self

    def compact(self) -> "WordIndex":
        """The index with its generations as one, in ranges of (term, segment): a search opens the files of its words' ranges. Old folders stay until their owner clears them."""
        had = self.generations()
        folder = f"c{len(had)}-{uuid.uuid4().hex}"
        rows = self.spark.read.schema(BLOCK).parquet(*[f"{self.path}/{f}" for f in had])
        rows.repartitionByRange("term", "segment").sortWithinPartitions("term", "segment").write.parquet(f"{self.path}/{folder}")
        return self._commit([folder])

    def blocks(self, terms: list[str]) -> DataFrame:
        """The blocks of some terms; their names reach the scan."""
        folders = self.generations()
        if not folders:
            return self.spark.createDataFrame([], BLOCK)
        return self.spark.read.schema(BLOCK).parquet(*[f"{self.path}/{f}" for f in folders]).filter(F.col("term").isin(terms))

    def terms(self) -> DataFrame:
        """(term, df, cf): how many documents hold each term, and how often it occurs. Sums of blocks; no postings of a common term meet."""
        rows = self.spark.read.schema(BLOCK).parquet(*[f"{self.path}/{f}" for f in self.generations()]).filter("term <> ''") if self.generations() else self.spark.createDataFrame([], BLOCK)
        return rows.select("term", "n", F.size("positions").alias("cf")).groupBy("term").agg(F.sum("n").cast("long").alias("df"), F.sum("cf").cast("long").alias("cf"))

    def bm25(self, asked: tuple[str, ...] | list[str], top: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(doc_id, score): the top documents by Okapi BM25 (six places), then by id."""
        asked = list(asked)
        rows, both = self.blocks(asked), self.blocks([*asked, ""])
        tokens_of = F.when(F.col("term") == "", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))
        held = {r.term: r for r in both.groupBy("term").agg(F.sum("n").alias("n"), F.sum(tokens_of).alias("tokens"), F.count(F.lit(1)).alias("segments")).collect()}  # a row a word
        if "" not in held:
            return self.spark.createDataFrame([], "doc_id long, score double")
        docs, tokens, segments = held[""].n, held[""].tokens, held[""].segments
        mean = tokens / docs
        idf = F.lit(0.0)
        for w in asked:
            df = held[w].n if w in held else 0
            idf = F.when(F.col("term") == w, asked.count(w) * F.ln(F.lit(1 + (docs - df + 0.5) / (df + 0.5)))).otherwise(idf)
        weigh = lambda f, n: idf * f * (k1 + 1) / (f + k1 * (1 - b + b * n / (mean or 1.0)))
        if segments <= FIRST:
            return self._scored(rows, weigh, top)
        bounds = rows.groupBy("segment").agg(F.sum(weigh(F.col("most"), F.col("shortest"))).alias("bound"))
        ahead = bounds.orderBy(F.desc("bound"), "segment").limit(FIRST).collect()
        first = [r.segment for r in ahead]
        best = self._scored(rows.filter(F.col("segment").isin(first)), weigh, top).collect()
        least = best[-1].score - 1e-6 if len(best) == top else float("-inf")
        rest = rows.join(bounds.filter((F.col("bound") >= least) & ~F.col("segment").isin(first)).select("segment"), "segment", "left_semi")
        found = self._scored(rest, weigh, top).unionByName(self.spark.createDataFrame(best, "doc_id long, score double"))
        return found.orderBy(F.desc("score"), "doc_id").limit(top)

    @staticmethod
    def _scored(rows: DataFrame, weigh, top: int) -> DataFrame:
        each = rows.select("term", "segment", F.explode(F.arrays_zip("slots", "ids", "counts", "lengths")).alias("x"))
        part = each.select("segment", "x.slots", "x.ids", weigh(F.col("x.counts"), F.col("x.lengths")).alias("part"))
        scores = part.groupBy("segment", "slots").agg(F.first("ids").alias("doc_id"), F.sum("part").alias("score"))
        return scores.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(top)

    def phrase(self, said: list[str]) -> DataFrame:
        """(doc_id, n): documents that hold the words one behind the other, and how often: a segment's places of each word, moved back by its place in the phrase, in all of these. Segments that lack a word drop out."""
        if not said:
            return self.spark.createDataFrame([], "doc_id long, n long")
        out = None
        for i, w in enumerate(said):
            rows = self.blocks([w]).select("segment", F.transform("positions", lambda p: p - i).alias("at" if out is None else "next"))  # noqa: B023
            out = rows if out is None else out.join(rows, "segment").select("segment", F.array_intersect("at", "next").alias("at")).filter("size(at) > 0")
        docs = self.blocks([""]).select("segment", "ids", F.col("positions").alias("bases"))
        hits = out.join(docs, "segment").select("segment", "ids", F.explode(F.transform("at", lambda p: F.size(F.filter("bases", lambda b: b <= p)) - 1)).alias("slot"))
        return hits.groupBy("segment", "slot").agg(F.first(F.get("ids", F.col("slot"))).alias("doc_id"), count().alias("n")).select("doc_id", "n")


def of_table(spark: SparkSession, sf_dir: str, name: str = "documents") -> WordIndex:
    """The index of a table's texts, kept in the shared folder under a digest of the table's files, their sizes and times, and built where there is none yet."""
    docs = table(spark, sf_dir, name)
    index = WordIndex(spark, f"{shared_dir(spark)}/words-{FORMAT}-{fingerprint(docs)}")
    return index if index.generations() else index.add(docs)


_TOKENS = f"SELECT doc_id, regexp_extract_all(translate(lower(coalesce(text, '')), '{C.ACCENTED}', '{C.PLAIN}'), '[a-z0-9]+') AS t FROM documents"


@query(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest(t) AS term FROM ({_TOKENS})) GROUP BY 1")
def word_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and collection frequencies of all words, from the index, which this builds where there is none."""
    return of_table(spark, sf_dir).terms()


@query(f"WITH {_bm25_sql()} SELECT * FROM bm ORDER BY score DESC, doc_id LIMIT 50")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_table(spark, sf_dir).bm25(WORDS, 50)


PHRASE = ("all", "rights", "reserved")


@query(f"SELECT doc_id, n FROM (SELECT doc_id, len(list_filter(range(1, len(t) + 1), lambda i: t[i:i + {len(PHRASE) - 1}] = {list(PHRASE)!r}))::BIGINT AS n FROM ({_TOKENS})) WHERE n > 0")
def phrase_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a phrase, by positions of its words alone."""
    return of_table(spark, sf_dir).phrase(list(PHRASE))


def hybrid_pool(spark: SparkSession, sf_dir: str, most: int = 30) -> DataFrame:
    """The lexical pool of the hybrid searches."""
    return of_table(spark, sf_dir).bm25(WORDS, most)

