"""An index for nearest vectors: an inverted file of cells around k-means centroids.

Centroids are fitted on a sample of SAMPLE vectors at most; every vector is assigned to its nearest and stored with its cell. A
search sends each query to its nearest cells alone, by a join on the cell, and re-ranks what it finds there by the exact
cosine. A cell of more than CELL_ROWS rows is searched in pieces, and its queries in blocks of QUERY_ROWS, so that neither a hot cell nor a
favourite one makes a large task; no query passes through the driver, and cells that nobody asks for aren't read.

exact=True goes on to the cells that could still hold a better row: a cell's rows lie within an angle of its centroid, so their
cosine to a query has a bound. What is bounded below the query's last hit is left out, and the result is exact.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.operators.registry import Registry
from lectern.sources.stored import fresh_path, written
from lectern.sources.tables import table

query = Registry()

#: Vectors that centroids are fitted on at most, cells at most, and rounds of fitting.
SAMPLE, CELLS, STEPS = 20_000, 2_048, 10
#: Rows and queries of a cell that meet in one task at most (about: both are dealt by hash).
CELL_ROWS, QUERY_ROWS = 20_000, 2_000
#: Scores are to six places, so rows within one of these places of the last hit may still be better by id.
PLACE = 1.5e-6
#: Queries that calibrated() asks at most.
ASKED = 256
FOUND, FOUND_NAMES = "query_id long, vec_id long, score double, cell long", ["query_id", "vec_id", "score", "cell"]


@dataclass
class Index:
    """rows (cell, vec_id, v, cosine to the centroid) in path/rows; centroids, rows of each cell, and the least cosine in it."""

    path: str
    centroids: np.ndarray
    n: np.ndarray
    least: np.ndarray
    rows: DataFrame

    @property
    def pieces(self) -> np.ndarray:
        return np.maximum(1, -(-self.n // CELL_ROWS))


def _matrix(column, dims: int) -> np.ndarray:
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)


def _usable(vectors: DataFrame, dims: int | None = None) -> DataFrame:
    """(vec_id, v) of vectors (vec_id, embedding) that have an id, a direction, and dims components, if that is given."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id IS NOT NULL AND size(v) > 0")
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(F.coalesce(fine, F.lit(False)))
    return rows.filter(F.size("v") == dims) if dims else rows


def fit(vectors: DataFrame, cells: int | None = None) -> np.ndarray:
    """Unit centroids by spherical k-means on at most SAMPLE of vectors (vec_id, v): all, or those of the least hashes. The square root of their number, CELLS at most, unless cells is given."""
    n = vectors.count()
    key = F.xxhash64("vec_id", "v")
    some = vectors if n <= SAMPLE else vectors.filter(key < int(-(2**63) + 2**64 * SAMPLE / n)).limit(2 * SAMPLE)
    rows = some.select(key.alias("k"), "v").toArrow().sort_by("k")
    if not len(rows):
        return np.zeros((0, 0))
    x = _matrix(rows["v"], len(rows["v"][0]))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    k = min(len(x), cells or min(CELLS, max(1, round(n**0.5))))
    c = x[np.random.default_rng(7).permutation(len(x))[:k]].copy()
    for _ in range(STEPS):
        of = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-300), c)
    return c


def _assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cell, vec_id, v, cosine) of vectors (vec_id, v)."""
    dims = centroids.shape[1]

    def run(batches):
        for b in batches:
            x = _matrix(b.column(1), dims)
            dot = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ centroids.T
            cell = dot.argmax(1) if len(dot) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), b.column(0), b.column(1), pa.array(dot[np.arange(len(dot)), cell], pa.float64())], ["cell", "vec_id", "v", "cosine"])

    return vectors.mapInArrow(run, "cell long, vec_id long, v array<double>, cosine double")


def build(vectors: DataFrame, path: str, cells: int | None = None, dims: int | None = None) -> Index | None:
    """An index of vectors (vec_id, embedding) in path; None if none is usable. Those without an id or a direction are left out, as are those of other than dims (or else the most common number of) components."""
    rows = _usable(vectors, dims)
    if not dims:
        most = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
        if not most:
            return None
        rows = rows.filter(F.size("v") == most.dims)
    centroids = fit(rows, cells)
    if not len(centroids):
        return None
    spark = vectors.sparkSession
    spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], "cell long, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    _put(rows, centroids, path)
    return opened(spark, path)


def _put(rows: DataFrame, centroids: np.ndarray, path: str) -> None:
    """Rows by ranges of (cell, id), so that a cell is in few files, which their statistics name, and a hot one in many."""
    _assigned(rows, centroids).repartitionByRange("cell", "vec_id").sortWithinPartitions("cell", "vec_id").write.mode("append").parquet(f"{path}/rows")


def opened(spark: SparkSession, path: str) -> Index:
    """An index that build() left in path."""
    centroids = np.array([r.centroid for r in spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()])
    rows = spark.read.parquet(f"{path}/rows")
    n, least = np.zeros(len(centroids), np.int64), np.ones(len(centroids))
    for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("least")).collect():  # a row a cell
        n[r.cell], least[r.cell] = r.n, r.least
    return Index(path, centroids, n, least, rows)


def add(index: Index, vectors: DataFrame) -> Index:
    """The index with more vectors, assigned to the cells that there are."""
    _put(_usable(vectors, index.centroids.shape[1]), index.centroids, index.path)
    return opened(vectors.sparkSession, index.path)


def _asked(queries: DataFrame, index: Index, probes: int, more: bool) -> DataFrame:
    """(cell, query_id, q): a row for each of a query's probes nearest cells, or, with more, for those beyond them that could hold a row as good as the query's column last."""
    c, n, dims = index.centroids, index.n, index.centroids.shape[1]
    wide = np.arccos(np.clip(index.least, -1, 1))

    def run(batches):
        for b in batches:
            x = _matrix(b.column(1), dims)
            dot = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ c.T
            dot[:, n == 0] = -2
            order = np.argsort(-dot, axis=1, kind="stable")
            first = np.zeros(dot.shape, bool)
            np.put_along_axis(first, order[:, :probes], True, 1)
            ask = first
            if more:
                angle = np.arccos(np.clip(dot, -1, 1)) - wide
                last = np.array([-2.0 if s is None else s for s in b.column(2).to_pylist()])
                ask = ~first & (np.cos(np.maximum(angle, 0)) >= last[:, None] - PLACE)
            row, cell = np.nonzero(ask & (n > 0))
            for at in range(0, len(row), 10_000):
                r = pa.array(row[at : at + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array(cell[at : at + 10_000], pa.int64()), b.column(0).take(r), b.column(1).take(r)], ["cell", "query_id", "q"])

    return queries.mapInArrow(run, "cell long, query_id long, q array<double>")


def _met(asked: DataFrame, index: Index, top: int) -> DataFrame:
    """(query_id, vec_id, score): the top rows of each query in each piece of a cell that it was sent to."""
    dims, spark = index.centroids.shape[1], asked.sparkSession
    asked = written(asked, "asked")
    blocks = {r.cell: -(-r.n // QUERY_ROWS) for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a cell
    if not blocks:
        return spark.createDataFrame([], FOUND)
    sizes = spark.createDataFrame([(cell, int(index.pieces[cell]), b) for cell, b in blocks.items()], "cell long, pieces int, blocks int")
    part = lambda key, of: F.pmod(F.xxhash64(key), F.col(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = asked.join(F.broadcast(sizes), "cell").select("cell", "query_id", "q", part("query_id", "blocks").alias("block"), each("pieces").alias("piece"))
    right = index.rows.join(F.broadcast(sizes), "cell").select("cell", "vec_id", "v", part("vec_id", "pieces").alias("piece"), each("blocks").alias("block"))

    def run(q: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(q) or not len(rows):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], pa.int64())], FOUND_NAMES)
        a, b, ids = _matrix(q["q"], dims), _matrix(rows["v"], dims), rows["vec_id"].to_numpy()
        a, b = a / np.linalg.norm(a, axis=1, keepdims=True), b / np.linalg.norm(b, axis=1, keepdims=True)
        by_id = np.argsort(ids, kind="stable")
        b, ids = b[by_id], ids[by_id]
        out = ([], [], [], [])
        for at in range(0, len(a), 256):
            score = np.round(a[at : at + 256] @ b.T, 6)
            best = np.argsort(-score, axis=1, kind="stable")[:, :top]
            out[0].append(np.repeat(q["query_id"].to_numpy()[at : at + 256], best.shape[1]))
            out[1].append(ids[best].ravel())
            out[2].append(np.take_along_axis(score, best, 1).ravel())
            out[3].append(np.full(best.size, rows["cell"][0].as_py()))
        return pa.table([np.concatenate(x) for x in out], FOUND_NAMES)

    key = ["cell", "piece", "block"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, FOUND)


def _best(found: DataFrame, top: int) -> DataFrame:
    return found.withColumn("k", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("k") <= top)


def search(index: Index, queries: DataFrame, top: int = 20, probes: int = 8, exact: bool = False) -> DataFrame:
    """(query_id, vec_id, score): the top rows of each query (vec_id, embedding) by cosine to six places, then by id.

    Of the rows in its probes nearest cells; of all rows if exact. Queries that the index couldn't hold have no rows.
    """
    asked = _usable(queries, index.centroids.shape[1]).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    found = _best(_met(_asked(asked, index, probes, False), index, top), top)
    if exact:
        found = written(found, "found")
        last = found.filter(F.col("k") == top).select("query_id", F.col("score").alias("last"))
        rest = _asked(asked.join(last, "query_id", "left").select("query_id", "q", "last"), index, probes, True)
        found = _best(found.drop("k").unionByName(_met(rest, index, top)), top)
    return found.select("query_id", "vec_id", "score")


def calibrated(index: Index, top: int = 20, recall: float = 0.95) -> int:
    """The least number of probes that gives a recall of top rows, measured against the exact search on about ASKED of the index's own rows, picked by hash. Data without clusters need many."""
    n = int(index.n.sum())
    rows = index.rows.select("vec_id", F.col("v").alias("embedding")).filter(F.xxhash64("vec_id", F.lit(1)) < int(min(2**63 - 1, -(2**63) + 2**64 * ASKED / max(1, n)))).limit(2 * ASKED)
    rows = written(rows.dropDuplicates(["vec_id"]), "sample")
    x = {r.vec_id: np.array(r.embedding) for r in rows.collect()}
    asked = _usable(rows, index.centroids.shape[1]).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    hits = _best(_met(_asked(asked, index, len(index.centroids), False), index, top), top).collect()  # top rows of a bounded sample
    ranks = []
    for r in hits:
        dot = index.centroids @ (x[r.query_id] / np.linalg.norm(x[r.query_id]))
        ranks.append(int(((dot > dot[r.cell]) & (index.n > 0)).sum()) + 1)
    return int(np.quantile(ranks, recall, method="higher")) if ranks else 1


def nearest(queries: DataFrame, rows: DataFrame, top: int = 20) -> DataFrame:
    """search(), exact, of rows that aren't indexed yet. Queries meet the rows that have as many components; each such number, of which there are few, has an index."""
    spark, out = rows.sparkSession, None
    for dims in sorted(r.dims for r in _usable(queries).select(F.size("v").alias("dims")).distinct().collect()):
        index = build(rows, fresh_path(spark, "vectors"), dims=dims)
        part = search(index, queries, top, exact=True) if index else None
        out = part if out is None else out if part is None else out.unionByName(part)
    return spark.createDataFrame([], "query_id long, vec_id long, score double") if out is None else out


@query("""
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q)
SELECT query_id, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
""")
def vector_topk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact nearest vectors to every one whose id is divisible by 100."""
    e = table(spark, sf_dir, "embeddings")
    return nearest(e.filter("vec_id % 100 = 0"), e)


@query()
def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a calibrated index's nearest cells alone; tests hold its recall to 0.9 and more."""
    e = table(spark, sf_dir, "embeddings")
    index = build(e, fresh_path(spark, "vectors"))
    return search(index, e.filter("vec_id % 100 = 0"), probes=calibrated(index)) if index else spark.createDataFrame([], "query_id long, vec_id long, score double")
