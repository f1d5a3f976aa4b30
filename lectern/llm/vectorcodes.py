"""Vector compression: four codebooks of 256 entries, nearest entries found by slice-and-intersect bitmasks.

Vectors become whole numbers, floor(1024 * x), and are cut into PARTS equal parts, each with a codebook of its own. A
codebook is prepared by dimension: its coordinates are sorted, and for each place in that order the uint64 words of a prefix
mask say which entries come before it. The entries within a radius of x in one dimension are then one prefix without
another, and those within it in all dimensions the AND of these. An initial radius gives some entries; the best of them
bounds the distance, and the masks at that bound hold every entry that can be as near: exact candidates, of which the
distances are computed.

How it runs: each round broadcasts the codebooks (1,024 entries, however many vectors there are), tasks assign their
vectors and hold sums by entry, and a shuffle adds at most 1,024 rows of each task up. Nothing else moves.
"""

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import written

#: The scale of components, parts of a vector, entries of a codebook, and rounds of moving them.
SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Scaled components stay below this, so that squared distances are exact in 64 bits.
LIMIT = 1 << 26
#: Vectors handled at a time: each can have 256 candidates.
CHUNK = 1024


class Slices:
    """One codebook (entries x dimensions, whole numbers), prepared for finding nearest entries."""

    def __init__(self, book: np.ndarray):
        self.book = book
        n, dims = book.shape
        words = -(-n // 64)
        order = np.argsort(book, axis=0, kind="stable")
        self.sorted = np.take_along_axis(book, order, 0)
        bit = np.zeros((n, words), np.uint64)
        bit[np.arange(n), np.arange(n) // 64] = np.uint64(1) << (np.arange(n) % 64).astype(np.uint64)
        self.prefix = np.zeros((dims, n + 1, words), np.uint64)
        for d in range(dims):
            self.prefix[d, 1:] = np.bitwise_or.accumulate(bit[order[:, d]], axis=0)
        far = np.abs(book[:, None] - book[None]).max(2)
        near = [x[x > 0].min() for x in far if (x > 0).any()]
        self.radius = max(1, int(np.median(near))) if near else 1

    def within(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """A mask for each row of x: the entries that differ from it by radius at most in every dimension."""
        out = None
        for d, column in enumerate(x.T):
            low, high = (np.searchsorted(self.sorted[:, d], at, side) for at, side in ((column - radius, "left"), (column + radius, "right")))
            own = self.prefix[d][high] & ~self.prefix[d][low]
            out = own if out is None else out & own
        return out

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) for each row of x; ties go to the lower entry."""
        entry, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for at in range(0, len(x), CHUNK):
            entry[at : at + CHUNK], distance[at : at + CHUNK] = self._nearest(x[at : at + CHUNK])
        return entry, distance

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, none = len(x), np.iinfo(np.int64).max
        entry, distance = np.zeros(n, np.int64), np.full(n, none)
        todo, radius, seen = np.arange(n), np.full(n, self.radius), np.zeros((n, self.prefix.shape[2]), np.uint64)
        while len(todo):
            masks = self.within(x[todo], radius[todo])
            fresh = masks & ~seen[todo]  # a wider box holds the one before
            seen[todo] = masks
            row, of = np.nonzero(np.unpackbits(fresh.astype("<u8").view(np.uint8), axis=1, bitorder="little"))
            if len(row):
                far = x[todo[row]] - self.book[of]
                d = np.einsum("ij,ij->i", far, far)
                starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                best = np.minimum.reduceat(d, starts)
                first = np.flatnonzero(d == np.repeat(best, np.diff(np.r_[starts, len(row)])))
                first = first[np.r_[True, row[first][1:] != row[first][:-1]]]
                at, new = todo[row[first]], of[first]
                better = (best < distance[at]) | (best == distance[at]) & (new < entry[at])
                entry[at[better]], distance[at[better]] = new[better], best[better]
            # an entry at distance b differs by sqrt(b) at most in any dimension: with a radius as large, the best is proven
            found = distance[todo] < none
            bound = np.where(found, np.sqrt(np.where(found, distance[todo], 0)).astype(np.int64) + 1, radius[todo] * 2)
            open_ = ~found | (bound > radius[todo])
            radius[todo] = bound
            todo = todo[open_]
        return entry, distance


@dataclass
class Books:
    """PARTS codebooks, each (entries x dimensions)."""

    parts: list[np.ndarray]

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for book in self.parts for v in book.ravel().tolist()).encode()).hexdigest()

    def cut(self, x: np.ndarray) -> list[np.ndarray]:
        dims = self.parts[0].shape[1]
        return [x[:, p * dims : (p + 1) * dims] for p in range(PARTS)]


def usable(vector: Column) -> Column:
    """Whether a vector is there, isn't empty, and holds neither nulls nor numbers that aren't finite."""
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def kept(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, v, label) of the usable vectors; other columns, whatever their names, are left out."""
    v = vectors[vector_col].cast("array<double>")
    return vectors.select(vectors[id_col].cast("long").alias("vec_id"), v.alias("v"), vectors[label_col].alias("label")).filter(usable(F.col("v")))


def _whole(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of an Arrow column as rows of whole numbers."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) * SCALE)
    if (np.abs(x) >= LIMIT).any():
        raise ValueError(f"vectors hold components of {LIMIT // SCALE} or more, for which distances aren't exact")
    return x.astype(np.int64)


def _books(flat: list[np.ndarray]) -> Books:
    rows = np.array(flat)
    dims = rows.shape[1] // PARTS
    return Books([rows[:, p * dims : (p + 1) * dims] for p in range(PARTS)])


def fit(vectors: DataFrame) -> Books | None:
    """Codebooks of kept() vectors; None if there are none.

    They start as the parts of the ENTRIES least ids (nulls last; of equal ids, the vector that sorts first), or of all if
    there are fewer; ROUNDS times each vector part goes to its nearest entry, and an entry becomes the floor of its parts'
    mean; an entry without parts stays. Vectors as long as the first are used; their length is a multiple of PARTS.
    """
    first = [r.v for r in vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(ENTRIES).collect()]
    if not first:
        return None
    dims = len(first[0])
    if dims % PARTS:
        raise ValueError(f"vectors of {dims} components can't be cut into {PARTS} equal parts")
    books = _books([_whole(pa.array([v]), dims)[0] for v in first if len(v) == dims])
    same = vectors.filter(F.size("v") == dims).select("v")
    for _ in range(ROUNDS):
        books = _moved(same, books)
    return books


def _moved(vectors: DataFrame, books: Books) -> Books:
    """The codebooks after one round. A slot is an entry's dimension, or, behind its dimensions, its number of parts."""
    dims = books.parts[0].shape[1]

    def run(batches):
        slices, sums = [Slices(b) for b in books.parts], np.zeros((PARTS, ENTRIES, dims + 1), np.int64)
        for batch in batches:
            for p, x in enumerate(books.cut(_whole(batch.column(0), dims * PARTS))):
                entry, _ = slices[p].nearest(x)
                for d in range(dims):
                    sums[p, :, d] += np.bincount(entry, x[:, d], ENTRIES).astype(np.int64)
                sums[p, :, dims] += np.bincount(entry, minlength=ENTRIES)
        flat = sums.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(flat[at], pa.int64())], ["slot", "n"])

    rows = vectors.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(PARTS * ENTRIES * (dims + 1), np.int64)
    for r in rows:
        flat[r.slot] = r.n
    out = []
    for book, sums in zip(books.parts, flat.reshape(PARTS, ENTRIES, dims + 1), strict=True):
        n, sums = sums[: len(book), dims:], sums[: len(book), :dims]
        out.append(np.where(n > 0, sums // np.maximum(n, 1), book))
    return Books(out)


def encode(vectors: DataFrame, books: Books) -> DataFrame:
    """(vec_id, label, code, error) of kept() vectors as long as the codebooks': two hex digits a part, and the squared distances summed over parts. One row in, one row out, no shuffle."""
    dims = books.parts[0].shape[1] * PARTS

    def run(batches):
        slices = [Slices(b) for b in books.parts]
        for batch in batches:
            found = [s.nearest(x) for s, x in zip(slices, books.cut(_whole(batch.column(2), dims)), strict=True)]
            codes = np.stack([f[0] for f in found], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(sum(f[1] for f in found), pa.int64())], ["vec_id", "label", "code", "error"])

    label = vectors.schema["label"].dataType.simpleString()
    return vectors.filter(F.size("v") == dims).select("vec_id", "label", "v").mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def decode(codes: DataFrame, books: Books) -> DataFrame:
    """codes with a column v: the vectors that their entries say, each half a step above its floor."""
    parts, names = books.parts, codes.columns

    def run(batches):
        for batch in batches:
            given = batch.column(names.index("code"))
            at = np.frombuffer(bytes.fromhex("".join(given.to_pylist())), np.uint8).reshape(-1, PARTS)
            v = (np.concatenate([b[at[:, p]] for p, b in enumerate(parts)], 1) + 0.5) / SCALE
            offsets = pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(v.ravel()))], [*names, "v"])

    return codes.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.schema) + ", v array<double>")


RESULT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def compressed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error (error summed over equal labels, nulls together) and codebooks_sha256 of every usable vector.

    Null vectors, and those with nulls or numbers that aren't finite, are left out, as are those of another length than that of
    the least id. Repeated rows give repeated rows. An empty table gives no rows. Other columns are left out, whatever their names.
    """
    spark, rows = vectors.sparkSession, kept(vectors, id_col, vector_col, label_col)
    books = fit(rows)
    if not books:
        return spark.createDataFrame([], RESULT)
    coded = written(encode(rows, books), "codes")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, coded["label"].eqNullSafe(by_label["of"])).select("vec_id", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))


def _sql() -> str:
    """The same in SQL: a CTE for each round's nearest entries and moved codebooks."""
    out = [
        f"""k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""x AS (SELECT rid, vec_id, label, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS v
  FROM (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS rid FROM k), range({PARTS}) r(part))""",
        f"b0 AS (SELECT part, rid AS entry, v FROM x WHERE rid < {ENTRIES})",
    ]
    for r in range(ROUNDS + 1):
        out.append(f"""d{r} AS (SELECT rid, x.part, b.entry, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN b{r} b USING (part))""")
        out.append(f"a{r} AS MATERIALIZED (SELECT rid, part, min(d) AS d, arg_min(entry, d * {ENTRIES} + entry) AS entry FROM d{r} GROUP BY rid, part)")
        if r < ROUNDS:
            out.append(f"""m{r} AS (SELECT part, entry, list(floor(total / n)::BIGINT ORDER BY pos) AS v FROM
  (SELECT part, entry, pos, sum(c) AS total, count(*) AS n FROM (SELECT x.part, a.entry, unnest(x.v) AS c, unnest(range(len(x.v))) AS pos FROM x JOIN a{r} a USING (rid, part)) GROUP BY ALL) GROUP BY ALL)""")
            out.append(f"b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m USING (part, entry))")
    return f"""WITH {", ".join(out)},
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS}),
c AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY rid)
SELECT x.vec_id, code, error, (sum(error) OVER (PARTITION BY x.label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN x ON c.rid = x.rid AND x.part = 0, h"""


CODES_SQL = _sql()
