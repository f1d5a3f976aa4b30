"""A cache of answers by meaning: exact questions first, then the nearest question above a threshold, within one isolation key."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.registry import Registry
from lectern.operators.retrieval import embedded
from lectern.sources.stored import written
from lectern.sources.tables import table

query = Registry()

#: Fixed value: the cosine from which a question counts as another's.
ALIKE = 0.92
#: Signs of random products: a pair at ALIKE agrees in one of 12 with probability 0.87, in a band of 12 with 0.19, in one of 28 bands with 0.997.
BANDS, BITS, SEED = 28, 12, 11


def _bands(rows: DataFrame) -> DataFrame:
    """(id, isolation, bucket): a row for each band of a vector's signs; vectors (id, isolation, v) of any one length meet those of theirs alone."""

    def run(batches):
        planes: dict = {}
        for b in batches:
            ids, isolation, v = b.column(0), b.column(1), b.column(2)
            sizes = np.diff(v.offsets.to_numpy())
            flat = v.flatten().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                starts = v.offsets.to_numpy()[at] - v.offsets.to_numpy()[0]
                x = flat[(starts[:, None] + np.arange(size)[None])] if size else np.zeros((len(at), 0))
                p = planes.setdefault(int(size), np.random.default_rng((SEED, int(size))).normal(size=(int(size), BANDS * BITS)))
                signs = (x @ p > 0).reshape(len(at), BANDS, BITS)
                bucket = (signs @ (1 << np.arange(BITS))) + (np.arange(BANDS)[None] << BITS) + (int(size) << 32)
                take = pa.array(np.repeat(at, BANDS))
                for k in range(0, len(take), 50_000):
                    t = take[k : k + 50_000]
                    yield pa.RecordBatch.from_arrays([ids.take(t), isolation.take(t), pa.array(bucket.ravel()[k : k + 50_000], pa.int64())], ["id", "isolation", "bucket"])

    return rows.mapInArrow(run, "id long, isolation string, bucket long")


def _cosine(a: str, b: str):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def answers(asked: DataFrame, cache: DataFrame, least: float = ALIKE) -> DataFrame:
    """(id, key, how, score) of asked (id, isolation, question, v) against cache (id, isolation, question, v): "exact" where an entry of the same isolation key has the same
    question, spaces and capitals aside; else "meaning", the entry of the greatest cosine, if that is least or more. Ties go to the least entry. Who finds nothing has no row.

    Candidates are entries that share a band of signs; their cosine is exact. Entries of equal vectors meet as one, and what matched exactly doesn't look further. A null isolation
    key is one; null or zero vectors have no meaning. A null question is no question.
    """
    plain = lambda d: d.select(F.col("id").cast("long").alias("id"), F.coalesce(F.concat(F.lit("="), F.col("isolation").cast("string")), F.lit("")).alias("isolation"), F.trim(F.regexp_replace(F.lower("question"), r"\s+", " ")).alias("question"), F.col("v").cast("array<double>").alias("v"))
    a, c = written(plain(asked), "asked"), written(plain(cache), "cache")
    digest = F.sha2("question", 256)
    first = c.filter("question IS NOT NULL").groupBy("isolation", digest.alias("h")).agg(F.min("id").alias("key"))
    exact = written(a.select("id", "isolation", digest.alias("h")).join(first, ["isolation", "h"]).groupBy("id").agg(F.min("key").alias("key")), "exact")
    fine = (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)) & F.exists("v", lambda x: x != 0)
    entries = written(c.filter(fine).groupBy("isolation", "v").agg(F.min("id").alias("id")), "entries")
    left = written(a.filter(fine).join(exact, "id", "left_anti").select("isolation", "v", "id"), "left")
    near = _bands(left.select("id", "isolation", "v")).alias("x").join(_bands(entries.select("id", "isolation", "v")).withColumnRenamed("id", "key").alias("y"), ["isolation", "bucket"])
    pairs = near.select("id", "key").distinct()
    scored = pairs.join(left.select("id", F.col("v").alias("p")), "id").join(entries.select(F.col("id").alias("key"), F.col("v").alias("q")), "key")
    scored = scored.select("id", "key", F.round(_cosine("p", "q"), 6).alias("score")).filter(F.col("score") >= least)
    best = scored.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("less"), F.col("key"))).alias("best"))
    found = best.select("id", F.col("best.key").alias("key"), F.lit("meaning").alias("how"), (-F.col("best.less")).alias("score"))
    return exact.select("id", "key", F.lit("exact").alias("how"), F.lit(1.0).alias("score")).unionByName(found)


@query()
def answer_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of pages with odd ids as questions (every second in another form), those of even ones as what was asked before; the language that a page names isolates."""
    p = table(spark, sf_dir, "pages").dropDuplicates(["page_id"])
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    p = p.select(F.col("page_id").alias("id"), F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("isolation"), F.when(F.col("page_id") % 4 == 1, F.concat(F.lit("¿"), F.upper(title), F.lit("?"))).otherwise(title).alias("question")).filter("question <> ''")
    v = embedded(p, "id", "question").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    p = written(p.join(v, "id"), "questions")
    return answers(p.filter("id % 2 = 1"), p.filter("id % 2 = 0"))
