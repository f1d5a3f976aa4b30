"""Digest cache of token counts: only texts that no earlier run has counted with this tokenizer are encoded.

A count is stored under the digest of the normalised content (a null text is the empty one; nothing else may change, as it
would change counts) and the digest of the tokenizer's file. A run finds the digests that the cache lacks, encodes one
document of each, appends the counts, and joins every document to its count by digest.
"""

import hashlib
from functools import cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import cut, fresh_path, texts

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"

#: So many missing ids (about 16 bytes each) are sent to every executor at most; beyond, the join shuffles.
BROADCAST_IDS = 1_000_000
#: A text is hot if its copies are more than one in so many rows.
HOT = 2_000


@cache
def _tokenizer(path: str):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda batch: [len(x) for x in model.encode(batch, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    encode = getattr(t, "encode_batch_fast", t.encode_batch)
    return lambda batch: [len(x.ids) for x in encode(batch, add_special_tokens=False)]


def tokenizer_digest(path: str) -> str:
    """SHA-256 of the tokenizer's file: another version is another key."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def counter(path: str, batch_chars: int = 400_000):
    """For mapInPandas over (digest, text): (digest, n_tokens), in batches of about batch_chars characters."""

    def run(frames):
        count = _tokenizer(path)
        for f in frames:
            out, batch, chars = [], [], 0
            for t in f["text"]:
                batch.append(t)
                chars += len(t)
                if chars > batch_chars:
                    out += count(batch)
                    batch, chars = [], 0
            yield pd.DataFrame({"digest": f["digest"], "n_tokens": out + count(batch) if batch else out})

    return run


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache table; a path that doesn't exist yet is an empty cache."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def token_counts(docs: DataFrame, tokenizer: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, n_bytes, n_tokens, cached for each row; the counts that were missing are appended to cache_path.

    Documents are read for digests (no text is shuffled), then again for the misses. Rows with a null id are counted too;
    a row stands for its digest by its id (0 for null), so among rows of one digest that with the least id is encoded. Appending is one Parquet commit; a run that fails before it leaves the cache as it was, and one repeated after it
    finds the counts. Two runs at once may append the same count twice; the reader takes one a digest.

    Counts of texts that make up more than 1 in HOT of all rows, of which there are fewer than HOT, are broadcast, and their rows
    are dealt by id instead of by digest, so no text's copies meet in one task. An empty table gives no rows. Other columns are
    left out, whatever their names.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer)
    d = texts(docs, id_col, text_col).withColumn("digest", F.unhex(F.sha2("text", 256))).withColumn("row", F.coalesce("doc_id", F.lit(0).cast("long")))
    known = open_cache(spark, cache_path).filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    each = cut(d.groupBy("digest").agg(F.min("row").alias("rep"), F.count("*").alias("n")))
    n_rows = each.agg(F.sum("n")).first()[0] or 0
    missing = cut(each.join(known, "digest", "left_anti").select("digest", "rep"))
    n_missing = missing.count()
    if n_missing:
        keys = missing.select("rep")
        picked = d.join(F.broadcast(keys) if n_missing <= BROADCAST_IDS else keys, d["row"] == keys["rep"], "left_semi")
        counted = picked.select("digest", "text").mapInPandas(counter(tokenizer), "digest binary, n_tokens long")
        counted.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    counts = open_cache(spark, cache_path).filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    fresh = missing.select("digest", F.lit(False).alias("cached"))
    counts = each.select("digest", "n").join(counts, "digest").join(fresh, "digest", "left")
    counts = cut(counts.select("digest", "n_tokens", F.coalesce("cached", F.lit(True)).alias("cached"), (F.col("n") * HOT > n_rows).alias("hot")))
    hot = counts.filter("hot").select(F.col("digest").alias("d"), F.col("n_tokens").alias("hot_tokens"), F.col("cached").alias("hot_cached"))
    rest = counts.filter("NOT hot").select(F.col("digest").alias("k"), "n_tokens", "cached")
    rows = d.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")).join(F.broadcast(hot), F.col("digest") == F.col("d"), "left")
    # a key of eight bytes meets no digest, which has 32
    rows = rows.withColumn("by", F.when(F.col("d").isNull(), F.col("digest")).otherwise(F.unhex(F.lpad(F.hex(F.xxhash64("doc_id", F.monotonically_increasing_id())), 16, "0"))))
    rows = rows.join(rest, F.col("by") == F.col("k"), "left")
    return rows.select("doc_id", "digest", "n_bytes", F.coalesce("n_tokens", "hot_tokens").alias("n_tokens"), F.coalesce("cached", "hot_cached").alias("cached"))


def cold_cache(spark: SparkSession) -> str:
    """A new, empty cache in the shared folder."""
    return fresh_path(spark, "token-counts")
