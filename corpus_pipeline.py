"""The corpus pipeline: quality rules, near-duplicates, decontamination, personal data, byte-level BPE.

Each stage takes (spark, docs, sf_dir), docs being what the stage before kept, and all but the last return the columns of
documents. The driver writes each result as Parquet and reads it again for the next stage; run() does the same in the
shared folder, so that a lost executor costs a stage's tasks, not the run.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, dartminhash, decontaminate, pii, quality
from lectern.llm.common import fresh_path, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
RANKS = "byte_bpe_multi_50k.tiktoken"


def _kept(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the ids in gone (doc_id, distinct): ids alone are compared, so a small gone is broadcast by Spark itself."""
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the production policy rejects go. One pass over the texts: the ledger is computed beside each row.

    A null text counts as empty, so it goes; rows with a null id, and repeated rows, stay or go like others. Empty tables give no rows.
    """
    return quality.kept(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, that of the least id; of repeated rows of it, too, only one, that of the least text.

    Similarity weighs shingles by their counts. A null text is the empty one; rows with a null id stay, as nothing names them.
    """
    classes = dartminhash.near_duplicates(docs, weighted=True)
    gone = classes.filter("doc_id <> class").select("doc_id").distinct()
    return dartminhash.one_each(_kept(docs, gone))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. A null text holds none; a row with a null id stays, as nothing names it; an empty benchmark lets all stay."""
    hits = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark"))
    return _kept(docs, hits.select("doc_id").distinct())


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span becomes its kind in brackets; n_chars follows. No document goes; a null text stays null, and so becomes its n_chars."""
    text = pii.redacted(pii.train(docs), spark)
    return docs.withColumn("text", text("text")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their number, and the digest of the bytes they decode to. A null text has no ids; null ids and repeated rows stay."""
    rows = bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("byte BPE", byte_bpe),
]

#: SQL can't express the stages from near-duplicates on; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = fresh_path(spark, f"stage-{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
