"""The registered queries of the operators, and their SQL."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, chat, ctw, dartminhash, decontaminate, licence, mixing, pii, quality, sourceaudit, tokencount, vectorcodes, warc
from lectern.llm.common import read

COUNT_LIMIT = 1024


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(read(spark, sf_dir, "documents"))
    return rows.withColumn("base_failed", ~quality.passes("base/1")).withColumn("kept", quality.passes(quality.PRODUCTION))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ablation(quality.ledger(read(spark, sf_dir, "documents")))


def op2_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return pii.digests(pii.find(docs, pii.train(docs)))


def op3_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.near_duplicates(read(spark, sf_dir, "documents"), weighted=True).withColumnRenamed("class", "class_id")


def op4_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(read(spark, sf_dir, "documents"))


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return licence.scan(docs, licence.train(docs)).filter("confirmed").select("doc_id", "line_no", "family", F.round("probability", 3).alias("probability"), F.round("similarity", 3).alias("similarity"), "start", "stop")


def op6_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(read(spark, sf_dir, "conversations"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(bpe.encode(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokencount.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), tokencount.cold_cache(spark))
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > COUNT_LIMIT).alias("over_limit"), "cached")


def op9_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compressed(read(spark, sf_dir, "embeddings"))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sourceaudit.audit(read(spark, sf_dir, "documents"))


def op13_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, quality_ablation, op2_skip_chain_pii, op3_dart_minhash, op4_context_tree, op5_licence_scan, op6_chat_rotation, op7_byte_bpe, op8_token_counts, op9_warc_salvage, op10_decontamination, op11_vector_codes, op12_source_audit, op13_entropy_mix)}

WARC_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS h FROM pages),
l AS (SELECT h, max(page_id) AS last, count(*) AS n FROM p GROUP BY h),
b AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, last, page_id = last AS own,
  (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h, 10 * g + 1, 10))::BIGINT >> (35 - 5 * k) & 31)::INT + 1, 1), '' ORDER BY g, k)
   FROM range(4) a(g), range(8) c(k)) AS payload_digest FROM p JOIN l USING (h))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN own THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN NOT own THEN last END AS refers_to FROM b
"""
ORACLES = {"op1_quality_rules": quality.LEDGER_SQL, "quality_ablation": quality.ABLATION_SQL, "op6_chat_rotation": chat.ROTATE_SQL, "op9_warc_salvage": WARC_SQL, "op11_vector_codes": vectorcodes.CODES_SQL, "op12_source_audit": sourceaudit.AUDIT_SQL}
