"""The column builders, by cases."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from lectern.functions import columns as C
from lectern.operators.documents import chunks, rrf


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "locale", "want"),
    [("1.234", "es", 1234.0), ("1.234,56", "es", 1234.56), ("12,5", "es", 12.5), ("1,234", "es", 1234.0), ("1,234.56", "en", 1234.56), ("1,234", "en", 1234.0), ("", "es", None), ("abc", "es", None), (None, "es", None)],
)
def test_amount(spark, raw, locale, want):
    assert one(spark, lambda c: C.amount(c, locale), raw) == want


@pytest.mark.parametrize(("raw", "want"), [("05/06/2026", date(2026, 6, 5)), ("5-6-69", date(2069, 6, 5)), ("15 de junio de 2026", date(2026, 6, 15)), ("31/02/2024", None), ("hoy", None), (None, None)])
def test_date(spark, raw, want):
    assert one(spark, C.date_es, raw) == want


@pytest.mark.parametrize(("raw", "want"), [("12345678Z", True), ("12345678A", False), ("1234567Z", False), (None, False)])
def test_nif(spark, raw, want):
    assert one(spark, C.nif_valid, raw) is want


@pytest.mark.parametrize(("raw", "want"), [("A58818501", True), ("A58818502", False), ("Z58818501", False), (None, False)])
def test_cif(spark, raw, want):
    assert one(spark, C.cif_valid, raw) is want


def test_ngrams_and_jaccard(spark):
    assert one(spark, C.ngrams, "ab") == ["ab"]
    assert one(spark, C.ngrams, "") == []
    assert one(spark, lambda c: C.jaccard(C.ngrams(c), C.ngrams(F.lit("abcd"))), "abce") == pytest.approx(1 / 3)


def test_rrf_counts_ranks(spark):
    a = spark.createDataFrame([(1, 2.0), (2, 1.0)], "doc long, score double")
    b = spark.createDataFrame([(2, 5.0)], "doc long, score double")
    got = [(r.doc, r.score) for r in rrf([a, b], "doc", 5).collect()]
    assert got == [(2, round(1 / 62 + 1 / 61, 6)), (1, round(1 / 61, 6))]


def test_chunks():
    assert chunks("") == []
    words = " ".join(f"w{i}." for i in range(500))
    parts = chunks(words)
    assert all(len(p.split()) <= 220 for p in parts)
    assert parts[1].split()[:40] == parts[0].split()[-40:]
    assert chunks("x " * 500)[0].split() == ["x"] * 220


def test_stream_and_batch_agree(spark, tmp_path):
    from lectern.streaming import events

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.union(e.limit(20)).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = events.hourly(events.read_stream(spark, str(tmp_path / "in"), "40 days")).writeStream.format("memory").queryName("hours").outputMode("update").option("checkpointLocation", str(tmp_path / "cp"))
    run = q.trigger(availableNow=True).start()
    run.awaitTermination()
    best = spark.table("hours").groupBy("start", "event_type").agg(F.max("n").alias("n"))
    want = events.hourly(e)
    assert best.exceptAll(want.select(best.columns)).count() == 0 and best.count() == want.count()
