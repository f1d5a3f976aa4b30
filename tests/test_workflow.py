"""Incremental work on tables by hand, and the streaming forms against their batch twins."""

import datetime

from pyspark.sql import functions as F

from lectern.operators import workflow
from lectern.streaming import events

NOW = datetime.datetime(2024, 1, 2)


def at(**kw):
    return NOW - datetime.timedelta(**kw)


def test_stale_jobs(spark):
    d = spark.createDataFrame([(1, "processing", at(minutes=31), NOW), (2, "processing", at(minutes=29), NOW), (3, "done", at(days=9), NOW)], "id int, status string, ts timestamp, now timestamp")
    assert {r.id: (r.status, r.stale) for r in workflow.stale(d, 30).collect()} == {1: ("failed", True), 2: ("processing", False), 3: ("done", False)}


def test_outbox(spark):
    rows = [(1, "pending", 0, at(hours=1), NOW, True), (2, "pending", 1, at(hours=1), NOW, False), (3, "pending", 4, at(hours=1), NOW, False), (4, "pending", 0, at(hours=-1), NOW, True), (5, "delivered", 2, at(hours=1), NOW, False)]
    d = spark.createDataFrame(rows, "id int, status string, attempts long, due timestamp, now timestamp, ok boolean")
    got = {r.id: (r.status, r.attempts, r.due - NOW) for r in workflow.delivered(d).collect()}
    h = datetime.timedelta(hours=1)
    assert got == {1: ("delivered", 1, -h), 2: ("pending", 2, datetime.timedelta(seconds=60)), 3: ("dead_letter", 5, -h), 4: ("pending", 0, h), 5: ("delivered", 2, -h)}
    again = workflow.delivered(workflow.delivered(d).withColumn("now", F.lit(NOW)).withColumn("ok", F.lit(False)))
    assert {r.id: r.status for r in again.collect()} == {k: v[0] for k, v in got.items()}


def test_suggestions(spark):
    d = spark.createDataFrame([(1, "pending", at(days=30), NOW), (2, "pending", at(days=25), NOW), (3, "pending", at(days=15), NOW), (4, "approved", at(days=99), NOW)], "id int, status string, ts timestamp, now timestamp")
    assert {r.id: (r.status, r.stale) for r in workflow.suggestions_aged(d, most=1).collect()} == {1: ("rejected", True), 2: ("pending", True), 3: ("pending", True), 4: ("approved", False)}
    assert {r.stale for r in workflow.suggestions_aged(d, stale_days=0).collect()} == {False}


def test_votes_and_weights(spark):
    v = spark.createDataFrame([(1, 1, 1, at(hours=3), 1), (1, 1, 1, at(hours=2), 2), (1, 1, -1, at(hours=1), 3), (1, 2, 5, NOW, 4), (2, 1, 1, NOW, 5)], "answer int, user int, vote int, ts timestamp, id int")
    assert sorted(r.id for r in workflow.accepted_votes(v).collect()) == [1, 3, 5]
    w = spark.createDataFrame([(1.0, 3), (3.0, 10), (3.0, 40), (0.1, 0)], "w double, d int")
    assert [round(r[0], 3) for r in w.select(workflow.rebalanced(F.col("w"), F.col("d"))).collect()] == [1.0, 2.0, 1.0, 0.1]
    assert [round(r[0], 3) for r in w.select(workflow.weight_delta(F.lit(1), F.col("w"))).collect()] == [1.0, 3.4, 3.4, 0.1]
    assert [r[0] for r in spark.range(1, 10).select(workflow.backoff(F.col("id"))).collect()][-1] == 3600.0


def test_streams_equal_their_batch_twins(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for k in range(3):
        e.filter(F.col("event_id") % 3 == k).union(e.filter(F.col("event_id") == k)).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
    source = spark.readStream.schema(e.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    once = source.withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(["event_id"])

    def run(stream, name, mode):
        q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(map(str, spark.table(name).collect()))

    assert run(once.select("event_id"), "once", "append") == sorted(map(str, e.select("event_id").collect()))
    assert run(events.sliding(source.withWatermark("ts", "60 days").dropDuplicates(["event_id"])), "slide", "complete") == sorted(map(str, events.sliding(e).collect()))
    assert run(events.hourly(source.dropDuplicates(["event_id"])), "hour", "complete") == sorted(map(str, events.hourly(e).collect()))
