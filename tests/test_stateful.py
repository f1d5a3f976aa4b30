"""Sweeps and retries on a stream: batches in any order, late rows, a restart from the checkpoint; against tables and by hand."""

import random
from datetime import datetime, timedelta

import pytest

from lectern.streaming import stateful

T0 = datetime(2026, 1, 1)


def at(minutes, s=0):
    return T0 + timedelta(minutes=minutes, seconds=s)


@pytest.fixture
def stream(spark, tmp_path):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.PROVIDER)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    n = iter(range(10**6))

    class Stream:
        src, check, out = str(tmp_path / "in"), str(tmp_path / "check"), str(tmp_path / "out")

        def put(self, key, rows):
            spark.createDataFrame([(next(n), *r) for r in rows], f"n long, {key} long, ts timestamp, what string").coalesce(1).write.mode("append").parquet(self.src)

        def run(self, key, of):
            """Takes what has come, from where the last run stopped, and ends: a restart each time."""
            s = spark.readStream.schema(f"n long, {key} long, ts timestamp, what string").option("maxFilesPerTrigger", 1).parquet(self.src)
            q = of(s).writeStream.format("parquet").option("checkpointLocation", self.check).option("path", self.out).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()
            return sorted(map(tuple, spark.read.parquet(self.out).collect()))

    yield Stream()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if old is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def test_jobs_that_hang_are_failed(spark, stream):
    stream.put("job", [(1, at(0), "processing"), (2, at(1), "processing"), (3, at(2), "processing"), (9, at(5), "tick")])
    stream.run("job", stateful.sweep)
    stream.put("job", [(2, at(20), "done"), (3, at(32), "done"), (9, at(36), "tick")])  # 3 is done just at its limit
    stream.run("job", stateful.sweep)
    # 1 hangs since 0; the watermark is 36 - 10 = 26, so nothing has failed yet
    stream.put("job", [(4, at(30), "processing"), (9, at(60), "tick")])
    stream.run("job", stateful.sweep)
    stream.put("job", [(1, at(10), "done"), (2, at(61), "processing"), (9, at(100), "tick")])  # 1's event is behind the watermark of 50: dropped
    stream.run("job", stateful.sweep)
    stream.put("job", [(9, at(200), "tick")])
    stream.run("job", stateful.sweep)
    stream.put("job", [(9, at(201), "tick")])
    got = stream.run("job", stateful.sweep)
    assert got == [(1, at(0), at(30)), (2, at(61), at(91)), (4, at(30), at(60))]


def test_a_stream_equals_its_table(spark, stream):
    rng = random.Random(3)
    rows = [(rng.randrange(12), at(rng.randrange(600), rng.randrange(60)), rng.choice(["processing", "processing", "done", "failed"])) for _ in range(150)]
    rows.sort(key=lambda r: r[1])
    for k in range(0, 150, 25):
        part = rows[k : k + 25]
        rng.shuffle(part)
        stream.put("job", part)
        if k % 50:
            stream.run("job", stateful.sweep)
    stream.put("job", [(99, at(5000), "tick")])
    stream.run("job", stateful.sweep)
    stream.put("job", [(99, at(5001), "tick")])
    got = stream.run("job", stateful.sweep)
    table = spark.createDataFrame(rows, "job long, ts timestamp, what string")
    want = sorted(map(tuple, stateful.swept(table, now=at(4990)).collect()))
    assert got == want and len(want) > 10


def test_failures_wait_longer_each_time_and_end_as_dead_letters(spark, stream):
    stream.put("id", [(1, at(0), "queued"), (2, at(0), "queued"), (3, at(0), "queued"), (9, at(1), "tick")])
    stream.run("id", stateful.retries)
    stream.put("id", [(1, at(1), "failed"), (2, at(1), "ok"), (3, at(1), "failed"), (3, at(2), "failed"), (3, at(4), "failed"), (9, at(30), "tick")])
    stream.run("id", stateful.retries)
    stream.put("id", [(3, at(40), "failed"), (3, at(60), "failed"), (1, at(25), "ok"), (9, at(90), "tick")])
    stream.run("id", stateful.retries)
    stream.put("id", [(9, at(200), "tick")])
    stream.run("id", stateful.retries)
    stream.put("id", [(9, at(201), "tick")])
    got = [r for r in stream.run("id", stateful.retries) if r[0] != 9]
    assert got == sorted([
        (1, "attempt", 1, at(0)), (1, "attempt", 2, at(1, 30)), (1, "delivered", 2, at(25)), (2, "attempt", 1, at(0)), (2, "delivered", 1, at(1)),
        (3, "attempt", 1, at(0)), (3, "attempt", 2, at(1, 30)), (3, "attempt", 3, at(3)), (3, "attempt", 4, at(6)), (3, "attempt", 5, at(44)), (3, "dead_letter", 5, at(60)),
    ])


def test_backoff():
    assert [stateful.backoff_ms(k) // 1000 for k in (1, 2, 3, 7, 8, 20)] == [30, 60, 120, 1920, 3600, 3600]
