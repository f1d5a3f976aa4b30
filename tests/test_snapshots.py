"""Merges by key: run twice, killed half way, against another writer, and from a stream that is restarted."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from lectern.sources import snapshots
from lectern.sources.snapshots import Conflict, Snapshots
from lectern.sources.stored import fresh_path

SCHEMA = "k long, part string, v string"


def rows(spark, *of):
    return spark.createDataFrame(list(of), SCHEMA)


def state(table, number=None):
    return sorted(map(tuple, table.read(number).collect()), key=str)


def test_a_batch_counts_once(spark):
    t = Snapshots(spark, fresh_path(spark, "t"), ["k", "part"], 4)
    assert t.read() is None and t.versions() == []
    one = t.merge(rows(spark, (1, "a", "x"), (2, None, None), (3, "c", "z")), "b1")
    assert (one.added, one.changed) == (3, 0)
    assert t.merge(rows(spark, (9, "never", "seen")), "b1").number == 1 and len(state(t)) == 3
    two = t.merge(rows(spark, (1, "a", "y"), (2, None, None), (4, "d", "w")), "b2")
    assert (two.added, two.changed) == (1, 1)
    assert state(t) == sorted([(1, "a", "y"), (2, None, None), (3, "c", "z"), (4, "d", "w")], key=str)
    assert state(t, 1) == sorted([(1, "a", "x"), (2, None, None), (3, "c", "z")], key=str)
    same = t.merge(rows(spark, (1, "a", "y"), (4, "d", "w")), "b3")
    assert (same.added, same.changed) == (0, 0) and same.folders == two.folders
    empty = t.merge(spark.createDataFrame([], SCHEMA), "b4")
    assert empty.folders == two.folders and len(state(t)) == 4


def test_only_touched_buckets_are_rewritten(spark):
    t = Snapshots(spark, fresh_path(spark, "t"), ["k"], 8)
    t.merge(rows(spark, *[(k, "p", "v") for k in range(64)]), "b1")
    before = t.versions()[-1].folders
    t.merge(rows(spark, (5, "p", "w")), "b2")
    after = t.versions()[-1].folders
    assert sum(before[b] != after[b] for b in before) == 1 and len(state(t)) == 64


def test_of_one_key_the_first_by_order_wins(spark):
    t = Snapshots(spark, fresh_path(spark, "t"), ["k"])
    t.merge(rows(spark, (1, "1", "old"), (1, "3", "new"), (1, "2", "mid")), "b1", order=[F.desc("part")])
    assert state(t) == [(1, "3", "new")]


def test_killed_before_its_version_it_leaves_nothing(spark, monkeypatch):
    t = Snapshots(spark, fresh_path(spark, "t"), ["k"])
    t.merge(rows(spark, (1, "a", "x")), "b1")
    monkeypatch.setattr(snapshots.Ledger, "create", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        t.merge(rows(spark, (1, "a", "y"), (2, "b", "z")), "b2")
    monkeypatch.undo()
    assert state(t) == [(1, "a", "x")] and len(t.versions()) == 1
    assert len(glob.glob(f"{t.path.removeprefix('file:')}/data/of=*")) == 2  # the orphan is there, and isn't read
    done = t.merge(rows(spark, (1, "a", "y"), (2, "b", "z")), "b2")
    assert (done.number, done.added, done.changed) == (2, 1, 1) and len(state(t)) == 2


def test_of_two_writers_one_begins_anew(spark, monkeypatch):
    path = fresh_path(spark, "t")
    a, b = Snapshots(spark, path, ["k"]), Snapshots(spark, path, ["k"])
    seen = b.versions()
    monkeypatch.setattr(b, "versions", lambda: seen)
    a.merge(rows(spark, (1, "a", "x")), "a1")
    with pytest.raises(Conflict):
        b.merge(rows(spark, (2, "b", "y")), "b1")
    monkeypatch.undo()
    b.again(rows(spark, (2, "b", "y")), "b1")
    assert len(state(a)) == 2 and [v.batch for v in a.versions()] == ["a1", "b1"]


def test_counts_are_combined(spark):
    t = Snapshots(spark, fresh_path(spark, "t"), ["k"])
    count = lambda both: both.groupBy("k").agg(F.min("part").alias("part"), F.sum(F.col("v").cast("long")).cast("string").alias("v"))
    t.merge(rows(spark, (1, "a", "2"), (1, "b", "3"), (2, "a", "1")), "b1", keep=count)
    t.merge(rows(spark, (1, "c", "10")), "b2", keep=count)
    t.merge(rows(spark, (1, "c", "10")), "b2", keep=count)
    assert state(t) == [(1, "a", "15"), (2, "a", "1")]


def test_a_restarted_stream_changes_nothing(spark, tmp_path):
    src, check = str(tmp_path / "in"), str(tmp_path / "check")
    t = Snapshots(spark, fresh_path(spark, "t"), ["k"], 4)
    put = lambda *of: rows(spark, *of).coalesce(1).write.mode("append").parquet(src)

    def run(sink):
        q = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src).writeStream.foreachBatch(sink).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()

    put((1, "a", "x"), (2, "b", "y"))
    run(t.sink("events"))
    merged, failed = t.sink("events"), []

    def dies_after_merging(df, n):
        merged(df, n)
        failed.append(n)
        raise RuntimeError("killed after the merge, before the stream's own commit")

    put((2, "b", "z"), (3, "c", "w"))
    with pytest.raises(Exception, match="killed"):
        run(dies_after_merging)
    assert len(t.versions()) == 2
    run(t.sink("events"))
    assert failed and len(t.versions()) == 2 and state(t) == [(1, "a", "x"), (2, "b", "z"), (3, "c", "w")]
    assert os.path.isdir(check)
