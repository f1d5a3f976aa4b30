"""Keyed tables in versions: merges that may be run twice, or be killed half way, and change nothing more.

A table is a folder. Rows are in folders of its data, by buckets of a hash of the key; a version is one small file in its ledger
that names the batch and the data folder of each bucket. A merge writes new folders first and then its version's file, which
the file system creates only if it isn't there: what was killed before is seen by nobody, a batch that the ledger
names is not merged again, and of two writers one begins anew. Only buckets with new or changed rows are rewritten, and rows
whose digest is the same aren't changes.
"""

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Buckets of a new table; a table keeps its own.
BUCKETS = 16
DIGEST = "_digest"


class Conflict(RuntimeError):
    """Another writer has committed the version."""


@dataclass
class Version:
    """number counts from 1; batch names what was merged; folders: the data folder of each bucket that has rows; added and changed count the merge's rows."""

    number: int
    batch: str
    buckets: int
    folders: dict[str, str]
    added: int = 0
    changed: int = 0


class Ledger:
    """The ledger's files, in any store that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        self.path, self.jvm = jvm.org.apache.hadoop.fs.Path(path), jvm
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self.path)) if self.fs.exists(self.path) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.jvm.org.apache.hadoop.fs.Path(self.path, name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Whether the file, whole from the start, is this one: written beside its place and moved there, if nothing is there."""
        self.fs.mkdirs(self.path)
        to, own = (self.jvm.org.apache.hadoop.fs.Path(self.path, x) for x in (name, f".{name}-{uuid.uuid4().hex}"))
        stream = self.fs.create(own, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.fs.exists(to):
            self.fs.delete(own, False)
            return False
        try:
            done = self.fs.rename(own, to)
        except Exception:  # the store says that the target is there
            done = False
        return bool(done) and self.read(name) == text


class Snapshots:
    """A keyed table in path. keys name its rows; two rows of one key can't be in one version."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self._buckets = spark, path.rstrip("/"), keys, buckets
        self.ledger = Ledger(spark, f"{self.path}/ledger")

    def versions(self) -> list[Version]:
        return [Version(**json.loads(self.ledger.read(n))) for n in self.ledger.names() if n.endswith(".json") and not n.startswith(".")]

    def read(self, number: int | None = None) -> DataFrame | None:
        """The rows of a version, the last unless one is named; None before the first and for a version without rows."""
        versions = [v for v in self.versions() if number is None or v.number == number]
        rows = self._rows(versions[-1], None) if versions else None
        return rows.drop(DIGEST, "_bucket") if rows is not None else None

    def _rows(self, version: Version | None, buckets: list[int] | None) -> DataFrame | None:
        folders = sorted({f for b, f in version.folders.items() if buckets is None or int(b) in buckets}) if version else []
        if not folders:
            return None
        rows = self.spark.read.option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/{f}" for f in folders])
        live = F.create_map(*[F.lit(x) for b, f in version.folders.items() for x in (int(b), f.removeprefix("of="))])
        rows = rows.filter(F.col("of") == live[F.col("_bucket")])
        return rows.drop("of") if buckets is None else rows.filter(F.col("_bucket").isin(buckets)).drop("of")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(self._buckets)).cast("int")

    def merge(self, rows: DataFrame, batch: str, order: list[Column] | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> Version:
        """The version after rows are merged by key; the batch's own version if it was merged before.

        Of rows with one key, the first by order wins, ties by digest. A row replaces that of its key if their digests (of all other columns) differ; equal rows aren't
        written. keep, if given, combines (rows of the table and new ones of touched keys) instead: it gets both, with a column _new, and returns a row a key.
        """
        versions = self.versions()
        for v in versions:
            if v.batch == batch:
                return v
        last = versions[-1] if versions else None
        self._buckets = last.buckets if last else self._buckets
        columns = rows.columns
        digest = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns])
        new = rows.withColumn(DIGEST, digest).withColumn("_bucket", self.bucket())
        if not keep:
            pick = W.partitionBy(*self.keys).orderBy(*(order or []), F.col(DIGEST))
            new = new.withColumn("_k", F.row_number().over(pick)).filter("_k = 1").drop("_k")
        folder = f"w{uuid.uuid4().hex}"
        staged = f"{self.path}/staged/{folder}"
        new.write.parquet(staged)  # what is merged is read once, however often it is used below
        new = self.spark.read.schema(new.schema).parquet(staged)
        touched = [r[0] for r in new.select("_bucket").distinct().collect()]  # as many as there are buckets
        old = self._rows(last, touched)
        added = changed = 0
        folders = dict(last.folders) if last else {}
        if touched:
            merged = self._merged(old, new, columns, keep)
            counts = merged.groupBy("_bucket").agg(F.count_if("_added").alias("added"), F.count_if("_changed").alias("changed")).collect()
            dirty = [r[0] for r in counts if r.added or r.changed]
            added, changed = sum(r.added for r in counts), sum(r.changed for r in counts)
            if dirty:
                out = merged.filter(F.col("_bucket").isin(dirty)).drop("_added", "_changed")
                out.repartition("_bucket", *self.keys).write.partitionBy("_bucket").parquet(f"{self.path}/data/of={folder}")
                folders |= {str(b): f"of={folder}" for b in dirty}
        version = Version(last.number + 1 if last else 1, batch, self._buckets, folders, added, changed)
        if not self.ledger.create(f"{version.number:010d}.json", json.dumps(version.__dict__)):
            raise Conflict(f"version {version.number} of {self.path} is another writer's; merge again")
        return version

    def _merged(self, old: DataFrame | None, new: DataFrame, columns: list[str], keep) -> DataFrame:
        """Rows of the touched buckets after the merge, with _added and _changed."""
        if keep:
            was = old.select(*columns, "_bucket", F.lit(False).alias("_new")) if old is not None else None
            both = new.select(*columns, "_bucket", F.lit(True).alias("_new"))
            combined = keep(was.unionByName(both) if was is not None else both).select(*columns)
            digest = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns])
            new = combined.withColumn(DIGEST, digest).withColumn("_bucket", self.bucket())
        if old is None:
            return new.withColumn("_added", F.lit(True)).withColumn("_changed", F.lit(False))
        on = F.lit(True)
        for k in self.keys:
            on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        both = old.alias("a").join(new.alias("b"), on, "full")
        differs, is_new = F.col(f"a.{DIGEST}") != F.col(f"b.{DIGEST}"), F.col(f"a.{DIGEST}").isNull()
        pick = [F.when(F.col(f"b.{DIGEST}").isNull(), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in [*columns, DIGEST, "_bucket"]]
        return both.select(*pick, is_new.alias("_added"), F.coalesce(differs, F.lit(False)).alias("_changed"))

    def again(self, rows: DataFrame, batch: str, tries: int = 5, **how) -> Version:
        """merge(), begun anew where another writer was first."""
        for k in range(tries):
            try:
                return self.merge(rows, batch, **how)
            except Conflict:
                if k + 1 == tries:
                    raise
        raise AssertionError

    def sink(self, name: str, **how) -> Callable[[DataFrame, int], None]:
        """For writeStream.foreachBatch: a batch that a restarted query sends again is known by its number and changes nothing."""
        return lambda rows, number: self.again(rows, f"{name}/{number}", **how) and None
