"""What the operators share: tables, the shared folder, and the columns they take."""

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words, everywhere in this package: runs of anything but space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a temporary one is set if all runs on this machine, as in tests; on a cluster that is an error."""
    to = spark.conf.get("spark.checkpoint.dir", None)
    if not to:
        got = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
        if not got and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir isn't set: name a folder there that the driver and all executors share")
        to = got or tempfile.mkdtemp(prefix="lectern-")
        if not got:
            spark.sparkContext.setCheckpointDir(to)
    return to.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoints to the shared folder: what follows survives lost executors and doesn't run what came before again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder, like cut(), but read by column. It stays there until its owner clears the folder."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text) go on, so other columns, whatever their names, clash with nothing; a null text is empty."""
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def total(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def sample_by_hash(df: DataFrame, key: Column, most: int) -> DataFrame:
    """About most rows: all if there are no more, else those whose 64-bit hash is below most's share of the range.

    Rows are counted first; no task sends candidates to the driver, so what arrives there doesn't grow with the tasks.
    At most twice as many rows come, also where one row is repeated very often.
    """
    n = df.count()
    return df if n <= most else df.filter(key < int(-(2**63) + 2**64 * most / n)).limit(2 * most)
