"""The given tables."""

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by name; only Spark touches the path, so any store will do."""
    if name not in TABLES:
        raise ValueError(f"no table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Partitions of a table that spread() still moves (of 128 MB each, unless the session says otherwise).
SMALL = 32


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if its files give fewer (one row group isn't split) and SMALL at most, for work that costs more than moving the rows.

    Larger tables stay as they are, however many cores there are: their texts aren't shuffled.
    """
    cores, n = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(cores) if n < min(cores, SMALL + 1) else df
