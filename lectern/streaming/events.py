"""Event-time operators that take a stream or a table alike; on a stream, give it a watermark first, as read_stream() does."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hourly(events: DataFrame) -> DataFrame:
    """(start, event_type, n) of each hour."""
    return events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, n) of each run of a user's events with less than gap between neighbours."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def read_stream(spark: SparkSession, folder: str, late: str = "1 hour") -> DataFrame:
    """Events from files that arrive in a folder, each event once within the watermark."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).parquet(folder).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def sliding(events: DataFrame, width: str = "1 hour", step: str = "30 minutes") -> DataFrame:
    """(start, event_type, n) of windows of a width that begin at every step."""
    return events.groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event_id once, as long as repeats come within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
