"""Files in and out: whole texts as pages, CSV and JSON exports, and tables that a run may write again."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T


def plain_texts(spark: SparkSession, path: str, glob: str = "*.{txt,csv,md}") -> DataFrame:
    """(path, page_number, text, confidence) of every text file under a path, in any store that Spark reads: one page, one text, confidence 1.

    Bytes that aren't UTF-8 become replacement characters. No files give no rows if the folder exists.
    """
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.lit(1).alias("page_number"), T.without_nul(F.col("value")).alias("text"), F.lit(1.0).alias("confidence"))


def export_csv(rows: DataFrame, path: str) -> None:
    """Rows as CSV files with a header; cells that a spreadsheet would take for formulas are made harmless."""
    safe = [T.csv_cell(F.col(c)).alias(c) if kind == "string" else F.col(c) for c, kind in rows.dtypes]
    rows.select(*safe).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def export_json(rows: DataFrame, path: str) -> None:
    """Rows as files of one JSON object a line, nulls kept."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def replace_parts(rows: DataFrame, path: str, by: str, parts: int = 64) -> None:
    """Writes rows under path so that a run that is repeated replaces what it wrote before: only the parts (of a hash of by) in rows are overwritten.

    rows is to hold all rows of each part that it touches, as a run over all documents of these parts does.
    """
    rows.withColumn("part", F.pmod(F.xxhash64(by), F.lit(parts))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def append_monthly(rows: DataFrame, path: str, ts: str = "ts") -> None:
    """Appends rows to a table that is parted by month."""
    rows.withColumn("month", F.date_format(ts, "yyyy-MM")).write.mode("append").partitionBy("month").parquet(path)
