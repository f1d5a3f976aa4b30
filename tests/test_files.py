"""Sources and sinks: round trips, and runs that are repeated."""

import datetime

from pyspark.sql import functions as F

from lectern.operators import layout
from lectern.sources import files


def test_texts_are_read_whole(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_bytes("uno\ndos é".encode() + b"\xff\x00")
    (tmp_path / "y.md").write_text("")
    (tmp_path / "z.bin").write_text("no")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.page_number, r.confidence) for r in files.plain_texts(spark, str(tmp_path)).collect()}
    assert got["x.txt"] == ("uno\ndos é�", 1, 1.0) and "z.bin" not in got


def test_exports(spark, tmp_path):
    d = spark.createDataFrame([(1, '=1+"x"', None), (2, "a,b\nc", 2.5)], "id int, t string, v double")
    files.export_csv(d, str(tmp_path / "c"))
    got = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(str(tmp_path / "c")).orderBy("id").collect()
    assert [(r.id, r.t, r.v) for r in got] == [("1", "'=1+\"x\"", None), ("2", "a,b\nc", "2.5")]
    files.export_json(d, str(tmp_path / "j"))
    assert {tuple(r) for r in spark.read.schema(d.schema).json(str(tmp_path / "j")).collect()} == {tuple(r) for r in d.collect()}


def test_a_repeated_run_replaces_its_rows(spark, tmp_path):
    d = spark.range(100).select(F.col("id").alias("document_id"), F.lit("a").alias("fact"))
    files.replace_parts(d, str(tmp_path / "t"), "document_id", 8)
    again = d.filter(F.pmod(F.xxhash64("document_id"), F.lit(8)) == 3).withColumn("fact", F.lit("b"))
    for _ in range(2):
        files.replace_parts(again, str(tmp_path / "t"), "document_id", 8)
    got = spark.read.parquet(str(tmp_path / "t"))
    assert got.count() == 100 and got.filter("fact = 'b'").count() == again.count() > 0
    e = spark.createDataFrame([(1, datetime.datetime(2024, 1, 5)), (2, datetime.datetime(2024, 2, 5))], "id int, ts timestamp")
    files.append_monthly(e, str(tmp_path / "m"))
    files.append_monthly(e.limit(0), str(tmp_path / "m"))
    assert sorted(r.month for r in spark.read.parquet(str(tmp_path / "m")).select("month").collect()) == ["2024-01", "2024-02"]


def test_layout_by_hand():
    assert layout.reading_order(([("a", 0, 0, 40, 5), ("c", 60, 0, 99, 5), ("b", 0, 9, 40, 14)]), 100) == (["a", "b", "c"], 2)
    assert layout.reading_order(([("a", 0, 0, 70, 5), ("c", 60, 9, 99, 5)]), 100) == (["a", "c"], 1) and layout.reading_order(([]), 100) == ([], 1)
    b = ([("Ref", 0, 0, 20, 5), ("Total", 80, 2, 99, 5), ("x", 0, 30, 9, 35), ("1,5", 85, 33, 99, 35), ("sigue", 0, 50, 9, 55)])
    assert layout.page_items(b, 100) == [{"reference": "x", "total_price": "1,5"}] and layout.page_items([], 100) == []
    assert layout.cluster_rows([x[2] for x in b], 100) == [0, 0, 1, 1, 2]


def test_repeated_tails():
    body = "".join(chr(97 + k * k % 23) for k in range(9000))
    assert layout.without_repeats(body + "xyz" * 50) == body + "xyz" and layout.without_repeats("xyz" * 50) == "xyz" * 50 and layout.without_repeats(None) is None
    assert layout.without_repeats(body + "xyz" * 4) == body + "xyz" * 4
