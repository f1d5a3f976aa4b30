"""Papers are written and read once, whatever the plan does with what is read."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from lectern.functions import columns as C
from lectern.functions import text as T
from lectern.operators import extraction

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def one_column(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "s string").select(f(F.col("s"))).collect()]


def test_bound_value_is_there_once(spark):
    twice = spark.range(1).select(C.bound(F.regexp_replace(F.col("id").cast("string"), "x", "y"), lambda x: F.concat(x, x)).alias("v"))
    assert plan_of(twice).count("regexp_replace") == 1 and twice.first().v == "00"


def test_order_key(spark):
    assert one_column(spark, ["007", "7", "0", "00", "x", "", None, "+5", " 5", "5.0", "9" * 19, "0-5"], extraction.order_key) == [7, 7, 0, 0, None, None, None, None, None, None, None, -5]


def test_related_orders_write_each_paper_once(spark):
    plan = plan_of(entry.queries()["related_orders"](spark, SF))
    assert plan.count("FACTURA") == 1 and plan.count("l_shipdate") > 0


def test_amount_is_short_code_and_reads_as_before(spark):
    plan = plan_of(spark.range(1).select(C.amount(F.col("id").cast("string")).alias("v")))
    assert plan.count("[\\s\xa0]") == 1
    want = {"1.234,56": 1234.56, "-5,1": -5.1, "1.2.3,4": 123.4, "1,234.56": 1.23, "12.5": 125.0, "1.234": 1234.0, "5,": 5.0, "5,123": 5123.0, "5,1\n": 5.1, " 5 ,1": 5.1, ",5": 0.5, "--5,1": None, "": None, None: None}
    assert one_column(spark, list(want), C.amount) == list(want.values())


def test_first_date_is_the_first_of_dates(spark):
    texts = ["31/02/2024 y 1-2-70", "5 de junio de 2026, 32.1.2020", "99/99/9999", "1.1.20 y 2/2/2021", "fecha 31/2/2024 y 3 sept. 2021", "1/1/2020 fecha", "", None]
    got = spark.createDataFrame([(t,) for t in texts], "s string").select(T.first_date(F.col("s")).alias("a"), F.get(T.dates(F.col("s")), F.lit(0)).alias("b"), T.first_date(F.col("s"), "fecha").alias("c")).collect()
    assert [r.a for r in got] == [r.b for r in got] and [str(r.c) for r in got[4:6]] == ["2021-09-03", "2020-01-01"]


def test_invoice_papers_need_no_long_code(spark):
    assert len(plan_of(entry.queries()["invoice_extraction"](spark, SF))) < 40_000


def test_has_table_is_where_table_rows_are(spark):
    texts = ["| a |\n| --- |\n| 1 |", "| --- |\n| 1 |", "x\n\n  |---|\n", "| --- |\n| a |\n| --- |", "| a |\n| - |", "", "\n\n", "a\n| :--- | ---: |", "a\r\n|---|\r\n", None]
    got = spark.createDataFrame([(t,) for t in texts], "s string").select(extraction.has_table(F.col("s")).alias("a"), extraction.table_rows(F.col("s")).isNotNull().alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and {r.a for r in got} == {True, False}


def test_budget_papers_need_no_long_code(spark):
    assert len(plan_of(entry.queries()["budget_extraction"](spark, SF))) < 40_000
