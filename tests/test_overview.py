"""The administrator's summaries on small tables with nulls."""

from datetime import datetime

from pyspark.sql import functions as F

from lectern.operators import overview as O

DOC = "doc long, type string, status string, quality_status string, deleted boolean"


def test_rules_of_data_quality(spark):
    d = spark.createDataFrame([(1, "presupuesto", "ok", "processed", False), (2, "presupuesto", "duplicate", None, None), (3, "pedido", "failed", "processed", False), (4, "factura", "ok", "processed", False), (5, "plano", "ok", "x", False), (6, "plano", "ok", "x", True), (7, "desconocido", None, "x", False)], DOC)
    pages = spark.createDataFrame([(1, "text", 0.2, True), (1, "", 0.9, True), (2, None, 0.1, False), (3, "t", None, True), (4, "t", 0.6, True), (6, None, 0.1, True)], "doc long, text string, confidence double, applies boolean")
    budgets = spark.createDataFrame([(1, "P-1"), (2, "")], "doc long, number string")
    orders, plans = spark.createDataFrame([(3, None)], "doc long, supplier string"), spark.createDataFrame([(5, False)], "doc long, has_scale boolean")
    got = {(r.part, r.key): r.n for r in O.data_quality(d, pages, budgets, orders, plans).collect()}
    assert got == {
        ("rule", "ocr_low"): 1, ("rule", "page_without_text"): 4, ("rule", "document_type_unknown"): 1, ("rule", "missing_budget_number"): 1, ("rule", "missing_order_supplier"): 1, ("rule", "missing_invoice_date"): 1,
        ("rule", "plan_without_scale"): 1, ("rule", "duplicate_document"): 1, ("rule", "failed_processing"): 1, ("status", "processed"): 3, ("status", None): 1, ("status", "x"): 2,
    }


def test_alerts_and_maintenance(spark):
    budgets = spark.createDataFrame([(1, True), (2, True), (3, False), (4, None)], "id long, accepted boolean")
    orders = spark.createDataFrame([(1,), (1,), (None,)], "budget long")
    d = spark.createDataFrame([(1, "a", "needs_review", "needs_human_review", False), (2, "a", "failed", None, True), (3, "a", "duplicate", "processed", None)], DOC)
    plans, jobs = spark.createDataFrame([(1, False), (2, None)], "doc long, has_scale boolean"), spark.createDataFrame([("failed",), ("pending",), ("processing",), (None,)], "status string")
    got = {r.alert: (r.severity, r.n) for r in O.alerts(budgets, orders, d, plans, jobs, disk_low=1, queue_most=2).collect()}
    assert got == {
        "accepted_budgets_without_order": ("warning", 1), "orders_without_budget": ("warning", 1), "ocr_review_documents": ("critical", 1), "plans_without_valid_scale": ("warning", 1), "duplicate_documents": ("info", 1), "failed_jobs": ("critical", 1),
        "low_quality_documents": ("warning", 1), "disk_low": ("critical", 1), "queue_backpressure": ("warning", 1),
    }
    none = O.alerts(budgets.limit(0), orders.limit(0), d.limit(0), plans.limit(0), jobs.limit(0))
    assert none.count() == 0
    assert {r.key: (r.status, r.n) for r in O.maintenance(jobs, jobs.limit(0)).collect()} == {"failed_jobs": ("warning", 1), "failed_watched_files": ("ok", 0)}


def test_series_by_day(spark):
    at = lambda d: datetime(2026, 3, d, 12)
    d = spark.createDataFrame([(at(1),), (at(9),), (at(9),), (None,)], "created_at timestamp")
    jobs = spark.createDataFrame([("processed", at(9)), ("failed", at(10)), ("pending", at(10))], "status string, finished_at timestamp")
    pages = spark.createDataFrame([(at(9), 0.5, True), (at(9), 0.25, True), (at(9), None, True), (at(9), 0.9, False)], "created_at timestamp, confidence double, applies boolean")
    got = {(r.series, r.day.day): r.value for r in O.activity(d, d.limit(1), jobs, pages, F.lit(at(10))).collect()}
    assert got == {("documents", 9): 2.0, ("jobs", 9): 1.0, ("failed", 10): 1.0, ("confidence", 9): 0.375}
