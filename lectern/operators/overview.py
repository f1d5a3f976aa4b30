"""What an administrator sees: rules of data quality, alerts, checks of maintenance, and series by day, over whole tables.

The functions take tables with the columns that they name; the queries derive these from the given tables.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.business import count
from lectern.operators.registry import Registry
from lectern.sources.tables import table

query = Registry()

#: The confidence below which recognised text is low, the statuses that ask for a review, and the quality statuses that count as low.
LOW, REVIEW, LOW_QUALITY = 0.60, ("failed", "needs_review"), ("processed_low_quality", "processed_missing_fields", "needs_human_review")
#: Alerts in their order, each with its severity.
ALERTS = (
    ("accepted_budgets_without_order", "warning"), ("orders_without_budget", "warning"), ("ocr_review_documents", "critical"), ("plans_without_valid_scale", "warning"), ("duplicate_documents", "info"),
    ("failed_jobs", "critical"), ("low_quality_documents", "warning"), ("disk_low", "critical"), ("queue_backpressure", "warning"),
)


def _n(df: DataFrame, key: str, where: str | Column = "true") -> DataFrame:
    return df.filter(where).agg(count().alias("n")).select(F.lit(key).alias("key"), "n")


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def data_quality(documents: DataFrame, pages: DataFrame, budgets: DataFrame, orders: DataFrame, plans: DataFrame) -> DataFrame:
    """(part, key, n): nine rules ("rule", zeros too) and the documents of each quality status ("status").

    documents (doc, type, status, quality_status, deleted), pages (doc, text, confidence, applies), budgets (doc, number), orders (doc, supplier),
    plans (doc, has_scale). Deleted documents don't count. A document without a page counts as one without text; each page without text counts. Papers of a kind without a row of their
    own lack what the row would hold; all invoices lack a date, as nothing records it.
    """
    d = documents.filter(~F.coalesce("deleted", F.lit(False)))
    one = d.agg(*[F.count_if(F.expr(c)).alias(k) for k, c in (("document_type_unknown", "type = 'desconocido'"), ("missing_invoice_date", "type = 'factura'"), ("duplicate_document", "status = 'duplicate'"), ("failed_processing", "status = 'failed'"))])
    own = one.selectExpr("stack(4, 'document_type_unknown', document_type_unknown, 'missing_invoice_date', missing_invoice_date, 'duplicate_document', duplicate_document, 'failed_processing', failed_processing) AS (key, n)")
    ids, p = d.select("doc", "type"), pages.select("doc", "confidence", "applies", F.coalesce(F.length("text") > 0, F.lit(False)).alias("has_text"))
    read = ids.join(p, "doc", "left").agg(F.count_if(F.col("applies") & (F.col("confidence") < LOW)).alias("low"), F.count_if(~F.coalesce("has_text", F.lit(False))).alias("bare"))
    read = read.selectExpr("stack(2, 'ocr_low', low, 'page_without_text', bare) AS (key, n)")
    lacks = lambda kind, rows, fine, key: _n(ids.filter(F.col("type") == kind).join(rows.select("doc", F.coalesce(fine, F.lit(False)).alias("fine")), "doc", "left"), key, ~F.coalesce("fine", F.lit(False)))
    papers = [
        lacks("presupuesto", budgets, F.length("number") > 0, "missing_budget_number"), lacks("pedido", orders, F.length("supplier") > 0, "missing_order_supplier"), lacks("plano", plans, F.col("has_scale"), "plan_without_scale"),
    ]
    rules = _all([own, read, *papers]).select(F.lit("rule").alias("part"), "key", "n")
    return rules.unionByName(d.groupBy(F.col("quality_status").alias("key")).agg(count().alias("n")).select(F.lit("status").alias("part"), "key", "n"))


def alerts(budgets: DataFrame, orders: DataFrame, documents: DataFrame, plans: DataFrame, jobs: DataFrame, disk_low: int = 0, queue_most: int = 200) -> DataFrame:
    """(alert, severity, n) of the nine counts that aren't zero. budgets (id, accepted), orders (budget), jobs (status); disk_low is what a monitor of disks counted, and the queue is under pressure (1) with queue_most jobs pending or processing."""
    without = budgets.filter("accepted").join(orders.select(F.col("budget").alias("id")).filter("id IS NOT NULL").distinct(), "id", "left_anti")
    d = documents.filter(~F.coalesce("deleted", F.lit(False)))
    on = lambda c, values: F.col(c).isin(*values)
    found = d.agg(F.count_if(on("status", REVIEW)).alias("a"), F.count_if(F.col("status") == "duplicate").alias("b"), F.count_if(on("quality_status", LOW_QUALITY)).alias("c"))
    found = found.selectExpr("stack(3, 'ocr_review_documents', a, 'duplicate_documents', b, 'low_quality_documents', c) AS (key, n)")
    work = jobs.agg(F.count_if(F.col("status") == "failed").alias("a"), (F.count_if(on("status", ("pending", "processing"))) >= queue_most).cast("long").alias("b"))
    work = work.selectExpr("stack(2, 'failed_jobs', a, 'queue_backpressure', b) AS (key, n)")
    disk = d.sparkSession.range(1).select(F.lit("disk_low").alias("key"), F.lit(disk_low).cast("long").alias("n"))
    all_ = _all([_n(without, "accepted_budgets_without_order"), _n(orders, "orders_without_budget", "budget IS NULL"), found, _n(plans, "plans_without_valid_scale", "NOT has_scale"), work, disk])
    severity = F.create_map(*[F.lit(x) for a in ALERTS for x in a])
    return all_.filter("n > 0").select(F.col("key").alias("alert"), severity[F.col("key")].alias("severity"), "n")


def maintenance(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """(key, status, n): failed jobs and failed files (status), each ok or a warning."""
    rows = _n(jobs, "failed_jobs", "status = 'failed'").unionByName(_n(files, "failed_watched_files", "status = 'failed'"))
    return rows.select("key", F.when(F.col("n") > 0, "warning").otherwise("ok").alias("status"), "n")


def activity(documents: DataFrame, questions: DataFrame, jobs: DataFrame, pages: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """(series, day, value): documents, questions, finished and failed jobs by day, and the mean confidence of recognised pages to three places, of the last days before now.

    documents, questions, pages have created_at; jobs status and finished_at; pages confidence and applies.
    """
    start = now - F.expr(f"INTERVAL {days} DAYS")

    def by_day(df: DataFrame, series: str, ts: str, value: Column) -> DataFrame:
        return df.filter(F.col(ts) >= start).groupBy(F.to_date(ts).alias("day")).agg(value.cast("double").alias("value")).select(F.lit(series).alias("series"), "day", "value")

    n = count()
    return _all([
        by_day(documents, "documents", "created_at", n), by_day(questions, "questions", "created_at", n), by_day(jobs.filter("status = 'processed'"), "jobs", "finished_at", n), by_day(jobs.filter("status = 'failed'"), "failed", "finished_at", n),
        by_day(pages.filter("applies AND confidence IS NOT NULL"), "confidence", "created_at", F.round(F.avg("confidence"), 3)),
    ])


# the given tables as documents, pages, papers and jobs

_DOCS_SQL = """
h AS (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS copy FROM documents),
d AS (SELECT d.doc_id AS doc, CASE lang WHEN 'en' THEN 'presupuesto' WHEN 'de' THEN 'pedido' WHEN 'fr' THEN 'factura' WHEN 'es' THEN 'plano' ELSE 'desconocido' END AS type,
  CASE WHEN copy THEN 'duplicate' WHEN l.toxic = 1 THEN 'failed' WHEN n_chars < 200 THEN 'needs_review' ELSE 'processed' END AS status,
  CASE WHEN l.quality = 1 THEN 'processed' WHEN l.quality = 0 THEN 'processed_low_quality' ELSE 'processed_missing_fields' END AS quality_status, coalesce(text, '') = '' AS deleted,
  text, least(1.0, n_chars / 2000.0)::DOUBLE AS confidence, source FROM documents d JOIN h USING (doc_id) LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("h", F.sha2("text", 256))
    first = d.groupBy(F.col("h").alias("k")).agg(F.min("doc_id").alias("first"))
    lab = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "l")
    d = d.join(first, F.col("h").eqNullSafe(F.col("k"))).join(lab, F.col("doc_id") == F.col("l"), "left")
    kinds = {"en": "presupuesto", "de": "pedido", "fr": "factura", "es": "plano"}
    kind = reduce(lambda a, k: a.when(F.col("lang") == k, kinds[k]), list(kinds)[1:], F.when(F.col("lang") == "en", kinds["en"])).otherwise("desconocido")
    return d.select(
        F.col("doc_id").alias("doc"), kind.alias("type"), F.when(F.col("doc_id") != F.col("first"), "duplicate").when(F.col("toxic") == 1, "failed").when(F.col("n_chars") < 200, "needs_review").otherwise("processed").alias("status"),
        F.when(F.col("quality") == 1, "processed").when(F.col("quality") == 0, "processed_low_quality").otherwise("processed_missing_fields").alias("quality_status"), (F.coalesce("text", F.lit("")) == "").alias("deleted"),
        "text", F.least(F.lit(1.0), F.col("n_chars") / 2000).alias("confidence"), "source", F.lit(True).alias("applies"),
    )


@query(f"""
WITH {_DOCS_SQL}, x AS (SELECT * FROM d WHERE NOT deleted), o AS (SELECT o_orderkey AS doc, o_orderpriority AS number FROM orders)
SELECT 'rule' AS part, key, n FROM (SELECT 'ocr_low' AS key, (count(*) FILTER (confidence < {LOW}))::BIGINT AS n FROM x UNION ALL SELECT 'page_without_text', 0 UNION ALL SELECT 'document_type_unknown', count(*) FILTER (type = 'desconocido') FROM x
 UNION ALL SELECT 'missing_invoice_date', count(*) FILTER (type = 'factura') FROM x UNION ALL SELECT 'duplicate_document', count(*) FILTER (status = 'duplicate') FROM x UNION ALL SELECT 'failed_processing', count(*) FILTER (status = 'failed') FROM x
 UNION ALL SELECT 'missing_budget_number', count(*) FROM x LEFT JOIN o USING (doc) WHERE type = 'presupuesto' AND number IS NULL UNION ALL SELECT 'missing_order_supplier', count(*) FROM x WHERE type = 'pedido' AND coalesce(source, '') = ''
 UNION ALL SELECT 'plan_without_scale', count(*) FROM x WHERE type = 'plano' AND NOT contains(text, ':'))
UNION ALL SELECT 'status', quality_status, count(*) FROM x GROUP BY 2
""")
def data_quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine rules over the documents: budgets find their numbers among the orders, plans have a scale if their text names a ratio."""
    d = _documents(spark, sf_dir)
    budgets = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.col("o_orderpriority").alias("number"))
    return data_quality(d, d, budgets, d.select("doc", F.col("source").alias("supplier")), d.select("doc", F.col("text").contains(":").alias("has_scale")))


@query(f"""
WITH {_DOCS_SQL}, x AS (SELECT * FROM d WHERE NOT deleted), b AS (SELECT o_orderkey AS id, o_orderstatus = 'F' AS accepted FROM orders), l AS (SELECT DISTINCT l_orderkey AS budget, l_suppkey FROM lineitem),
c AS (SELECT 'accepted_budgets_without_order' AS alert, 'warning' AS severity, count(*) AS n FROM b ANTI JOIN l ON l.budget = b.id WHERE accepted UNION ALL SELECT 'ocr_review_documents', 'critical', count(*) FROM x WHERE status IN ('failed', 'needs_review')
 UNION ALL SELECT 'duplicate_documents', 'info', count(*) FROM x WHERE status = 'duplicate' UNION ALL SELECT 'low_quality_documents', 'warning', count(*) FROM x WHERE quality_status <> 'processed'
 UNION ALL SELECT 'plans_without_valid_scale', 'warning', count(*) FROM d WHERE type = 'plano' AND NOT contains(text, ':') UNION ALL SELECT 'failed_jobs', 'critical', count(*) FROM events WHERE event_type = 'error'
 UNION ALL SELECT 'queue_backpressure', 'warning', (count(*) >= 200)::BIGINT FROM events WHERE event_type NOT IN ('error', 'purchase'))
SELECT * FROM c WHERE n > 0
""")
def operations_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts over budgets, orders, documents, plans and jobs (events)."""
    d = _documents(spark, sf_dir)
    budgets = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("accepted"))
    orders = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("budget"), "l_suppkey").distinct()
    plans = d.filter("type = 'plano'").select("doc", F.col("text").contains(":").alias("has_scale"))
    return alerts(budgets, orders, d, plans, _jobs(spark, sf_dir))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_type")
    status = F.when(e == "error", "failed").when(e == "purchase", "processed").when(e == "view", "pending").otherwise("processing")
    return table(spark, sf_dir, "events").select(status.alias("status"), F.col("ts").alias("finished_at"), "value")


@query("""
WITH t AS (SELECT max(ts) - INTERVAL 7 DAY AS start FROM events), e AS (SELECT event_type, ts::DATE AS day, value FROM events, t WHERE ts >= start)
SELECT CASE event_type WHEN 'purchase' THEN 'jobs' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'questions' ELSE 'documents' END AS series, day, count(*)::DOUBLE AS value FROM e WHERE event_type IN ('purchase', 'error', 'view', 'signup') GROUP BY 1, 2
UNION ALL SELECT 'confidence', day, round(avg(value), 3) FROM e WHERE value IS NOT NULL GROUP BY day
""")
def activity_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five series of the last seven days of events: sign-ups as documents, views as questions, purchases and errors as jobs, values as confidences."""
    e, jobs = table(spark, sf_dir, "events"), _jobs(spark, sf_dir)
    now = F.lit(e.agg(F.max("ts")).first()[0]).cast(e.schema["ts"].dataType)
    made = e.select("event_type", F.col("ts").alias("created_at"), F.col("value").alias("confidence"), F.lit(True).alias("applies"))
    return activity(made.filter("event_type = 'signup'"), made.filter("event_type = 'view'"), jobs, made, now)


@query("""
SELECT 'failed_jobs' AS key, CASE WHEN count(*) > 0 THEN 'warning' ELSE 'ok' END AS status, count(*) AS n FROM events WHERE event_type = 'error'
UNION ALL SELECT 'failed_watched_files', CASE WHEN count(*) > 0 THEN 'warning' ELSE 'ok' END, count(*) FROM pages WHERE html IS NULL OR NOT contains(html, '</html>')
""")
def maintenance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed jobs (events), and failed files: pages that are missing or cut off."""
    whole = F.coalesce(F.col("html").contains("</html>"), F.lit(False))
    return maintenance(_jobs(spark, sf_dir), table(spark, sf_dir, "pages").select(F.when(whole, "processed").otherwise("failed").alias("status")))
