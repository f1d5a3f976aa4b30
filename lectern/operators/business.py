"""Business aggregation, reconciliation, access and dashboards over the given tables. Each query has its SQL beside it."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import columns as C
from lectern.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def count() -> Column:
    return F.count(F.lit(1)).cast("long")


def money(c: Column | str) -> Column:
    """Sums of exact decimals, so that they don't depend on the order of rows; six places hold a price times two percentages."""
    return F.sum(F.round(F.expr(c) if isinstance(c, str) else c, 6).cast("decimal(18,6)")).cast("double")


GROSS = "l_extendedprice * (1 - l_discount) * (1 + l_tax)"
GROSS_SQL = "round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6)::DECIMAL(18,6)"


@query(f"SELECT year(l_shipdate)::BIGINT AS year, month(l_shipdate)::BIGINT AS month, sum({GROSS_SQL})::DOUBLE AS total, count(*) AS n FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1, 2")
def invoice_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter("l_shipdate IS NOT NULL")
    return rows.groupBy(F.year("l_shipdate").cast("long").alias("year"), F.month("l_shipdate").cast("long").alias("month")).agg(money(GROSS).alias("total"), count().alias("n"))


@query(f"SELECT year(l_shipdate)::BIGINT AS year, sum({GROSS_SQL})::DOUBLE AS total, count(*) AS n FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1")
def invoice_yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter("l_shipdate IS NOT NULL").groupBy(F.year("l_shipdate").cast("long").alias("year")).agg(money(GROSS).alias("total"), count().alias("n"))


@query(f"SELECT s_name AS supplier, total, n FROM (SELECT l_suppkey, sum({GROSS_SQL})::DOUBLE AS total, count(*) AS n FROM lineitem GROUP BY 1) JOIN supplier ON s_suppkey = l_suppkey ORDER BY total DESC, supplier LIMIT 10")
def invoice_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are summed by key before the join, so only one row a supplier meets the names. A top-k report."""
    sums = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(money(GROSS).alias("total"), count().alias("n"))
    return sums.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_name").alias("supplier"), "total", "n").orderBy(F.desc("total"), "supplier").limit(10)


@query("SELECT count(*) AS n, coalesce(sum(round(o_totalprice, 6)::DECIMAL(18,6))::DOUBLE, 0) AS total, (count(*) FILTER (o_orderstatus = 'F'))::BIGINT AS accepted FROM orders")
def budget_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").agg(count().alias("n"), F.coalesce(money(F.col("o_totalprice")), F.lit(0.0)).alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("accepted"))


@query("SELECT o_orderkey AS budget, c_name AS client, o_totalprice AS total FROM orders JOIN customer ON c_custkey = o_custkey ORDER BY total DESC, budget LIMIT 10")
def budget_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report. Orders without a client don't count, so the join comes first; each task then keeps ten."""
    top = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    return top.select(F.col("o_orderkey").alias("budget"), F.col("c_name").alias("client"), F.col("o_totalprice").alias("total")).orderBy(F.desc("total"), "budget").limit(10)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL)")
def accepted_without_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").select("l_orderkey")
    return o.filter("o_orderstatus = 'F'").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey", "o_totalprice")


@query("""
WITH l AS (SELECT l_orderkey, sum(round(l_extendedprice, 6)::DECIMAL(18,6))::DOUBLE AS lines FROM lineitem GROUP BY 1)
SELECT 'accepted without lines' AS kind, o_orderkey AS budget, o_totalprice AS expected, NULL::DOUBLE AS actual FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM l)
UNION ALL SELECT 'lines do not match', o_orderkey, o_totalprice, lines FROM orders JOIN l ON l_orderkey = o_orderkey WHERE abs(o_totalprice - lines) > greatest(1.0, o_totalprice * 0.01)
UNION ALL SELECT 'no client', o_orderkey, o_totalprice, NULL FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
""")
def reconciliation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of three rules. Lines are summed once and reused by two of them."""
    o = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(money(F.col("l_extendedprice")).alias("lines"))
    both = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    gap = F.abs(F.col("o_totalprice") - F.col("lines")) > F.greatest(F.lit(1.0), F.col("o_totalprice") * 0.01)
    kind = F.when(F.col("lines").isNull() & (F.col("o_orderstatus") == "F"), "accepted without lines").when(gap, "lines do not match")
    first = both.withColumn("kind", kind).filter("kind IS NOT NULL").select("kind", F.col("o_orderkey").alias("budget"), F.col("o_totalprice").alias("expected"), F.col("lines").alias("actual"))
    lost = o.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    return first.unionByName(lost.select(F.lit("no client").alias("kind"), F.col("o_orderkey").alias("budget"), F.col("o_totalprice").alias("expected"), F.lit(None).cast("double").alias("actual")))


@query(f"SELECT o_orderkey AS budget, o_totalprice AS total, coalesce(sum({GROSS_SQL})::DOUBLE, 0) AS invoiced, count(DISTINCT l_suppkey) AS n_invoices FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def budget_invoiced_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is invoiced of each budget. Lines are summed by budget before the join."""
    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(money(GROSS).alias("invoiced"), F.count_distinct("l_suppkey").alias("n"))
    rows = table(spark, sf_dir, "orders").join(sums, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select(F.col("o_orderkey").alias("budget"), F.col("o_totalprice").alias("total"), F.coalesce("invoiced", F.lit(0.0)).alias("invoiced"), F.coalesce("n", F.lit(0)).cast("long").alias("n_invoices"))


@query("""
WITH l AS (SELECT l_orderkey, sum(round(l_extendedprice, 6)::DECIMAL(18,6))::DOUBLE AS lines FROM lineitem GROUP BY 1)
SELECT o_orderkey AS budget, o_totalprice AS total, lines, abs(o_totalprice - lines) <= greatest(1.0, o_totalprice * 0.01) AS matches FROM orders JOIN l ON l_orderkey = o_orderkey
""")
def lines_match_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(money(F.col("l_extendedprice")).alias("lines"))
    rows = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select(F.col("o_orderkey").alias("budget"), F.col("o_totalprice").alias("total"), "lines", (F.abs(F.col("o_totalprice") - F.col("lines")) <= F.greatest(F.lit(1.0), F.col("o_totalprice") * 0.01)).alias("matches"))


@query("SELECT coalesce(nullif(lang, ''), 'unknown') AS lang, coalesce(nullif(source, ''), 'unknown') AS source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY GROUPING SETS ((1), (2), ())")
def docs_group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by language, by source, and of all, in one pass."""
    d = table(spark, sf_dir, "documents")
    name = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))
    d = d.select(name("lang").alias("lang"), name("source").alias("source"), "n_chars")
    return d.groupingSets([["lang"], ["source"], []], "lang", "source").agg(count().alias("n"), F.sum("n_chars").alias("chars"))


@query("""
SELECT count(*) AS n_docs, (count(*) FILTER (l.doc_id IS NULL))::BIGINT AS unlabelled, (count(*) FILTER (quality = 0))::BIGINT AS low_quality, (count(*) FILTER (toxic = 1))::BIGINT AS toxic,
  (count(*) FILTER (text IS NULL OR text = ''))::BIGINT AS empty, (count(*) FILTER (n_chars < 40))::BIGINT AS short, (count(*) FILTER (length(text) <> n_chars))::BIGINT AS wrong_length
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
""")
def quality_rules_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "label_id")
    n = lambda c: F.count_if(F.expr(c))
    rows = d.select("doc_id", "n_chars", F.length("text").alias("size")).join(lab, F.col("doc_id") == F.col("label_id"), "left")
    return rows.agg(count().alias("n_docs"), n("label_id IS NULL").alias("unlabelled"), n("quality = 0").alias("low_quality"), n("toxic = 1").alias("toxic"), n("size IS NULL OR size = 0").alias("empty"), n("n_chars < 40").alias("short"), n("size <> n_chars").alias("wrong_length"))


@query("""
WITH c AS (SELECT (count(*) FILTER (event_type = 'error'))::BIGINT AS errors, (count(*) FILTER (value IS NULL))::BIGINT AS missing, (count(*) FILTER (value < 0))::BIGINT AS negative, (count(*) FILTER (props IS NULL))::BIGINT AS bare FROM events)
SELECT * FROM (SELECT 'errors' AS alert, 'critical' AS severity, errors AS n FROM c UNION ALL SELECT 'missing', 'warning', missing FROM c UNION ALL SELECT 'negative', 'warning', negative FROM c UNION ALL SELECT 'bare', 'info', bare FROM c) WHERE n > 0
""")
def admin_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that aren't zero, with their severity, from one pass."""
    n = lambda c: F.count_if(F.expr(c))
    c = table(spark, sf_dir, "events").agg(n("event_type = 'error'").alias("errors"), n("value IS NULL").alias("missing"), n("value < 0").alias("negative"), n("props IS NULL").alias("bare"))
    return c.selectExpr("stack(4, 'errors', 'critical', errors, 'missing', 'warning', missing, 'negative', 'warning', negative, 'bare', 'info', bare) AS (alert, severity, n)").filter("n > 0")


@query("SELECT ts::DATE AS day, event_type, count(*) AS n, sum(round(value, 6)::DECIMAL(18,6))::DOUBLE / count(value) AS mean FROM events GROUP BY 1, 2")
def daily_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    mean = money("value") / F.count("value")
    return e.groupBy(F.to_date("ts").alias("day"), "event_type").agg(count().alias("n"), mean.alias("mean"))


@query("""
WITH t AS (SELECT max(ts) AS now FROM events)
SELECT count(*) AS n, (count(*) FILTER (ts::DATE = now::DATE))::BIGINT AS today, (count(*) FILTER (ts > now - INTERVAL 7 DAY))::BIGINT AS week, count(DISTINCT user_id) AS users,
  (count(DISTINCT user_id) FILTER (ts > now - INTERVAL 7 DAY))::BIGINT AS active FROM events, t
""")
def dashboard_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As of the newest event. That one row is joined to all."""
    e = table(spark, sf_dir, "events").select("ts", "user_id")
    rows = e.join(F.broadcast(e.agg(F.max("ts").alias("now"))))
    week = F.expr("ts > now - INTERVAL 7 DAYS")
    return rows.agg(count().alias("n"), F.count_if(F.to_date("ts") == F.to_date("now")).alias("today"), F.count_if(week).alias("week"), F.count_distinct("user_id").alias("users"), F.count_distinct(F.when(week, F.col("user_id"))).alias("active"))


@query("SELECT coalesce(event_type, 'unset') AS engine, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM events GROUP BY 1")
def engine_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "events").groupBy(F.coalesce("event_type", F.lit("unset")).alias("engine")).agg(count().alias("n"))
    return by.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 4))


@query("""
WITH t AS (SELECT 1000 AS wanted)
SELECT (SELECT max(o_orderkey) FROM orders, t WHERE o_orderkey < wanted) AS below, (SELECT min(o_orderkey) FROM orders, t WHERE o_orderkey > wanted) AS above,
  (SELECT count(*) FROM orders, t WHERE o_orderkey = wanted)::BIGINT AS exact
""")
def nearest_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest order numbers to 1000, in one pass."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").agg(F.max(F.when(k < 1000, k)).alias("below"), F.min(F.when(k > 1000, k)).alias("above"), F.count_if(k == 1000).alias("exact"))


@query("SELECT DISTINCT regexp_extract(url, '/([a-z]+)/[0-9]+', 1) AS section, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages")
def distinct_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.regexp_extract("url", "/([a-z]+)/[0-9]+", 1).alias("section"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host")).distinct()


@query("SELECT lower(p_type) AS system, count(DISTINCT p_brand) AS brands, count(DISTINCT p_size) AS sizes FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1 OR count(DISTINCT p_size) > 1")
def contradictions_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "part").groupBy(F.lower("p_type").alias("system")).agg(F.count_distinct("p_brand").alias("brands"), F.count_distinct("p_size").alias("sizes"))
    return by.filter("brands > 1 OR sizes > 1")


@query("""
SELECT 'union' AS op, k FROM (SELECT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders) UNION ALL
SELECT 'intersect', k FROM (SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL
SELECT 'except', k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders)
""")
def set_ops_union_intersect_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    name = lambda op, df: df.select(F.lit(op).alias("op"), "k")
    return name("union", a.union(b).distinct()).union(name("intersect", a.intersect(b))).union(name("except", a.subtract(b)))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice AS parsed FROM lineitem")
def parse_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices written the Spanish way (1.234,56) and read again: a round trip."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long").cast("string")
    whole = F.reverse(F.regexp_replace(F.reverse(F.expr("substring(c, 1, length(c) - 2)")), r"([0-9]{3})(?=[0-9])", "$1."))
    rows = table(spark, sf_dir, "lineitem").withColumn("c", F.lpad(cents, F.greatest(F.length(cents), F.lit(3)), F.lit("0")))
    return rows.select("l_orderkey", "l_linenumber", C.amount(F.concat(whole, F.lit(","), F.expr("right(c, 2)")), "es").alias("parsed"))


@query("SELECT o_orderkey, o_orderdate::DATE AS numeric, o_orderdate::DATE AS wordy FROM orders")
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written as 05/06/1998 and as 5 de junio de 1998, and read again: a round trip."""
    d = F.col("o_orderdate")
    words = F.concat(F.dayofmonth(d).cast("string"), F.lit(" de "), F.element_at(F.array(*map(F.lit, C.MONTHS)), F.month(d)), F.lit(" de "), F.year(d).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", C.date_es(F.date_format(d, "dd/MM/yyyy")).alias("numeric"), C.date_es(words).alias("wordy"))


@query("SELECT o_orderkey, lower('ord' || o_orderkey || 'x') AS number FROM orders")
def normalize_doc_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", C.doc_number(F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string"), F.lit(" /.X"))).alias("number"))


@query("""
WITH t AS (SELECT c_custkey, lpad(c_custkey::VARCHAR, 8, '0') || substr('TRWAGMYFPDXBNJZSQVHLCKE', ((c_custkey + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END) % 23 + 1)::INT, 1) AS nif FROM customer)
SELECT c_custkey, nif, c_custkey % 3 <> 0 AS valid FROM t
""")
def nif_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tax ids made from customer keys, a third of them with the wrong letter, and checked."""
    k = F.col("c_custkey")
    letter = F.substring(F.lit(C.NIF_LETTERS), ((k + F.when(k % 3 == 0, 1).otherwise(0)) % 23 + 1).cast("int"), F.lit(1))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lpad(k.cast("string"), 8, "0"), letter).alias("nif"))
    return rows.withColumn("valid", C.nif_valid(F.col("nif")))


ACCESS_SQL = """
SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
WHERE d.lang IN ('en', 'fr') AND coalesce(l.toxic, 0) = 0 AND d.source IN ('src0', 'src1', 'src2')
"""


@query(ACCESS_SQL)
def access_filtered_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a scope may see: its sources, its languages, and none with a denied tag."""
    tags = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(F.array().cast("array<string>")).alias("tags"))
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").filter(F.col("source").isin("src0", "src1", "src2") & F.col("lang").isin("en", "fr"))
    denied = F.array(F.lit("toxic"))
    return d.join(tags, "doc_id", "left").filter(~F.coalesce(F.arrays_overlap("tags", denied), F.lit(False))).select("doc_id")


@query("""
WITH r(pattern, tenant) AS (VALUES ('src', 'all'), ('src1', 'one'), ('src2', 'two'), ('src1', 'other')),
m AS (SELECT DISTINCT d.source, tenant, rank() OVER (PARTITION BY d.source ORDER BY length(pattern) DESC) AS k FROM (SELECT DISTINCT source FROM documents) d JOIN r ON starts_with(d.source, pattern)),
g AS (SELECT source, CASE WHEN count(DISTINCT tenant) > 1 THEN 'quarantine' ELSE min(tenant) END AS tenant FROM m WHERE k = 1 GROUP BY 1)
SELECT d.doc_id, coalesce(tenant, 'unassigned') AS tenant FROM documents d LEFT JOIN g USING (source)
""")
def folder_rule_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most specific (longest) rule wins; rules that differ at that length quarantine. Rules are matched once a distinct source."""
    rules = spark.createDataFrame([("src", "all"), ("src1", "one"), ("src2", "two"), ("src1", "other")], "pattern string, tenant string")
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    m = d.select("source").distinct().join(F.broadcast(rules), F.expr("startswith(source, pattern)"))
    m = m.withColumn("k", F.rank().over(W.partitionBy("source").orderBy(F.desc(F.length("pattern"))))).filter("k = 1")
    g = m.groupBy("source").agg(F.when(F.count_distinct("tenant") > 1, "quarantine").otherwise(F.min("tenant")).alias("tenant"))
    return d.join(g, "source", "left").select("doc_id", F.coalesce("tenant", F.lit("unassigned")).alias("tenant"))


@query("""
SELECT l1.l_orderkey AS a, l2.l_orderkey AS b, count(DISTINCT l1.l_partkey) AS shared FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) l1
JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) l2 ON l1.l_partkey = l2.l_partkey AND l1.l_orderkey < l2.l_orderkey GROUP BY 1, 2 HAVING count(*) >= 2
""")
def shared_reference_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that share at least two parts."""
    return sharing(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("ref")))


#: References of a document up to which it makes pairs of them (some 20,000 then).
FEW = 200


def sharing(mentions: DataFrame, few: int = FEW) -> DataFrame:
    """(a, b, shared): the documents that share two references or more, of mentions (doc, ref).

    They meet by pairs of references instead of by one: what two documents with s shared references have in common is s (s - 1) / 2
    pairs, so a reference that half of all documents hold makes no pairs of documents that aren't in the result. A document of more
    than few references would make too many pairs of them: it meets the others by single references, of which none is collected. Such documents are few, as
    there are at most mentions / few of them.
    """
    m = mentions.filter("doc IS NOT NULL AND ref IS NOT NULL").select("doc", "ref").distinct()
    sizes = m.groupBy("doc").agg(count().alias("n"))
    long_ = sizes.filter(F.col("n") > few).select("doc")
    refs = m.join(long_, "doc", "left_anti").groupBy("doc").agg(F.array_sort(F.collect_set("ref")).alias("refs"))
    two = F.flatten(F.transform("refs", lambda x, i: F.transform(F.slice("refs", i + 2, F.size("refs")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    keys = refs.select("doc", F.explode(two).alias("k")).select("doc", "k.x", "k.y")
    a, b = keys.select(F.col("doc").alias("a"), "x", "y"), keys.select(F.col("doc").alias("b"), "x", "y")
    n = a.join(b, ["x", "y"]).filter("a < b").groupBy("a", "b").agg(count().alias("n"))
    short = n.select("a", "b", F.round((1 + F.sqrt(1 + 8 * F.col("n"))) / 2).cast("long").alias("shared"))
    own = m.join(long_, "doc", "left_semi").select(F.col("doc").alias("x"), "ref")
    met = own.join(m.select(F.col("doc").alias("y"), "ref"), "ref").filter("x <> y").groupBy("x", "y").agg(count().alias("shared")).filter("shared >= 2")
    # two long documents find each other twice
    return short.unionByName(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared").distinct())


def hops(edges: DataFrame, most: int) -> DataFrame:
    """(order, hops) of the orders within most hops of the first, over shared suppliers; edges is (o, s).

    Only keys are walked: those reached last are joined to the edges, made distinct before the next join, and not met again.
    """
    e = edges.filter("o IS NOT NULL AND s IS NOT NULL").distinct()
    last = e.agg(F.min("o").alias("o")).filter("o IS NOT NULL")
    seen = last.select("o", F.lit(0).cast("long").alias("hops"))
    for k in range(1, most + 1):
        over = e.join(last, "o", "left_semi").select("s").distinct()
        last = e.join(over, "s", "left_semi").select("o").distinct().join(seen, "o", "left_anti")
        seen = seen.unionByName(last.select("o", F.lit(k).cast("long").alias("hops")))
    return seen.select(F.col("o").alias("order"), "hops")


@query("""
WITH e AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem),
s1 AS (SELECT DISTINCT s FROM e WHERE o = (SELECT min(o) FROM e)), h1 AS (SELECT DISTINCT o FROM e WHERE s IN (SELECT s FROM s1)),
s2 AS (SELECT DISTINCT s FROM e WHERE o IN (SELECT o FROM h1)), h2 AS (SELECT DISTINCT o FROM e WHERE s IN (SELECT s FROM s2))
SELECT o AS "order", CASE WHEN o = (SELECT min(o) FROM e) THEN 0 WHEN o IN (SELECT o FROM h1) THEN 1 ELSE 2 END::BIGINT AS hops FROM h2
""")
def related_k_hop_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders within two hops of the first, over shared suppliers, among all orders."""
    return hops(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s")), 2)
