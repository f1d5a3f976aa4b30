"""Budgets, orders, invoices and their lines: filters, look-ups, chains, roll-ups and issues over them.

The records are views of the given tables (budgets, lines, invoices); operators take them, or any table of the same columns,
and parameters. Each registered query is one call, with its SQL beside it.
"""

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import columns as C
from lectern.operators.business import GROSS, GROSS_SQL, count, money, sharing
from lectern.operators.registry import Registry
from lectern.sources.tables import table

query = Registry()

DEC = "::DECIMAL(18,6)"
BASE, BASE_SQL = "l_extendedprice * (1 - l_discount)", "round(l_extendedprice * (1 - l_discount), 6)" + DEC
VAT, VAT_SQL = "l_extendedprice * (1 - l_discount) * l_tax", "round(l_extendedprice * (1 - l_discount) * l_tax, 6)" + DEC

BUDGETS_SQL = """budgets AS (SELECT o_orderkey AS id, 'PRE-' || lpad(o_orderkey::VARCHAR, 7, '0') AS number, c_name AS client, o_orderdate::DATE AS date, o_totalprice AS total,
 o_orderstatus AS status, o_orderstatus = 'F' AS accepted FROM orders LEFT JOIN customer ON c_custkey = o_custkey)"""
LINES_SQL = """lines AS (SELECT l_orderkey AS parent_id, l_linenumber::BIGINT AS line, p_brand || '-' || p_partkey AS reference, p_name AS description, l_quantity AS quantity,
 floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS unit_price, l_extendedprice AS total, l_suppkey AS supplier_id FROM lineitem LEFT JOIN part ON p_partkey = l_partkey)"""
INVOICES_SQL = f"""invoices AS (SELECT order_id, supplier_id, 'INV-' || order_id || '-' || supplier_id AS number, s_name AS supplier, date, base, vat, total FROM
 (SELECT l_orderkey AS order_id, l_suppkey AS supplier_id, max(l_shipdate)::DATE AS date, sum({BASE_SQL})::DOUBLE AS base, sum({VAT_SQL})::DOUBLE AS vat, sum({GROSS_SQL})::DOUBLE AS total
  FROM lineitem GROUP BY 1, 2) LEFT JOIN supplier ON s_suppkey = supplier_id)"""


def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, number, client, date, total, status, accepted), one row an order."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    rows = o.join(c, F.col("c_custkey") == F.col("o_custkey"), "left")
    number = F.concat(F.lit("PRE-"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0"))
    return rows.select(
        F.col("o_orderkey").alias("id"), number.alias("number"), F.col("c_name").alias("client"), F.to_date("o_orderdate").alias("date"),
        F.col("o_totalprice").alias("total"), F.col("o_orderstatus").alias("status"), (F.col("o_orderstatus") == "F").alias("accepted"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(parent_id, line, reference, description, quantity, unit_price, total, supplier_id)."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name"), F.col("p_partkey") == F.col("l_partkey"), "left")
    return rows.select(
        F.col("l_orderkey").alias("parent_id"), F.col("l_linenumber").cast("long").alias("line"), F.concat("p_brand", F.lit("-"), F.col("p_partkey").cast("string")).alias("reference"),
        F.col("p_name").alias("description"), F.col("l_quantity").alias("quantity"), (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5) / 100).alias("unit_price"),
        F.col("l_extendedprice").alias("total"), F.col("l_suppkey").alias("supplier_id"),
    )


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order_id, supplier_id, number, supplier, date, base, vat, total): what one supplier has of one order. Lines are summed before names are joined."""
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_id"), F.col("l_suppkey").alias("supplier_id")).agg(
        F.to_date(F.max("l_shipdate")).alias("date"), money(BASE).alias("base"), money(VAT).alias("vat"), money(GROSS).alias("total")
    )
    rows = sums.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), F.col("s_suppkey") == F.col("supplier_id"), "left")
    number = F.concat_ws("-", F.lit("INV"), F.col("order_id").cast("string"), F.col("supplier_id").cast("string"))
    return rows.select("order_id", "supplier_id", number.alias("number"), F.col("s_name").alias("supplier"), "date", "base", "vat", "total")


def decimal_sum(c: str) -> Column:
    return F.sum(F.round(c, 6).cast("decimal(18,6)")).cast("double")


# filters

#: The filters that records know, and what each asks.
FILTERS = ("text", "client", "supplier", "status", "accepted", "min_total", "max_total", "year", "month", "ids")


def money_filters(question: str) -> dict:
    """A question's filters: amounts as Spaniards write them, the year, the month's name, accepted or not. Negatives are looked for last, so they win."""
    q = question.lower()
    amount = r"([0-9][0-9.]*(?:,[0-9]{1,2})?)"
    number = lambda s: float(s.replace(".", "").replace(",", "."))
    out: dict = {}
    for key, words in (("min_total", r"(?:más de|mas de|superior(?:es)? a|mayor(?:es)? (?:de|a|que)|desde)"), ("max_total", r"(?:menos de|inferior(?:es)? a|menor(?:es)? (?:de|a|que)|hasta)")):
        if m := re.search(words + r"\s+" + amount, q):
            out[key] = number(m[1].rstrip("."))
    if m := re.search(r"\b(?:en|de|del|año)\s+((?:19|20)[0-9]{2})\b", q):
        out["year"] = int(m[1])
    for k, name in enumerate(C.MONTHS, 1):
        if re.search(rf"\b{name}\b", q):
            out["month"] = k
    if "aceptad" in q:
        out["accepted"] = True
    if re.search(r"\b(?:no|sin)\s+acepta", q):
        out["accepted"] = False
    return out


def conditions(filters: dict, columns: list[str]) -> Column:
    """The conjunction of filters, for a table of the columns. Unknown and null filters are left out; one whose column isn't there is an error."""
    known = {k: v for k, v in filters.items() if k in FILTERS and v is not None}
    like = lambda c, v: F.lower(F.col(c)).contains(str(v).lower())
    of = {
        "text": lambda v: reduce(lambda a, b: a | b, [like(c, v) for c in ("number", "client", "supplier") if c in columns]),
        "client": lambda v: like("client", v),
        "supplier": lambda v: like("supplier", v),
        "status": lambda v: F.col("status").isin(v if isinstance(v, list) else [v]),
        "accepted": lambda v: F.col("accepted") == bool(v),
        "min_total": lambda v: F.col("total") >= v,
        "max_total": lambda v: F.col("total") <= v,
        "year": lambda v: F.year("date") == v,
        "month": lambda v: F.month("date") == v,
        "ids": lambda v: F.col("id").isin(list(v)),
    }
    return reduce(lambda a, b: a & b, [F.coalesce(of[k](v), F.lit(False)) for k, v in sorted(known.items())], F.lit(True))


def aggregate(records: DataFrame, kind: str, filters: dict, by: str | None = None, can_view_prices: bool = True) -> DataFrame:
    """count, total, top (ten by total) or by (a column, null as "(none)", ten by total) of the records that pass the filters.

    Without the right to see prices, kinds that show them give no rows.
    """
    rows = records.filter(conditions(filters, records.columns))
    if kind != "count" and not can_view_prices:
        rows = rows.filter(F.lit(False))
    if kind == "count":
        return rows.agg(count().alias("n"))
    if kind == "total":
        out = rows.agg(count().alias("n"), F.coalesce(decimal_sum("total"), F.lit(0.0)).alias("total"))
        return out if can_view_prices else out.filter(F.lit(False))
    if kind == "top":
        return rows.select("number", "total").orderBy(F.desc("total"), "number").limit(10)
    if kind == "by":
        sums = rows.groupBy(F.coalesce(F.col(by), F.lit("(none)")).alias(by)).agg(count().alias("n"), decimal_sum("total").alias("total"))
        return sums.orderBy(F.desc("total"), by).limit(10)
    raise ValueError(f"unknown kind {kind}")


@query(f"WITH {BUDGETS_SQL} SELECT count(*) AS n FROM budgets WHERE accepted AND contains(lower(client), '7')")
def budget_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate(budgets(spark, sf_dir), "count", {"accepted": True, "client": "7"})


@query(f"WITH {BUDGETS_SQL} SELECT count(*) AS n, coalesce(sum(round(total, 6)::DECIMAL(18,6))::DOUBLE, 0) AS total FROM budgets WHERE NOT accepted AND total >= 10000.5 AND year(date) = 1996 AND month(date) = 3")
def aggregate_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question's filters are read from its words."""
    return aggregate(budgets(spark, sf_dir), "total", money_filters("Total de presupuestos no aceptados de más de 10.000,50 en marzo de 1996"))


@query(f"WITH {INVOICES_SQL} SELECT number, total FROM invoices WHERE year(date) = 1995 ORDER BY total DESC, number LIMIT 10")
def invoice_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report."""
    return aggregate(invoices(spark, sf_dir), "top", {"year": 1995})


@query(f"WITH {INVOICES_SQL} SELECT coalesce(supplier, '(none)') AS supplier, count(*) AS n, sum(round(total, 6)::DECIMAL(18,6))::DOUBLE AS total FROM invoices WHERE total >= 1000 GROUP BY 1 ORDER BY total DESC, supplier LIMIT 10")
def order_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report."""
    return aggregate(invoices(spark, sf_dir), "by", {"min_total": 1000}, by="supplier")


@query(f"""
WITH {BUDGETS_SQL}, {INVOICES_SQL}, b AS (SELECT b.*, id IN (SELECT order_id FROM invoices) AS invoiced FROM budgets b)
SELECT invoiced, status, count(*) AS n, sum(round(total, 6)::DECIMAL(18,6))::DOUBLE AS total FROM b GROUP BY 1, 2
""")
def order_aggregate_invoiced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with and without invoices, by status: one distinct list of invoiced orders serves both."""
    b, known = budgets(spark, sf_dir), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id")).distinct()
    rows = b.join(known, F.col("id") == F.col("order_id"), "left").withColumn("invoiced", F.col("order_id").isNotNull())
    return rows.groupBy("invoiced", "status").agg(count().alias("n"), decimal_sum("total").alias("total"))


@query(f"WITH {INVOICES_SQL} SELECT year(date)::BIGINT AS year, month(date)::BIGINT AS month, supplier, sum(round(total, 6)::DECIMAL(18,6))::DOUBLE AS total, count(*) AS n FROM invoices GROUP BY ROLLUP (year(date), month(date), supplier)")
def invoice_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By year, month and supplier, with all subtotals."""
    rows = invoices(spark, sf_dir).select(F.year("date").cast("long").alias("year"), F.month("date").cast("long").alias("month"), "supplier", "total")
    return rows.rollup("year", "month", "supplier").agg(decimal_sum("total").alias("total"), count().alias("n"))


# look-ups and lists


def search(records: DataFrame, filters: dict, limit: int, order: list[Column]) -> DataFrame:
    """The first records that pass the filters: a bounded list, as an interface shows it."""
    return records.filter(conditions(filters, records.columns)).orderBy(*order).limit(limit)


@query(f"WITH {BUDGETS_SQL} SELECT id, number, client, status, total FROM budgets WHERE (contains(lower(number), '00012') OR contains(lower(client), '00012')) AND status IN ('O', 'P') ORDER BY id LIMIT 20")
def search_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = budgets(spark, sf_dir).select("id", "number", "client", "status", "total")
    return search(rows, {"text": "00012", "status": ["O", "P"]}, 20, [F.asc("id")])


@query(f"WITH {INVOICES_SQL} SELECT number, supplier, order_id, total FROM invoices WHERE contains(lower(supplier), '0003') OR contains(lower(number), '0003') ORDER BY order_id, number LIMIT 20")
def search_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(invoices(spark, sf_dir).select("number", "supplier", "order_id", "total"), {"text": "0003"}, 20, [F.asc("order_id"), F.asc("number")])


@query(f"WITH {BUDGETS_SQL} SELECT number, client, date, total FROM budgets WHERE accepted ORDER BY date DESC, number DESC LIMIT 10")
def recent_accepted_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(budgets(spark, sf_dir).select("number", "client", "date", "total", "accepted"), {"accepted": True}, 10, [F.desc("date"), F.desc("number")]).drop("accepted")


def by_number(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (asked) with the record whose number it is: exactly, or else without accents, white space, dashes, dots, slashes, commas and case.

    Of several the one of least id. One that nothing matches has nulls.
    """
    key = lambda c: F.regexp_replace(C.fold(c), r"[\s\-_/.,]", "")
    least = lambda c: records.groupBy(c.alias("k")).agg(F.min("id").alias("found"))
    exact = wanted.join(least(F.col("number")), F.col("asked") == F.col("k"), "left").select("asked", F.col("found").alias("exact"))
    rows = exact.join(least(key(F.col("number"))), key(F.col("asked")) == F.col("k"), "left").select("asked", F.coalesce("exact", "found").alias("found"))
    return rows.join(records, F.col("found") == F.col("id"), "left").drop("found")


@query(f"""
WITH {BUDGETS_SQL}, w AS (SELECT DISTINCT CASE id % 3 WHEN 0 THEN number WHEN 1 THEN lower(replace(number, '-', ' / ')) ELSE 'x' || number END AS asked FROM budgets)
SELECT asked, id, client, total FROM w LEFT JOIN budgets ON regexp_replace(lower(number), '[\\s\\-_/.,]', '', 'g') = regexp_replace(lower(asked), '[\\s\\-_/.,]', '', 'g')
""")
def budget_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every budget is asked for: as written, otherwise written, and by a number that isn't there."""
    b = budgets(spark, sf_dir)
    other = F.lower(F.replace(F.col("number"), F.lit("-"), F.lit(" / ")))
    asked = F.when(F.col("id") % 3 == 0, F.col("number")).when(F.col("id") % 3 == 1, other).otherwise(F.concat(F.lit("x"), F.col("number")))
    return by_number(b, b.select(asked.alias("asked")).distinct()).select("asked", "id", "client", "total")


@query(f"""
WITH {LINES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY line, reference, total, quantity) AS k FROM lines)
SELECT parent_id AS budget, line, reference, description, quantity, unit_price, total FROM r WHERE k <= 3
""")
def budget_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three lines of each budget: a report of bounded length a budget."""
    w = W.partitionBy("parent_id").orderBy("line", "reference", "total", "quantity")
    rows = lines(spark, sf_dir).withColumn("k", F.row_number().over(w)).filter("k <= 3")
    return rows.select(F.col("parent_id").alias("budget"), "line", "reference", "description", "quantity", "unit_price", "total")


@query(f"WITH {INVOICES_SQL}, {BUDGETS_SQL} SELECT i.number AS invoice, i.total AS invoiced, b.number AS budget, b.client, b.total AS budgeted FROM invoices i LEFT JOIN budgets b ON b.id = i.order_id")
def invoice_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice, order and budget, the latter two optional."""
    i, b = invoices(spark, sf_dir).alias("i"), budgets(spark, sf_dir).alias("b")
    rows = i.join(b, F.col("b.id") == F.col("i.order_id"), "left")
    return rows.select(F.col("i.number").alias("invoice"), F.col("i.total").alias("invoiced"), F.col("b.number").alias("budget"), "b.client", F.col("b.total").alias("budgeted"))


@query(f"""
WITH {BUDGETS_SQL}, t AS (SELECT id AS at FROM budgets)
SELECT number, lag(number) OVER (ORDER BY id) AS before, lead(number) OVER (ORDER BY id) AS after FROM budgets
""")
def neighbouring_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number before and after each, by id: runs of 100,000 ids are sorted apart, and each run's ends are joined to its neighbours'."""
    b = budgets(spark, sf_dir).select("id", "number", F.floor(F.col("id") / 100_000).alias("part"))
    ends = b.groupBy("part").agg(F.min_by("number", "id").alias("first"), F.max_by("number", "id").alias("last"))
    w = W.orderBy("part")  # one row a run
    ends = ends.select("part", F.lag("last").over(w).alias("left"), F.lead("first").over(w).alias("right"))
    own = W.partitionBy("part").orderBy("id")
    rows = b.select("part", "number", F.lag("number").over(own).alias("lag"), F.lead("number").over(own).alias("lead")).join(ends, "part")
    return rows.select("number", F.coalesce("lag", "left").alias("before"), F.coalesce("lead", "right").alias("after"))


@query(f"""
WITH {LINES_SQL} SELECT parent_id AS project, 'budget' AS kind, reference, description, quantity FROM lines WHERE quantity >= 45
UNION ALL SELECT parent_id, 'order', reference, description, quantity FROM lines WHERE quantity < 3
""")
def project_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budget and order lines of the projects in one list."""
    x = lines(spark, sf_dir)
    kind = F.when(F.col("quantity") >= 45, "budget").when(F.col("quantity") < 3, "order")
    return x.select(F.col("parent_id").alias("project"), kind.alias("kind"), "reference", "description", "quantity").filter("kind IS NOT NULL")


# checks


@query(f"""
WITH {LINES_SQL}, {INVOICES_SQL}, {BUDGETS_SQL},
s AS (SELECT parent_id, sum(round(total, 6)::DECIMAL(18,6))::DOUBLE AS lines FROM lines GROUP BY 1)
SELECT 'line' AS kind, parent_id || '/' || line AS what FROM lines WHERE abs(quantity * unit_price - total) > greatest(0.05, total * 0.02)
UNION ALL SELECT 'lines', id::VARCHAR FROM budgets JOIN s ON parent_id = id WHERE abs(total - lines) > greatest(0.5, total * 0.01)
UNION ALL SELECT 'vat', number FROM invoices WHERE abs(base + vat - total) > greatest(0.05, total * 0.02)
UNION ALL SELECT 'no vat', number FROM invoices WHERE vat = 0
""")
def extraction_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What doesn't add up: quantity times price, lines and total, base and VAT, or no VAT at all."""
    x, i, b = lines(spark, sf_dir), invoices(spark, sf_dir), budgets(spark, sf_dir)
    off = lambda a, t, least, share: F.abs(a - F.col(t)) > F.greatest(F.lit(least), F.col(t) * share)
    s = x.groupBy("parent_id").agg(decimal_sum("total").alias("lines"))
    one = x.filter(off(F.col("quantity") * F.col("unit_price"), "total", 0.05, 0.02)).select(F.lit("line").alias("kind"), F.concat_ws("/", F.col("parent_id").cast("string"), F.col("line").cast("string")).alias("what"))
    two = b.join(s, F.col("parent_id") == F.col("id")).filter(off(F.col("lines"), "total", 0.5, 0.01)).select(F.lit("lines").alias("kind"), F.col("id").cast("string").alias("what"))
    kinds = F.array_compact(F.array(F.when(off(F.col("base") + F.col("vat"), "total", 0.05, 0.02), F.lit("vat")), F.when(F.col("vat") == 0, F.lit("no vat"))))
    three = i.select(F.explode(kinds).alias("kind"), F.col("number").alias("what"))
    return one.unionByName(two).unionByName(three)


def ensure_issues(found: DataFrame, known: DataFrame) -> DataFrame:
    """The issues of found that known lacks, null-safe on (kind, budget, invoice); repeats of one are one."""
    on = reduce(lambda a, b: a & b, [found[c].eqNullSafe(known[c]) for c in ("kind", "budget", "invoice")])
    return found.join(known, on, "left_anti").dropDuplicates(["kind", "budget", "invoice"])


@query(f"""
WITH {INVOICES_SQL}, f AS (SELECT 'no vat' AS kind, order_id AS budget, number AS invoice FROM invoices WHERE vat = 0 UNION ALL SELECT 'large', order_id, NULL FROM invoices WHERE total > 200000)
SELECT DISTINCT kind, budget, invoice FROM f WHERE NOT (budget % 2 = 0 AND kind = 'large')
""")
def new_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of two rules, less those already known (here: the large ones of even budgets)."""
    i = invoices(spark, sf_dir)
    none = i.filter("vat = 0").select(F.lit("no vat").alias("kind"), F.col("order_id").alias("budget"), F.col("number").alias("invoice"))
    large = i.filter("total > 200000").select(F.lit("large").alias("kind"), F.col("order_id").alias("budget"), F.lit(None).cast("string").alias("invoice"))
    return ensure_issues(none.unionByName(large), large.filter("budget % 2 = 0"))


# roll-ups


@query(f"""
WITH {BUDGETS_SQL}, {LINES_SQL}, l AS (SELECT parent_id, count(*) AS n_lines, count(DISTINCT supplier_id) AS n_suppliers, sum(round(total, 6)::DECIMAL(18,6)) AS lines FROM lines GROUP BY 1)
SELECT client AS project, count(*) AS n_budgets, (count(*) FILTER (accepted))::BIGINT AS n_accepted, sum(round(total, 6)::DECIMAL(18,6))::DOUBLE AS budgeted, sum(lines)::DOUBLE AS lines,
 coalesce(sum(n_lines), 0)::BIGINT AS n_lines, min(date) AS first_date, max(date) AS last_date, (count(*) FILTER (parent_id IS NULL))::BIGINT AS without_lines FROM budgets LEFT JOIN l ON parent_id = id GROUP BY 1
""")
def project_dossier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A client's budgets in one row: counts, sums, dates and gaps. Lines are rolled up by budget before the join."""
    x = lines(spark, sf_dir).groupBy("parent_id").agg(count().alias("n_lines"), F.sum(F.round("total", 6).cast("decimal(18,6)")).alias("lines"))
    rows = budgets(spark, sf_dir).join(x, F.col("parent_id") == F.col("id"), "left")
    return rows.groupBy(F.col("client").alias("project")).agg(
        count().alias("n_budgets"), F.count_if("accepted").alias("n_accepted"), decimal_sum("total").alias("budgeted"), F.sum("lines").cast("double").alias("lines"),
        F.coalesce(F.sum("n_lines"), F.lit(0)).alias("n_lines"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count_if(F.col("parent_id").isNull()).alias("without_lines"),
    )


@query(f"""
WITH {BUDGETS_SQL}, {INVOICES_SQL}, i AS (SELECT order_id, sum(round(total, 6)::DECIMAL(18,6)) AS invoiced, count(*) AS n FROM invoices GROUP BY 1)
SELECT client AS project, sum(round(total, 6)::DECIMAL(18,6))::DOUBLE AS budgeted, coalesce(sum(invoiced), 0)::DOUBLE AS invoiced, coalesce(sum(n), 0)::BIGINT AS n_invoices FROM budgets LEFT JOIN i ON order_id = id GROUP BY 1
""")
def project_financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = invoices(spark, sf_dir).groupBy("order_id").agg(F.sum(F.round("total", 6).cast("decimal(18,6)")).alias("invoiced"), count().alias("n"))
    rows = budgets(spark, sf_dir).join(i, F.col("order_id") == F.col("id"), "left")
    return rows.groupBy(F.col("client").alias("project")).agg(decimal_sum("total").alias("budgeted"), F.coalesce(F.sum("invoiced"), F.lit(0)).cast("double").alias("invoiced"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_invoices"))


@query("""
SELECT split_part(p_brand, '#', 1) AS unit, lower(split_part(p_type, ' ', 1)) AS chapter, count(*) AS items, sum(round(l_quantity, 2)::DECIMAL(18,2))::DOUBLE AS quantity,
 sum(round(l_extendedprice, 2)::DECIMAL(18,2))::DOUBLE AS total FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY GROUPING SETS ((1), (2), ())
""")
def work_item_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work items by unit, by chapter, and in all, in one pass."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.split_part("p_brand", F.lit("#"), F.lit(1)).alias("unit"), F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))).alias("chapter"))
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice").join(p, F.col("p_partkey") == F.col("l_partkey"))
    return rows.groupingSets([["unit"], ["chapter"], []], "unit", "chapter").agg(count().alias("items"), decimal_sum("l_quantity").alias("quantity"), decimal_sum("l_extendedprice").alias("total"))


@query(f"""
WITH {BUDGETS_SQL}, {INVOICES_SQL}
SELECT (SELECT count(*) FROM budgets) AS budgets, (SELECT count(*) FROM budgets WHERE accepted) AS accepted, (SELECT count(*) FROM budgets WHERE accepted AND id NOT IN (SELECT order_id FROM invoices)) AS accepted_without_order,
 (SELECT count(*) FROM invoices) AS invoices, (SELECT count(*) FROM invoices WHERE vat = 0) AS without_vat, (SELECT count(*) FROM documents) AS documents, (SELECT count(DISTINCT client) FROM budgets) AS clients
""")
def admin_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headline counters, each table read once."""
    i = invoices(spark, sf_dir).select("order_id", "vat")
    b = budgets(spark, sf_dir).join(i.select("order_id").distinct(), F.col("order_id") == F.col("id"), "left")
    one = b.agg(count().alias("budgets"), F.count_if("accepted").alias("accepted"), F.count_if(F.col("accepted") & F.col("order_id").isNull()).alias("accepted_without_order"), F.count_distinct("client").alias("clients"))
    two, three = i.agg(count().alias("invoices"), F.count_if(F.col("vat") == 0).alias("without_vat")), table(spark, sf_dir, "documents").agg(count().alias("documents"))
    return one.join(F.broadcast(two)).join(F.broadcast(three))


@query(f"WITH {BUDGETS_SQL} SELECT client AS supplier, count(*) AS n, floor(quantile_cont(total, 0.5) * 100 + 0.5) / 100 AS median, max(total) AS most, round(stddev_samp(total), 4) AS spread FROM budgets GROUP BY 1 HAVING count(*) > 1")
def budget_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and spread of a client's budgets; exact percentiles, as a group is one client's."""
    rows = budgets(spark, sf_dir).groupBy(F.col("client").alias("supplier")).agg(
        count().alias("n"), (F.floor(F.percentile("total", 0.5) * 100 + 0.5) / 100).alias("median"), F.max("total").alias("most"), F.round(F.stddev_samp("total"), 4).alias("spread")
    )
    return rows.filter("n > 1")


# graph and revisions


@query(f"""
WITH {LINES_SQL}, {INVOICES_SQL}, e AS (SELECT 'order ' || order_id AS a, 'invoice ' || number AS b, 'invoiced' AS relation FROM invoices UNION SELECT 'order ' || parent_id, 'reference ' || reference, 'mentions' FROM lines)
SELECT a, b, relation FROM e
""")
def document_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between orders and their invoices, and orders and the references they mention. Two orders of one reference meet at its node, so no pairs are made."""
    i = invoices(spark, sf_dir).select(F.concat(F.lit("order "), F.col("order_id").cast("string")).alias("a"), F.concat(F.lit("invoice "), F.col("number")).alias("b"), F.lit("invoiced").alias("relation"))
    m = lines(spark, sf_dir).select(F.concat(F.lit("order "), F.col("parent_id").cast("string")).alias("a"), F.concat(F.lit("reference "), F.col("reference")).alias("b"), F.lit("mentions").alias("relation"))
    return i.unionByName(m).distinct()


@query(f"""
WITH {LINES_SQL}, m AS (SELECT DISTINCT reference, parent_id FROM lines), n AS (SELECT reference, count(*) AS documents, min(parent_id) AS first, max(parent_id) AS last FROM m GROUP BY 1)
SELECT reference, documents, first, last, round(1.0 / documents, 6)::DOUBLE AS confidence, CASE WHEN documents <= 20 THEN 'verified' ELSE 'pending' END AS status FROM n WHERE documents > 1
""")
def reference_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each shared reference as one node with its degree: a relation of many documents without their pairs; rare references are the sure ones."""
    n = lines(spark, sf_dir).select("reference", "parent_id").distinct().groupBy("reference").agg(count().alias("documents"), F.min("parent_id").alias("first"), F.max("parent_id").alias("last")).filter("documents > 1")
    return n.select("reference", "documents", "first", "last", F.round(1.0 / F.col("documents"), 6).alias("confidence"), F.when(F.col("documents") <= 20, "verified").otherwise("pending").alias("status"))


@query(f"""
WITH {LINES_SQL}, o AS (SELECT parent_id, line, reference, quantity FROM lines WHERE line % 4 <> 0), n AS (SELECT parent_id, line, reference, CASE WHEN line % 3 = 0 THEN quantity + 1 ELSE quantity END AS quantity FROM lines WHERE line % 5 <> 0)
SELECT coalesce(o.parent_id, n.parent_id) AS parent_id, coalesce(o.line, n.line) AS line, CASE WHEN o.line IS NULL THEN 'added' WHEN n.line IS NULL THEN 'removed' ELSE 'changed' END AS change, o.quantity AS before, n.quantity AS after
FROM o FULL JOIN n ON o.parent_id = n.parent_id AND o.line = n.line WHERE o.line IS NULL OR n.line IS NULL OR o.quantity <> n.quantity OR o.reference <> n.reference
""")
def revision_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two revisions of the lines differ in, by a full outer join."""
    x = lines(spark, sf_dir).select("parent_id", "line", "reference", "quantity")
    o, n = x.filter("line % 4 <> 0"), x.filter("line % 5 <> 0").withColumn("quantity", F.when(F.col("line") % 3 == 0, F.col("quantity") + 1).otherwise(F.col("quantity")))
    both = o.withColumn("o", F.lit(1)).alias("o").join(n.withColumn("n", F.lit(1)).alias("n"), ["parent_id", "line"], "full")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when((F.col("o.quantity") != F.col("n.quantity")) | (F.col("o.reference") != F.col("n.reference")), "changed")
    return both.select("parent_id", "line", change.alias("change"), F.col("o.quantity").alias("before"), F.col("n.quantity").alias("after")).filter("change IS NOT NULL")


@query(f"""
WITH {LINES_SQL}, m AS (SELECT DISTINCT parent_id AS doc, reference AS ref FROM lines), n AS (SELECT doc, count(*) AS n FROM m GROUP BY 1),
s AS (SELECT a.doc AS a, b.doc AS b, count(*) AS shared FROM m a JOIN m b ON a.ref = b.ref AND a.doc < b.doc GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT a, b, shared, round(shared / (x.n + y.n - shared), 6)::DOUBLE AS confidence, CASE WHEN shared / (x.n + y.n - shared) >= 0.5 THEN 'verified' ELSE 'pending' END AS status FROM s JOIN n x ON x.doc = a JOIN n y ON y.doc = b
""")
def proposed_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of documents that share two references or more, as sure as the Jaccard similarity of their references."""
    m = lines(spark, sf_dir).select(F.col("parent_id").alias("doc"), F.col("reference").alias("ref")).distinct()
    n = m.groupBy("doc").agg(count().alias("n"))
    rows = sharing(m).join(n.select(F.col("doc").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("doc").alias("b"), F.col("n").alias("nb")), "b")
    c = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    return rows.select("a", "b", "shared", F.round(c, 6).alias("confidence"), F.when(c >= 0.5, "verified").otherwise("pending").alias("status"))


def entity_id(tenant: str, name: str) -> Column:
    """A number of 60 bits out of an entity's key, so that runs at once, or a run again, give one entity one id."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x01", F.coalesce(F.col(tenant).cast("string"), F.lit("")), name), 256), 1, 15), 16, 10).cast("long")


def resolved(found: DataFrame, known: DataFrame, tenant: str, name: str) -> DataFrame:
    """(tenant, name, id, fresh) of every distinct entity of found: its id in known (tenant, name, id) if it is there, null tenants being one, else entity_id()."""
    f, k = found.select(tenant, name).distinct(), known.select(F.col(tenant).alias("kt"), F.col(name).alias("kn"), "id")
    rows = f.join(k, f[tenant].eqNullSafe(k["kt"]) & (f[name] == k["kn"]), "left")
    return rows.select(tenant, name, F.coalesce("id", entity_id(tenant, name)).alias("id"), F.col("id").isNull().alias("fresh"))


@query(f"""
WITH {LINES_SQL}, f AS (SELECT DISTINCT CASE WHEN parent_id % 5 = 0 THEN NULL ELSE parent_id % 3 END AS tenant, reference AS name FROM lines)
SELECT tenant, name, CASE WHEN length(name) % 2 = 0 THEN length(name) ELSE ('0x' || substr(sha256(coalesce(tenant::VARCHAR, '') || chr(1) || name), 1, 15))::BIGINT END AS id, length(name) % 2 <> 0 AS fresh FROM f
""")
def entities_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The references as entities of tenants, some of them known by an earlier run."""
    f = lines(spark, sf_dir).select(F.when(F.col("parent_id") % 5 != 0, F.col("parent_id") % 3).alias("tenant"), F.col("reference").alias("name")).distinct()
    known = f.filter("length(name) % 2 = 0").withColumn("id", F.length("name").cast("long"))
    return resolved(f, known, "tenant", "name")
