"""Fields, tables, work items, plans, mails and sections out of texts.

The given tables hold no such papers, so each query writes them from typed columns (render_*) and reads them again; the SQL
says what must come back. Extractors take a table with a text column and work line by line with DataFrame functions.
"""

import re
from email.utils import getaddresses
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lectern.functions import columns as C
from lectern.functions import text as T
from lectern.operators import patterns
from lectern.operators.business import count
from lectern.operators.records import BUDGETS_SQL, INVOICES_SQL, LINES_SQL, budgets, invoices, lines
from lectern.operators.registry import Registry
from lectern.operators.textops import spanish
from lectern.sources.tables import table

query = Registry()


def lines_of(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, line) of every line of each row's text; a null text has none."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


# Markdown tables

_RULE = r"^\|\s*(?::?-{2,}:?\s*\|\s*)*:?-{2,}:?\s*\|?$"


def cells(row: Column) -> Column:
    """The trimmed cells of a Markdown row, without its outer pipes."""
    return F.transform(F.split(F.regexp_replace(F.trim(row), r"^\|+|\|+$", ""), r"\|"), lambda x: F.trim(x))


def table_rows(text: Column) -> Column:
    """array<array<string>> of the first Markdown table of a text: its header, then its rows, cut or filled to the header's width.

    The header stands above the first line of dashes. A table ends at the first line without a pipe, and later tables of a text aren't read: what follows a table is
    mostly notes, which would come out as rows. Too many cells are joined
    to the last one. Rows without any content are left out. Null without a table.
    """
    rows = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rule = F.array_position(F.transform(rows, lambda x: x.rlike(_RULE)), True).cast("int")
    head, body = cells(F.get(rows, rule - 2)), F.slice(rows, rule + 1, F.size(rows))
    end = F.array_position(F.transform(body, lambda x: x.contains("|")), False).cast("int")
    body = F.when(end > 0, F.slice(body, F.lit(1), end - 1)).otherwise(body)

    def fitted(r: Column) -> Column:
        c, n = cells(r), F.size(head)
        more = F.concat(F.slice(c, F.lit(1), n - 1), F.array(F.array_join(F.slice(c, n, F.greatest(F.size(c) - n + 1, F.lit(0))), " | ")))
        return F.when(F.size(c) < n, F.concat(c, F.array_repeat(F.lit(""), n - F.size(c)))).when(F.size(c) > n, more).otherwise(c)

    whole = F.filter(F.transform(body, fitted), lambda r: F.exists(r, lambda x: x != ""))
    return F.when(rule > 1, F.concat(F.array(head), whole))


def has_table(text: Column) -> Column:
    """Whether table_rows() of a text isn't null: its first line of dashes has a line above it."""
    rows = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rule = lambda x: x.rlike(_RULE)
    return F.coalesce(C.bound(rows, lambda r: ~F.get(r, F.lit(0)).rlike(_RULE) & F.exists(r, rule)), F.lit(False))


#: What a column of a table of items is called, by what it holds.
ROLES = {
    "reference": "art|articulo|ref|referencia|sku|codigo|código|code",
    "description": "desc|descripcion|descripción|concepto|producto|denominacion|denominación|name|detalle",
    "quantity": "cant|cantidad|qty|quantity|uds|unidades",
    "unit": r"unidad|unit|u\.?\s?d\.?",
    "unit_price": r"precio\s*uni|precio\s*unidad|unit\s*price|pvp\s*uni|importe\s*uni",
    "total_price": r"total|subtotal|importe|pvp|amount|precio|precio\s*total",
}


def first_table(text: str | None) -> list[list[str]] | None:
    """table_rows() of a string."""
    rows = [r for r in (x.strip(" ") for x in (text or "").split("\n")) if r]
    rule = next((k for k, r in enumerate(rows) if _RULE_LINE.search(r)), -1)
    if rule < 1:
        return None
    split = lambda r: [x.strip(" ") for x in _PIPES.sub("", r).split("|")]
    head, body = split(rows[rule - 1]), []
    for r in rows[rule + 1 :]:
        if "|" not in r:
            break
        c, n = split(r), len(head)
        c = c + [""] * (n - len(c)) if len(c) <= n else [*c[: n - 1], " | ".join(c[n - 1 :])]
        if any(c):
            body.append(c)
    return [head, *body]


_RULE_LINE, _PIPES = re.compile(_RULE), re.compile(r"^\|+|\|+$")
_ROLE = {name: re.compile(f"(?:{words})") for name, words in ROLES.items()}


def items(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, item, reference, description, quantity, unit, unit_price, total_price) of the rows of each text's table that have a reference or a description.

    item counts from 0. Prices and quantities that can't be read are null. Texts go to Python once, in Arrow batches; as nested column expressions
    the same was copied into a plan of 65,000 characters.
    """
    names = list(ROLES)

    def run(batches):
        for b in batches:
            at, item, cells_ = [], [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                rows = first_table(t) if t and "|" in t else None
                if not rows:
                    continue
                roles = [next((r for r in names if _ROLE[r].fullmatch(h.lower())), None) for h in rows[0]]
                of = [roles.index(r) if r in roles else -1 for r in names]
                for i, c in enumerate(rows[1:]):
                    at.append(k)
                    item.append(i)
                    cells_.append([(c[j] or None) if j >= 0 else None for j in of])
                    if len(at) == 20_000:
                        yield batch(b, at, item, cells_)
                        at, item, cells_ = [], [], []
            yield batch(b, at, item, cells_)

    def batch(b, at, item, cells_):
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(item, pa.int64()), *[pa.array([c[j] for c in cells_], pa.string()) for j in range(len(names))]], ["key", "item", *names])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, item long, " + ", ".join(f"{n} string" for n in names))
    out = out.select(F.col("key").alias(key), "item", "reference", "description", T.quantity(F.col("quantity")).alias("quantity"), "unit", T.money(F.col("unit_price")).alias("unit_price"), T.money(F.col("total_price")).alias("total_price"))
    return out.filter("reference IS NOT NULL OR description IS NOT NULL")


def table_total(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, total): the price of the first row that is called TOTAL, else the greatest of the table."""
    i = items(df, key, text)
    named = F.upper(F.concat_ws(" ", "reference", "description")).contains("TOTAL")
    return i.groupBy(key).agg(F.coalesce(F.min_by(F.when(named, F.col("total_price")), F.when(named & F.col("total_price").isNotNull(), F.col("item"))), F.max("total_price")).alias("total"))


def render_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): a paper for each budget that has lines, of which there are few; their table is collected by budget."""
    x = lines(spark, sf_dir)
    number = lambda c: spanish(F.round(F.col(c) * 100).cast("long"))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "reference", F.regexp_replace("description", r"\|", "/"), F.col("quantity").cast("long").cast("string"), number("unit_price"), number("total")), F.lit(" |"))
    tables = x.groupBy("parent_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("line", "reference", "total", "quantity", row.alias("row"))))["row"], "\n").alias("rows"))
    b = budgets(spark, sf_dir).join(tables, F.col("parent_id") == F.col("id"))
    status = F.when(F.col("status") == "F", "aceptado").when(F.col("status") == "O", "no aceptado").otherwise("pendiente")
    total = spanish(F.round(F.col("total") * 100).cast("long"))
    head = F.concat(F.lit("# Presupuesto\nPresupuesto Nº: "), "number", F.lit("\nCliente: "), "client", F.lit("\nFecha:\n"), F.date_format("date", "d/M/yyyy"), F.lit("\nEstado: "), status)
    body = F.concat(F.lit("\n\n| Ref | Descripcion | Cantidad | Precio unidad | Total |\n| --- | :--- | ---: | --- | --- |\n"), "rows", F.lit("\n\nTotal presupuesto: "), total, F.lit(" €\nTotal: 1,00\n"))
    return b.select("id", F.concat(head, body).alias("text"))


def budget_fields(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, number, client, date, total, status, confidence) out of each paper; null where it says nothing."""
    t = F.col(text)
    f = df.select(
        key, T.first_with_digit(t, [r"(?im)^presupuesto\s+n[º°o.]*\s*:?\s*(\S+)", r"(?i)\b(PRE-[0-9]+)\b"]).alias("number"), T.labelled_line(t, "cliente").alias("client"),
        T.first_date(t, "fecha").alias("date"), T.total_amount(t).alias("total"), T.stated_status(t).alias("status"), has_table(t).alias("has_lines"),
    )
    present = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in ("number", "client", "date", "total")])
    return f.select(key, "number", "client", "date", "total", "status", F.round(T.field_confidence(F.lit(None).cast("double"), present, F.col("has_lines")), 4).alias("confidence"))


@query(f"""
WITH {BUDGETS_SQL} SELECT id, number, client, date, total, CASE status WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'rejected' ELSE 'pending' END AS status, 0.89::DOUBLE AS confidence
FROM budgets WHERE id IN (SELECT l_orderkey FROM lineitem)
""")
def budget_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget_fields(render_budgets(spark, sf_dir), "id")


@query(f"""
WITH {LINES_SQL} SELECT parent_id AS id, (row_number() OVER (PARTITION BY parent_id ORDER BY line, reference, total, quantity) - 1)::BIGINT AS item, reference, replace(description, '|', '/') AS description, quantity, NULL::VARCHAR AS unit, unit_price, total AS total_price FROM lines
""")
def line_item_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(render_budgets(spark, sf_dir), "id")


@query(f"WITH {LINES_SQL} SELECT parent_id AS id, max(total) AS total FROM lines GROUP BY 1")
def table_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_total(render_budgets(spark, sf_dir), "id")


def render_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(number, text): a paper for each invoice, without a table."""
    i = invoices(spark, sf_dir)
    number = lambda c: spanish(F.round(F.col(c) * 100).cast("long"))
    return i.select("number", F.concat(
        F.lit("FACTURA\nFactura: "), "number", F.lit("\nProveedor: "), "supplier", F.lit(" S.L.\nNIF "), F.lpad(F.col("supplier_id").cast("string"), 8, "0"), F.lit("T\nFecha factura: "), F.date_format("date", "dd-MM-yyyy"),
        F.lit("\nPedido: "), F.col("order_id").cast("string"), F.lit("\nBase imponible: "), number("base"), F.lit(" €\nIVA: "), number("vat"), F.lit(" €\nTotal factura: "), number("total"), F.lit(" €\n"),
    ).alias("text"))


def invoice_fields(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, supplier, tax_id, date, base, vat, total, order_number, issues) out of each paper; issues names what doesn't add up or is missing."""
    t = F.col(text)
    f = df.select(
        key, T.labelled_line(t, "proveedor").alias("supplier"), F.nullif(F.regexp_extract(t, r"(?=[0-9])\b([0-9]{8}[A-Z])\b", 1), F.lit("")).alias("tax_id"), T.first_date(t, "fecha factura").alias("date"),
        T.labelled_amount(t, r"base\s+imponible").alias("base"), T.labelled_amount(t, "iva").alias("vat"), T.total_amount(t).alias("total"), T.labelled_line(t, "pedido").alias("order_number"),
    )
    off = F.abs(F.col("base") + F.col("vat") - F.col("total")) > F.greatest(F.lit(0.05), F.col("total") * 0.02)
    issues = F.array_join(F.array_compact(F.array(F.when(off, F.lit("total")), F.when(F.col("vat").isNull() | (F.col("vat") == 0), F.lit("vat")))), ",")
    return f.withColumn("issues", issues)


@query(f"""
WITH {INVOICES_SQL} SELECT number, supplier || ' S.L.' AS supplier, lpad(supplier_id::VARCHAR, 8, '0') || 'T' AS tax_id, date, round(base, 2) AS base, round(vat, 2) AS vat, round(total, 2) AS total, order_id::VARCHAR AS order_number,
 CASE WHEN round(vat, 2) = 0 THEN 'vat' ELSE '' END AS issues FROM invoices
""")
def invoice_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invoice_fields(render_invoices(spark, sf_dir), "number")


def order_key(number: Column) -> Column:
    """The key that is written as a number is without its leading zeros; null if none is."""
    return C.bound(F.regexp_replace(number, "^0+(?=.)", ""), lambda n: C.bound(n.try_cast("long"), lambda k: F.when(k.cast("string") == n, k)))


@query(f"WITH {INVOICES_SQL} SELECT i.number, o.o_orderkey AS order_id, o.o_totalprice AS ordered FROM invoices i JOIN orders o ON o.o_orderkey = i.order_id")
def related_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order that an invoice's paper names, by its number in normal form.

    Orders' keys are written in normal form, so a number that is written as a key is its own normal form, and one equi-join finds those too. The number comes out of explode(),
    below which the join's filter isn't pushed: there each paper would be written and read a second time.
    """
    f = invoice_fields(render_invoices(spark, sf_dir), "number").select("number", F.explode(F.array(order_key(F.concat(F.lit("0"), "order_number")))).alias("named"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("ordered"))
    return f.join(o, F.col("named") == F.col("order_id")).select("number", "order_id", "ordered")


# work items: chapters, and items that carry their chapter


def work_items(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, code, parent, chapter, unit, description, quantity, unit_price, total) of each text's work items.

    A chapter is a line of a code and a title without numbers at its end; an item has a code, a unit, a description and three
    numbers. An item's chapter is the last one above it; its parent is its code without the last part.
    """
    x = lines_of(df, key, text)
    number = r"(\d[\d.]*(?:,\d+)?)"
    pattern = rf"^\s*(\d+(?:\.\d+)+)\s+(m2|m3|ml|ud|kg|h)\s+(.*?)\s+{number}\s+{number}\s+{number}\s*$"
    part = lambda k: F.regexp_extract("line", pattern, k)
    title = F.nullif(F.regexp_extract("line", r"^\s*\d+(?:\.\d+)*\.?\s+(\p{L}[^\d]*?)\s*$", 1), F.lit(""))
    above = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("chapter", F.last(title, ignorenulls=True).over(above)).filter(F.col("line").rlike(pattern))
    parse = lambda k: T.work_number(part(k))
    code = part(1)
    return x.select(key, code.alias("code"), F.regexp_extract(code, r"^(.*)\.\d+$", 1).alias("parent"), "chapter", part(2).alias("unit"), part(3).alias("description"), parse(4).alias("quantity"), parse(5).alias("unit_price"), parse(6).alias("total"))


@query(f"""
WITH {LINES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY line, reference, total, quantity) AS k FROM lines), c AS (SELECT *, (k + 1) // 2 AS c FROM n)
SELECT parent_id AS id, c || '.' || k AS code, c::VARCHAR AS parent, CASE WHEN c % 2 = 1 THEN 'Obra' ELSE 'Instalaciones y otros' END AS chapter, 'm2' AS unit, description, quantity, unit_price, total FROM c
""")
def work_item_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as work items, two to a chapter, written and read again."""
    k = F.row_number().over(W.partitionBy("parent_id").orderBy("line", "reference", "total", "quantity"))
    x = lines(spark, sf_dir).withColumn("k", k).withColumn("c", F.floor((F.col("k") + 1) / 2))
    number = lambda c: spanish(F.round(F.col(c) * 100).cast("long"))
    chapter = F.when(F.col("k") % 2 == 1, F.concat(F.col("c").cast("string"), F.lit("  "), F.when(F.col("c") % 2 == 1, "Obra").otherwise("Instalaciones y otros"), F.lit("\n"))).otherwise("")
    row = F.concat(chapter, F.lit(" "), F.col("c").cast("string"), F.lit("."), F.col("k").cast("string"), F.lit(" m2 "), "description", F.lit("  "), number("quantity"), F.lit(" "), number("unit_price"), F.lit(" "), number("total"))
    texts = x.groupBy(F.col("parent_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", row.alias("row")))), lambda r: r["row"]), "\n").alias("text"))
    return work_items(texts, "id")


# plans


def plan_fields(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, scale, rooms, dimensions, phase, likely, confidence): what a plan's text says.

    rooms are "name=area" in square metres, dimensions in metres, both distinct, sorted and joined; likely by a scale, or else by
    how many plan words and dimensions there are.
    """
    t = F.col(text)
    scale = F.nullif(F.regexp_extract(t, r"(?i)\b(?:escala|scale|e)\s*[:=]?\s*1\s*[:/]\s*(\d{1,5})\b", 1), F.lit("")).cast("long")
    rooms = F.transform(F.regexp_extract_all(t, F.lit(r"(?im)^(\p{L}[\p{L} ]*?)[ :]+(\d+(?:[.,]\d+)?)\s*m(?:2|²)"), 0), lambda x: F.concat(F.trim(F.regexp_extract(x, r"^(\p{L}[\p{L} ]*?)[ :]+\d", 1)), F.lit("="), F.replace(F.regexp_extract(x, r"(\d+(?:[.,]\d+)?)\s*m", 1), F.lit(","), F.lit("."))))
    dims = F.transform(F.regexp_extract_all(t, F.lit(r"(?i)(?<![\d.,:/])(\d+(?:[.,]\d+)?)\s*(?:mm|cm|m)(?![\p{L}\d²])"), 0), lambda x: F.round(T.metres(T.quantity(F.regexp_extract(x, r"^([\d.,]+)", 1)), F.regexp_extract(x, r"(mm|cm|m)$", 1)), 4))
    words = F.size(F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"\b(planta|alzado|seccion|sección|cota|plano|detalle)\b"), 1)))
    phase = F.when(t.rlike(r"(?i)\banteproyecto\b"), "preliminary").when(t.rlike(r"(?i)proyecto\s+b[aá]sico"), "basic").when(t.rlike(r"(?i)proyecto\s+de\s+ejecuci[oó]n|\bejecuci[oó]n\b"), "construction")
    confidence = F.when(scale.isNotNull(), 0.9).when(words >= 3, 0.7).when((words >= 2) & (F.size(dims) >= 3), 0.6).when(F.size(dims) >= 6, 0.5).otherwise(0.0)
    out = df.select(key, scale.alias("scale"), F.array_join(F.array_sort(F.array_distinct(rooms)), ";").alias("rooms"), F.array_join(F.array_sort(F.array_distinct(dims)).cast("array<string>"), ";").alias("dimensions"), phase.alias("phase"), confidence.alias("confidence"))
    return out.withColumn("likely", F.col("confidence") > 0)


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size * 5 END::BIGINT AS scale, 'Cocina=' || p_size || '.5;Salon grande=' || (p_size + 10) || '.25' AS rooms, '3.2;' || (p_size + 4) || '.0' AS dimensions,
 CASE p_partkey % 2 WHEN 0 THEN 'basic' ELSE 'construction' END AS phase, CASE WHEN p_partkey % 3 = 0 THEN 0.7 ELSE 0.9 END::DOUBLE AS confidence, true AS likely FROM part
""")
def plan_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan's text for each part, written and read again."""
    n, k = F.col("p_size").cast("string"), F.col("p_partkey")
    scale = F.when(k % 3 == 0, "sin dato").otherwise(F.concat(F.lit("Escala 1:"), (F.col("p_size") * 5).cast("string")))
    phase = F.when(k % 2 == 0, "Proyecto básico").otherwise("Proyecto de ejecución")
    text = F.concat(F.lit("Plano de planta, alzado y detalle\n"), scale, F.lit("\n"), phase, F.lit("\nCocina: "), n, F.lit(",5 m2\nSalon grande "), (F.col("p_size") + 10).cast("string"), F.lit(".25 m²\nCota 320 cm y "), (F.col("p_size") + 4).cast("string"), F.lit(" m, 3,2 m\n"))
    return plan_fields(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "p_partkey")


# sections and specifications of technical papers


def sections(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, code, level, title, path, body) of the numbered sections of each text, body being the lines up to the next one.

    path joins the titles of the codes that a code begins with. Lines before the first section belong to none and are left out.
    """
    pattern = r"^\s*(\d+(?:\.\d+)*)\.?\s+(\p{Lu}.{0,78}[^.;,:])\s*$"
    x = lines_of(df, key, text).withColumn("code", F.nullif(F.regexp_extract("line", pattern, 1), F.lit("")))
    above = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("at", F.count("code").over(above)).filter("at > 0")
    s = x.groupBy(key, "at").agg(
        F.max("code").alias("code"), F.max(F.when(F.col("code").isNotNull(), F.regexp_extract("line", pattern, 2))).alias("title"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("code").isNull() & (F.trim("line") != ""), F.struct("pos", "line")))), lambda r: r["line"]), "\n").alias("body"),
    )
    titles = s.select(F.col(key).alias("k"), F.col("code").alias("c"), F.col("title").alias("t")).dropDuplicates(["k", "c"])
    parts = F.split("code", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    long = s.select(key, "at", F.explode(prefixes).alias("prefix")).join(titles, (F.col(key) == F.col("k")) & (F.col("prefix") == F.col("c")))
    paths = long.groupBy(F.col(key).alias("k"), F.col("at").alias("a")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.length("prefix").alias("n"), F.col("t").alias("t")))), lambda r: r["t"]), " → ").alias("path"))
    return s.join(paths, (F.col(key) == F.col("k")) & (F.col("at") == F.col("a"))).select(key, "code", F.size(parts).cast("long").alias("level"), "title", "path", "body")


def specifications(df: DataFrame) -> DataFrame:
    """df with material, thickness_cm, fire and standards read from body; null where it says nothing, standards sorted and joined."""
    b = F.col("body")
    material = F.nullif(F.lower(F.regexp_extract(b, r"(?i)\b(hormig[oó]n|acero|madera|yeso laminado|lana mineral|aluminio)\b", 1)), F.lit(""))
    fire = F.nullif(F.upper(F.regexp_extract(b, r"(?i)\b(R?EI[- ]?\d{2,3})\b", 1)), F.lit(""))
    standards = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(b, F.lit(r"\b((?:UNE|EN|ISO)(?:[- ](?:EN|ISO))*[- ]\d+(?:[-:]\d+)*)"), 1))), ";")
    return df.withColumns({"material": material, "thickness_cm": T.thickness_cm(b), "fire": fire, "standards": standards})


@query("""
WITH p AS (SELECT p_partkey AS id, p_size AS n FROM part)
SELECT id, '1' AS code, 1::BIGINT AS level, 'Memoria de obra' AS title, 'Memoria de obra' AS path, NULL::VARCHAR AS material, NULL::DOUBLE AS thickness_cm, NULL::VARCHAR AS fire, '' AS standards FROM p
UNION ALL SELECT id, '1.1', 2, 'Tabiques', 'Memoria de obra → Tabiques', 'yeso laminado', n / 10.0, 'EI-60', 'EN 520;UNE 102043' FROM p
UNION ALL SELECT id, '2', 1, 'Estructura', 'Estructura', 'acero', NULL, 'REI 120', '' FROM p
""")
def section_specifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A memory of works for each part, its sections and what they specify."""
    text = F.concat(F.lit("Portada\n1. Memoria de obra\nTexto general.\n\n1.1 Tabiques\nPlaca de yeso laminado, espesor: "), F.col("p_size").cast("string"), F.lit(" mm, EI-60.\nSegún UNE 102043 y EN 520, EN 520.\n2 Estructura\nPerfiles de acero con REI 120\n"))
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("text"))
    return specifications(sections(docs, "id")).drop("body")


# mails and threads

#: What a mail's headers are called in English and Spanish.
HEADERS = {"sender": "from|de", "to": "to|para", "cc": "cc|copia", "subject": "subject|asunto", "date": "date|fecha|enviado|sent", "message_id": "message-id", "in_reply_to": "in-reply-to"}


@F.pandas_udf(ArrayType(StringType()))
def addresses(s: pd.Series) -> pd.Series:
    """The addresses of a header, in lower case, in order; null for null. Python: the grammar of addresses nests."""
    return s.map(lambda x: None if x is None else [a.lower() for _, a in getaddresses([x]) if "@" in a])


def mail_fields(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """df's key with a column for each of HEADERS, of the lines before the first empty one, and subject_key, is_issue, attachments (sorted, joined)."""
    head = F.regexp_extract(text, r"(?s)^(.*?)(?:\n\s*\n|$)", 1)
    got = {name: F.nullif(F.trim(F.regexp_extract(head, rf"(?im)^(?:{words})\s*:[ \t]*(.*)$", 1)), F.lit("")) for name, words in HEADERS.items()}
    issue = F.concat_ws(" ", got["subject"], F.col(text)).rlike(r"(?i)\b(incidencia|problema|defecto|reclamaci[oó]n|issue|urgent[e]?)\b")
    block = F.regexp_extract(text, r"(?im)^(?:adjuntos?|attachments?)\s*:((?:[^\n]*\n?){1,11})", 1)
    files = F.array_join(F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(block, F.lit(r"(?i)([\p{L}\p{N}_.-]+\.(?:pdf|docx?|xlsx?|dwg|dxf|jpe?g|png|msg|eml))\b"), 1), lambda x: F.lower(x)))), ";")
    return df.select(key, *[c.alias(name) for name, c in got.items()], T.subject(got["subject"]).alias("subject_key"), issue.alias("is_issue"), files.alias("attachments"))


def render_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, conv, turn, text): every turn as a mail; answers name the turn before, and some have another subject."""
    c = table(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 100_000 + F.col("turn"))
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    topic = F.when(F.col("turn") % 3 == 2, F.concat(F.lit("Otro "), conv, F.lit("/"), turn)).otherwise(F.concat(F.lit("Tema "), conv))
    reply = F.when(F.col("turn") > 0, F.concat(F.lit("\nIn-Reply-To: <"), conv, F.lit("."), (F.col("turn") - 1).cast("string"), F.lit("@x>"))).otherwise("")
    text = F.concat(
        F.lit("De: Ana <Ana"), conv, F.lit("@Example.com>\nPara: b@example.com, \"C, D\" <c@example.com>\nAsunto: "), F.when(F.col("turn") > 0, "Re: rv: ").otherwise(""), topic, F.lit("\nMessage-ID: <"), conv, F.lit("."), turn, F.lit("@x>"), reply,
        F.lit("\n\n"), F.coalesce("text", F.lit("")), F.when(F.col("turn") % 4 == 1, F.lit("\nAdjuntos:\n - Plano_1.PDF\n - b.xlsx\n")).otherwise(""),
    )
    return c.select("id", F.col("conv_id").alias("conv"), "turn", text.alias("text"))


@query("""
WITH c AS (SELECT conv_id * 100000 + turn AS id, conv_id, turn FROM conversations)
SELECT id, 'ana' || conv_id || '@example.com' AS sender, 'b@example.com;c@example.com' AS recipients, CASE WHEN turn % 3 = 2 THEN 'otro ' || conv_id || '/' || turn ELSE 'tema ' || conv_id END AS subject_key,
 CASE WHEN turn % 4 = 1 THEN 'b.xlsx;plano_1.pdf' ELSE '' END AS attachments, CASE WHEN turn > 0 THEN '<' || conv_id || '.' || (turn - 1) || '@x>' END AS in_reply_to FROM c
""")
def mail_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mail_fields(render_mails(spark, sf_dir), "id")
    return m.select("id", F.get(addresses("sender"), F.lit(0)).alias("sender"), F.array_join(addresses("to"), ";").alias("recipients"), "subject_key", "attachments", "in_reply_to")


@query("""
WITH p AS (SELECT page_id, lower(split_part(split_part(url, '?', 1), '/', -1)) AS name, split_part(url, '/', 3) AS project FROM pages),
a AS (SELECT page_id AS message, project, CASE WHEN page_id % 2 = 0 THEN upper(name) ELSE 'x' || name END AS asked FROM p)
SELECT message, min(p.page_id) AS found FROM a JOIN p ON lower(a.asked) = p.name AND a.project = p.project GROUP BY 1
""")
def named_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments linked to the file of that name in the same project, whatever its case."""
    p = table(spark, sf_dir, "pages").select("page_id", F.lower(F.element_at(F.split(F.split_part("url", F.lit("?"), F.lit(1)), "/"), -1)).alias("name"), F.split_part("url", F.lit("/"), F.lit(3)).alias("project"))
    asked = p.select(F.col("page_id").alias("message"), F.col("project").alias("mine"), F.lower(F.when(F.col("page_id") % 2 == 0, F.upper("name")).otherwise(F.concat(F.lit("x"), "name"))).alias("asked"))
    first = p.groupBy("project", "name").agg(F.min("page_id").alias("found"))
    return asked.join(first, (F.col("asked") == F.col("name")) & (F.col("mine") == F.col("project"))).select("message", "found")


# pages


@query("SELECT page_id, k - 1 AS position, trim(list_extract(l, k)) AS item FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS k FROM (SELECT page_id, list_transform(regexp_extract_all(html, '(?s)<li[^>]*>(.*?)</li>', 1), lambda x: regexp_replace(x, '<[^>]+>', '', 'g')) AS l FROM pages))")
def html_list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = F.transform(F.regexp_extract_all("html", F.lit(r"(?s)<li[^>]*>(.*?)</li>"), 1), lambda x: F.trim(F.regexp_replace(x, "<[^>]+>", "")))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(li).alias("position", "item")).withColumn("position", F.col("position").cast("long"))


def html_markdown(html: Column) -> Column:
    """HTML as Markdown: scripts and styles go; headings, bold, italics, links' texts and list items get their marks; paragraphs are parted by blank lines; tables become rows of pipes."""
    t = html
    for pattern, to in (
        (r"(?is)<(script|style|head)\b[^>]*>.*?</\1>", ""), (r"(?s)<!--.*?-->", ""), (r"\s+", " "), (r"(?i)</?(?:b|strong)\b[^>]*>", "**"), (r"(?i)</?(?:i|em)\b[^>]*>", "*"), (r"(?i)<li\b[^>]*>\s*", "\n- "),
        (r"(?i)<h[1-6]\b[^>]*>\s*", "\n\n# "), (r"(?i)<br\s*/?>", "\n"), (r"(?i)<tr\b[^>]*>\s*", "\n"), (r"(?i)<t[dh]\b[^>]*>\s*", "| "), (r"(?i)\s*</t[dh]>\s*", " "), (r"(?i)</tr>", "|"),
        (r"(?i)</?(?:p|div|article|section|ul|ol|table|nav|h[1-6])\b[^>]*>", "\n\n"), (r"<[^>]+>", ""), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), (r"[ \t]*\n[ \t]*", "\n"), (r"\n{3,}", "\n\n"),
    ):
        t = F.regexp_replace(t, pattern, to)
    return F.regexp_replace(t, r"^\s+|\s+$", "")


_MARKDOWN_STEPS = (
    (r"<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<head[^>]*>.*?</head>", "", "gis"), (r"<!--.*?-->", "", "gs"), (r"\s+", " ", "g"), (r"</?(?:b|strong)\b[^>]*>", "**", "gi"), (r"</?(?:i|em)\b[^>]*>", "*", "gi"), (r"<li\b[^>]*>\s*", "\n- ", "gi"),
    (r"<h[1-6]\b[^>]*>\s*", "\n\n# ", "gi"), (r"<br\s*/?>", "\n", "gi"), (r"<tr\b[^>]*>\s*", "\n", "gi"), (r"<t[dh]\b[^>]*>\s*", "| ", "gi"), (r"\s*</t[dh]>\s*", " ", "gi"), (r"</tr>", "|", "gi"),
    (r"</?(?:p|div|article|section|ul|ol|table|nav|h[1-6])\b[^>]*>", "\n\n", "gi"), (r"<[^>]+>", "", "g"), ("&nbsp;", " ", "g"), ("&lt;", "<", "g"), ("&gt;", ">", "g"), ("&amp;", "&", "g"), (r"[ \t]*\n[ \t]*", "\n", "g"), (r"\n{3,}", "\n\n", "g"), (r"^\s+|\s+$", "", "g"),
)
_MARKDOWN_SQL = reduce(lambda a, s: f"regexp_replace({a}, '{s[0]}', '{s[1]}', '{s[2]}')", _MARKDOWN_STEPS, "html")


@query(f"SELECT page_id, {_MARKDOWN_SQL} AS markdown FROM pages")
def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html_markdown(F.col("html")).alias("markdown"))


@query("SELECT l_orderkey, '| a | b |' || chr(10) || string_agg('| ' || l_linenumber || ' | ' || l_quantity::INT || ' |', chr(10) ORDER BY l_linenumber, l_quantity) AS markdown FROM lineitem GROUP BY 1")
def html_tables_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of a page alone: here one table of an order's lines, written as HTML."""
    row = F.concat(F.lit("<tr><td>"), F.col("l_linenumber").cast("string"), F.lit("</td>\n<td class='q'>"), F.col("l_quantity").cast("int").cast("string"), F.lit("</td></tr>"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", row.alias("row")))), lambda r: r["row"]), "\n")
    pages = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit("<p>before</p><table id=1><tr><th>a</th><th>b</th></tr>"), rows, F.lit("</table> after")).alias("html"))
    tables = F.regexp_extract_all("html", F.lit(r"(?is)(<table\b.*?</table>)"), 1)
    return pages.select("l_orderkey", F.array_join(F.transform(tables, html_markdown), "\n\n").alias("markdown"))


# rules: formats, types, tags, profiles

#: What votes for a page's format: its kind of evidence, a pattern, the format, the weight.
FORMAT_VOTES = (("url", r"\.html?(\?|$)", "html", 0.6), ("url", r"\.xml(\?|$)", "xml", 0.6), ("url", r"\.pdf(\?|$)", "pdf", 0.6), ("html", r"(?i)<!doctype html|<html", "html", 0.8), ("html", r"^\s*<\?xml", "xml", 0.8), ("html", r"<li|<p|<div", "html", 0.5))


def format_votes(df: DataFrame, key: str, votes=FORMAT_VOTES) -> DataFrame:
    """(key, format, weight): the format of most weight, the first by name of equals; unknown without a vote. One pass, no shuffle."""
    by: dict[str, Column] = {}
    for c, pattern, name, weight in votes:
        by[name] = by.get(name, F.lit(0.0)) + F.when(F.col(c).rlike(pattern), weight).otherwise(0.0)
    best = F.array_max(F.array(*[F.struct(F.round(w, 4).alias("w"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, w) in enumerate(sorted(by.items()))]))
    return df.select(key, best.alias("b")).select(key, F.when(F.col("b.w") > 0, F.col("b.name")).otherwise("unknown").alias("format"), F.col("b.w").alias("weight"))


@query("""
WITH v AS (SELECT page_id, CASE WHEN regexp_matches(url, '\\.html?(\\?|$)') THEN 0.6 ELSE 0 END + CASE WHEN regexp_matches(html, '(?i)<!doctype html|<html') THEN 0.8 ELSE 0 END + CASE WHEN regexp_matches(html, '<li|<p|<div') THEN 0.5 ELSE 0 END AS h,
 CASE WHEN regexp_matches(url, '\\.pdf(\\?|$)') THEN 0.6 ELSE 0 END AS p, CASE WHEN regexp_matches(url, '\\.xml(\\?|$)') THEN 0.6 ELSE 0 END + CASE WHEN regexp_matches(html, '^\\s*<\\?xml') THEN 0.8 ELSE 0 END AS x FROM pages)
SELECT page_id, CASE WHEN greatest(h, p, x) = 0 THEN 'unknown' WHEN h = greatest(h, p, x) THEN 'html' WHEN p = greatest(h, p, x) THEN 'pdf' ELSE 'xml' END AS format, greatest(h, p, x)::DOUBLE AS weight FROM v
""")
def source_format_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_votes(table(spark, sf_dir, "pages"), "page_id")


#: Tags by the words that give them, in order.
TAG_RULES = (("licence", "license|licen[cs]ed"), ("rights", "rights reserved"), ("contact", "@[a-z0-9]"), ("secret", "token = "), ("table", r" \| "), ("public", r"\bpublic\b"), ("question", r"\?"), ("long_number", "[0-9]{12}"), ("network", r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"))


def tags(c: Column, most: int = 8) -> Column:
    """The first tags, in the rules' order, whose words a text has."""
    return F.slice(F.array_compact(F.array(*[F.when(F.lower(c).rlike(p), F.lit(tag)) for tag, p in TAG_RULES])), 1, most)


@query("SELECT doc_id, coalesce(array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{t}' END" for t, p in TAG_RULES) + "], lambda x: x IS NOT NULL)[:8], ','), '') AS tags, coalesce(CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{t}'" for t, p in TAG_RULES) + " END, 'plain') AS subtype FROM documents")
def content_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to eight tags of each text, and the first of them as its subtype."""
    t = tags(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(t, ",").alias("tags"), F.coalesce(F.get(t, F.lit(0)), F.lit("plain")).alias("subtype"))


#: Phases of the classifier of pages: where a rule looks, its pattern, the type it speaks for, its weight.
TYPE_RULES = (
    ("name", r"^[0-9]+$", "record", 0.35), ("name", r"index|home", "index", 0.35), ("folder", r"news|blog|post", "article", 0.55), ("folder", r"shop|item|product", "product", 0.55), ("folder", r"docs|wiki", "manual", 0.55),
    ("text", r"<article", "article", 0.25), ("text", r"<nav", "index", 0.25), ("text", r"<li", "index", 0.25), ("text", r"copyright|rights reserved", "legal", 0.25), ("extension", r"^html?$", "article", 0.50), ("extension", r"^pdf$", "manual", 0.50),
)
#: Patterns that settle a type by themselves, before all votes.
SETTLED = (("text", r"404 not found", "error", 0.98),)


def classified(df: DataFrame, key: str, rules=TYPE_RULES, settled=SETTLED, learned: DataFrame | None = None, default: str = "other") -> DataFrame:
    """(key, type, confidence) of a table with the columns that the rules look at (name, folder, text, extension).

    A settled pattern decides alone. Else every rule that matches adds its weight to its type, a learned rule (type, word, weight;
    any number of them, looked for at once) adds its weight where the name or the folder holds its word, and the greatest sum wins, the
    first by name of equals. Confidence is held between 0.4 and 0.98; default at 0.4 where nothing matches.
    """
    own = F.array(*[F.when(F.lower(F.col(c)).rlike(p), F.struct(F.lit(t).alias("type"), F.lit(float(w)).alias("weight"))) for c, p, t, w in rules])
    rows = df.withColumn("votes", F.array_compact(own))
    if learned is not None:
        hits = patterns.found(df.select(key, F.concat_ws("/", "folder", "name").alias("where")), key, "where", learned)
        said = hits.join(learned.select("type", "weight", F.lower("word").alias("word")), "word")
        said = said.groupBy(F.col(key).alias("k")).agg(F.collect_list(F.struct("type", F.col("weight").cast("double").alias("weight"))).alias("more"))  # at most a vote a rule
        rows = rows.join(said, F.col(key) == F.col("k"), "left").withColumn("votes", F.concat("votes", F.coalesce("more", F.array().cast("array<struct<type:string,weight:double>>"))))
    types = F.array_sort(F.array_distinct(F.transform("votes", lambda v: v["type"])))
    total = lambda t: F.round(F.aggregate(F.filter("votes", lambda v: v["type"] == t), F.lit(0.0), lambda a, v: a + v["weight"]), 4)
    best = F.array_max(F.transform(types, lambda t, i: F.struct(total(t).alias("w"), (-i).alias("i"), t.alias("t"))))
    first = reduce(lambda a, s: a.when(F.lower(F.col(s[0])).rlike(s[1]), F.struct(F.lit(s[3]).alias("w"), F.lit(0).alias("i"), F.lit(s[2]).alias("t"))), settled, F.when(F.lit(False), F.struct(F.lit(0.0).alias("w"), F.lit(0).alias("i"), F.lit("").alias("t"))))
    rows = rows.select(key, F.coalesce(first, best).alias("b"))
    return rows.select(key, F.coalesce("b.t", F.lit(default)).alias("type"), F.least(F.greatest(F.coalesce("b.w", F.lit(0.4)), F.lit(0.4)), F.lit(0.98)).alias("confidence"))


def page_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, name, folder, extension, text) of the pages."""
    path = F.regexp_replace(F.split_part("url", F.lit("?"), F.lit(1)), "^[a-z]+://[^/]+/?", "")
    name = F.element_at(F.split(path, "/"), -1)
    return table(spark, sf_dir, "pages").select("page_id", name.alias("name"), F.regexp_replace(path, "[^/]*$", "").alias("folder"), F.regexp_extract(name, r"\.([a-z0-9]+)$", 1).alias("extension"), F.col("html").alias("text"))


_RULES_SQL = ", ".join(f"('{c}', '{p}', '{t}', {w})" for c, p, t, w in TYPE_RULES)


@query(f"""
WITH u AS (SELECT page_id, regexp_replace(split_part(url, '?', 1), '^[a-z]+://[^/]+/?', '') AS path, html AS text FROM pages),
d AS (SELECT page_id, lower(split_part(path, '/', -1)) AS name, lower(regexp_replace(path, '[^/]*$', '')) AS folder, regexp_extract(split_part(path, '/', -1), '\\.([a-z0-9]+)$', 1) AS extension, lower(text) AS text FROM u),
r(c, p, t, w) AS (VALUES {_RULES_SQL}),
v AS (SELECT page_id, t, w FROM d JOIN r ON regexp_matches(CASE c WHEN 'name' THEN name WHEN 'folder' THEN folder WHEN 'extension' THEN extension ELSE text END, p)
 UNION ALL SELECT page_id, t, w FROM d JOIN (VALUES ('record', '7', 0.3), ('product', '1', 0.2)) l(t, word, w) ON contains(folder || '/' || name, word)),
s AS (SELECT page_id, t, round(sum(w)::DOUBLE, 4) AS s FROM v GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY s DESC, t) AS k FROM s)
SELECT d.page_id, CASE WHEN regexp_matches(text, '404 not found') THEN 'error' ELSE coalesce(t, 'other') END AS type, least(greatest(CASE WHEN regexp_matches(text, '404 not found') THEN 0.98 ELSE coalesce(s, 0.4) END, 0.4), 0.98)::DOUBLE AS confidence FROM d LEFT JOIN b ON b.page_id = d.page_id AND k = 1
""")
def classify_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    learned = spark.createDataFrame([("record", "7", 0.3), ("product", "1", 0.2)], "type string, word string, weight double")
    return classified(page_parts(spark, sf_dir), "page_id", learned=learned)


#: How a supplier shows in a text: profile, kind of evidence, pattern.
PROFILES = (("alpha", "name", "supplier#0{6}001"), ("alpha", "header", "factura"), ("beta", "name", "supplier#0{6}00[2-5]"), ("beta", "tax_id", "0000000[2-5]t"), ("gamma", "tax_id", "00000001t"))
EVIDENCE = {"tax_id": 3, "name": 2, "header": 1}


@query(f"""
WITH {INVOICES_SQL}, t AS (SELECT number, lower('FACTURA' || chr(10) || supplier || chr(10) || lpad(supplier_id::VARCHAR, 8, '0') || 'T') AS t FROM invoices),
r(p, s, pat) AS (VALUES {", ".join(f"('{p}', {EVIDENCE[k]}, '{pat}')" for p, k, pat in PROFILES)}),
s AS (SELECT number, p, sum(s) AS s FROM t JOIN r ON regexp_matches(t, pat) GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY number ORDER BY s DESC, p) AS k FROM s)
SELECT t.number, coalesce(p, 'generic') AS profile FROM t LEFT JOIN b ON b.number = t.number AND k = 1
""")
def supplier_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile whose patterns score most in an invoice's text."""
    t = F.lower("text")
    score = {p: sum((F.when(t.rlike(pat), EVIDENCE[k]).otherwise(0) for q, k, pat in PROFILES if q == p), F.lit(0)) for p in sorted({p for p, _, _ in PROFILES})}
    best = F.array_max(F.array(*[F.struct(s.alias("s"), F.lit(-i).alias("i"), F.lit(p).alias("p")) for i, (p, s) in enumerate(score.items())]))
    return render_invoices(spark, sf_dir).select("number", best.alias("b")).select("number", F.when(F.col("b.s") > 0, F.col("b.p")).otherwise("generic").alias("profile"))


@query("SELECT doc_id, '[tipo=' || lang || ' | fichero=' || replace(source, '|', '') || ' | pág=1]' AS header, array_to_string(regexp_split_to_array(trim(coalesce(text, '')), '\\s+')[:50], ' ') AS head FROM documents")
def chunk_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk's header, and the first fifty words of a text: the budget of words is the feature."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", metadata_header(F.col("lang"), F.col("source"), F.lit(1)).alias("header"), F.array_join(F.slice(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+"), 1, 50), " ").alias("head"))


def metadata_header(kind: Column, filename: Column, page: Column) -> Column:
    """[tipo=… | fichero=… | pág=…] of the fields that aren't null, pipes taken out of the values; empty without any."""
    said = lambda name, c: F.concat(F.lit(f"{name}="), F.trim(F.translate(c.cast("string"), "|", "")))
    body = F.concat_ws(" | ", said("tipo", kind), said("fichero", filename), said("pág", page))
    return F.when(body != "", F.concat(F.lit("["), body, F.lit("]"))).otherwise("")


# structure-aware chunks


@query()
def chunk_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, idx, chunk_text, token_count, chunk_type): chunks of paragraphs with headings before them, and whole tables.

    Python, a text at a time, in pieces of bounded size: what a chunk takes over from the one before can't be told from its own lines.
    """
    from lectern.operators.chunking import structured

    def run(frames):
        for f in frames:
            rows = []
            for i, t in zip(f["doc_id"].astype(object), f["text"], strict=True):
                for k, (chunk, kind) in enumerate(structured(t or "")):
                    rows.append((None if pd.isna(i) else int(i), k, chunk, len(chunk.split()), kind))
                    if len(rows) == 1_000:
                        yield pd.DataFrame(rows, columns=["doc_id", "idx", "chunk_text", "token_count", "chunk_type"])
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "idx", "chunk_text", "token_count", "chunk_type"])

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInPandas(run, "doc_id long, idx long, chunk_text string, token_count long, chunk_type string")


@query("SELECT chunk_type, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(trim(l), '^\\|.*\\|$') THEN 'table line' ELSE 'text line' END AS chunk_type FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents)) GROUP BY 1")
def table_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lines_of(table(spark, sf_dir, "documents"), "doc_id")
    return x.select(F.when(F.trim("line").rlike(r"^\|.*\|$"), "table line").otherwise("text line").alias("chunk_type")).groupBy("chunk_type").agg(count().alias("n"))
