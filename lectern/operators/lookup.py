"""Point look-ups, best matches, routes and categories, papers of orders and deliveries, corrections of recognised text, evidence."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import columns as C
from lectern.functions import text as T
from lectern.operators.business import count
from lectern.operators.corpus import DESCRIBED_SQL, described
from lectern.operators.extraction import items, plan_fields
from lectern.operators.records import BUDGETS_SQL, INVOICES_SQL, LINES_SQL, budgets, invoices, lines
from lectern.operators.registry import Registry
from lectern.operators.textops import spanish
from lectern.sources.tables import table

query = Registry()


# look-ups


def by_id(records: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """(asked and the record) for every id that is asked for, once; ids without a record have nulls. Ids that are asked for are broadcast by Spark where they are few."""
    a = wanted.select("asked").distinct()
    return a.join(records, a["asked"] == records[key], "left").drop(key)


@query(f"""
WITH {DESCRIBED_SQL}, w AS (SELECT DISTINCT user_id * 3 AS asked FROM events WHERE user_id IS NOT NULL)
SELECT asked, filename, status, length(text)::BIGINT AS size FROM w LEFT JOIN d ON d.id = asked
""")
def documents_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "events").filter("user_id IS NOT NULL").select((F.col("user_id") * 3).alias("asked"))
    d = described(spark, sf_dir).select("id", "filename", "status", F.length("text").cast("long").alias("size"))
    return by_id(d, wanted, "id")


@query("""
WITH l AS (SELECT doc_id, unnest(range(1, len(s) + 1)) AS k, s FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)), b AS (SELECT doc_id, k, s[k] AS t FROM l WHERE trim(s[k]) <> '')
SELECT doc_id, k - 1 AS block, length(t)::BIGINT AS size, md5(t) AS text_md5 FROM b JOIN (SELECT DISTINCT user_id FROM events) e ON e.user_id = b.doc_id
""")
def document_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks (lines) of the documents that are asked for; these are found before their texts are cut."""
    asked = table(spark, sf_dir, "events").select(F.col("user_id").alias("u")).distinct()
    d = table(spark, sf_dir, "documents").select("doc_id", "text").join(asked, F.col("doc_id") == F.col("u"), "left_semi")
    b = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("block", "t")).filter(F.trim("t") != "")
    return b.select("doc_id", F.col("block").cast("long").alias("block"), F.length("t").cast("long").alias("size"), F.md5("t").alias("text_md5"))


@query(f"WITH {LINES_SQL} SELECT reference, description, count(*) AS mentions, min(parent_id) AS first FROM lines WHERE contains(lower(reference), 'brand#1') AND contains(lower(description), 'gear') GROUP BY 1, 2 ORDER BY mentions DESC, reference LIMIT 50")
def entity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of a type whose value holds a text, the most mentioned first: a list of fifty."""
    x = lines(spark, sf_dir).filter(F.lower("reference").contains("brand#1") & F.lower("description").contains("gear"))
    return x.groupBy("reference", "description").agg(count().alias("mentions"), F.min("parent_id").alias("first")).orderBy(F.desc("mentions"), "reference").limit(50)


@query(f"""
WITH {LINES_SQL}, e AS (SELECT parent_id AS document, reference AS entity, min(line) AS line FROM lines GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY document ORDER BY line DESC, entity) AS k FROM e)
SELECT document, entity, line, count(*) OVER (PARTITION BY document) AS n_entities FROM r WHERE k <= 3
""")
def evidence_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's three newest evidences, and how many entities it mentions; repeated mentions are one."""
    e = lines(spark, sf_dir).groupBy(F.col("parent_id").alias("document"), F.col("reference").alias("entity")).agg(F.min("line").alias("line"))
    w = W.partitionBy("document").orderBy(F.desc("line"), "entity")
    rows = e.withColumn("k", F.row_number().over(w)).filter("k <= 3")
    return rows.select("document", "entity", "line", F.count("*").over(W.partitionBy("document")).alias("n_entities"))


def best(matches: DataFrame, query_col: str, priority: dict[str, int], preferred: str | None = None) -> DataFrame:
    """The best match (query, document, source, type) of each query: the preferred type's, then by its source's priority, then the least document. Unknown sources come last."""
    rank = F.coalesce(reduce(lambda a, kv: a.when(F.col("source") == kv[0], kv[1]), priority.items(), F.when(F.lit(False), 0)), F.lit(99))
    key = F.struct(rank.alias("r"), F.when(F.col("type") == preferred, 0).otherwise(1).alias("t"), F.col("document"))
    return matches.groupBy(query_col).agg(F.min_by(F.struct("document", "source", "type"), key).alias("m")).select(query_col, "m.*")


@query(f"""
WITH {BUDGETS_SQL}, {INVOICES_SQL}, m AS (SELECT id % 500 AS q, id AS document, 'number' AS source, 'budget' AS type FROM budgets UNION ALL SELECT order_id % 500, order_id + supplier_id, 'text', 'invoice' FROM invoices UNION ALL SELECT order_id % 500, supplier_id, 'path', 'budget' FROM invoices WHERE vat = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY CASE source WHEN 'number' THEN 2 WHEN 'text' THEN 1 ELSE 99 END, type <> 'invoice', document) AS k FROM m)
SELECT q, document, source, type FROM r WHERE k = 1
""")
def best_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, i = budgets(spark, sf_dir), invoices(spark, sf_dir)
    m = b.select((F.col("id") % 500).alias("q"), F.col("id").alias("document"), F.lit("number").alias("source"), F.lit("budget").alias("type"))
    m = m.unionByName(i.select((F.col("order_id") % 500).alias("q"), (F.col("order_id") + F.col("supplier_id")).alias("document"), F.lit("text").alias("source"), F.lit("invoice").alias("type")))
    m = m.unionByName(i.filter("vat = 0").select((F.col("order_id") % 500).alias("q"), F.col("supplier_id").alias("document"), F.lit("path").alias("source"), F.lit("budget").alias("type")))
    return best(m, "q", {"text": 1, "number": 2}, "invoice")


@query("SELECT conv_id, turn, min(role) AS role FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1, 2 ORDER BY conv_id, turn LIMIT 10")
def cited_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sources, those without a document left out, ten at most: an answer's list of citations."""
    c = table(spark, sf_dir, "conversations").filter("conv_id IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    return c.orderBy("conv_id", "turn").limit(10)


@query(f"WITH {DESCRIBED_SQL} SELECT id, split_part(path, '/', -1) AS shown_path, substr(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), 1, 80) AS excerpt, sha256(lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')))) AS text_hash FROM d")
def safe_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of a source may be shown: its name without folders, an excerpt of eighty characters (the feature); and the digest of its normal form."""
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")
    return described(spark, sf_dir).select("id", F.substring_index("path", "/", -1).alias("shown_path"), F.substring(plain, 1, 80).alias("excerpt"), F.sha2(F.lower(F.trim(plain)), 256).alias("text_hash"))


# words and routes

#: Words that are looked for whole, with a Spanish plural; others are looked for as parts.
WHOLE_WORDS = ("plano", "pedido", "factura", "license")


def has_keyword(c: Column, keyword: str) -> Column:
    """Whether a text has a keyword, without case: those of WHOLE_WORDS as words, also in the plural, others anywhere."""
    if keyword in WHOLE_WORDS:
        return F.coalesce(c.rlike(rf"(?i)(?<![\p{{L}}\p{{N}}_]){keyword}(es|s)?(?![\p{{L}}\p{{N}}_])"), F.lit(False))
    return F.coalesce(F.lower(c).contains(keyword), F.lit(False))


@query("SELECT doc_id, regexp_matches(text, '(?i)(^|[^\\pL\\pN_])license(es|s)?($|[^\\pL\\pN_])') AS license, contains(lower(text), 'public') AS public FROM documents WHERE text IS NOT NULL")
def keyword_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return d.select("doc_id", has_keyword(F.col("text"), "license").alias("license"), has_keyword(F.col("text"), "public").alias("public"))


#: folders' categories, and then names' patterns, in order.
FOLDER_CATEGORIES = {"planos": "planos", "planes": "planos", "pedidos": "pedidos", "facturas": "facturas", "fotos": "imagenes"}
NAME_CATEGORIES = ((r"\.xlsx?$", "pedidos"), (r"\.(?:jpe?g|png)$", "imagenes"), (r"\.dwg$|plano", "planos"), (r"presupuesto", "presupuestos"), (r"factura", "facturas"))


def category(name: Column, folder: Column) -> Column:
    """A file's category: its folder's, if that is known, the folder itself if it has another name, else by the first pattern that the name has, else otros."""
    f, n = F.lower(F.trim(folder)), F.lower(name)
    known = F.create_map(*[F.lit(x) for kv in FOLDER_CATEGORIES.items() for x in kv])
    by_name = reduce(lambda a, r: a.when(n.rlike(r[0]), r[1]), NAME_CATEGORIES[1:], F.when(n.rlike(NAME_CATEGORIES[0][0]), NAME_CATEGORIES[0][1])).otherwise("otros")
    return F.when(F.coalesce(f, F.lit("")) != "", F.coalesce(F.try_element_at(known, f), f)).otherwise(by_name)


@query("""
SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'planos' WHEN 1 THEN 'imagenes' WHEN 2 THEN 'obra vieja' WHEN 3 THEN 'pedidos' WHEN 4 THEN 'imagenes' WHEN 5 THEN 'planos' WHEN 6 THEN 'presupuestos' ELSE 'otros' END AS category,
 CASE p_partkey % 8 WHEN 3 THEN 'spreadsheet' WHEN 4 THEN 'photo' WHEN 5 THEN 'plan' ELSE 'text' END AS route FROM part
""")
def file_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories and routes of files, by folder and name."""
    k = F.col("p_partkey") % 8
    folder = F.get(F.array(*map(F.lit, (" Planos", "fotos", "Obra Vieja", "", "", "", "", ""))), k.cast("int"))
    name = F.get(F.array(*map(F.lit, ("x.pdf", "x.pdf", "x.pdf", "Lista.XLSX", "a.JPG", "Plano 1.pdf", "Presupuesto.docx", "x.txt"))), k.cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", category(name, folder).alias("category"), route(name).alias("route"))


def route(name: Column) -> Column:
    """How a file is to be read, by its extension and name."""
    n = F.lower(name)
    return F.when(n.rlike(r"\.xlsx?$|\.csv$"), "spreadsheet").when(n.rlike(r"\.(?:jpe?g|png)$"), "photo").when(n.rlike(r"\.d[wx][gf]$|plano"), "plan").otherwise("text")


#: What a question asks about, and how it is to be added up, by words, in order.
ENTITIES = (("invoice", "factura|invoice"), ("order", "pedido|order"), ("budget", "presupuesto|budget|oferta"))
KINDS = (("by_supplier", "por proveedor|by supplier"), ("top", "mayores|top|más caros"), ("count", "cuánt[oa]s|how many|número de"), ("total", "total|suma|importe|sum"))


def aggregation(c: Column) -> Column:
    """struct<entity, kind> of what a question wants to have added up; null fields where no word tells."""
    first = lambda rules: reduce(lambda a, r: a.when(F.lower(c).rlike(r[1]), r[0]), rules[1:], F.when(F.lower(c).rlike(rules[0][1]), rules[0][0]))
    return F.struct(first(ENTITIES).alias("entity"), first(KINDS).alias("kind"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'invoice' WHEN 1 THEN 'budget' END AS entity, CASE o_orderkey % 2 WHEN 0 THEN 'count' ELSE 'by_supplier' END AS kind FROM orders")
def question_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    what = F.when(k % 3 == 0, "facturas").when(k % 3 == 1, "Presupuestos").otherwise("cosas")
    text = F.when(k % 2 == 0, F.concat(F.lit("¿Cuántas "), what, F.lit(" hay?"))).otherwise(F.concat(F.lit("Importe de "), what, F.lit(" por proveedor")))
    return table(spark, sf_dir, "orders").select("o_orderkey", aggregation(text).alias("a")).select("o_orderkey", "a.*")


# papers


def order_fields(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, number, supplier, client, date, total, budget) out of an order's paper: the number behind its label, else a line of five or six
    digits near it; the supplier by its label, else the first company; the client by its label, else the second company."""
    t = F.col(text)
    companies = F.regexp_extract_all(t, F.lit(r"(?m)^[ \t]*([\p{Lu}][\p{L}\p{N}#. ]{1,60}\s(?:S\.?L\.?U?\.?|S\.?A\.?))[ \t]*$"), 1)
    lone = F.regexp_extract(t, r"(?is)pedido[^\n]*\n(?:[^\n]*\n){0,6}?[ \t]*(\d{5,6})[ \t]*(?:\n|$)", 1)
    return df.select(
        key, F.coalesce(T.first_with_digit(t, [r"(?im)^pedido\s+n[º°o.]*\s*:?\s*(\S+)", r"(?im)^n[º°o.]*\s*pedido\s*:?\s*(\S+)"]), F.nullif(lone, F.lit(""))).alias("number"), F.coalesce(T.labelled_line(t, "proveedor"), F.get(companies, F.lit(0))).alias("supplier"),
        F.coalesce(T.labelled_line(t, "cliente"), F.get(companies, F.lit(1))).alias("client"), T.first_date(t, "fecha").alias("date"), T.total_amount(t).alias("total"), F.nullif(F.regexp_extract(t, r"(?i)presupuesto\s*:?\s*(\S+)", 1), F.lit("")).alias("budget"),
    )


@query(f"""
WITH {INVOICES_SQL} SELECT number AS paper, CASE WHEN order_id % 2 = 0 THEN 'P-' || order_id ELSE (100000 + order_id % 900000)::VARCHAR END AS number, supplier || ' S.L.' AS supplier, CASE WHEN order_id % 2 = 0 THEN 'Cliente ' || supplier_id ELSE 'Hotel Sol S.A.' END AS client, date, round(total, 2) AS total, 'PRE-' || order_id AS budget FROM invoices
""")
def order_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers of orders of two layouts, with labels and without, written and read again."""
    i = invoices(spark, sf_dir)
    k = F.col("order_id").cast("string")
    end = F.concat(F.lit("\nFecha: "), F.date_format("date", "dd/MM/yyyy"), F.lit("\nSegún presupuesto: PRE-"), k, F.lit("\nTotal pedido: "), spanish(F.round(F.col("total") * 100).cast("long")), F.lit(" €\n"))
    one = F.concat(F.lit("Pedido Nº: P-"), k, F.lit("\nProveedor: "), "supplier", F.lit(" S.L.\nCliente: Cliente "), F.col("supplier_id").cast("string"), end)
    two = F.concat(F.lit("PEDIDO\n\n"), (F.col("order_id") % 900_000 + 100_000).cast("string"), F.lit("\n"), "supplier", F.lit(" S.L.\nHotel Sol S.A."), end)
    return order_fields(i.select(F.col("number").alias("paper"), F.when(F.col("order_id") % 2 == 0, one).otherwise(two).alias("text")), "paper")


@query(f"""
WITH {LINES_SQL} SELECT parent_id AS id, 'ALB-' || parent_id AS number, count(*) AS n_items, sum(quantity)::DOUBLE AS quantity FROM lines GROUP BY 1
""")
def delivery_note_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery notes of each order's lines (of which there are few), written and read again."""
    x = lines(spark, sf_dir)
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "reference", "description", F.col("quantity").cast("int").cast("string")), F.lit(" |"))
    notes = x.groupBy(F.col("parent_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("rows"))
    notes = notes.select("id", F.concat(F.lit("ALBARÁN\nAlbarán nº: ALB-"), F.col("id").cast("string"), F.lit("\n\n| Codigo | Detalle | Uds |\n|---|---|---|\n"), "rows").alias("text"))
    number = notes.select(F.col("id").alias("k"), F.regexp_extract("text", r"(?im)^albar[aá]n\s+n[º°o.]*\s*:?\s*(\S+)", 1).alias("number"))
    sums = items(notes, "id").groupBy("id").agg(count().alias("n_items"), F.sum("quantity").alias("quantity"))
    return sums.join(number, F.col("id") == F.col("k")).select("id", "number", "n_items", "quantity")


@query("SELECT p_partkey, 'Cocina' AS room, p_size + 0.5::DOUBLE AS area, p_name AS plan FROM part WHERE p_size >= 10")
def plan_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kitchens of all plans with their areas, where these are ten square metres or more."""
    text = F.concat(F.lit("Escala 1:50\nCocina: "), F.col("p_size").cast("string"), F.lit(",5 m2\nBaño 3 m2\n"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("plan"), text.alias("text"))
    rooms = plan_fields(p, "p_partkey").select(F.col("p_partkey").alias("k"), F.explode(F.split("rooms", ";")).alias("r"))
    rooms = rooms.select("k", F.substring_index("r", "=", 1).alias("room"), F.substring_index("r", "=", -1).cast("double").alias("area")).filter("room ILIKE '%cocina%' AND area >= 10")
    return rooms.join(p.select("p_partkey", "plan"), F.col("k") == F.col("p_partkey")).select("p_partkey", "room", "area", "plan")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'different' WHEN 2 THEN 'unexpected' ELSE 'equal' END AS result FROM part")
def manifest_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was found against what a manifest expects, within one per cent."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("v"))
    k = F.col("p_partkey") % 4
    expected, found = p.filter(k != 2), p.filter(k != 0).withColumn("v", F.when(k == 1, F.col("v") * 1.5).otherwise(F.col("v") * 1.001))
    return validated(expected, found, "p_partkey", "v")


def validated(expected: DataFrame, found: DataFrame, key: str, value: str, share: float = 0.01) -> DataFrame:
    """(key, result) by a full outer join: missing, unexpected, equal within a share, or different; nulls are equal to nulls only."""
    both = expected.select(key, F.col(value).alias("e"), F.lit(True).alias("in_e")).join(found.select(key, F.col(value).alias("f"), F.lit(True).alias("in_f")), key, "full")
    near = F.coalesce(F.abs(F.col("e") - F.col("f")) <= share * F.abs("e"), F.col("e").isNull() & F.col("f").isNull())
    return both.select(key, F.when(F.col("in_f").isNull(), "missing").when(F.col("in_e").isNull(), "unexpected").when(near, "equal").otherwise("different").alias("result"))


# corrections of recognised text


#: Kinds of what is corrected, in their order: pattern, normal form (null: not one), and what it takes to be sure of it.
CORRECTED = (
    ("nif", r"\b([0-9]{8}[A-Za-z58])\b", T.nif_repaired, lambda c: T.nif_repaired(c).isNotNull()),
    ("cif", r"\b([A-Wa-w][0-9]{7}[0-9A-Za-z])\b", lambda c: F.when(C.cif_valid(c), F.upper(c)), lambda c: F.lit(True)),
    ("iban", r"\b([A-Z]{2}[0-9]{2}(?: [0-9A-Z]{4}){3,7}(?: [0-9A-Z]{1,3})?)\b", lambda c: F.replace(c, F.lit(" "), F.lit("")), T.iban_valid),
    ("amount", r"(?<![\w.,/-])([0-9OIl]{1,3}(?:[.,][0-9OIl]{3})*[.,][0-9OIl]{2})(?![\w/])", T.recognised_number, lambda c: T.recognised_number(c).rlike(r"^\d+\.\d{2}$")),
    ("date", r"\b((?:1[3-9]|[2-3][0-9])[/-](?:0?[1-9]|1[0-2])[/-](?:[0-9]{4}|[0-9]{2}))\b", T.iso_dates, lambda c: F.size(T.dates(c)) > 0),
)


def postprocessed(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, text, kind, original, corrected, confidence), a row a correction, and one of null kind for a text without any: tax ids of persons whose
    letter was read as a digit, those of firms in capitals, account numbers without their spaces, amounts and dates in normal form. confidence is 1 for what passes its check, else 0.8.

    Every occurrence is corrected, kind by kind, each kind in the text that the one before left. Rows that share a key stay rows of their own.
    """
    # a kind's corrections and text are columns of their own behind a barrier of the kind before, so no expression is copied into the next
    df, t, logs = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text")), F.col("_text"), []
    for kind, pattern, fix, sure in CORRECTED:
        each = F.transform(F.regexp_extract_all(t, F.lit(pattern), 1), lambda h: F.struct(F.lit(kind).alias("kind"), h.alias("original"), fix(h).alias("corrected"), F.when(sure(h), 1.0).otherwise(0.8).alias("confidence")))  # noqa: B023
        df = df.withColumn(f"_{kind}", F.filter(each, lambda c: c["corrected"].isNotNull() & (c["corrected"] != c["original"])))
        df = df.withColumn("_text", _replaced(t, F.col(f"_{kind}")))
        logs.append(F.col(f"_{kind}"))
    return df.select(key, F.col("_text").alias("text"), F.explode_outer(F.concat(*logs)).alias("c")).select(key, "text", "c.kind", "c.original", "c.corrected", "c.confidence")


def _replaced(t: Column, corrections: Column) -> Column:
    """t with each correction in turn put where its original comes next."""
    pair = lambda done, rest: F.struct(done.alias("done"), rest.alias("rest"))

    def one(a, c):
        at = F.instr(a["rest"], c["original"])
        return pair(F.concat(a["done"], F.substring(a["rest"], F.lit(1), at - 1), c["corrected"]), F.substring(a["rest"], at + F.length(c["original"]), F.length(a["rest"])))

    return F.when(F.size(corrections) == 0, t).otherwise(F.aggregate(corrections, pair(F.lit(""), t), one, lambda a: F.concat(a["done"], a["rest"])))


@query("""
WITH k AS (SELECT c_custkey AS k, lpad(c_custkey::VARCHAR, 8, '0') AS n, substr('TRWAGMYFPDXBNJZSQVHLCKE', (c_custkey % 23 + 1)::INT, 1) AS c FROM customer)
SELECT k AS c_custkey, 'amount' AS kind, '1.2O' || (k % 10) || ',50' AS original, '120' || (k % 10) || '.50' AS corrected, 1.0::DOUBLE AS confidence FROM k
UNION ALL SELECT k, 'amount', '2.3O' || (k % 7) || ',60', '230' || (k % 7) || '.60', 1.0 FROM k
UNION ALL SELECT k, 'date', '25/03/2026', '2026-03-25', 1.0 FROM k UNION ALL SELECT k, 'nif', n || translate(c, 'SB', '58'), n || c, 1.0 FROM k WHERE c IN ('S', 'B')
""")
def ocr_postprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters with misread ids, amounts and dates, and what is corrected in them."""
    k = F.col("c_custkey")
    letter = F.translate(F.substring(F.lit(C.NIF_LETTERS), (k % 23 + 1).cast("int"), F.lit(1)), "SB", "58")
    text = F.concat(F.lit("NIF "), F.lpad(k.cast("string"), 8, "0"), letter, F.lit(" importe 1.2O"), (k % 10).cast("string"), F.lit(",50 y 2.3O"), (k % 7).cast("string"), F.lit(",60 el 25/03/2026"))
    return postprocessed(table(spark, sf_dir, "customer").select("c_custkey", text.alias("text")), "c_custkey").drop("text")
