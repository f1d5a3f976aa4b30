"""Documents with their descriptions: filters as parameters, visibility, quality, review lists and dashboards.

The given tables describe documents by little more than language and source; described() derives the rest from their columns.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import columns as C
from lectern.functions import text as T
from lectern.operators.business import count
from lectern.operators.registry import Registry
from lectern.sources.tables import table

query = Registry()

DESCRIBED_SQL = """d AS (SELECT d.doc_id AS id, source || '_' || d.doc_id || CASE WHEN d.doc_id % 3 = 0 THEN '.PDF' WHEN d.doc_id % 3 = 1 THEN '.docx' ELSE '.msg' END AS filename,
 '/Corpus/2024/' || source || '/Presupuesto ' || lpad((d.doc_id % 50)::VARCHAR, 6, '0') || '/' || source || '_' || d.doc_id AS path, lang AS type, d.doc_id % 3 AS ext,
 CASE WHEN toxic = 1 THEN 'failed' WHEN quality = 0 THEN 'needs_review' WHEN d.doc_id % 23 = 0 THEN 'duplicate' ELSE 'processed' END AS status, CASE WHEN d.doc_id % 9 = 0 THEN NULL ELSE (d.doc_id * 37 % 100) / 100.0::DOUBLE END AS confidence,
 DATE '2024-01-01' + (d.doc_id % 365)::INT AS created, d.doc_id % 19 = 0 AS deleted, text, n_chars, quality, toxic,
 CASE WHEN d.doc_id % 17 = 0 THEN NULL WHEN d.doc_id % 13 = 0 THEN 'quarantine' WHEN d.doc_id % 11 = 0 THEN 'unassigned' ELSE 'assigned' END AS assignment, d.doc_id % 3 AS chain, d.doc_id % 7 AS hotel,
 CASE WHEN d.doc_id % 5 = 0 THEN ['Confidential', lang] ELSE [lang] END AS tags
 FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id)"""


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, filename, path, type, ext, status, confidence, created, deleted, text, n_chars, quality, toxic, assignment, chain, hotel, tags).

    assignment is null where a document has no row of access metadata.
    """
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("labelled")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    d = table(spark, sf_dir, "documents").join(labels, F.col("doc_id") == F.col("labelled"), "left")
    k, key = F.col("doc_id"), F.col("doc_id").cast("string")
    stem = F.concat_ws("_", "source", key)
    status = F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 0, "needs_review").when(k % 23 == 0, "duplicate").otherwise("processed")
    return d.select(
        k.alias("id"), F.concat(stem, F.when(k % 3 == 0, ".PDF").when(k % 3 == 1, ".docx").otherwise(".msg")).alias("filename"),
        F.concat(F.lit("/Corpus/2024/"), "source", F.lit("/Presupuesto "), F.lpad((k % 50).cast("string"), 6, "0"), F.lit("/"), stem).alias("path"), F.col("lang").alias("type"), (k % 3).alias("ext"),
        status.alias("status"), F.when(k % 9 != 0, k * 37 % 100 / 100.0).alias("confidence"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 365).cast("int")).alias("created"), (k % 19 == 0).alias("deleted"),
        "text", "n_chars", "quality", "toxic", F.when(k % 17 == 0, None).when(k % 13 == 0, "quarantine").when(k % 11 == 0, "unassigned").otherwise("assigned").alias("assignment"),
        (k % 3).alias("chain"), (k % 7).alias("hotel"), F.when(k % 5 == 0, F.array(F.lit("Confidential"), F.col("lang"))).otherwise(F.array("lang")).alias("tags"),
    )


# filters

#: The filters that documents know.
FILTERS = ("type", "status", "not_status", "path", "filename", "extension", "created_from", "created_to", "tags_any", "tags_all", "min_chars", "min_confidence", "ids", "text")


def normalised(filters: dict) -> dict:
    """Only known filters with a value; lists sorted and distinct; an extension with its dot, in lower case."""
    out = {}
    for k in FILTERS:
        v = filters.get(k)
        if v is None or v == "" or v == []:
            continue
        if isinstance(v, (list, tuple, set)):
            v = sorted(set(v))
        if k == "extension":
            v = "." + str(v).lower().lstrip(".")
        out[k] = v
    return out


def condition(filters: dict) -> Column:
    """The conjunction of normalised() filters over described() columns; a null column passes no filter but min_confidence, where unknown passes."""
    some = lambda v: v if isinstance(v, list) else [v]
    has = lambda c, v: F.lower(F.col(c)).contains(str(v).lower())
    of = {
        "type": lambda v: F.col("type").isin(some(v)),
        "status": lambda v: F.col("status").isin(some(v)),
        "not_status": lambda v: ~F.col("status").isin(some(v)),
        "path": lambda v: has("path", v),
        "filename": lambda v: has("filename", v),
        "extension": lambda v: F.lower("filename").endswith(v),
        "created_from": lambda v: F.col("created") >= F.lit(v).cast("date"),
        "created_to": lambda v: F.col("created") <= F.lit(v).cast("date"),
        "tags_any": lambda v: F.arrays_overlap("tags", F.array(*map(F.lit, some(v)))),
        "tags_all": lambda v: F.size(F.array_except(F.array(*map(F.lit, some(v))), F.col("tags"))) == 0,
        "min_chars": lambda v: F.col("n_chars") >= v,
        "min_confidence": lambda v: F.col("confidence").isNull() | (F.col("confidence") >= v),
        "ids": lambda v: F.col("id").isin(some(v)),
        "text": lambda v: has("text", v),
    }
    return reduce(lambda a, b: a & b, [F.coalesce(of[k](v), F.lit(False)) for k, v in normalised(filters).items()], F.lit(True))


@query(f"""
WITH {DESCRIBED_SQL} SELECT id, filename, status, created FROM d WHERE type IN ('en', 'de') AND status NOT IN ('failed') AND contains(lower(path), 'presupuesto 00000') AND lower(filename) LIKE '%.pdf'
 AND created BETWEEN DATE '2024-02-01' AND DATE '2024-11-30' AND list_contains(tags, 'en') AND n_chars >= 300 AND (confidence IS NULL OR confidence >= 0.2)
""")
def filtered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = {"type": ["en", "de"], "not_status": "failed", "path": "Presupuesto 00000", "extension": "PDF", "created_from": "2024-02-01", "created_to": "2024-11-30", "tags_any": ["en", "xx"], "min_chars": 300, "min_confidence": 0.2, "unknown": 1}
    return described(spark, sf_dir).filter(condition(filters)).select("id", "filename", "status", "created")


@query(f"WITH {DESCRIBED_SQL} SELECT id, filename, status FROM d WHERE NOT deleted AND status IN ('failed', 'needs_review') OR confidence < 0.75 AND NOT deleted ORDER BY id DESC LIMIT 50")
def review_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest fifty that need a look: a list of stated length."""
    d = described(spark, sf_dir).filter(~F.col("deleted") & (F.col("status").isin("failed", "needs_review") | F.coalesce(F.col("confidence") < 0.75, F.lit(False))))
    return d.select("id", "filename", "status").orderBy(F.desc("id")).limit(50)


@query(f"WITH {DESCRIBED_SQL} SELECT id, filename, path FROM d WHERE status = 'duplicate'")
def duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(spark, sf_dir).filter(condition({"status": "duplicate"})).select("id", "filename", "path")


@query(f"WITH {DESCRIBED_SQL} SELECT id, filename, status FROM d WHERE contains(lower(filename), 'src1') OR contains(lower(path), 'src1') ORDER BY status = 'duplicate', type <> 'en', created DESC, id DESC LIMIT 20")
def documents_by_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By a part of the name or path: no duplicates first, then English ones, then the newest."""
    d = described(spark, sf_dir).filter(condition({"filename": "SRC1"}) | condition({"path": "SRC1"}))
    return d.orderBy(F.col("status") == "duplicate", F.col("type") != "en", F.desc("created"), F.desc("id")).limit(20).select("id", "filename", "status")


@query(f"WITH {DESCRIBED_SQL} SELECT id, filename, regexp_extract(path, 'Presupuesto ([0-9]{{6}})', 1) AS code FROM d WHERE contains(lower(path), '/presupuesto 000007/') AND status <> 'duplicate' ORDER BY created DESC, id LIMIT 100")
def documents_by_budget_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = described(spark, sf_dir).filter(condition({"path": "/Presupuesto 000007/", "not_status": "duplicate"}))
    return d.orderBy(F.desc("created"), "id").limit(100).select("id", "filename", F.regexp_extract("path", "Presupuesto ([0-9]{6})", 1).alias("code"))


@query(f"WITH {DESCRIBED_SQL} SELECT id, filename, created FROM d WHERE status = 'processed' AND NOT deleted AND contains(lower(filename), 'src_1') = false ORDER BY created DESC, id DESC LIMIT 25 OFFSET 50")
def document_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of a list, newest first. A name is looked for as it is written: _ and % stand for themselves."""
    d = described(spark, sf_dir).filter(condition({"status": "processed"}) & ~F.col("deleted") & ~condition({"filename": "src_1"}))
    return d.orderBy(F.desc("created"), F.desc("id")).offset(50).limit(25).select("id", "filename", "created")


def like_escaped(c: Column) -> Column:
    """A text to be used within LIKE … ESCAPE '\\': backslash, % and _ stand for themselves."""
    return F.regexp_replace(c, r"([\\%_])", r"\\$1")


@query(f"""
WITH {DESCRIBED_SQL}, q AS (SELECT unnest(regexp_extract_all('what of order 0017 or 12345, and 42?', '[0-9]{{4,8}}')) AS n),
h AS (SELECT DISTINCT id, filename, created FROM d JOIN q ON contains(filename, ltrim(n, '0')) WHERE status <> 'duplicate')
SELECT id, filename FROM h ORDER BY created DESC, id LIMIT 3
""")
def similar_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that hold a number of four to eight digits of a question, without leading zeros; three at most."""
    numbers = F.regexp_extract_all(F.lit("what of order 0017 or 12345, and 42?"), F.lit("([0-9]{4,8})"), 1)
    d = described(spark, sf_dir).filter(F.exists(numbers, lambda n: F.col("filename").contains(F.ltrim(n, F.lit("0"))))).filter("status <> 'duplicate'")
    return d.orderBy(F.desc("created"), "id").limit(3).select("id", "filename")


# visibility


def allowed(scope: dict) -> Column:
    """Whether a reader of a scope may see a described() document; one definition for lists, searches and explanations.

    Deleted documents aren't seen. Administrators see the rest. A type outside the allow list, if there is one, isn't seen;
    nor is one with a denied tag (without case). Without metadata, or not assigned, a document is seen if the scope allows
    unassigned ones; assigned, if all hotels, its hotel or its chain are allowed.
    """
    return reason(scope).startswith("allowed")


def reason(scope: dict) -> Column:
    """Why, in the order of the rules; it begins with allowed or denied."""
    denied = F.array(*[F.lit(t.lower()) for t in scope.get("denied_tags", [])]).cast("array<string>")
    unassigned = F.lit(bool(scope.get("allow_unassigned")))
    one_of = lambda c, ids: F.coalesce(F.col(c).isin(list(ids)), F.lit(False)) if ids else F.lit(False)
    types = scope.get("types")
    loose = lambda what: F.when(unassigned, f"allowed: {what}").otherwise(f"denied: {what}")
    return (
        F.when(F.col("deleted"), "denied: deleted")
        .when(F.lit(bool(scope.get("is_admin"))), "allowed: administrator")
        .when(~F.coalesce(F.col("type").isin(types), F.lit(False)) if types else F.lit(False), "denied: type")
        .when(F.col("assignment").isNull(), loose("no metadata"))
        .when(F.coalesce(F.arrays_overlap(F.transform("tags", lambda t: F.lower(t)), denied), F.lit(False)), "denied: tag")
        .when(F.col("assignment") != "assigned", loose("not assigned"))
        .when(F.lit(bool(scope.get("all_hotels"))), "allowed: all hotels")
        .when(one_of("hotel", scope.get("hotels")), "allowed: hotel")
        .when(one_of("chain", scope.get("chains")), "allowed: chain")
        .otherwise("denied: outside")
    )


SCOPE = {"types": ["en", "es", "de"], "denied_tags": ["CONFIDENTIAL"], "allow_unassigned": True, "hotels": [1, 4], "chains": [2]}
REASON_SQL = """CASE WHEN deleted THEN 'denied: deleted' WHEN type IS NULL OR type NOT IN ('en', 'es', 'de') THEN 'denied: type' WHEN assignment IS NULL THEN 'allowed: no metadata' WHEN list_contains(tags, 'Confidential') THEN 'denied: tag'
 WHEN assignment <> 'assigned' THEN 'allowed: not assigned' WHEN hotel IN (1, 4) THEN 'allowed: hotel' WHEN chain = 2 THEN 'allowed: chain' ELSE 'denied: outside' END"""


@query(f"WITH {DESCRIBED_SQL} SELECT id, {REASON_SQL} AS reason, starts_with({REASON_SQL}, 'allowed') AS allowed FROM d")
def document_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(spark, sf_dir).select("id", reason(SCOPE).alias("reason"), allowed(SCOPE).alias("allowed"))


@query(f"WITH {DESCRIBED_SQL} SELECT id, filename FROM d WHERE contains(lower(text), 'license') AND starts_with({REASON_SQL}, 'allowed') ORDER BY id LIMIT 10")
def scoped_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten hits that the reader may see; the scope is applied before the limit."""
    return described(spark, sf_dir).filter(condition({"text": "License"}) & allowed(SCOPE)).orderBy("id").limit(10).select("id", "filename")


@query(f"WITH {DESCRIBED_SQL} SELECT id, assignment FROM d WHERE (assignment IS NULL OR assignment IN ('quarantine', 'unassigned')) AND NOT deleted")
def quarantined_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(spark, sf_dir).filter("(assignment IS NULL OR assignment IN ('quarantine', 'unassigned')) AND NOT deleted").select("id", "assignment")


#: Assignment rules: pattern, how it matches, tenant.
FOLDER_RULES = (("*/src1/*", "glob", "one"), ("src1?*", "glob", "never"), ("/corpus/20[0-9]+/src[2-4]/", "regex", "two"), ("presupuesto 00001", "substring", "three"), ("presupuesto 00002", "substring", "four"), ("/src5/presupuesto", "substring", "five"), ("(unclosed", "regex", "never"))


def glob_pattern(glob: str) -> str:
    """A glob's regular expression: * is anything, ? one character."""
    specials = set(r"\.^$+{}[]|()")
    return "^" + "".join({"*": ".*", "?": "."}.get(c, "\\" + c if c in specials else c) for c in glob) + "$"


def assigned(df: DataFrame, key: str, path: str, rules) -> DataFrame:
    """(key, tenant): that of the longest rule that matches the path, in lower case with one kind of slash; quarantine if rules of that length differ; unassigned without one.

    Rules are an array of columns of one pass: nothing is joined or shuffled. A pattern that isn't one matches nothing.
    """
    import re

    p, options = F.lower(F.translate(F.col(path), "\\", "/")), []
    for pattern, kind, tenant in rules:
        if kind == "substring":
            hit = p.contains(pattern.lower())
        else:
            expression = glob_pattern(pattern.lower()) if kind == "glob" else pattern.lower()
            try:
                re.compile(expression)
            except re.error:
                continue
            hit = p.rlike(expression)
        options.append(F.when(hit, F.struct(F.lit(len(pattern)).alias("size"), F.lit(tenant).alias("tenant"))))
    hits = F.array_compact(F.array(*options))
    best = F.array_max(F.transform(hits, lambda h: h["size"]))
    tenants = F.array_distinct(F.transform(F.filter(hits, lambda h: h["size"] == best), lambda h: h["tenant"]))
    return df.select(key, F.when(F.size(tenants) > 1, "quarantine").when(F.size(tenants) == 1, F.get(tenants, F.lit(0))).otherwise("unassigned").alias("tenant"))


@query(f"""
WITH {DESCRIBED_SQL}, p AS (SELECT id, lower(path) AS p FROM d), m AS (SELECT id, 17 AS n, 'three' AS t FROM p WHERE contains(p, 'presupuesto 00001') UNION ALL SELECT id, 17, 'four' FROM p WHERE contains(p, 'presupuesto 00002')
 UNION ALL SELECT id, 17, 'five' FROM p WHERE contains(p, '/src5/presupuesto') UNION ALL SELECT id, 8, 'one' FROM p WHERE contains(p, '/src1/') UNION ALL SELECT id, 28, 'two' FROM p WHERE regexp_matches(p, '/corpus/20[0-9]+/src[2-4]/')),
b AS (SELECT id, t, rank() OVER (PARTITION BY id ORDER BY n DESC) AS k FROM m), g AS (SELECT id, CASE WHEN count(DISTINCT t) > 1 THEN 'quarantine' ELSE min(t) END AS tenant FROM b WHERE k = 1 GROUP BY 1)
SELECT p.id, coalesce(tenant, 'unassigned') AS tenant FROM p LEFT JOIN g ON g.id = p.id
""")
def folder_rules_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(described(spark, sf_dir), "id", "path", FOLDER_RULES)


@query("""
WITH m AS (SELECT c_custkey % 40 AS principal, c_nationkey AS grp FROM customer), g AS (SELECT n_nationkey AS grp, n_regionkey AS chain, n_nationkey % 3 = 0 AS prices, n_nationkey % 5 = 0 AS unassigned FROM nation)
SELECT principal, bool_or(prices) AS can_view_prices, bool_or(unassigned) AS allow_unassigned, array_to_string(list_sort(list_distinct(list(chain))), ',') AS chains, count(DISTINCT m.grp) AS n_groups FROM m JOIN g ON g.grp = m.grp GROUP BY 1
""")
def effective_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each principal's groups allow together: rights by OR, chains by union (at most one a region)."""
    m = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 40).alias("principal"), F.col("c_nationkey").alias("grp"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("g"), F.col("n_regionkey").alias("chain"))
    rows = m.distinct().join(F.broadcast(n), F.col("grp") == F.col("g"))
    return rows.groupBy("principal").agg(
        F.bool_or(F.col("g") % 3 == 0).alias("can_view_prices"), F.bool_or(F.col("g") % 5 == 0).alias("allow_unassigned"), F.array_join(F.array_sort(F.collect_set("chain")).cast("array<string>"), ",").alias("chains"), F.count_distinct("grp").alias("n_groups")
    )


# quality


@query(f"""
WITH {DESCRIBED_SQL}, f AS (SELECT id, confidence, status, list_filter([CASE WHEN trim(coalesce(text, '')) = '' THEN 'page_without_text' END, CASE WHEN trim(coalesce(text, '')) <> '' AND length(trim(text)) < 40 THEN 'text_too_short' END,
 CASE WHEN coalesce(type, '') IN ('', 'fr') THEN 'document_type_unknown' END, CASE WHEN confidence < 0.3 THEN 'low_ocr_confidence' END, CASE WHEN quality = 0 THEN 'business_extraction_needs_review' END,
 CASE WHEN toxic = 1 THEN 'page_failed' END], lambda x: x IS NOT NULL) AS flags FROM d),
s AS (SELECT id, flags, status, round(greatest(0, least(1, coalesce(confidence, 0.8) - least(0.55, len(flags) * 0.12))), 4)::DOUBLE AS score FROM f)
SELECT id, score, array_to_string(list_sort(flags), ',') AS flags, CASE WHEN status = 'failed' AND NOT list_contains(flags, 'page_failed') THEN 'failed' WHEN list_contains(flags, 'page_failed') THEN 'technical_failure' WHEN list_contains(flags, 'business_extraction_needs_review') THEN 'needs_human_review'
 WHEN list_contains(flags, 'page_without_text') THEN 'needs_human_review' WHEN list_contains(flags, 'low_ocr_confidence') OR score < 0.5 THEN 'usable_with_warnings' WHEN list_contains(flags, 'document_type_unknown') THEN 'usable_with_warnings' ELSE 'processed_ok' END AS quality_status FROM s
""")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags, a score that each of them lowers, and the status that follows, the gravest first."""
    t = F.trim(F.coalesce("text", F.lit("")))
    rules = (
        ("page_without_text", t == ""), ("text_too_short", (t != "") & (F.length(t) < 40)), ("document_type_unknown", F.coalesce("type", F.lit("")).isin("", "fr")), ("low_ocr_confidence", F.col("confidence") < 0.3),
        ("business_extraction_needs_review", F.col("quality") == 0), ("page_failed", F.col("toxic") == 1),
    )
    flags = F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules])))
    d = described(spark, sf_dir).select("id", "status", "confidence", flags.alias("f"))
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.8)) - F.least(F.lit(0.55), F.size("f") * 0.12))), 4)
    d = d.withColumn("score", score)
    has = lambda name: F.array_contains("f", name)
    status = (
        F.when((F.col("status") == "failed") & ~has("page_failed"), "failed").when(has("page_failed"), "technical_failure").when(has("business_extraction_needs_review") | has("page_without_text"), "needs_human_review")
        .when(has("low_ocr_confidence") | (F.col("score") < 0.5) | has("document_type_unknown"), "usable_with_warnings").otherwise("processed_ok")
    )
    return d.select("id", "score", F.array_join("f", ",").alias("flags"), status.alias("quality_status"))


READINGS_SQL = """r AS (SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'native' WHEN 2 THEN 'engine_a' ELSE 'engine_b' END AS engine, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'native_text' WHEN 2 THEN 'photo' ELSE 'ocr' END AS kind,
 CASE WHEN doc_id % 6 = 0 THEN NULL ELSE (doc_id * 53 % 100) / 100.0::DOUBLE END AS confidence, text, replace(text, 'e', '') AS other FROM documents)"""


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, engine, kind, confidence, text, other): each text as an engine's reading of a page, with another reading to hold it against."""
    k = F.col("doc_id")
    engine = F.when(k % 4 == 1, "native").when(k % 4 == 2, "engine_a").when(k % 4 == 3, "engine_b")
    kind = F.when(k % 5 == 0, None).when(k % 5 == 1, "native_text").when(k % 5 == 2, "photo").otherwise("ocr")
    return table(spark, sf_dir, "documents").select(k.alias("id"), engine.alias("engine"), kind.alias("kind"), F.when(k % 6 != 0, k * 53 % 100 / 100.0).alias("confidence"), "text", F.replace("text", F.lit("e"), F.lit("")).alias("other"))


#: Kinds of pages that no recognition applies to.
NOT_RECOGNISED = ("native_text", "photo", "decorative")


def recognition_applies(kind: Column) -> Column:
    return kind.isNull() | ~kind.isin(*NOT_RECOGNISED)


def meets(kind: Column, confidence: Column, least: float) -> Column:
    """Pages that no recognition applies to pass by definition; others by their confidence."""
    return F.coalesce(~recognition_applies(kind) | (confidence >= least), F.lit(False))


def inferred_kind(kind: Column, engine: Column, text: Column) -> Column:
    """The kind as given, else by engine: native text, a photo without text, or a recognised page."""
    return F.coalesce(kind, F.when(engine == "native", "native_text").when(engine.isNull() & (F.coalesce(F.trim(text), F.lit("")) == ""), "photo").otherwise("ocr"))


@query(f"""
WITH {READINGS_SQL}, k AS (SELECT *, coalesce(kind, CASE WHEN engine = 'native' THEN 'native_text' WHEN engine IS NULL AND coalesce(trim(text), '') = '' THEN 'photo' ELSE 'ocr' END) AS inferred FROM r)
SELECT inferred AS kind, coalesce(engine, 'unset') AS engine, count(*) AS n, (count(*) FILTER (inferred IN ('native_text', 'photo', 'decorative') OR coalesce(confidence, -1) >= 0.6))::BIGINT AS passed FROM k GROUP BY 1, 2
""")
def recognition_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir).withColumn("kind", inferred_kind(F.col("kind"), F.col("engine"), F.col("text")))
    return r.groupBy("kind", F.coalesce("engine", F.lit("unset")).alias("engine")).agg(count().alias("n"), F.count_if(meets(F.col("kind"), F.col("confidence"), 0.6)).alias("passed"))


def decision(text: Column, confidence: Column, other: Column) -> Column:
    """struct<calibrated, decision, reason> of a reading, given another one that is sure at 0.5.

    Calibrated confidence weighs the engine's own, the text's quality and the agreement. A reading whose numbers contradict the
    other's, an empty one, one below 0.6 or one no better than the other by 0.02 is for review.
    """
    quality, agree = C.text_quality(F.trim(text)), T.agreement(F.lower(text), F.lower(other))
    calibrated = F.when(confidence.isNull(), quality * 0.70 + agree * 0.30).otherwise(confidence * 0.65 + quality * 0.25 + agree * 0.10)
    why = (
        F.when(T.numeric_conflict(text, other, F.lit(0.5)), "numeric_conflict").when(F.coalesce(F.trim(text), F.lit("")) == "", "empty_text").when(calibrated < 0.6, "below_acceptance_threshold")
        .when(quality < C.text_quality(F.trim(other)) + 0.02, "insufficient_improvement").otherwise("acceptance_threshold_met")
    )
    return F.struct(F.round(calibrated, 6).alias("calibrated"), F.when(why == "acceptance_threshold_met", "auto_accepted").otherwise("review_required").alias("decision"), why.alias("reason"))


_QUALITY = "(CASE WHEN length(trim({c})) > 0 THEN least(1::DOUBLE, 0.55::DOUBLE * (length(regexp_replace(trim({c}), '[^\\pL\\pN]', '', 'g')) / length(trim({c}))) + 0.45::DOUBLE * least(length(trim({c})) / 500::DOUBLE, 1::DOUBLE)) ELSE 0 END)"


@query(f"""
WITH {READINGS_SQL}, q AS (SELECT *, {_QUALITY.replace('{c}', 'text')} AS q, {_QUALITY.replace('{c}', 'other')} AS p, list_distinct(regexp_extract_all(lower(text), '[\\pL\\pN_]{{2,}}')) AS a, list_distinct(regexp_extract_all(lower(other), '[\\pL\\pN_]{{2,}}')) AS b,
 regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*') AS x, regexp_extract_all(other, '[0-9]+(?:[.,][0-9]+)*') AS y FROM r),
g AS (SELECT *, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.5 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS g FROM q),
c AS (SELECT *, CASE WHEN confidence IS NULL THEN q * 0.70 + g * 0.30 ELSE confidence * 0.65 + q * 0.25 + g * 0.10 END AS c FROM g),
w AS (SELECT id, engine, c, CASE WHEN len(x) > 0 AND len(y) > 0 AND len(list_intersect(x, y)) = 0 THEN 'numeric_conflict' WHEN coalesce(trim(text), '') = '' THEN 'empty_text' WHEN c < 0.6 THEN 'below_acceptance_threshold' WHEN q < p + 0.02 THEN 'insufficient_improvement' ELSE 'acceptance_threshold_met' END AS reason FROM c)
SELECT coalesce(engine, 'unset') AS engine, reason, CASE WHEN reason = 'acceptance_threshold_met' THEN 'auto_accepted' ELSE 'review_required' END AS decision, count(*) AS n, round(sum(round(c::DOUBLE, 6)::DECIMAL(18,6))::DOUBLE, 4) AS total FROM w GROUP BY 1, 2, 3
""")
def recognition_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir).select("engine", decision(F.col("text"), F.col("confidence"), F.col("other")).alias("x")).select(F.coalesce("engine", F.lit("unset")).alias("engine"), "x.*")
    return r.groupBy("engine", "reason", "decision").agg(count().alias("n"), F.round(F.sum(F.col("calibrated").cast("decimal(18,6)")).cast("double"), 4).alias("total"))


@query(f"WITH {READINGS_SQL} SELECT id, confidence, engine FROM r WHERE (confidence < 0.3 OR confidence IS NULL AND kind = 'ocr') ORDER BY confidence NULLS FIRST, id LIMIT 100")
def recognition_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred least sure pages; pages of which nothing is known come first."""
    r = readings(spark, sf_dir).filter((F.col("confidence") < 0.3) | (F.col("confidence").isNull() & (F.col("kind") == "ocr")))
    return r.orderBy(F.asc_nulls_first("confidence"), "id").limit(100).select("id", "confidence", "engine")


def replaces(primary: Column, primary_quality: Column, fallback: Column, fallback_quality: Column, least: float = 0.10, gain: int = 30) -> Column:
    """Whether a fallback reading replaces the first: not if both are weak (below 0.3), else if its quality or its count of letters and digits is enough better."""
    letters = lambda c: F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}]", ""))
    weak = (primary_quality < 0.3) & (fallback_quality < 0.3)
    return F.when(weak, False).otherwise((fallback_quality - primary_quality >= least) | (letters(fallback) - letters(primary) >= gain))


@query(f"""
WITH {READINGS_SQL}, q AS (SELECT id, text, other, {_QUALITY.replace('{c}', 'text')} AS q, {_QUALITY.replace('{c}', 'other')} AS p FROM r WHERE text IS NOT NULL)
SELECT id, CASE WHEN p < 0.3 AND q < 0.3 THEN false ELSE q - p >= 0.1 OR length(regexp_replace(text, '[^\\pL\\pN]', '', 'g')) - length(regexp_replace(other, '[^\\pL\\pN]', '', 'g')) >= 30 END AS replaced FROM q
""")
def fallback_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = lambda c: C.text_quality(F.trim(c))
    return readings(spark, sf_dir).filter("text IS NOT NULL").select("id", replaces(F.col("other"), q("other"), F.col("text"), q("text")).alias("replaced"))


# dashboards


@query(f"""
WITH {DESCRIBED_SQL} SELECT (count(*) FILTER (confidence < 0.5 AND status <> 'processed'))::BIGINT AS low_confidence, (count(*) FILTER (type = 'fr'))::BIGINT AS unknown_type, (count(*) FILTER (status = 'duplicate'))::BIGINT AS duplicates,
 (count(*) FILTER (status = 'failed'))::BIGINT AS failed, (count(*) FILTER (status = 'needs_review'))::BIGINT AS review FROM d WHERE starts_with({REASON_SQL}, 'allowed')
""")
def work_inbox_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of what waits, of the documents that the reader may see, in one pass."""
    n = lambda c: F.count_if(F.expr(c))
    return described(spark, sf_dir).filter(allowed(SCOPE)).agg(n("confidence < 0.5 AND status <> 'processed'").alias("low_confidence"), n("type = 'fr'").alias("unknown_type"), n("status = 'duplicate'").alias("duplicates"), n("status = 'failed'").alias("failed"), n("status = 'needs_review'").alias("review"))


@query(f"WITH {DESCRIBED_SQL} SELECT 'status' AS metric, status AS name, count(*) AS n FROM d GROUP BY 2 UNION ALL SELECT 'type', coalesce(type, 'unknown'), count(*) FROM d GROUP BY 2 UNION ALL SELECT 'assignment', coalesce(assignment, 'unknown'), count(*) FROM d GROUP BY 2")
def processing_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by three columns at once: rows are unpivoted and pre-aggregated, so the documents are read once."""
    d = described(spark, sf_dir).select("status", "type", "assignment")
    rows = d.selectExpr("stack(3, 'status', status, 'type', type, 'assignment', assignment) AS (metric, name)")
    return rows.groupBy("metric", F.coalesce("name", F.lit("unknown")).alias("name")).agg(count().alias("n"))


@query(f"""
WITH {DESCRIBED_SQL} SELECT regexp_extract(path, 'Presupuesto ([0-9]+)', 1) AS budget, status, type, count(*) AS n FROM d WHERE NOT deleted GROUP BY GROUPING SETS ((budget, status), (budget, type), (budget))
""")
def budget_summary_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each budget by status, by type, and in all, in one pass."""
    d = described(spark, sf_dir).filter("NOT deleted").select(F.regexp_extract("path", "Presupuesto ([0-9]+)", 1).alias("budget"), "status", "type")
    return d.groupingSets([["budget", "status"], ["budget", "type"], ["budget"]], "budget", "status", "type").agg(count().alias("n"))


@query("""
WITH j AS (SELECT event_id, ts, event_type, value, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type IN ('purchase', 'error')),
m AS (SELECT sum(round(value, 6)::DECIMAL(18,6))::DOUBLE / count(value) AS mean FROM j WHERE k <= 200), c AS (SELECT (count(*) FILTER (event_type = 'signup'))::BIGINT AS pending, (count(*) FILTER (event_type = 'error'))::BIGINT AS failed FROM events)
SELECT pending, failed, round(mean, 6) AS mean_seconds, round(mean * pending, 4) AS eta_seconds, CASE WHEN failed > 10 THEN 'warning' ELSE 'ok' END AS state FROM m, c
""")
def operations_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What waits, the mean duration of the last 200 finished jobs, and when the rest will be done."""
    e = table(spark, sf_dir, "events")
    last = e.filter("event_type IN ('purchase', 'error')").orderBy(F.desc("ts"), F.desc("event_id")).limit(200)
    mean = last.agg((F.sum(F.round("value", 6).cast("decimal(18,6)")).cast("double") / F.count("value")).alias("mean"))
    c = e.agg(F.count_if(F.col("event_type") == "signup").alias("pending"), F.count_if(F.col("event_type") == "error").alias("failed"))
    return c.join(F.broadcast(mean)).select("pending", "failed", F.round("mean", 6).alias("mean_seconds"), F.round(F.col("mean") * F.col("pending"), 4).alias("eta_seconds"), F.when(F.col("failed") > 10, "warning").otherwise("ok").alias("state"))


@query("""
WITH t AS (SELECT max(ts) AS now FROM events), w AS (SELECT user_id, count(*) AS n FROM events, t WHERE ts > now - INTERVAL 1 DAY AND event_type = 'signup' GROUP BY 1),
p AS (SELECT 'pending ' || user_id AS what, n FROM w ORDER BY n DESC, user_id LIMIT 10), s AS (SELECT 'status ' || s.x AS what, (SELECT count(*) FROM events WHERE event_type = s.x) AS n FROM (VALUES ('signup'), ('purchase'), ('refund')) s(x))
SELECT what, n FROM p UNION ALL SELECT what, n FROM s UNION ALL SELECT 'oldest age in hours', floor(date_part('epoch', now - (SELECT min(ts) FROM events WHERE event_type = 'signup')) / 3600)::BIGINT FROM t
""")
def health_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by status with zeros, the age of the oldest that waits, and the ten who wait most within a day."""
    e = table(spark, sf_dir, "events").select("ts", "user_id", "event_type")
    now = e.agg(F.max("ts").alias("now"))
    recent = e.filter("event_type = 'signup'").join(F.broadcast(now)).filter("ts > now - INTERVAL 1 DAY").groupBy("user_id").agg(count().alias("n")).orderBy(F.desc("n"), "user_id").limit(10)
    one = recent.select(F.concat(F.lit("pending "), F.col("user_id").cast("string")).alias("what"), "n")
    sums = e.agg(*[F.count_if(F.col("event_type") == s).alias(s) for s in ("signup", "purchase", "refund")], F.max("ts").alias("now"), F.min(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("oldest"))
    age = F.expr("floor((unix_micros(cast(now AS timestamp)) - unix_micros(cast(oldest AS timestamp))) / 3600000000)").cast("long")
    two = sums.select(F.explode(F.array(*[F.struct(F.lit(f"status {s}").alias("what"), F.col(s).alias("n")) for s in ("signup", "purchase", "refund")], F.struct(F.lit("oldest age in hours").alias("what"), age.alias("n")))).alias("r")).select("r.*")
    return one.unionByName(two)


@query("SELECT label AS symbol, count(*) AS n, (count(*) FILTER (abs(embedding[1]) >= 0.1))::BIGINT AS sure FROM embeddings GROUP BY 1 HAVING count(*) > 1")
def symbol_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections by class, and those that are sure enough."""
    e = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("symbol")).agg(count().alias("n"), F.count_if(F.abs(F.get("embedding", F.lit(0))) >= 0.1).alias("sure"))
    return e.filter("n > 1")


@query(f"""
WITH {DESCRIBED_SQL}, c AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'no vector' WHEN id % 7 = 0 THEN 'fallback' WHEN id % 11 = 0 THEN 'old model' WHEN id % 13 = 0 THEN 'asked for' END AS why FROM d WHERE NOT deleted)
SELECT id, why FROM c WHERE why IS NOT NULL ORDER BY id LIMIT 200
""")
def reembedding_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that need new vectors and why, the first reason that holds; a batch of stated size."""
    k = F.col("id")
    why = F.when(k % 4 == 0, "no vector").when(k % 7 == 0, "fallback").when(k % 11 == 0, "old model").when(k % 13 == 0, "asked for")
    return described(spark, sf_dir).filter("NOT deleted").select("id", why.alias("why")).filter("why IS NOT NULL").orderBy("id").limit(200)


@query(f"""
WITH {DESCRIBED_SQL} SELECT id, confidence, concat_ws('; ', CASE WHEN confidence < 0.5 THEN 'low confidence' END, CASE WHEN status = 'needs_review' THEN 'needs review' END) AS why FROM d
WHERE (confidence < 0.5 OR status = 'needs_review') AND starts_with({REASON_SQL}, 'allowed') ORDER BY confidence NULLS LAST, id LIMIT 40
""")
def improvement_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least sure that the reader may see, unknown last; a list of stated length."""
    d = described(spark, sf_dir).filter(allowed(SCOPE) & ((F.col("confidence") < 0.5) | (F.col("status") == "needs_review")))
    why = F.concat_ws("; ", F.when(F.col("confidence") < 0.5, "low confidence"), F.when(F.col("status") == "needs_review", "needs review"))
    return d.orderBy(F.asc_nulls_last("confidence"), "id").limit(40).select("id", "confidence", why.alias("why"))


@query(f"""
WITH {DESCRIBED_SQL}, x AS (SELECT id, path, text FROM d WHERE contains(path, 'Presupuesto 00000') AND regexp_matches(lower(coalesce(text, '')), 'public|token|license|porte'))
SELECT id, regexp_extract(lower(x.text), '(public|token|license|porte)', 1) AS word, confidence FROM x JOIN d USING (id) ORDER BY confidence DESC NULLS LAST, id LIMIT 20
""")
def keyword_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents below a path that hold any of some words, the surest first, unknown last."""
    d = described(spark, sf_dir).filter(condition({"path": "Presupuesto 00000"})).withColumn("word", F.regexp_extract(F.lower("text"), "(public|token|license|porte)", 1)).filter("word <> ''")
    return d.orderBy(F.desc_nulls_last("confidence"), "id").limit(20).select("id", "word", "confidence")


@query(f"""
WITH {DESCRIBED_SQL}, o AS (SELECT sha256(coalesce(text, '')) AS h, min(id) AS first FROM d GROUP BY 1)
SELECT id, h AS file_hash, CASE WHEN first <> id THEN first END AS duplicate_of, regexp_extract(path, 'Presupuesto ([0-9]+)', 1) AS folder_code, CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN '000001' ELSE lpad((id % 50)::VARCHAR, 6, '0') END AS content_code,
 CASE WHEN id % 4 = 0 THEN 'folder_only' WHEN id % 4 = 1 AND id % 50 <> 1 THEN 'conflict' ELSE 'verified' END AS link_status FROM d JOIN o ON o.h = sha256(coalesce(text, ''))
""")
def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each content occurs: the first of equal contents, and whether folder and content name one code. Only digests are shuffled."""
    d = described(spark, sf_dir).select("id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("file_hash"), F.regexp_extract("path", "Presupuesto ([0-9]+)", 1).alias("folder_code"))
    k = F.col("id")
    code = F.when(k % 4 == 0, None).when(k % 4 == 1, "000001").otherwise(F.lpad((k % 50).cast("string"), 6, "0"))
    first = d.groupBy(F.col("file_hash").alias("h")).agg(F.min("id").alias("first"))
    d = d.withColumn("content_code", code).join(first, F.col("file_hash") == F.col("h"))
    folder, content = F.col("folder_code"), F.col("content_code")
    status = F.when(content.isNull() & (folder != ""), "folder_only").when(folder == content, "verified").when((folder != "") & content.isNotNull(), "conflict").when(content.isNotNull(), "content_only").otherwise("manual")
    return d.select("id", "file_hash", F.nullif("first", "id").alias("duplicate_of"), "folder_code", "content_code", status.alias("link_status"))


@query(f"""
WITH {DESCRIBED_SQL}, f AS (SELECT id AS stored FROM d WHERE id % 10 <> 3 UNION ALL SELECT -id FROM d WHERE id % 50 = 1)
SELECT CASE WHEN stored IS NULL THEN 'missing' ELSE 'orphan' END AS kind, count(*) AS n FROM d FULL JOIN f ON stored = id WHERE stored IS NULL OR id IS NULL GROUP BY 1
""")
def storage_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a file, and files without a document."""
    ids = described(spark, sf_dir).select("id")
    files = ids.filter("id % 10 <> 3").select(F.col("id").alias("stored")).unionByName(ids.filter("id % 50 = 1").select((-F.col("id")).alias("stored")))
    both = ids.join(files, F.col("stored") == F.col("id"), "full").filter("stored IS NULL OR id IS NULL")
    return both.groupBy(F.when(F.col("stored").isNull(), "missing").otherwise("orphan").alias("kind")).agg(count().alias("n"))


@query(f"""
WITH {DESCRIBED_SQL}, c AS (SELECT id FROM d WHERE status = 'processed' AND list_contains(tags, 'en') AND list_contains(tags, 'Confidential') AND id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND user_id IS NOT NULL))
SELECT id FROM c ORDER BY id DESC LIMIT 30
""")
def bulk_reprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with all of some tags and no active job, the newest first, up to a stated ceiling."""
    busy = table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("user_id").alias("busy")).distinct()
    d = described(spark, sf_dir).filter(condition({"status": "processed", "tags_all": ["en", "Confidential"]}))
    return d.join(busy, F.col("id") == F.col("busy"), "left_anti").select("id").orderBy(F.desc("id")).limit(30)


@query("""
WITH p AS (SELECT DISTINCT conv_id, role AS person FROM conversations), c AS (SELECT c_custkey, c_name FROM customer)
SELECT conv_id, person, CASE WHEN c_name IS NULL THEN '(unknown)' ELSE left(c_name, 1) || '***' END AS contact FROM p LEFT JOIN c ON c_custkey = conv_id
""")
def project_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who takes part, with their contact if there is one, redacted."""
    p = table(spark, sf_dir, "conversations").select("conv_id", F.col("role").alias("person")).distinct()
    rows = p.join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("c_custkey") == F.col("conv_id"), "left")
    return rows.select("conv_id", "person", F.when(F.col("c_name").isNull(), "(unknown)").otherwise(F.concat(F.left("c_name", F.lit(1)), F.lit("***"))).alias("contact"))


@query("""
WITH r AS (SELECT l_orderkey AS source, l_partkey AS target, l_suppkey AS evidence, l_linenumber AS depth FROM lineitem),
b AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY depth, evidence) AS k FROM r)
SELECT source, target, evidence, p_name AS name FROM b LEFT JOIN part ON p_partkey = target WHERE k = 1
""")
def strongest_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest relation of each pair with its name; min_by aggregates before the shuffle."""
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target")).agg(F.min_by("l_suppkey", F.struct("l_linenumber", "l_suppkey")).alias("evidence"))
    return r.join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name")), F.col("p_partkey") == F.col("target"), "left").select("source", "target", "evidence", "name")


@query("""
WITH q AS (SELECT event_id, CASE event_id % 2 WHEN 0 THEN 'relation' ELSE 'entity' END AS kind, user_id AS target FROM events WHERE event_type = 'view')
SELECT event_id, kind, c_name AS name FROM q LEFT JOIN customer ON kind = 'relation' AND c_custkey = target
""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items for review with the relation that they are about, if they are about one."""
    q = table(spark, sf_dir, "events").filter("event_type = 'view'").select("event_id", F.when(F.col("event_id") % 2 == 0, "relation").otherwise("entity").alias("kind"), F.col("user_id").alias("target"))
    rows = q.join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), (F.col("kind") == "relation") & (F.col("c_custkey") == F.col("target")), "left")
    return rows.select("event_id", "kind", F.col("c_name").alias("name"))


def top_by_document(items: DataFrame, most: int = 12) -> DataFrame:
    """items (document, item, score) in the order in which a context takes them: each document's best first, then the rest, by score; most of them at most."""
    w = W.partitionBy("document").orderBy(F.desc("score"), "item")
    rows = items.withColumn("k", F.row_number().over(w))
    return rows.orderBy(F.least("k", F.lit(2)), F.desc("score"), "document", "item").limit(most).drop("k")


@query("""
WITH i AS (SELECT DISTINCT conv_id AS document, turn AS item, CASE role WHEN 'system' THEN 2.0 WHEN 'user' THEN 1.5 ELSE 1.0 END + least(length(text), 400) / 4000.0 AS score FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY document ORDER BY score DESC, item) AS k FROM i)
SELECT document, item, round(score, 6)::DOUBLE AS score FROM k ORDER BY least(k, 2), score DESC, document, item LIMIT 12
""")
def prioritised_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("role") == "system", 2.0).when(F.col("role") == "user", 1.5).otherwise(1.0) + F.least(F.length("text"), F.lit(400)) / 4000.0
    i = table(spark, sf_dir, "conversations").filter("conv_id IS NOT NULL").select(F.col("conv_id").alias("document"), F.col("turn").alias("item"), score.alias("score")).distinct()
    return top_by_document(i).withColumn("score", F.round("score", 6))
