"""Hash embeddings, three-list hybrid search, exact search over several sources, fusion, and the measures of retrieval."""

import difflib
import hashlib
from collections import Counter
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lectern.functions import columns as C
from lectern.functions import text as T
from lectern.operators.business import count
from lectern.operators.corpus import DESCRIBED_SQL, described
from lectern.operators.documents import WORDS, _bm25_sql, rrf, text_search
from lectern.operators.records import BUDGETS_SQL, INVOICES_SQL, budgets, invoices
from lectern.operators.registry import Registry
from lectern.operators.vectorindex import nearest
from lectern.operators.wordindex import hybrid_pool
from lectern.sources.stored import once
from lectern.sources.tables import spread, table

query = Registry()

#: Components of a hash embedding, and what a token's 3-grams weigh beside it.
SIZE, GRAM = 64, 0.35


def _feature(feature: str, size: int) -> tuple[int, float]:
    """A feature's component and sign, of its SHA-256: the first four bytes, and the parity of the fifth."""
    digest = hashlib.sha256(feature.encode()).digest()
    return int.from_bytes(digest[:4], "big") % size, 1.0 if digest[4] % 2 == 0 else -1.0


@lru_cache(100_000)
def _token(token: str, size: int) -> np.ndarray:
    """What one token adds: its own feature and those of its 3-grams. A worker remembers the last 100,000 tokens (half a kilobyte each)."""
    v = np.zeros(size)
    grams = [token] if len(token) <= 3 else [token[i : i + 3] for i in range(len(token) - 2)]
    for name, weight in ((token, 1.0), *((f"ng:{g}", GRAM) for g in grams)):
        at, sign = _feature(name, size)
        v[at] += sign * weight
    return v


def embedding(tokens: list[str], size: int = SIZE) -> list[float]:
    """Signed sums of the tokens' and their 3-grams' features, at length 1; zeros without tokens."""
    times = Counter(tokens)
    v = np.array(list(times.values()), float) @ np.stack([_token(t, size) for t in times]) if times else np.zeros(size)
    norm = np.sqrt(v @ v)
    return (v / norm if norm else v).tolist()


@F.pandas_udf(ArrayType(DoubleType()))
def hash_vector(s: pd.Series) -> pd.Series:
    """embedding() of a column of token arrays; null for null. Python, in Arrow batches: a token is hashed once a worker."""
    return pd.Series([None if x is None else embedding(list(x)) for x in s], dtype=object)


#: Tokens whose vectors a task holds (half a kilobyte each) before it begins anew.
HELD = 200_000


def embedded(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(vec_id, embedding) of every row's whole text, in one Arrow pass from text to vector; a null text is empty. A task hashes each token once."""
    rows = spread(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")))

    def run(batches):
        known, vectors = {}, np.empty((1024, SIZE))
        for b in batches:
            out = np.zeros((len(b), SIZE))
            for k, t in enumerate(b.column(1).to_pylist()):
                times = Counter(T.plain_tokens(t or ""))
                if len(known) > HELD:
                    known.clear()
                at = np.empty(len(times), np.int64)
                for j, w in enumerate(times):
                    i = known.get(w)
                    if i is None:
                        i = known[w] = len(known)
                        if i >= len(vectors):
                            vectors = np.concatenate([vectors, np.empty_like(vectors)])
                        vectors[i] = _token(w, SIZE)
                    at[j] = i
                if len(at):
                    v = np.fromiter(times.values(), float, len(at)) @ vectors[at]
                    norm = np.sqrt(v @ v)
                    out[k] = v / norm if norm else v
            offsets = pa.array(np.arange(len(b) + 1) * SIZE, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], ["vec_id", "embedding"])

    return rows.mapInArrow(run, "vec_id long, embedding array<double>")


def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embedded() of the documents, made once."""
    return once(table(spark, sf_dir, "documents"), f"vectors-{SIZE}-2", embedded)


EMBEDDED_SQL = f"""
et AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(strip_accents(lower(coalesce(text, ''))), '[^\\x00-\\x7F]', '', 'g'), '[a-z0-9]+')) AS w FROM documents),
ec AS (SELECT doc_id, w, count(*) AS n FROM et GROUP BY 1, 2),
ef AS (SELECT w AS t, w AS f, 1.0::DOUBLE AS weight FROM (SELECT DISTINCT w FROM ec) UNION ALL
 SELECT w, unnest(CASE WHEN length(w) <= 3 THEN ['ng:' || w] ELSE list_transform(range(1, length(w) - 1), lambda k: 'ng:' || substr(w, k, 3)) END), {GRAM} FROM (SELECT DISTINCT w FROM ec)),
eh AS (SELECT t, f, weight, sha256(f) AS h FROM ef), ev AS (SELECT t, ('0x' || substr(h, 1, 8))::BIGINT % {SIZE} AS b, sum(CASE WHEN ('0x' || substr(h, 9, 2))::BIGINT % 2 = 0 THEN weight ELSE -weight END) AS v FROM eh GROUP BY 1, 2),
es AS (SELECT doc_id, b, sum(n * v) AS v FROM ec JOIN ev ON t = w GROUP BY 1, 2), en AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM es GROUP BY 1)"""


@query(f"WITH {EMBEDDED_SQL} SELECT doc_id, b AS component, round(v / norm, 6) AS value FROM es JOIN en USING (doc_id) WHERE norm > 0 AND abs(round(v / norm, 6)) > 0")
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components that aren't zero of each text's vector."""
    e = stored_vectors(spark, sf_dir).select(F.col("vec_id").alias("doc_id"), F.posexplode("embedding").alias("component", "value"))
    return e.select("doc_id", F.col("component").cast("long").alias("component"), F.round("value", 6).alias("value")).filter("abs(value) > 0")


def semantic(e: DataFrame, words: tuple[str, ...], most: int = 30) -> DataFrame:
    """(doc_id, score): of vectors (vec_id, embedding) of texts, those nearest to a query's words, exact, at most most of them."""
    q = np.array(embedding(list(words)))
    dot = F.aggregate(F.zip_with("embedding", F.array(*map(F.lit, q.tolist())), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return e.select(F.col("vec_id").alias("doc_id"), F.round(dot, 6).alias("score")).filter("score > 0.02").orderBy(F.desc("score"), "doc_id").limit(most)


_BM = _bm25_sql()
_Q = ", ".join(f"({b}, {v!r})" for b, v in enumerate(embedding(list(WORDS))))


@query(f"""
WITH {_BM},
a AS (SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 30),
b AS (SELECT doc_id, 1.0 AS score FROM documents WHERE contains(lower(text), 'license') ORDER BY doc_id LIMIT 30),
r AS (SELECT doc_id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) AS part FROM a UNION ALL SELECT doc_id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) FROM b)
SELECT doc_id, round(sum(part), 6)::DOUBLE AS score FROM r GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 10
""")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best of a lexical list and a phrase list, fused; pools of thirty each."""
    said = text_search(spark, sf_dir).orderBy(F.desc("score"), "doc_id").limit(30)
    return rrf([hybrid_pool(spark, sf_dir), said], "doc_id", 10)


@query(f"""
WITH {_BM}, {EMBEDDED_SQL}, q(b, q) AS (VALUES {_Q}),
sem AS (SELECT doc_id, round(sum(v / norm * q), 6) AS score FROM es JOIN en USING (doc_id) JOIN q USING (b) WHERE norm > 0 GROUP BY 1),
a AS (SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 30), b AS (SELECT doc_id, 1.0 AS score FROM documents WHERE contains(lower(text), 'license') ORDER BY doc_id LIMIT 30), c AS (SELECT doc_id, score FROM sem WHERE score > 0.02 ORDER BY score DESC, doc_id LIMIT 30),
r AS (SELECT doc_id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) AS part FROM a UNION ALL SELECT doc_id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) FROM b UNION ALL SELECT doc_id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) FROM c)
SELECT doc_id, round(sum(part), 6)::DOUBLE AS score FROM r GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 10
""")
def hybrid_three_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best of a lexical, a phrase and a semantic list, fused; pools of thirty each."""
    said = text_search(spark, sf_dir).orderBy(F.desc("score"), "doc_id").limit(30)
    return rrf([hybrid_pool(spark, sf_dir), said, semantic(stored_vectors(spark, sf_dir), WORDS)], "doc_id", 10)


# exact search

#: How a question names a number: kind, pattern.
IDENTIFIERS = (("budget", r"(?i)\bpresupuesto\s+(?:n[º°o.]*\s*)?([A-Z]{0,4}-?\d[\d./-]*)"), ("order", r"(?i)\bpedido\s+(?:n[º°o.]*\s*)?(\d[\d./-]*)"), ("invoice", r"(?i)\bfactura\s+(?:n[º°o.]*\s*)?([A-Z]{0,4}-?\d[\d./-]*)"), ("number", r"(?<![\d-])(\d{5,12})(?![\d-])"))


def identifiers(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, value) of the numbers that each question names, value being at least two characters."""
    found = F.concat(*[F.transform(F.regexp_extract_all(F.col(text), F.lit(p), 1), _kinded(kind)) for kind, p in IDENTIFIERS])
    return df.select(key, F.explode(found).alias("i")).select(key, "i.kind", F.regexp_replace("i.value", r"[./-]+$", "").alias("value")).filter("length(value) >= 2")


def _kinded(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))


def plain_number(c: Column) -> Column:
    """A number without separators and leading zeros; at least one digit."""
    return F.regexp_replace(F.regexp_replace(c, r"[\s./-]", ""), "^0+(?=.)", "")


def contains_number(text: Column, plain: str) -> Column:
    """Whether a text holds the number as a whole: separators between digits and leading zeros don't matter, further digits do."""
    return F.coalesce(text.rlike(r"(?<!\d)0*" + r"[\s.\-/]*".join(plain) + r"(?!\d)"), F.lit(False))


def contains_phrase(text: Column, phrase: str) -> Column:
    """Whether a text holds the phrase, without case, with no letter, digit or underscore beside it."""
    import re

    return F.coalesce(text.rlike(r"(?iU)(?<![\p{L}\p{N}_])" + re.escape(phrase) + r"(?![\p{L}\p{N}_])"), F.lit(False))


def by_priority(sources: list[DataFrame], asked: DataFrame) -> DataFrame:
    """(asked, document, priority) for numbers that are asked for: each source is (document, number), the first the best; a document's best hit stays.

    Numbers meet by their plain form in an equi-join for each source, whatever their number, and pre-aggregated.
    """
    a = asked.select("asked", plain_number(F.col("asked")).alias("k")).distinct()
    hits = [s.select("document", plain_number(F.col("number")).alias("n")).distinct().join(a, F.col("n") == F.col("k")).select("asked", "document", F.lit(i + 1).cast("long").alias("priority")) for i, s in enumerate(sources)]
    return reduce(lambda x, y: x.unionByName(y), hits).groupBy("asked", "document").agg(F.min("priority").alias("priority"))


@query(f"""
WITH {BUDGETS_SQL}, {INVOICES_SQL}, a AS (SELECT DISTINCT '0' || o_orderkey AS asked, o_orderkey::VARCHAR AS k FROM orders WHERE o_orderkey % 100 = 0),
h AS (SELECT asked, 'budget ' || id AS document, 1 AS p FROM budgets JOIN a ON id::VARCHAR = k UNION ALL SELECT asked, 'invoice ' || number, 2 FROM invoices JOIN a ON order_id::VARCHAR = k
 UNION ALL SELECT asked, 'text ' || doc_id, 3 FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS n FROM documents) t JOIN a ON ltrim(n, '0') = k OR (ltrim(n, '0') = '' AND n <> '' AND k = '0'))
SELECT asked, document, min(p)::BIGINT AS priority FROM h GROUP BY 1, 2
""")
def exact_search_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth order's number, written with a leading zero, in budgets, invoices and texts."""
    b = budgets(spark, sf_dir).select(F.concat(F.lit("budget "), F.col("id").cast("string")).alias("document"), F.col("id").cast("string").alias("number"))
    i = invoices(spark, sf_dir).select(F.concat(F.lit("invoice "), F.col("number")).alias("document"), F.col("order_id").cast("string").alias("number"))
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("text "), F.col("doc_id").cast("string")).alias("document"), F.explode(F.regexp_extract_all("text", F.lit("([0-9]+)"), 1)).alias("number"))
    asked = table(spark, sf_dir, "orders").filter("o_orderkey % 100 = 0").select(F.concat(F.lit("0"), F.col("o_orderkey").cast("string")).alias("asked"))
    return by_priority([b, i, d], asked)


@query("""
WITH h AS (SELECT doc_id AS id, 1::BIGINT AS p FROM documents WHERE regexp_matches(text, '(?i)(^|[^\\pL\\pN_])rights reserved($|[^\\pL\\pN_])') UNION ALL SELECT doc_id, 2 FROM documents WHERE regexp_matches(text, '(?i)(^|[^\\pL\\pN_])public license($|[^\\pL\\pN_])')
 UNION ALL SELECT doc_id, 3 FROM documents WHERE regexp_matches(source, '(?i)(^|[^\\pL\\pN_])src1($|[^\\pL\\pN_])'))
SELECT id, min(p) AS priority FROM h GROUP BY 1
""")
def phrase_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases as whole words in several places, each document's best hit; one pass."""
    t = F.col("text")
    p = F.when(contains_phrase(t, "Rights Reserved"), 1).when(contains_phrase(t, "public license"), 2).when(contains_phrase(F.col("source"), "SRC1"), 3)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), p.cast("long").alias("priority")).filter("priority IS NOT NULL")


@query("SELECT o_orderkey, 'order' AS kind, o_orderkey::VARCHAR || '/96' AS value FROM orders UNION ALL SELECT o_orderkey, 'invoice', 'F-' || o_orderkey FROM orders UNION ALL SELECT o_orderkey, 'number', (1000000 + o_orderkey)::VARCHAR FROM orders UNION ALL SELECT o_orderkey, 'number', o_orderkey::VARCHAR FROM orders WHERE o_orderkey >= 10000")
def question_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers that a question for each order names."""
    k = F.col("o_orderkey").cast("string")
    text = F.concat(F.lit("¿Qué hay del pedido nº "), k, F.lit("/96. y de la factura F-"), k, F.lit(", o "), (F.col("o_orderkey") + 1_000_000).cast("string"), F.lit("?"))
    return identifiers(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), "o_orderkey", "text")


# fusion and contexts


@query("""
WITH q AS (SELECT doc_id, lower(text) AS t FROM documents), l AS (SELECT 'a' AS s, doc_id, length(t) - length(replace(t, 'license', '')) AS score FROM q WHERE contains(t, 'license') UNION ALL SELECT 'b', doc_id, length(t) - length(replace(t, 'public', '')) FROM q WHERE contains(t, 'public')
 UNION ALL SELECT 'c', doc_id, length(t) - length(replace(t, 'rights', '')) FROM q WHERE contains(t, 'rights')),
k AS (SELECT s, doc_id, row_number() OVER (PARTITION BY s ORDER BY score DESC, doc_id) AS r FROM l)
SELECT doc_id, round(sum(1.0 / (60 + r)), 6)::DOUBLE AS score FROM k WHERE r <= 40 GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 15
""")
def reformulations_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen best of three reformulations' lists, of forty each."""
    t = F.lower("text")
    one = lambda w: table(spark, sf_dir, "documents").filter(t.contains(w)).select("doc_id", (F.length(t) - F.length(F.replace(t, F.lit(w), F.lit("")))).alias("score")).orderBy(F.desc("score"), "doc_id").limit(40)
    return rrf([one(w) for w in ("license", "public", "rights")], "doc_id", 15)


def variations(query_text: str, most: int = 4) -> list[tuple[str, float]]:
    """A question and its variations with their weights, 1 / (1 + n): its words alone, its numbers (0.9), and these without separators (0.85), none over 2.5 times its length."""
    import re

    words = " ".join(w for w in re.findall(r"\w+", query_text.lower()) if len(w) > 3)
    out = [(query_text, 1.0)] + [(v, 1 / (1 + n)) for n, v in enumerate([words, f"documento {words}"], 1) if v.strip()]
    numbers = re.findall(r"\d[\d./-]*\d", query_text)
    out += [(n, 0.9) for n in numbers] + [(re.sub(r"[./-]", "", n), 0.85) for n in numbers if re.search(r"[./-]", n)]
    best: dict[str, float] = {}
    for v, w in out:
        if len(v) <= 2.5 * len(query_text):
            best[v] = max(w, best.get(v, 0))
    return sorted(best.items(), key=lambda x: -x[1])[:most]


@query("""
WITH e AS (SELECT label, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM e),
x AS (SELECT label, unnest(u) AS x, unnest(range(1, 65)) AS k FROM u), s AS (SELECT label, k, sum(x) AS s FROM x GROUP BY 1, 2), n AS (SELECT label, count(*) AS n FROM u GROUP BY 1)
SELECT s.label, n, round((sum(s * s) - n) / (n * (n - 1)), 6) AS similarity FROM s JOIN n USING (label) WHERE n > 1 GROUP BY 1, 2
""")
def average_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cosine similarity of all pairs of a class: from the length of the sum of its unit vectors, so no pairs are made."""
    u = table(spark, sf_dir, "embeddings").select("label", T.unit(F.col("embedding")).alias("u"))
    n = u.groupBy(F.col("label").alias("l")).agg(count().alias("n"))
    s = u.select("label", F.posexplode("u").alias("k", "x")).groupBy("label", "k").agg(F.sum("x").alias("s")).groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("square"))
    rows = s.join(n, F.col("label") == F.col("l")).filter("n > 1")
    return rows.select("label", "n", F.round((F.col("square") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 6).alias("similarity"))


@query(f"""
WITH {DESCRIBED_SQL}, g AS (SELECT type, count(*) AS n, avg(quality) AS relevance, exp(avg(ln(greatest(coalesce(confidence, 0.15), 0.15)))) AS reading FROM d GROUP BY 1),
c AS (SELECT type, 0.35 * least(n / 6.0, 1) + 0.35 * coalesce(relevance, 0) + 0.30 * reading AS c FROM g)
SELECT type, round(c::DOUBLE, 6) AS confidence, CASE WHEN c >= 0.8 THEN 'Alta' WHEN c >= 0.5 THEN 'Media' ELSE 'Baja' END AS label FROM c
""")
def answer_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sure an answer from a group of sources is: how many, how relevant, and the geometric mean of how well they were read."""
    d = described(spark, sf_dir).groupBy("type").agg(count().alias("n"), F.avg("quality").alias("relevance"), F.exp(F.avg(F.ln(F.greatest(F.coalesce("confidence", F.lit(0.15)), F.lit(0.15))))).alias("reading"))
    c = 0.35 * F.least(F.col("n") / 6.0, F.lit(1.0)) + 0.35 * F.coalesce("relevance", F.lit(0.0)) + 0.30 * F.col("reading")
    return d.select("type", F.round(c, 6).alias("confidence"), F.when(c >= 0.8, "Alta").when(c >= 0.5, "Media").otherwise("Baja").alias("label"))


@query(f"""
WITH {DESCRIBED_SQL} SELECT id, array_to_string(list_filter([CASE WHEN confidence < 0.5 THEN 'low_confidence' END, CASE WHEN status = 'duplicate' THEN 'duplicate' END, CASE WHEN coalesce(type, '') = '' THEN 'unknown_type' END, CASE WHEN status = 'needs_review' THEN 'review' END,
 CASE WHEN coalesce(trim(text), '') = '' THEN 'empty' END, CASE WHEN length(trim(text)) BETWEEN 1 AND 199 THEN 'short' END], lambda x: x IS NOT NULL), ',') AS gates FROM d
""")
def confidence_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why an answer from a document needs care."""
    t = F.trim(F.coalesce("text", F.lit("")))
    rules = (("low_confidence", F.col("confidence") < 0.5), ("duplicate", F.col("status") == "duplicate"), ("unknown_type", F.coalesce("type", F.lit("")) == ""), ("review", F.col("status") == "needs_review"), ("empty", t == ""), ("short", F.length(t).between(1, 199)))
    return described(spark, sf_dir).select("id", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules])), ",").alias("gates"))


# measures


def recall_at(retrieved: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """(query, recall, precision, n_expected): of each query's expected items (query, item), the share among its k first retrieved (query, item, rank).

    precision is the share of hits among the first three distinct ones, over the smaller of three, what was retrieved and what is
    expected. A query that expects nothing has a recall of 1 and no precision.
    """
    r = retrieved.groupBy("query", "item").agg(F.min("rank").alias("rank"))
    w = W.partitionBy("query").orderBy("rank")
    r = r.filter(F.col("rank") <= k).withColumn("at", F.row_number().over(w))
    hits = r.join(expected.distinct().withColumn("hit", F.lit(1)), ["query", "item"], "left")
    found = hits.groupBy("query").agg(F.count("hit").alias("hits"), F.count_if((F.col("at") <= 3) & F.col("hit").isNotNull()).alias("top"), F.least(count(), F.lit(3)).alias("n_top"))
    n = expected.distinct().groupBy("query").agg(count().alias("n_expected"))
    rows = retrieved.select("query").distinct().join(found, "query", "left").join(n, "query", "left")
    small = F.least(F.col("n_top"), F.col("n_expected"))
    return rows.select("query", F.round(F.when(F.col("n_expected").isNull(), 1.0).otherwise(F.col("hits") / F.col("n_expected")), 6).alias("recall"), F.round(F.when(F.col("n_expected") > 0, F.col("top") / small), 6).alias("precision"), F.coalesce("n_expected", F.lit(0)).alias("n_expected"))


@query("""
WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS q, label FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query, vec_id AS item, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q),
r AS (SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM s QUALIFY rank <= 20),
x AS (SELECT q.query, e.vec_id AS item FROM embeddings e JOIN q ON q.label = e.label WHERE e.vec_id <= q.query + 400), n AS (SELECT query, count(*) AS n FROM x GROUP BY 1),
h AS (SELECT r.query, count(x.item) AS hits, (count(x.item) FILTER (rank <= 3))::BIGINT AS top FROM r LEFT JOIN x USING (query, item) GROUP BY 1)
SELECT h.query, round(hits / n, 6)::DOUBLE AS recall, round(top / least(3, n), 6)::DOUBLE AS precision, n AS n_expected FROM h JOIN n USING (query)
""")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 20 and precision at 3 of the nearest vectors, those of the query's class (up to 400 ids on) being expected."""
    e = table(spark, sf_dir, "embeddings")
    near = nearest(e.filter("vec_id % 100 = 0"), e).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("label").alias("l"))
    expected = e.select(F.col("vec_id").alias("item"), "label").join(q, (F.col("label") == F.col("l")) & (F.col("item") <= F.col("query") + 400)).select("query", "item")
    return recall_at(near.select(F.col("query_id").alias("query"), F.col("vec_id").alias("item"), "rank"), expected, 20)


@query("""
WITH c AS (SELECT conv_id, turn, min(lower(text)) AS t FROM conversations GROUP BY 1, 2), p AS (SELECT a.conv_id, a.turn, list_distinct(regexp_extract_all(a.t, '[\\pL\\pN_]{4,}')) AS k, b.t FROM c a JOIN c b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, len(k)::BIGINT AS n_keywords, round(CASE WHEN len(k) = 0 THEN 1 ELSE len(list_filter(k, lambda w: contains(t, w))) / len(k) END, 6)::DOUBLE AS relevancy FROM p
""")
def keyword_relevancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each turn's longer words that the next turn has in it."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min(F.lower("text")).alias("t"))
    after = c.select(F.col("conv_id").alias("c"), (F.col("turn") - 1).alias("before"), F.col("t").alias("answer"))
    rows = c.join(after, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("before")))
    k = F.array_distinct(F.regexp_extract_all("t", F.lit(r"([\p{L}\p{N}_]{4,})"), 1))
    return rows.select("conv_id", "turn", F.size(k).cast("long").alias("n_keywords"), F.round(keyword_recall(k, F.col("answer")), 6).alias("relevancy"))


def keyword_recall(keywords: Column, text: Column) -> Column:
    """The share of keywords that a text has in it; 1 without keywords."""
    return F.when(F.size(keywords) == 0, 1.0).otherwise(F.size(F.filter(keywords, lambda w: text.contains(w))) / F.size(keywords))


@F.pandas_udf(DoubleType())
def character_error_rate(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    """1 less the ratio of matching blocks of two texts; 0 if both are empty, 1 if one is. For page-sized texts: its time grows with the product of the lengths."""
    squash = lambda t: " ".join((t or "").split())
    return pd.Series([1.0 - difflib.SequenceMatcher(None, squash(a), squash(b), autojunk=False).ratio() if squash(a) or squash(b) else 0.0 for a, b in zip(reference, hypothesis, strict=True)], dtype=float)


@query("""
WITH b AS (SELECT item_id, item_id % 5 AS fixture, text AS r, replace(replace(text, 'th', 'h'), 'la', 'lo') AS h FROM benchmark),
w AS (SELECT *, list_filter(regexp_split_to_array(lower(trim(r)), '\\s+'), lambda x: x <> '') AS w FROM b),
s AS (SELECT fixture, levenshtein(r, h) / greatest(length(r), 1) AS cer, CASE WHEN len(w) = 0 THEN 1 ELSE len(list_filter(w, lambda x: contains(lower(h), x))) / len(w) END AS recall FROM w)
SELECT fixture, count(*) AS pages, round(avg(cer), 6) AS cer, round(avg(recall), 6) AS recall, bool_and(cer <= 0.05 AND recall >= 0.5) AS passed FROM s GROUP BY 1
""")
def reading_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages read with errors, held against what they say: edit distance over length, words found, and whether a whole fixture passes."""
    h = F.replace(F.replace(F.col("text"), F.lit("th"), F.lit("h")), F.lit("la"), F.lit("lo"))
    b = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 5).alias("fixture"), F.col("text").alias("r"), h.alias("h"))
    words = F.filter(F.split(F.lower(F.trim("r")), r"\s+"), lambda x: x != "")
    s = b.select("fixture", (F.levenshtein("r", "h") / F.greatest(F.length("r"), F.lit(1))).alias("cer"), keyword_recall(words, F.lower("h")).alias("recall"))
    return s.groupBy("fixture").agg(count().alias("pages"), F.round(F.avg("cer"), 6).alias("cer"), F.round(F.avg("recall"), 6).alias("recall"), F.bool_and((F.col("cer") <= 0.05) & (F.col("recall") >= 0.5)).alias("passed"))


@query()
def matching_block_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error rate of matching blocks of each benchmark text against a reading of it; SQL has no such measure, a test has it by hand."""
    h = F.replace(F.col("text"), F.lit("la"), F.lit("lo"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.round(character_error_rate("text", h), 6).alias("error"))


@query("""
WITH q AS (SELECT label AS category, (vec_id * 7 % 10) / 10.0::DOUBLE AS recall, (vec_id * 3 % 10) / 10.0::DOUBLE AS relevancy FROM embeddings)
SELECT coalesce(category::VARCHAR, 'all') AS category, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(relevancy), 6) AS relevancy, min(recall) AS least, (count(*) FILTER (recall >= 0.6))::BIGINT AS passed FROM q GROUP BY ROLLUP (category)
""")
def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by category and of all, in one pass."""
    q = table(spark, sf_dir, "embeddings").select(F.col("label").alias("category"), (F.col("vec_id") * 7 % 10 / 10.0).alias("recall"), (F.col("vec_id") * 3 % 10 / 10.0).alias("relevancy"))
    rows = q.rollup("category").agg(count().alias("n"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("relevancy"), 6).alias("relevancy"), F.min("recall").alias("least"), F.count_if(F.col("recall") >= 0.6).alias("passed"))
    return rows.withColumn("category", F.coalesce(F.col("category").cast("string"), F.lit("all")))


@query("""
WITH q AS (SELECT conv_id, turn, role, md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS k FROM conversations WHERE text IS NOT NULL AND conv_id IS NOT NULL), f AS (SELECT role, k, min(conv_id) AS first, count(*) AS n FROM q GROUP BY 1, 2)
SELECT q.conv_id, q.turn, q.role, CASE WHEN first < q.conv_id THEN first END AS answered_in, n FROM q JOIN f USING (role, k)
""")
def cached_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that an earlier conversation had already, in the same role (the isolation) and the same normal form: an exact key, pre-aggregated, of the whole text."""
    key = F.md5(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))))
    q = table(spark, sf_dir, "conversations").filter("text IS NOT NULL AND conv_id IS NOT NULL").select("conv_id", "turn", "role", key.alias("k"))
    first = q.groupBy(F.col("role").alias("r"), F.col("k").alias("c")).agg(F.min("conv_id").alias("first"), count().alias("n"))
    rows = q.join(first, (F.col("role") == F.col("r")) & (F.col("k") == F.col("c")))
    return rows.select("conv_id", "turn", "role", F.when(F.col("first") < F.col("conv_id"), F.col("first")).alias("answered_in"), "n")


@query("SELECT doc_id, round(0.55 * least(1, len(w) / 200.0) + CASE WHEN contains(text, '|') THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(text, '[0-9]{4}') THEN 0.25 ELSE 0 END, 6)::DOUBLE AS strength FROM (SELECT doc_id, text, regexp_split_to_array(trim(text), '\\s+') AS w FROM documents WHERE text IS NOT NULL)")
def context_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much a text can bear as evidence: its words, its tables, its numbers."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    n = F.size(F.split(F.trim("text"), r"\s+"))
    strength = 0.55 * F.least(F.lit(1.0), n / 200.0) + F.when(F.col("text").contains("|"), 0.2).otherwise(0.0) + F.when(F.col("text").rlike("[0-9]{4}"), 0.25).otherwise(0.0)
    return d.select("doc_id", F.round(strength, 6).alias("strength"))
