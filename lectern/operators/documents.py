"""Retrieval, text and conversation operators. Each query has its SQL beside it, where SQL can express it."""

import collections
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import columns as C
from lectern.operators.business import count
from lectern.sources.tables import spread, table

QUERIES: dict = {}
ORACLES: dict = {}
WORDS = ("the", "tion", "and")


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


TEXT_SEARCH_SQL = "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE contains(lower(text), 'license')"


@query(TEXT_SEARCH_SQL)
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(F.lower("text").contains("license")).select("doc_id", F.lit(1.0).alias("score"))


@query("""
WITH h AS (SELECT doc_id, text, strpos(lower(text), 'license') AS p FROM documents)
SELECT doc_id, CASE WHEN p > 161 THEN '…' ELSE '' END || substr(text, greatest(1, p - 160), least(p - 1, 160) + 167) || CASE WHEN p + 166 < length(text) THEN '…' ELSE '' END AS excerpt FROM h WHERE p > 0
""")
def text_search_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """160 characters on either side of the first hit."""
    h = table(spark, sf_dir, "documents").select("doc_id", "text", F.locate("license", F.lower("text")).alias("p")).filter("p > 0")
    return h.selectExpr("doc_id", "concat(if(p > 161, '…', ''), substring(text, greatest(1, p - 160), least(p - 1, 160) + 167), if(p + 166 < length(text), '…', '')) AS excerpt")


def bm25(docs: DataFrame, words: tuple[str, ...], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc_id, score): Okapi BM25 of the query's words. One pass counts each row's words; document frequencies are aggregates of it.

    Words are counted where they stand, without making arrays of them. Accents are folded by the patterns, each letter standing
    for its accented forms too, instead of character by character in the texts.
    """
    t = spread(docs.select("doc_id", "text")).select("doc_id", F.lower("text").alias("t"))
    letter = f"[a-z0-9{C.ACCENTED}]"
    forms = lambda w: "".join(f"[{c}{''.join(a for a, p in zip(C.ACCENTED, C.PLAIN, strict=True) if p == c)}]" for c in w)
    tf = [F.regexp_count("t", F.lit(f"(?<!{letter}){forms(w)}(?!{letter})")).alias(f"f{i}") for i, w in enumerate(words)]
    t = t.select("doc_id", F.regexp_count("t", F.lit(f"{letter}+")).alias("n"), *tf)
    stats = t.agg(count().alias("docs"), F.avg("n").alias("mean"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(words))])
    score = F.lit(0.0)
    for i in range(len(words)):
        f, df = F.col(f"f{i}"), F.col(f"d{i}")
        score = score + F.ln(1 + (F.col("docs") - df + 0.5) / (df + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    hit = F.greatest(*[F.col(f"f{i}") for i in range(len(words))], F.lit(0)) > 0
    return t.filter(hit).join(F.broadcast(stats)).select("doc_id", F.round(score, 6).alias("score"))


def _bm25_sql(words=WORDS) -> str:
    folded = f"translate(lower(text), '{C.ACCENTED}', '{C.PLAIN}')"
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(words))
    d = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(words)))
    s = " + ".join(f"ln(1 + (docs - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * n / mean))" for i in range(len(words)))
    hit = " OR ".join(f"f{i} > 0" for i in range(len(words)))
    return f"bt AS (SELECT doc_id, regexp_extract_all({folded}, '[a-z0-9]+') AS t FROM documents), bf AS (SELECT doc_id, len(t) AS n, {tf} FROM bt), bs AS (SELECT count(*) AS docs, avg(n) AS mean, {d} FROM bf), bm AS (SELECT doc_id, round({s}, 6) AS score FROM bf, bs WHERE {hit})"


@query("""
WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 20
""")
def vector_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact nearest vectors to the first one, which is one row. vector_topk_all asks for every hundredth."""
    e = table(spark, sf_dir, "embeddings")
    q = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    return e.join(F.broadcast(q)).select("vec_id", F.round(C.cosine(F.col("embedding"), F.col("q")), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(20)


def blocks(rows: DataFrame, most: int):
    """Lists of at most most rows, streamed to the driver."""
    block = []
    for r in rows.toLocalIterator():
        block.append(r)
        if len(block) == most:
            yield block
            block = []
    if block:
        yield block


def rrf(lists: list[DataFrame], key: str, limit: int, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (key, score), each of bounded length: sum of 1 / (k + rank), rank from 1."""
    best = W.orderBy(F.desc("score"), key)
    ranked = [d.withColumn("part", 1.0 / (k + F.row_number().over(best))).select(key, "part") for d in lists]
    all_ = ranked[0]
    for r in ranked[1:]:
        all_ = all_.unionByName(r)
    return all_.groupBy(key).agg(F.round(F.sum("part"), 6).alias("score")).orderBy(F.desc("score"), key).limit(limit)


@query()
def mmr_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal marginal relevance: (rank, doc_id, score) of ten out of a pool of thirty, one group a query."""
    pool = bm25(table(spark, sf_dir, "documents"), WORDS).orderBy(F.desc("score"), "doc_id").limit(30)
    return mmr_of(pool, table(spark, sf_dir, "documents"))


def mmr_of(pool: DataFrame, docs: DataFrame) -> DataFrame:
    """mmr() on the 3-gram sets of the whole texts of a pool of bounded size (doc_id, score)."""

    @F.pandas_udf("array<string>")
    def grams(s: pd.Series) -> pd.Series:
        return pd.Series([sorted(trigrams(re.sub(r"\s+", " ", (t or "").lower()).strip())) for t in s], dtype=object)

    rows = docs.select("doc_id", "text").join(F.broadcast(pool), "doc_id").select(F.lit(0).alias("query"), "doc_id", "score", grams("text").alias("grams"))
    return rows.groupBy("query").applyInPandas(lambda f: mmr(f), "rank long, doc_id long, score double")


def mmr(pool: pd.DataFrame, top: int = 10, weight: float = 0.7) -> pd.DataFrame:
    """Greedy: weight / rank less (1 - weight) times the greatest 3-gram similarity to what is chosen."""
    pool = pool.sort_values(["score", "doc_id"], ascending=[False, True]).reset_index(drop=True)
    grams = [set(g) for g in pool.grams]
    like = lambda a, b: len(grams[a] & grams[b]) / len(grams[a] | grams[b]) if grams[a] and grams[b] else 0.0
    left, out = list(range(len(pool))), []
    while left and len(out) < top:
        value = {i: weight / (i + 1) - (1 - weight) * max((like(i, j) for j, _ in out), default=0.0) for i in left}
        best = max(left, key=lambda i: (value[i], -i))
        out.append((best, value[best]))
        left.remove(best)
    return pd.DataFrame([(k + 1, int(pool.doc_id[i]), v) for k, (i, v) in enumerate(out)], columns=["rank", "doc_id", "score"])


@query("SELECT doc_id, regexp_extract_all(text, '[0-9]{16}') AS numbers FROM documents WHERE regexp_matches(text, '[0-9]{16}')".replace("regexp_extract_all(text, '[0-9]{16}') AS numbers", "array_to_string(regexp_extract_all(text, '[0-9]{16}'), ',') AS numbers"))
def exact_number_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(F.col("text").rlike("[0-9]{16}")).select("doc_id", F.array_join(F.regexp_extract_all("text", F.lit("([0-9]{16})"), 1), ",").alias("numbers"))


@query("SELECT doc_id, min(p) AS priority FROM (SELECT doc_id, 1::BIGINT AS p FROM documents WHERE contains(text, 'All rights reserved') UNION ALL SELECT doc_id, 2 FROM documents WHERE contains(lower(text), 'rights')) GROUP BY 1")
def exact_phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    p = F.when(F.col("text").contains("All rights reserved"), 1).when(F.lower("text").contains("rights"), 2).cast("long")
    return d.select("doc_id", p.alias("priority")).filter("priority IS NOT NULL")


def trigrams(t: str) -> set[str]:
    """C.ngrams of a text that is in lower case with single spaces, in time linear in it."""
    return {t[k : k + 3] for k in range(max(1, len(t) - 2))} if t else set()


#: Items whose postings are held, and broadcast, at a time.
ITEM_BLOCK = 5_000


class Postings:
    """Which items of a block hold a 3-gram; what an item shares with a text is counted over the text's 3-grams, so it is exact."""

    def __init__(self, items: list[tuple[int, str]]):
        sets = [(i, g) for i, t in items if (g := trigrams(t))]
        self.ids, self.sizes = [i for i, _ in sets], np.array([len(g) for _, g in sets], np.int64)
        of = collections.defaultdict(list)
        for k, (_, g) in enumerate(sets):
            for x in g:
                of[x].append(k)
        self.of = {x: np.array(ks, np.int64) for x, ks in of.items()}

    def alike(self, text: str, least: float) -> list[tuple[int, float]]:
        """(item, similarity) of the items that reach least."""
        g = trigrams(text)
        # the smaller set over the larger bounds the similarity
        if not g or not ((np.minimum(self.sizes, len(g)) / np.maximum(self.sizes, len(g))) >= least).any():
            return []
        found = [self.of[x] for x in g if x in self.of]
        if not found:
            return []
        both = np.bincount(np.concatenate(found), minlength=len(self.sizes))
        j = both / (self.sizes + len(g) - both)
        return [(self.ids[k], float(j[k])) for k in np.flatnonzero(j >= least)]


def alike(items: DataFrame, docs: DataFrame, least: float = 0.3, item_block: int = ITEM_BLOCK) -> DataFrame:
    """(item_id, doc_id, similarity) of all pairs whose whole texts' 3-gram sets have a Jaccard similarity of least (over 0) or more.

    No shuffle: documents are read once for each block of items. Null texts and texts of white space alone match nothing.
    """
    plain = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")).alias("text")
    d, out = docs.select("doc_id", plain).filter("text <> ''"), None
    for block in blocks(items.select("item_id", plain).filter("text <> ''"), item_block):
        sent = docs.sparkSession.sparkContext.broadcast(Postings([(r.item_id, r.text) for r in block]))

        def run(frames, sent=sent):
            for f in frames:
                rows = [(item, i, j) for i, t in zip(f["doc_id"], f["text"], strict=True) for item, j in sent.value.alike(t, least)]
                yield pd.DataFrame(rows, columns=["item_id", "doc_id", "similarity"]).astype({"item_id": "Int64", "doc_id": "Int64", "similarity": "float64"})

        part = d.mapInPandas(run, "item_id long, doc_id long, similarity double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id long, doc_id long, similarity double")
    return out.select("item_id", "doc_id", F.round("similarity", 6).alias("similarity"))


@query("""
WITH i AS (SELECT item_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS x FROM benchmark), d AS (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS y FROM documents),
a AS (SELECT item_id, list_distinct(list_transform(range(1, greatest(length(x) - 1, 2)), lambda k: substr(x, k, 3))) AS a FROM i WHERE x <> ''),
b AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(length(y) - 1, 2)), lambda k: substr(y, k, 3))) AS b FROM d WHERE y <> ''),
p AS (SELECT item_id, doc_id, len(list_intersect(a, b)) AS n, len(a) + len(b) AS m FROM a, b)
SELECT item_id, doc_id, round(n / (m - n), 6) AS similarity FROM p WHERE n / (m - n) >= 0.3
""")
def jaccard_trigram_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of benchmark items and documents, by whole texts, that share three tenths of their 3-grams."""
    return alike(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


@query("SELECT doc_id, nullif(min(doc_id) OVER (PARTITION BY sha256(text)), doc_id) AS duplicate_of FROM documents")
def exact_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each content stays; others point at it. Only digests are shuffled, pre-aggregated. Null texts are one content."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = d.groupBy(F.col("h").alias("k")).agg(F.min("doc_id").alias("first"))
    return d.join(first, F.col("h").eqNullSafe(F.col("k"))).select("doc_id", F.nullif("first", "doc_id").alias("duplicate_of"))


@query(f"""
WITH r AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '{C.EMAIL}', '[EMAIL]', 'g'), '{C.LONG_NUMBER}', '[ACCOUNT]', 'g'), '{C.IP}', '[IP]', 'g') AS t FROM documents)
SELECT doc_id, md5(t) AS redacted_md5 FROM r
""")
def pii_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(C.redact(F.col("text"))).alias("redacted_md5"))


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{C.EMAIL}'))::BIGINT AS emails, len(regexp_extract_all(text, '{C.LONG_NUMBER}'))::BIGINT AS accounts, len(regexp_extract_all(text, '{C.IP}'))::BIGINT AS ips FROM documents")
def pii_findings_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", n(C.EMAIL).alias("emails"), n(C.LONG_NUMBER).alias("accounts"), n(C.IP).alias("ips"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("SELECT page_id, k - 1 AS position, list_extract(l, k) AS href FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS k FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS l FROM pages))")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("position", "href"))
    return p.withColumn("position", F.col("position").cast("long"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gs'), '<[^>]+>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS text FROM pages")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Script and style go with their content, other tags leave a space."""
    t = F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]+>", " "), r"[ \t\r\n]+", " ")).alias("text"))


@query("SELECT page_id, split_part(url, '/', 3) AS host, split_part(split_part(url, '?', 1), '/', 4) AS section, split_part(split_part(url, '?', 1), '/', 5) AS code FROM pages")
def url_path_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.split_part(F.col("url"), F.lit("?"), F.lit(1))
    part = lambda c, k: F.split_part(c, F.lit("/"), F.lit(k))
    return table(spark, sf_dir, "pages").select("page_id", part(F.col("url"), 3).alias("host"), part(path, 4).alias("section"), part(path, 5).alias("code"))


#: Rules of the classifier: type, pattern, weight.
RULES = (("licence", "license", 0.55), ("licence", "rights reserved", 0.35), ("contact", "@", 0.5), ("contact", "\\+1 \\(", 0.5), ("secret", "token = ", 0.6), ("table", " \\| ", 0.5))


@query("""
WITH r(type, pattern, weight) AS (VALUES """ + ", ".join(f"('{t}', '{p}', {w})" for t, p, w in RULES) + """),
s AS (SELECT doc_id, type, sum(weight) AS s FROM documents JOIN r ON regexp_matches(lower(text), pattern) GROUP BY 1, 2),
b AS (SELECT doc_id, type, s, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, type) AS k FROM s)
SELECT d.doc_id, coalesce(type, 'other') AS type, round(least(greatest(coalesce(s, 0.4), 0.4), 0.98), 4)::DOUBLE AS confidence FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id AND k = 1
""")
def classify_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type of the greatest sum of rule weights; every rule is a column of the same pass, so nothing is shuffled."""
    low = F.lower("text")
    by = {}
    for t, p, w in RULES:
        by[t] = by.get(t, F.lit(0.0)) + F.when(low.rlike(p), w).otherwise(0.0)
    best = F.array_max(F.array(*[F.struct(F.round(s, 4).alias("s"), F.lit(-i).alias("i"), F.lit(t).alias("t")) for i, (t, s) in enumerate(sorted(by.items()))]))
    d = table(spark, sf_dir, "documents").select("doc_id", best.alias("b"))
    return d.select("doc_id", F.when(F.col("b.s") > 0, F.col("b.t")).otherwise("other").alias("type"), F.round(F.least(F.greatest(F.col("b.s"), F.lit(0.4)), F.lit(0.98)), 4).alias("confidence"))


@query("SELECT doc_id, round(CASE WHEN length(text) > 0 THEN least(1::DOUBLE, 0.55::DOUBLE * (length(regexp_replace(text, '[^\\pL\\pN]', '', 'g')) / length(text)) + 0.45::DOUBLE * least(length(text) / 500::DOUBLE, 1::DOUBLE)) ELSE 0 END, 6)::DOUBLE AS quality FROM documents")
def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(C.text_quality(F.col("text")), 6).alias("quality"))


@query("""
WITH c AS (SELECT conv_id, turn, role, length(text) AS size, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS total FROM conversations)
SELECT conv_id, count(*) AS messages, max(turn) AS last_turn, (sum(size) FILTER (total <= 800))::BIGINT AS kept_chars, (count(*) FILTER (total <= 800))::BIGINT AS kept FROM c GROUP BY 1
""")
def token_budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each conversation fits a budget of 800 characters, from its start."""
    w = W.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("size")).withColumn("total", F.sum("size").over(w))
    fits = F.col("total") <= 800
    return c.groupBy("conv_id").agg(count().alias("messages"), F.max("turn").alias("last_turn"), F.sum(F.when(fits, F.col("size"))).alias("kept_chars"), F.count_if(fits).alias("kept"))


@query("SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY 1")
def latest_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """max_by aggregates before the shuffle, so a long conversation sends one row a task."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("role", "turn").alias("role"), F.max_by("text", "turn").alias("text"))


@query("""
WITH t AS (SELECT max(ts) AS now FROM events),
v AS (SELECT user_id, sum(CASE WHEN event_type = 'purchase' THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END) AS votes, count(*) AS n FROM events, t WHERE ts >= now - INTERVAL 30 DAY GROUP BY 1)
SELECT user_id, greatest(0.1, least(5.0, 1 + 0.1 * votes))::DOUBLE AS weight FROM v WHERE n >= 3
""")
def feedback_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of the last thirty days, where there are three or more, as weights."""
    e = table(spark, sf_dir, "events").select("ts", "user_id", "event_type")
    e = e.join(F.broadcast(e.agg(F.max("ts").alias("now")))).filter("ts >= now - INTERVAL 30 DAYS")
    vote = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    v = e.groupBy("user_id").agg(F.sum(vote).alias("votes"), count().alias("n")).filter("n >= 3")
    return v.select("user_id", F.greatest(F.lit(0.1), F.least(F.lit(5.0), 1 + F.lit(0.1) * F.col("votes"))).alias("weight"))


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch twin of streaming.events.hourly()."""
    from lectern.streaming.events import hourly

    return hourly(table(spark, sf_dir, "events"))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k
""")
def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.streaming.events import sessions

    return sessions(table(spark, sf_dir, "events"))


@query("SELECT user_id, event_type, min(event_id) AS event_id, count(*) AS n FROM events GROUP BY 1, 2")
def events_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"), count().alias("n"))


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, idx, chunk_text, token_count) of chunks of at most 220 words that overlap by 40; whole sentences where they fit."""

    def run(frames):
        made = lambda rows: pd.DataFrame(rows, columns=["doc_id", "idx", "chunk_text", "token_count"])
        for f in frames:
            rows = []
            for i, t in zip(f["doc_id"].astype(object), f["text"], strict=True):
                for k, c in enumerate(chunks(t or "")):
                    rows.append((None if pd.isna(i) else int(i), k, c, len(c.split())))
                    if len(rows) == 1_000:  # a batch of long texts has far more chunks than texts
                        yield made(rows)
                        rows = []
            if rows:
                yield made(rows)

    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).mapInPandas(run, "doc_id long, idx long, chunk_text string, token_count long")


def chunks(text: str, most: int = 220, overlap: int = 40) -> list[str]:
    """Sentences are packed up to most words, each chunk beginning with the last overlap words of the one before; a longer sentence is cut."""
    out, now, fresh = [], [], False
    for sentence in re.split(r"(?<=[.!?])\s+", text.strip()):
        ws = sentence.split()
        while ws:
            room = most - len(now)
            if len(ws) > room and fresh:
                out.append(" ".join(now))
                now, fresh = now[-overlap:], False
                continue
            now, ws, fresh = now + ws[:room], ws[room:], True
    return out + [" ".join(now)] if fresh else out
