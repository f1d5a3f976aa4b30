"""Rule bitmask ledger: each quality rule is evaluated once a document; policies and ablations read the bits.

The ledger holds every measurement and one long of failure bits. A policy is a versioned set of rules, so applying one is
a bitwise AND, and an ablation is a count over the (at most 2^rules) bit patterns that occur. DataFrame functions only.

Null texts count as empty and fail too_few_words. Repeated rows give repeated rows. Columns other than id and text are ignored.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import SPACE, texts

#: Characters that count as symbols, and the window in words.
SYMBOLS, WINDOW = "#*$%&|<>", 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rule by bit; true: the document fails it. All in whole numbers, so that every engine decides alike.
RULES: list[tuple[str, str]] = [
    ("too_few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbol_heavy", "10 * n_symbols > n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 40 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("few_letter_words", "100 * n_letter_words < 60 * n_words"),
    ("shouting", "n_upper > n_lower"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: Versioned policies: the rules that reject.
POLICIES: dict[str, list[str]] = {
    "base/1": ["too_few_words", "repeated_windows"],
    "prose/1": ["too_few_words", "repeated_windows", "symbol_heavy", "duplicate_lines"],
    "prose/2": [name for name, _ in RULES],
}
PRODUCTION = "prose/2"


def mask(policy: str) -> int:
    return sum(BIT[r] for r in POLICIES[policy])


def _count_of(chars: str) -> Column:
    return (F.length("text") - F.length(F.translate("text", chars, ""))).cast("long")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_measured() without the documents' own columns."""
    return _measured(texts(docs, id_col, text_col), ["doc_id"])


def _measured(d: DataFrame, keep: list[str]) -> DataFrame:
    """keep and the measurements of every whole text, one row in, one row out, no shuffle.

    n_repeat_words: words in windows of five words that occur twice or more. Windows are compared by 64-bit hashes within a
    document; the starts of repeated windows, in order, cover min(5, distance to the next) words each.
    """
    d = d.withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != ""))
    d = d.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.translate(x, " \t\n\x0b\f\r", "") != ""))
    d = d.select(
        *keep,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        _count_of(SYMBOLS).alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_letter_words"),
        _count_of(UPPER).alias("n_upper"),
        _count_of(LOWER).alias("n_lower"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    at = lambda i: F.get("hashes", i)
    d = d.withColumn(
        "windows",
        F.when(F.size("hashes") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("hashes") - WINDOW), lambda i: F.xxhash64(*[at(i + k) for k in range(WINDOW)]))).otherwise(
            F.array().cast("array<bigint>")
        ),
    ).drop("hashes")
    d = d.withColumn("has_repeat", F.size(F.array_distinct("windows")) < F.size("windows"))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    d = d.withColumn("sorted", F.when(F.col("has_repeat"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none)).drop("windows")
    same = lambda x, j: F.coalesce(F.get("sorted", j)["h"] == x["h"], F.lit(False))
    d = d.withColumn("starts", F.array_sort(F.transform(F.filter("sorted", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))).drop("sorted")
    covered = F.transform("starts", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", j + 1) - p, F.lit(WINDOW))).cast("long"))
    d = d.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x))
    return d.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words", "n_upper", "n_lower")


def _bits():
    bits = F.lit(0).cast("long")
    for name, failed in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(failed), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return bits


def _held_bits():
    """_bits(), depending on the task as far as Spark knows: a filter above then stays above. Pushed down, it would copy the measurements into itself many times over."""
    return F.when(F.spark_partition_id() < 0, F.lit(0).cast("long")).otherwise(_bits())


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """measures() and rule_bits: bit i is set if the document fails RULES[i]."""
    return measures(docs, id_col, text_col).withColumn("rule_bits", _held_bits())


def store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger, written once as a table; policies and ablations then read its bits, and no text again."""
    ledger(docs, id_col, text_col).write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.parquet(path)


def kept(docs: DataFrame, policy: str = PRODUCTION, text_col: str = "text") -> DataFrame:
    """The rows of docs, with their own columns, that a policy keeps; no join, as the ledger is computed beside each row."""
    row = F.struct(*[F.col(c) for c in docs.columns])
    d = docs.select(row.alias("row"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    return _measured(d, ["row"]).withColumn("rule_bits", _held_bits()).filter(passes(policy)).select("row.*")


def passes(policy: str, bits: str = "rule_bits") -> Column:
    """Whether a ledger row is kept under a policy."""
    return F.col(bits).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablation(rows: DataFrame, policies: dict[str, list[str]] | None = None) -> DataFrame:
    """For each policy and rule in it: documents, kept ones, those that fail the rule, and those kept only if it were dropped.

    rows: a ledger. It is first counted by bit pattern, of which there are at most 2^rules, so the rest is small however
    many documents there are. An empty ledger gives no rows.
    """
    named = policies or POLICIES
    pairs = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit"), F.lit(sum(BIT[x] for x in rs)).cast("long").alias("mask")) for p, rs in named.items() for r in rs])
    by_bits = rows.groupBy("rule_bits").agg(F.count("*").alias("n"))
    each = by_bits.select("rule_bits", "n", F.explode(pairs).alias("p")).select("*", F.col("rule_bits").bitwiseAND(F.col("p.mask")).alias("hit"))
    count = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    return each.groupBy(F.col("p.policy").alias("policy"), F.col("p.rule").alias("rule")).agg(
        F.sum("n").alias("n_docs"),
        count(F.col("hit") == 0).alias("n_kept"),
        count(F.col("hit").bitwiseAND(F.col("p.bit")) != 0).alias("n_failed"),
        count(F.col("hit") == F.col("p.bit")).alias("n_only_this"),
    )


MEASURES_SQL = r"""
r AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM r),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM
      (SELECT rid, i, array_to_string(words[i:i+4], ' ') AS gram FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5))),
c AS (SELECT rid, count(DISTINCT i + k)::BIGINT AS n FROM (SELECT rid, i, unnest(range(5)) AS k FROM g WHERE n > 1) GROUP BY rid),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
      len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
      coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
      len(list_filter(words, lambda x: regexp_matches(x, '\pL')))::BIGINT AS n_letter_words,
      len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n_upper, len(regexp_extract_all(text, '[a-z]'))::BIGINT AS n_lower
      FROM w LEFT JOIN c USING (rid)),
l AS (SELECT *, {bits} AS rule_bits FROM m)
""".replace("{bits}", "(" + " + ".join(f"CASE WHEN {sql} THEN {BIT[name]} ELSE 0 END" for name, sql in RULES) + ")::BIGINT")
LEDGER_SQL = f"WITH {MEASURES_SQL} SELECT *, (rule_bits & {mask('base/1')}) <> 0 AS base_failed, (rule_bits & {mask(PRODUCTION)}) = 0 AS kept FROM l"
ABLATION_SQL = f"WITH {MEASURES_SQL}, p(policy, rule, bit, mask) AS (VALUES " + ", ".join(f"('{p}', '{r}', {BIT[r]}, {mask(p)})" for p, rs in POLICIES.items() for r in rs) + (
    ") SELECT policy, rule, count(*)::BIGINT AS n_docs, (count(*) FILTER (rule_bits & mask = 0))::BIGINT AS n_kept, "
    "(count(*) FILTER (rule_bits & bit <> 0))::BIGINT AS n_failed, (count(*) FILTER (rule_bits & mask = bit))::BIGINT AS n_only_this FROM l, p GROUP BY ALL"
)
