"""Multi-party perspective rotation: each dialogue is rendered once for every participant, with that speaker as assistant.

All other speakers become named users, and the mask covers what the assistant says. A rendering comes in parts of
PART_TURNS turn numbers, so that a dialogue that holds a third of all rows is spread over many rows and tasks; offset says
where in the whole rendering a part begins, and parts joined in its order are the dialogue. Turns may be null or repeated: a
part of more than PART_TURNS messages comes as several rows of as many messages at most. DataFrame functions only.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import cut

#: Turn numbers in a part, and messages in a row.
PART_TURNS = 64
#: So many keys of overfull parts are broadcast; beyond, the joins with them shuffle.
BROADCAST_PARTS = 100_000


def pieces(t: DataFrame, most: int, broadcast: int = BROADCAST_PARTS) -> DataFrame:
    """t (conv_id, part, turn, role, text) with piece: 0, or, in parts of more than most messages, which most of them a message is among.

    Only messages of such parts are sorted: over ranges, each numbered in itself and moved on by the ranges before. So no
    task takes a whole part. Equal messages are told apart by a number for the ranges' sake; which of them comes first doesn't matter.
    """
    key = ["conv_id", "part"]
    crowded = cut(t.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select(F.col("conv_id").alias("c"), F.col("part").alias("k")))
    whole, n = F.lit(0).cast("long"), crowded.count()
    if not n:
        return t.withColumn("piece", whole)
    crowded = F.broadcast(crowded) if n <= broadcast else crowded
    on = t["conv_id"].eqNullSafe(crowded["c"]) & (t["part"] == crowded["k"])
    order = ["turn", "role", "text", "tie"]
    many = t.withColumn("tie", F.monotonically_increasing_id()).join(crowded, on, "left_semi")  # numbered before any shuffle, so a task run again numbers alike
    many = cut(many.repartitionByRange(*key, *order).withColumn("at", F.spark_partition_id()))
    counts = many.groupBy(*key, "at").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy(*key).orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(F.col("conv_id").alias("c"), F.col("part").alias("k"), F.col("at").alias("a"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("moved"))
    many = many.withColumn("i", F.row_number().over(W.partitionBy(*key, "at").orderBy(*order)) - 1)
    many = many.join(counts, many["conv_id"].eqNullSafe(counts["c"]) & (many["part"] == counts["k"]) & (many["at"] == counts["a"]))
    many = many.select(*t.columns, F.floor((F.col("moved") + F.col("i")) / most).cast("long").alias("piece"))
    return t.join(crowded, on, "left_anti").withColumn("piece", whole).unionByName(many)


def _sizes(t: DataFrame, people: DataFrame) -> DataFrame:
    """(conv_id, perspective, part, piece, size): the code points of each rendering, told from counts and lengths by role alone, so that nothing is rendered for it.

    As a user's, a message takes its text, its role and the marks around them; as the assistant's, the other lead for the role.
    """
    key = ["conv_id", "part", "piece"]
    fixed, lead = len("<|user|>\n<|end|>\n"), len("<|assistant|>\n") - len("<|user|>\n")
    by_role = t.groupBy(*key, "role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    each = F.sum(F.col("chars") + F.col("n") * (F.length("role") + fixed))
    parts = by_role.groupBy(*key).agg(each.alias("size"), F.map_from_entries(F.collect_list(F.struct("role", "n"))).alias("said_by"))
    rows = parts.alias("d").join(people.alias("p"), F.col("d.conv_id").eqNullSafe(F.col("p.conv_id"))).select("d.conv_id", "d.part", "d.piece", "d.size", "d.said_by", F.explode("p.people").alias("perspective"))
    own = F.coalesce(F.try_element_at("said_by", "perspective"), F.lit(0))
    return rows.select("conv_id", "perspective", "part", "piece", (F.col("size") + own * (lead - F.length("perspective"))).cast("long").alias("size"))


def rotate(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, perspective, part, n_messages, offset, text, mask) of (conv_id, turn, role, text).

    A message is "<|assistant|>\\n" or "<|user|>name\\n", its text, "<|end|>\\n". mask lists "start:end" of what the assistant
    says, end mark included, in code points of the part's text, joined by commas; empty if it says nothing in that part.
    Messages are in the order of turn, then role, then text; rows that are equal in all of them stay, each a message. A null
    turn comes first, in part -1. Rows of one part differ in offset. An empty table gives no rows. Other columns are left out, whatever their names. A null role is the participant "unknown"; a null text is empty; null conversations are one.
    """
    t = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("part", F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1)).cast("long"))
    t = pieces(t, part_turns)
    people = t.groupBy("conv_id").agg(F.collect_set("role").alias("people"))
    parts = t.groupBy("conv_id", "part", "piece").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("said"))
    cid = F.col("p.conv_id")
    both = parts.alias("d").join(people.alias("p"), F.col("d.conv_id").eqNullSafe(cid)).select("d.conv_id", "d.part", "d.piece", "d.said", F.explode("p.people").alias("perspective"))
    own = lambda m: m["role"] == F.col("perspective")
    lead = lambda m: F.when(own(m), F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user|>"), m["role"], F.lit("\n")))
    both = both.withColumn("messages", F.transform("said", lambda m: F.struct(lead(m).alias("lead"), F.concat(m["text"], F.lit("<|end|>\n")).alias("body"), own(m).alias("own"))))
    both = both.withColumn("ends", F.transform("messages", lambda m: (F.length(m["lead"]) + F.length(m["body"])).cast("long")))
    # the ends so far: each part is bounded, so this fold over its messages is too
    both = both.withColumn("ends", F.aggregate("ends", F.array().cast("array<bigint>"), lambda a, n: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0).cast("long")) + n))))
    both = both.select(
        "conv_id",
        "perspective",
        "part",
        "piece",
        F.size("messages").cast("long").alias("n_messages"),
        F.array_join(F.transform("messages", lambda m: F.concat(m["lead"], m["body"])), "").alias("text"),
        F.array_join(
            F.filter(F.transform("messages", lambda m, i: F.when(m["own"], F.concat_ws(":", F.get("ends", i) - F.length(m["body"]), F.get("ends", i)))), lambda s: s.isNotNull()), ","
        ).alias("mask"),
    )
    before = W.partitionBy("conv_id", "perspective").orderBy("part", "piece").rowsBetween(W.unboundedPreceding, -1)
    where = _sizes(t, people).withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0).cast("long")))
    where = where.select(F.col("conv_id").alias("c"), F.col("perspective").alias("w"), F.col("part").alias("k"), F.col("piece").alias("l"), "offset")
    on = both["conv_id"].eqNullSafe(where["c"]) & (both["perspective"] == where["w"]) & (both["part"] == where["k"]) & (both["piece"] == where["l"])
    return both.join(where, on).select("conv_id", "perspective", "part", "n_messages", "offset", "text", "mask")


ROTATE_SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, coalesce(floor(turn / {PART_TURNS}), -1)::BIGINT AS part FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t),
m AS (SELECT t.*, perspective, role = perspective AS own,
      CASE WHEN role = perspective THEN '<|assistant|>' ELSE '<|user|>' || role END || chr(10) AS lead, text || '<|end|>' || chr(10) AS body
      FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
e AS (SELECT *, row_number() OVER o AS i, sum(length(lead) + length(body)) OVER (o ROWS UNBOUNDED PRECEDING) AS stop
      FROM m WINDOW o AS (PARTITION BY conv_id, perspective, part ORDER BY turn NULLS FIRST, role, text)),
g AS (SELECT conv_id, perspective, part, count(*) AS n_messages, string_agg(lead || body, '' ORDER BY i) AS text,
      coalesce(string_agg(CASE WHEN own THEN (stop - length(body))::BIGINT::VARCHAR || ':' || stop::BIGINT::VARCHAR END, ',' ORDER BY i), '') AS mask FROM e GROUP BY ALL)
SELECT conv_id, perspective, part, n_messages, text, mask,
  (sum(length(text)) OVER (PARTITION BY conv_id, perspective ORDER BY part) - length(text))::BIGINT AS "offset" FROM g
"""
