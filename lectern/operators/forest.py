"""Forests of links: the root of every node by pointer jumping, and the threads that replies form."""

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.extraction import mail_fields, render_mails
from lectern.operators.registry import Registry
from lectern.sources.stored import written

query = Registry()


def roots(nodes: DataFrame) -> DataFrame:
    """(node, root) of (node, parent), node being distinct: the end of the parents' chain; parents that are no node, or null, end it.

    Each round a node's pointer moves to where its target points, so a chain of n takes about log2(n) rounds. Nodes whose
    target is a root are done and leave the join, so a root of very many nodes is met once by each. The nodes of a cycle, and
    those that lead to it, have the cycle's least node as root.
    """
    known = nodes.select(F.col("node").alias("is"))
    start = nodes.join(known, F.col("parent") == F.col("is"), "left").select("node", F.coalesce("is", "node").alias("at"))
    # low: the least node on the way; it matters only in cycles
    state = written(start.withColumn("low", F.least("node", "at")).withColumn("done", F.col("at") == F.col("node")), "forest")
    rounds = 1 + math.ceil(math.log2(max(2, state.count())))
    ended = [state.filter("done")]
    moving = state.filter("NOT done")
    for _ in range(rounds):
        if moving.isEmpty():
            break
        to = state.select(F.col("node").alias("t"), F.col("at").alias("t_at"), F.col("low").alias("t_low"), F.col("done").alias("t_done"))
        now = moving.join(to, F.col("at") == F.col("t")).select("node", F.col("t_at").alias("at"), F.least("low", "t_low").alias("low"), F.col("t_done").alias("done"))
        now = written(now, "forest")
        ended.append(now.filter("done"))
        moving = now.filter("NOT done")
        state = now
        for e in ended[:-1]:
            state = state.unionByName(e)
    out = ended[0]
    for e in ended[1:]:
        out = out.unionByName(e)
    # what still moves has gone round a cycle: its target is on it, and knows the least there
    least = moving.select(F.col("node").alias("t"), F.col("low").alias("root"))
    round_ = moving.join(least, F.col("at") == F.col("t")).select("node", "root")
    return out.select("node", F.col("at").alias("root")).unionByName(round_)


def threads(mails: DataFrame, key: str, project: str | None = None) -> DataFrame:
    """(key, thread) of mails (key, message_id, in_reply_to, subject_key, project): a reply is in the thread of the mail it answers, however long the chain; mails that
    answer nothing known form threads by project and normal subject. thread is the least key in it.

    Of mails with one message_id, the least key is the one answered, and the others are in its thread. A mail without
    a subject that answers nothing is alone. Nulls in project are one.
    """
    of = F.col(project).cast("string") if project else F.lit(None).cast("string")
    m = written(mails.select(key, "message_id", "in_reply_to", "subject_key", of.alias("project")), "mails")
    first = m.filter("message_id IS NOT NULL").groupBy(F.col("message_id").alias("m")).agg(F.min(key).alias("first"))
    own = m.join(first, F.col("message_id") == F.col("m"), "left").withColumnRenamed("first", "same").drop("m")
    links = own.join(first, F.col("in_reply_to") == F.col("m"), "left")
    parent = F.when(F.col("same") < F.col(key), F.col("same")).otherwise(F.nullif("first", F.col(key)))
    r = roots(links.select(F.col(key).alias("node"), parent.alias("parent")))
    about = m.select(F.col(key).alias("root"), F.coalesce("subject_key", F.concat(F.lit("#"), F.col(key).cast("string"))).alias("subject"), "project")
    placed = written(r.join(about, "root"), "placed")
    least = placed.groupBy("project", "subject").agg(F.min("node").alias("thread"))
    both = placed.alias("a").join(least.alias("b"), F.col("a.project").eqNullSafe(F.col("b.project")) & (F.col("a.subject") == F.col("b.subject")))
    return both.select(F.col("a.node").alias(key), "thread")


@query("""
WITH RECURSIVE c AS (SELECT conv_id * 100000 + turn AS id, conv_id, turn FROM conversations),
s AS (SELECT id, conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'otro ' || conv_id || '/' || turn ELSE 'tema ' || conv_id END AS s FROM c),
l AS (SELECT a.id, b.id AS parent FROM s a LEFT JOIN s b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1 AND a.turn > 0),
w AS (SELECT id, id AS root FROM l WHERE parent IS NULL UNION ALL SELECT l.id, w.root FROM l JOIN w ON l.parent = w.id)
SELECT w.id, min(w.id) OVER (PARTITION BY s.conv_id % 5, s.s) AS thread FROM w JOIN s ON s.id = w.root
""")
def conversation_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as mails that answer the turn before: whole chains are threads, also where the subject changes on the way."""
    mails = render_mails(spark, sf_dir)
    project = mails.select("id", (F.col("conv") % 5).alias("project"))
    return threads(mail_fields(mails, "id").join(project, "id"), "id", "project")
