"""Incremental work: stale jobs, outboxes with retries, suggestions, votes and weights, over event tables. "Now" is the newest event.

Streaming forms are in lectern.streaming; the queries here are their batch twins.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.operators.business import count
from lectern.operators.registry import Registry
from lectern.sources.tables import table
from lectern.streaming import events as S
from lectern.streaming import stateful

query = Registry()


def with_now(events: DataFrame) -> DataFrame:
    """events and the newest of their times, which is one row."""
    return events.join(F.broadcast(events.agg(F.max("ts").alias("now"))))


@query("SELECT w AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 30 MINUTE, time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 30 MINUTE]) AS w, ts FROM events) WHERE ts >= w AND ts < w + INTERVAL 1 HOUR GROUP BY 1, 2")
def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of windows of an hour that begin every half hour."""
    return S.sliding(table(spark, sf_dir, "events"))


@query("SELECT user_id, event_type, min(ts) AS ts, count(*) AS n FROM events GROUP BY user_id, event_type, time_bucket(INTERVAL 1 HOUR, ts)")
def events_dedupe_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events of one type within an hour are one, the first."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", "event_type", F.window("ts", "1 hour")).agg(F.min("ts").alias("ts"), count().alias("n")).select("user_id", "event_type", "ts", "n")


def stale(jobs: DataFrame, minutes: int) -> DataFrame:
    """jobs (ts, now, status) with status failed where they have been processing for more than minutes."""
    old = (F.col("status") == "processing") & (F.col("ts") < F.col("now") - F.expr(f"INTERVAL {minutes} MINUTES"))
    return jobs.withColumn("stale", old).withColumn("status", F.when(old, "failed").otherwise(F.col("status")))


@query("""
WITH t AS (SELECT max(ts) AS now FROM events), j AS (SELECT event_id, user_id, CASE event_type WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'done' ELSE 'pending' END AS status, ts FROM events)
SELECT CASE WHEN status = 'processing' AND ts < now - INTERVAL 30 MINUTE THEN 'failed' ELSE status END AS status, (status = 'processing' AND ts < now - INTERVAL 30 MINUTE) AS stale, count(*) AS n, max(event_id) AS last FROM j, t GROUP BY 1, 2
""")
def stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by status after those that hang have been swept."""
    status = F.when(F.col("event_type") == "view", "processing").when(F.col("event_type") == "purchase", "done").otherwise("pending")
    j = with_now(table(spark, sf_dir, "events").select("event_id", "ts", status.alias("status")))
    return stale(j, 30).groupBy("status", "stale").agg(count().alias("n"), F.max("event_id").alias("last"))


@query("""
WITH e AS (SELECT user_id AS job, ts, CASE WHEN event_type = 'view' THEN 'processing' ELSE event_type END AS what FROM events), n AS (SELECT *, lead(ts) OVER (PARTITION BY job ORDER BY ts, what) AS next FROM e)
SELECT job, ts AS since, ts + INTERVAL 30 MINUTE AS failed_at FROM n WHERE what = 'processing' AND (next IS NULL OR next > ts + INTERVAL 30 MINUTE) AND ts + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM e)
""")
def hung_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs without an event for 30 minutes after they began; stateful.sweep() gives the same of a stream."""
    what = F.when(F.col("event_type") == "view", "processing").otherwise(F.col("event_type"))
    return stateful.swept(table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), "ts", what.alias("what")))


def backoff(attempt: Column, initial: int = 30, cap: int = 3600) -> Column:
    """Seconds until the next attempt: twice as long each time, up to a cap."""
    return F.least(F.lit(float(cap)), initial * F.pow(F.lit(2.0), attempt - 1))


def delivered(outbox: DataFrame, most: int = 5) -> DataFrame:
    """outbox (id, status, attempts, due, now, ok) after one drain: what is due and pending is tried; a failure waits by backoff(), or, at most attempts, is given up.

    What isn't due or pending stays as it is. Draining twice at one moment changes nothing more, as what failed isn't due.
    """
    tried = (F.col("status") == "pending") & (F.col("due") <= F.col("now"))
    n = F.col("attempts") + F.when(tried, 1).otherwise(0)
    status = F.when(~tried, F.col("status")).when(F.col("ok"), "delivered").when(n >= most, "dead_letter").otherwise("pending")
    wait = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), backoff(n).cast("decimal(18,6)"))
    due = F.when(tried & ~F.col("ok") & (n < most), F.col("now") + wait).otherwise(F.col("due"))
    return outbox.select("id", status.alias("status"), n.alias("attempts"), due.alias("due"), tried.alias("tried"))


@query("""
WITH t AS (SELECT max(ts) AS now FROM events), o AS (SELECT event_id AS id, CASE WHEN event_type = 'purchase' THEN 'delivered' ELSE 'pending' END AS status, event_id % 5 AS attempts, CASE WHEN event_type = 'view' THEN now + INTERVAL 1 HOUR ELSE ts END AS due, now, user_id % 3 <> 0 AS ok FROM events, t),
d AS (SELECT id, status = 'pending' AND due <= now AS tried, attempts + CASE WHEN status = 'pending' AND due <= now THEN 1 ELSE 0 END AS attempts, status, ok, due, now FROM o)
SELECT id, CASE WHEN NOT tried THEN status WHEN ok THEN 'delivered' WHEN attempts >= 5 THEN 'dead_letter' ELSE 'pending' END AS status, attempts, CASE WHEN tried AND NOT ok AND attempts < 5 THEN now + to_seconds(least(3600, 30 * pow(2, attempts - 1))::BIGINT) ELSE due END AS due, tried FROM d
""")
def outbox_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One drain of an outbox: delivered, to be tried again, or given up."""
    e = with_now(table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "user_id"))
    o = e.select(
        F.col("event_id").alias("id"), F.when(F.col("event_type") == "purchase", "delivered").otherwise("pending").alias("status"), (F.col("event_id") % 5).alias("attempts"),
        F.when(F.col("event_type") == "view", F.col("now") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("ts")).alias("due"), "now", (F.col("user_id") % 3 != 0).alias("ok"),
    )
    return delivered(o)


@query("""
WITH t AS (SELECT max(ts) AS now FROM events), o AS (SELECT CASE event_type WHEN 'purchase' THEN 'delivered' WHEN 'error' THEN 'dead_letter' ELSE 'pending' END AS status, ts FROM events)
SELECT status, count(*) AS n, CASE WHEN status = 'pending' THEN floor(date_part('epoch', max(now) - min(ts)) / 3600)::BIGINT END AS oldest_hours FROM o, t GROUP BY 1
""")
def outbox_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "delivered").when(F.col("event_type") == "error", "dead_letter").otherwise("pending")
    o = with_now(table(spark, sf_dir, "events").select("ts", status.alias("status")))
    age = F.floor((F.unix_micros(F.max("now").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 3_600_000_000).cast("long")
    return o.groupBy("status").agg(count().alias("n"), F.when(F.col("status") == "pending", age).alias("oldest_hours"))


def suggestions_aged(s: DataFrame, stale_days: int = 14, reject_days: int = 21, most: int = 500) -> DataFrame:
    """s (id, status, ts, now) after two sweeps: pending ones older than stale_days are stale; of those older than reject_days the oldest most are rejected.

    A sweep takes a stated number at a time and leaves the rest for the next one; 0 days turn a sweep off.
    """
    older = lambda d: F.col("ts") < F.col("now") - F.expr(f"INTERVAL {d} DAYS") if d > 0 else F.lit(False)
    s = s.withColumn("stale", (F.col("status") == "pending") & older(stale_days))
    due = s.filter(F.col("stale") & older(reject_days)).orderBy("ts", "id").limit(most).select(F.col("id").alias("gone"))
    rows = s.join(F.broadcast(due), F.col("id") == F.col("gone"), "left")
    return rows.select("id", F.when(F.col("gone").isNotNull(), "rejected").otherwise(F.col("status")).alias("status"), "stale")


@query("""
WITH t AS (SELECT max(ts) AS now FROM events), s AS (SELECT event_id AS id, CASE event_type WHEN 'signup' THEN 'approved' WHEN 'error' THEN 'rejected' ELSE 'pending' END AS status, ts, now FROM events, t),
a AS (SELECT *, status = 'pending' AND ts < now - INTERVAL 14 DAY AS stale, row_number() OVER (PARTITION BY status = 'pending' AND ts < now - INTERVAL 21 DAY ORDER BY ts, id) AS k FROM s)
SELECT CASE WHEN status = 'pending' AND ts < now - INTERVAL 21 DAY AND k <= 500 THEN 'rejected' ELSE status END AS status, stale, count(*) AS n FROM a GROUP BY 1, 2
""")
def suggestion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions by status after the sweeps; the batch of 500 is the feature."""
    status = F.when(F.col("event_type") == "signup", "approved").when(F.col("event_type") == "error", "rejected").otherwise("pending")
    s = with_now(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", status.alias("status")))
    return suggestions_aged(s).groupBy("status", "stale").agg(count().alias("n"))


@query("""
WITH p AS (SELECT DISTINCT event_type AS pattern, user_id % 7 AS target FROM events WHERE event_type IN ('signup', 'view')), a AS (SELECT pattern, min(target) AS target, count(*) AS n FROM p GROUP BY 1)
SELECT d.doc_id, coalesce(a.pattern, 'unchanged') AS rule FROM documents d LEFT JOIN a ON d.doc_id % 7 = a.target AND a.pattern = CASE WHEN d.lang = 'en' THEN 'signup' ELSE 'view' END
""")
def approved_patterns_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved patterns become rules, one each, and the documents that they meet are named."""
    p = table(spark, sf_dir, "events").filter("event_type IN ('signup', 'view')").select(F.col("event_type").alias("pattern"), (F.col("user_id") % 7).alias("target")).distinct()
    a = p.groupBy("pattern").agg(F.min("target").alias("target"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "en", "signup").otherwise("view").alias("wanted"))
    return d.join(F.broadcast(a), (F.col("doc_id") % 7 == F.col("target")) & (F.col("wanted") == F.col("pattern")), "left").select("doc_id", F.coalesce("pattern", F.lit("unchanged")).alias("rule"))


# votes and weights


def accepted_votes(votes: DataFrame) -> DataFrame:
    """votes (answer, user, vote, ts, id) less those that aren't 1 or -1, and those that repeat the user's vote before on the answer."""
    w = W.partitionBy("answer", "user").orderBy("ts", "id")
    good = votes.filter(F.col("vote").isin(1, -1)).withColumn("before", F.lag("vote").over(w))
    return good.filter("before IS NULL OR before <> vote").drop("before")


@query("""
WITH v AS (SELECT event_id AS id, user_id % 10 AS answer, user_id AS u, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS vote, ts FROM events),
b AS (SELECT *, lag(vote) OVER (PARTITION BY answer, u ORDER BY ts, id) AS before FROM v WHERE vote IN (1, -1))
SELECT answer, count(*) AS n, sum(vote)::BIGINT AS total, max(id) AS last FROM b WHERE before IS NULL OR before <> vote GROUP BY 1
""")
def feedback_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes that count, by answer."""
    vote = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    v = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("answer"), F.col("user_id").alias("user"), vote.alias("vote"), "ts")
    return accepted_votes(v).groupBy("answer").agg(count().alias("n"), F.sum("vote").alias("total"), F.max("id").alias("last"))


def clamped(weight: Column) -> Column:
    return F.greatest(F.lit(0.1), F.least(F.lit(5.0), weight))


def rebalanced(weight: Column, days: Column, decay: float = 0.05) -> Column:
    """A weight's distance from 1 shrinks by decay a day, to nothing at the most; held within 0.1 and 5."""
    return clamped(1 + (weight - 1) * F.greatest(F.lit(0.0), 1 - decay * days))


def weight_delta(vote: Column, weight: Column, up: float = 0.20, down: float = -0.30) -> Column:
    """The weight after one vote: its distance from 1 grows by the vote's share; at 1 it doesn't change."""
    return clamped(weight + F.when(vote > 0, up).when(vote < 0, down).otherwise(0.0) * (weight - 1))


@query("""
WITH w AS (SELECT user_id, greatest(0.1, least(5.0, 1 + sum(CASE event_type WHEN 'purchase' THEN 0.2 WHEN 'error' THEN -0.3 ELSE 0 END)))::DOUBLE AS weight, count(*) % 30 AS days FROM events GROUP BY 1)
SELECT user_id, round(weight, 6) AS weight, round(greatest(0.1, least(5.0, 1 + (weight - 1) * greatest(0, 1 - 0.05 * days))), 6)::DOUBLE AS rebalanced, round(greatest(0.1, least(5.0, weight - 0.3 * (weight - 1))), 6)::DOUBLE AS after_vote FROM w
""")
def weight_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights out of votes, after days of decay, and after one vote against."""
    step = F.when(F.col("event_type") == "purchase", F.lit("0.2").cast("decimal(4,1)")).when(F.col("event_type") == "error", F.lit("-0.3").cast("decimal(4,1)")).otherwise(F.lit("0").cast("decimal(4,1)"))
    w = table(spark, sf_dir, "events").groupBy("user_id").agg(clamped(1 + F.sum(step).cast("double")).alias("weight"), (count() % 30).alias("days"))
    return w.select("user_id", F.round("weight", 6).alias("weight"), F.round(rebalanced(F.col("weight"), F.col("days")), 6).alias("rebalanced"), F.round(weight_delta(F.lit(-1), F.col("weight")), 6).alias("after_vote"))


@query("""
WITH t AS (SELECT max(ts) AS now FROM events)
SELECT user_id, (count(*) FILTER (event_type = 'signup' AND ts > now - INTERVAL 3600 SECOND * 24))::BIGINT AS recent FROM events, t GROUP BY 1
""")
def recent_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each client has waiting from the last day."""
    e = with_now(table(spark, sf_dir, "events").select("user_id", "event_type", "ts"))
    return e.groupBy("user_id").agg(F.count_if((F.col("event_type") == "signup") & (F.col("ts") > F.col("now") - F.expr("INTERVAL 24 HOURS"))).alias("recent"))


@query("""
WITH e AS (SELECT user_id, event_type, ts, event_id FROM events), l AS (SELECT user_id, max(ts) AS ts FROM e GROUP BY 1)
SELECT l.user_id, arg_max(event_type, (e.ts, event_id)) AS status, arg_max(event_id, (e.ts, event_id)) AS event_id FROM l JOIN e ON e.user_id = l.user_id AND e.ts = l.ts GROUP BY 1
""")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last write of each key wins; max_by aggregates before the shuffle."""
    last = F.max_by(F.struct("event_type", "event_id"), F.struct("ts", "event_id"))
    return table(spark, sf_dir, "events").filter("user_id IS NOT NULL").groupBy("user_id").agg(last.alias("l")).select("user_id", F.col("l.event_type").alias("status"), F.col("l.event_id").alias("event_id"))
