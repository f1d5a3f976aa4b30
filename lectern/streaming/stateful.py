"""Sweeps and retries over streams: state a key, with timers.

Events of a key wait in its state until the watermark has passed them and are then taken in the order of their times, so that what comes out
doesn't depend on how they were dealt into batches; only events behind the watermark, which Spark drops, can change it. The
functions at the end give the same of a table, by windows, as a stream that has come to a watermark.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Where a query with state keeps it; transformWithState takes no other.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Minutes after which a job that is still processing is failed.
LIMIT = 30
#: Delivery attempts at most, seconds until the second, and at most between two; hours after which a key that says nothing is forgotten.
ATTEMPTS, INITIAL, CAP, FORGET = 5, 30, 3600, 24 * 7


class _InOrder(StatefulProcessor):
    """Holds (ts in ms, what) until the watermark passes it. Subclasses say what follows from an event, and from a moment that has come."""

    STATE = ""
    KEY = ""

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "ts long, what string")
        self.state = handle.getValueState("state", self.STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(t), str(w)) for f in rows for t, w in zip((f["ts"].astype("datetime64[us]").astype("int64") // 1000), f["what"], strict=True)]
        self.held.appendList(new)
        for t in {t for t, _ in new}:
            self.handle.registerTimer(t)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted(tuple(r) for r in self.held.get())
        state, out = self.state.get() if self.state.exists() else None, []
        for t, what in (h for h in held if h[0] <= now):
            state, rows = self.until(state, t)
            out += rows
            state, rows = self.step(state, t, what)
            out += rows
        state, rows = self.until(state, now + 1)
        out += rows
        later = [h for h in held if h[0] > now]
        if later:
            self.held.put(later)
        else:
            self.held.clear()
        if state is None:
            self.state.clear()
        else:
            self.state.update(state)
            if (due := self.due(state)) is not None:
                self.handle.registerTimer(due)
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=self.COLUMNS).assign(**{c: lambda f, c=c: pd.to_datetime(f[c], unit="ms") for c in self.TIMES})

    def close(self) -> None:
        pass


class Sweep(_InOrder):
    """A job that has been processing for longer than the limit, without an event since, fails at the limit."""

    STATE, COLUMNS, TIMES = "since long", ["job", "since", "failed_at"], ["since", "failed_at"]
    OUTPUT = "job long, since timestamp, failed_at timestamp"

    def __init__(self, minutes: int = LIMIT):
        self.limit = minutes * 60_000

    def due(self, state):
        return state[0] + self.limit

    def until(self, state, t):
        """What has happened before t: the job fails, unless an event came by its limit."""
        if state is not None and self.due(state) < t:
            return None, [(state[0], self.due(state))]
        return state, []

    def step(self, state, t, what):
        return ((t,) if what == "processing" else None), []


def backoff_ms(attempt: int) -> int:
    """Milliseconds from a failed attempt to the next: twice as long each time, up to a cap."""
    return 1000 * min(CAP, INITIAL * 2 ** (attempt - 1))


class Outbox(_InOrder):
    """Deliveries: "queued" asks for an attempt at once; of "failed" ones the next is due by backoff, up to the last, which makes a dead letter; "ok" is delivered.

    What an id said is forgotten FORGET hours after its last event.
    """

    STATE, COLUMNS, TIMES = "attempts int, due long, last long", ["id", "action", "attempt", "at"], ["at"]
    OUTPUT = "id long, action string, attempt int, at timestamp"

    def __init__(self, most: int = ATTEMPTS):
        self.most = most

    def due(self, state):
        return state[1] if state[1] >= 0 else state[2] + FORGET * 3_600_000

    def until(self, state, t):
        if state is None or self.due(state) >= t:
            return state, []
        attempts, due, last = state
        if due < 0:
            return None, []
        state, rows = (attempts, -1, due), [("attempt", attempts + 1, due)]
        after, _ = self.until(state, t)
        return after, rows

    def step(self, state, t, what):
        attempts, due, _ = state or (0, -1, t)
        if what == "queued":
            return ((attempts, t, t), []) if state is None else ((attempts, due, t), [])
        attempts += 1
        if what == "ok":
            return None, [("delivered", attempts, t)]
        if attempts >= self.most:
            return None, [("dead_letter", attempts, t)]
        return (attempts, t + backoff_ms(attempts), t), []


def _run(events: DataFrame, key: str, processor: _InOrder, late: str) -> DataFrame:
    """events (key, ts, what) with a watermark, through a processor. The session's spark.sql.streaming.stateStore.providerClass is to be PROVIDER."""
    rows = events.select(F.col(key).cast("long").alias(key), "ts", "what").withWatermark("ts", late)
    return rows.groupBy(key).transformWithStateInPandas(processor, processor.OUTPUT, "Append", "EventTime")


def sweep(events: DataFrame, late: str = "10 minutes", minutes: int = LIMIT) -> DataFrame:
    """(job, since, failed_at) of a stream of jobs' events (job, ts, what)."""
    return _run(events, "job", Sweep(minutes), late)


def retries(events: DataFrame, late: str = "10 minutes", most: int = ATTEMPTS) -> DataFrame:
    """(id, action, attempt, at) of a stream of what became of deliveries (id, ts, what): attempts that are due, deliveries, and dead letters."""
    return _run(events, "id", Outbox(most), late)


def swept(events: DataFrame, minutes: int = LIMIT, now=None) -> DataFrame:
    """What sweep() gives of a table of events, with now as the watermark that it has come to (else the newest time)."""
    at = F.lit(now).cast("timestamp") if now is not None else F.col("newest")
    e = events.select("job", F.col("ts").cast("timestamp").alias("ts"), "what")
    e = e.join(F.broadcast(e.agg(F.max("ts").alias("newest"))))  # one row
    limit = F.col("ts") + F.expr(f"INTERVAL {minutes} MINUTES")
    e = e.withColumn("next", F.lead("ts").over(W.partitionBy("job").orderBy("ts", "what"))).filter("what = 'processing'")
    return e.filter((F.col("next").isNull() | (F.col("next") > limit)) & (limit <= at)).select("job", F.col("ts").alias("since"), limit.alias("failed_at"))
