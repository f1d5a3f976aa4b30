"""Mixing sources to target weights by entropy balancing: rates as near to one as the targets allow, then whole copies.

Of all document rates w, those that meet every source's target of words, sum(w * size) = target, with w <= MOST, and with the
least relative entropy to taking each document once, are exponentially tilted: w = min(MOST, exp(tilt * size)), one tilt a
source. The tilts solve the convex dual, of which the derivative by a tilt is its source's words less its target; safeguarded
Newton steps on the logarithm find them.

How it runs: rates depend on (source, size) alone, so documents are counted by these once, and every iteration sums over that
table, which a shuffle has dealt, whatever source is hot. Sums are of whole numbers (millionths of a word) and so don't depend
on their order: reruns agree to the last digit. Copies are given to (source, size) cells by cumulative rounding, mended until a
source's words meet its target as nearly as its sizes allow, and within a cell the documents that come first by a hash of
their ids get one more than the others. DataFrame functions only.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import SPACE, written

#: Weights of the sources in order, repeating; no document is taken more often than MOST.
WEIGHTS, MOST = (5, 2, 1), 3
#: Newton iterations and mending rounds at most (few are used), and how near words and targets are to be, as shares of the target.
ROUNDS, MENDS, NEAR, CLOSE = 60, 8, 1e-9, 1e-4
SPACES = " \t\n\x0b\f\r"


def n_words(text: Column) -> Column:
    """Runs of anything but space and \\t to \\r in a text; 0 for null."""
    bare = F.trim(text, F.lit(SPACES))
    return F.when(F.length(bare) > 0, F.size(F.split(bare, SPACE))).otherwise(0).cast("long")


def ranges(df: DataFrame, *order: Column, name: str) -> DataFrame:
    """df written in ranges of order, with the number of each row's range as "at". Rows equal in order must differ in nothing that matters."""
    return written(df.repartitionByRange(*order).withColumn("at", F.spark_partition_id()), name)


def numbered(sources: DataFrame) -> DataFrame:
    """(source, source_size) with place: 0, 1, ... by code point, null last. Ranges are numbered in themselves and moved on by those before."""
    placed = ranges(sources, F.col("source").asc_nulls_last(), name="sources")
    before = placed.groupBy("at").agg(F.count(F.lit(1)).alias("n"))
    before = before.select(F.col("at").alias("of"), F.coalesce(F.sum("n").over(W.orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("moved"))
    own = F.row_number().over(W.partitionBy("at").orderBy(F.col("source").asc_nulls_last())) - 1
    placed = placed.withColumn("own", own)
    return placed.join(before, placed["at"] == before["of"]).select("source", "source_size", (F.col("moved") + F.col("own")).alias("place"))


def targets(sources: DataFrame) -> DataFrame:
    """numbered() sources with target: their weights' shares of all words, none over MOST times its own; what is over is shared anew by weight.

    A share is weight * level; capped sources leave the level to the others, which can only raise it, until none is above.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    s = written(sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * MOST), "capped")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level, seen = 0.0, None
    while True:
        above = F.col("most") < F.col("weight") * level
        capped, n, free = s.agg(F.sum(F.when(above, F.col("most")).otherwise(0)), F.sum(above.cast("long")), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        if n == seen or not free:
            return s.withColumn("target", F.least(F.col("most").cast("double"), F.col("weight") * level)).drop("weight", "most")
        level, seen = (total - capped) / free, n


def _rate(tilt: str, size: str) -> Column:
    return F.when(F.col(tilt).isNull(), F.lit(float(MOST))).otherwise(F.least(F.lit(float(MOST)), F.exp(F.col(tilt) * F.col(size))))


def tilts(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """(place, tilt) for each source; a null tilt says that every document is taken MOST times.

    cells: (place, size, n). A tilt lies between log(target / words) over the least and over the largest size of its source, as
    at these ends all rates are on one side of target / words. Newton steps that leave what is left of this range halve it.
    """
    grain = lambda x: F.round(x * 1_000_000).cast("decimal(38, 0)")
    some = cells.filter("size > 0")
    known = some.groupBy("place").agg(F.min("size").alias("least"), F.max("size").alias("largest"), F.sum(F.col("n").cast("decimal(38, 0)") * F.col("size") * F.col("size")).cast("double").alias("squares"))
    s = sources.join(known, "place")
    full = s.filter(F.col("target") >= F.col("source_size") * MOST).select("place", F.lit(None).cast("double").alias("tilt"))
    s = s.filter(F.col("target") < F.col("source_size") * MOST).withColumn("need", F.log(F.col("target") / F.col("source_size")))
    ends = [F.col("need") / F.col("least"), F.col("need") / F.col("largest")]
    state = written(s.select("place", "target", (F.col("need") * F.col("source_size") / F.col("squares")).alias("tilt"), F.least(*ends).alias("low"), F.greatest(*ends).alias("high"), F.lit(False).alias("done")), "tilts")
    done = []
    for _ in range(ROUNDS):
        rate = _rate("tilt", "size")
        part = some.join(state.select("place", "tilt"), "place").select("place", "size", (F.col("n") * F.col("size") * rate).alias("words"), (rate < MOST).alias("free"))
        sums = part.groupBy("place").agg(F.sum(grain(F.col("words"))).alias("got"), F.sum(grain(F.when(F.col("free"), F.col("words") * F.col("size")).otherwise(0.0))).alias("slope"))
        now = state.join(sums, "place").withColumn("got", F.col("got").cast("double") / 1_000_000).withColumn("slope", F.col("slope").cast("double") / 1_000_000)
        over = F.col("got") >= F.col("target")
        now = now.withColumn("high", F.when(over, F.col("tilt")).otherwise(F.col("high"))).withColumn("low", F.when(over, F.col("low")).otherwise(F.col("tilt")))
        step = F.col("tilt") - F.col("got") / F.col("slope") * F.log(F.col("got") / F.col("target"))
        fits = (F.col("slope") > 0) & (step > F.col("low")) & (step < F.col("high"))
        near = (F.abs(F.col("got") - F.col("target")) <= F.col("target") * NEAR + 1e-6) | (F.col("high") - F.col("low") <= F.abs(F.col("high")) * 1e-15)
        now = now.select("place", "target", F.when(near, F.col("tilt")).when(fits, step).otherwise((F.col("low") + F.col("high")) / 2).alias("tilt"), "low", "high", near.alias("done"))
        state = written(now, "tilts")
        done.append(state.filter("done").select("place", "tilt"))
        state = state.filter("NOT done")
        if state.isEmpty():
            break
    done.append(state.select("place", "tilt"))
    for d in done:
        full = full.unionByName(d)
    return written(full, "tilts")


def copies(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """(place, size, n, copies): how many copies all documents of a cell have together, 0 to MOST a document.

    cells: (place, size, n, rate). From the largest size down, copies are the rounded sums of rates so far, less those before; so the
    words of a source are off by half its largest document at most. Then, round by round, that cell gives or takes copies which
    comes nearest to what its source lacks or has too much.
    """
    down = W.partitionBy("place").orderBy(F.desc("size"))
    so_far = F.round(F.sum(F.col("n") * F.col("rate")).over(down.rowsBetween(W.unboundedPreceding, 0)))
    c = cells.withColumn("so_far", so_far).withColumn("copies", (F.col("so_far") - F.coalesce(F.lag("so_far").over(down), F.lit(0.0))).cast("long"))
    c = written(c.select("place", "size", "n", F.greatest(F.lit(0), F.least(F.col("copies"), F.col("n") * MOST)).alias("copies")), "copies")
    for _ in range(MENDS):
        taken = c.groupBy("place").agg(F.sum(F.col("copies") * F.col("size")).alias("words"))
        off = sources.join(taken, "place").select("place", F.round(F.col("target") - F.col("words")).cast("long").alias("off"), "target").filter((F.abs("off") > 1) & (F.abs("off") > F.col("target") * CLOSE))
        room = F.when(F.col("off") > 0, F.col("n") * MOST - F.col("copies")).otherwise(F.col("copies"))
        each = c.filter("size > 0").join(off, "place").withColumn("some", F.least(room, F.greatest(F.lit(1), F.round(F.abs("off") / F.col("size")).cast("long"))))
        each = each.withColumn("left", F.abs(F.abs("off") - F.col("some") * F.col("size"))).filter((F.col("some") > 0) & (F.col("left") < F.abs("off")))
        best = each.groupBy("place").agg(F.min(F.struct("left", "some", "size", (F.col("some") * F.signum("off").cast("long")).alias("add"))).alias("best"))
        best = written(best.select("place", F.col("best.size").alias("size"), F.col("best.add").alias("add")), "mends")
        if best.isEmpty():
            break
        c = written(c.join(best, ["place", "size"], "left").select("place", "size", "n", (F.col("copies") + F.coalesce("add", F.lit(0))).alias("copies")), "copies")
    return c


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, copies, rate) of every document: taken = copies * size.

    A null text has no words; null sources are one, behind all others. Documents without words have rate 1. Rows with equal or null ids are
    documents of their own, and which of them gets a copy more shows nowhere. An empty table gives no rows. Other columns are left out, whatever their names.
    """
    rows = written(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"), n_words(docs[text_col].cast("string")).alias("size")), "sizes")
    rows = rows.withColumn("hash", F.xxhash64(F.coalesce("doc_id", F.lit(0)))).withColumn("tie", F.monotonically_increasing_id())
    # ranges end anywhere in a cell, so that one of a third of all rows is in many of them
    rows = ranges(rows, F.col("source"), F.col("size"), F.col("hash"), F.col("doc_id"), F.col("tie"), name="documents").drop("tie")
    spans = written(rows.groupBy("source", "size", "at").agg(F.count(F.lit(1)).alias("n")), "spans")
    by_source = spans.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    sources = written(targets(numbered(by_source)), "targets")
    named = sources.select(F.col("source").alias("s"), "place")
    cells = spans.groupBy("source", "size").agg(F.sum("n").alias("n"))
    cells = written(cells.join(named, cells["source"].eqNullSafe(named["s"])).select("place", "size", "n"), "cells")
    rates = cells.join(tilts(cells, sources), "place", "left").withColumn("rate", F.when(F.col("size") == 0, 1.0).otherwise(_rate("tilt", "size"))).select("place", "size", "n", "rate")
    given = copies(rates, sources)

    # the range's own share of its cell's spare copies: those behind the ranges before
    before = W.partitionBy("source", "size").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    moved = spans.withColumn("moved", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    about = sources.join(given, "place").join(rates.select("place", "size", "rate"), ["place", "size"])
    about = about.select(F.col("source").alias("s"), F.col("size").alias("z"), "source_size", "target", "rate", F.expr("copies DIV n").alias("each"), F.expr("copies % n").alias("spare"))
    moved = moved.join(about, moved["source"].eqNullSafe(about["s"]) & (moved["size"] == about["z"]))
    moved = moved.select("s", "z", F.col("at").alias("a"), "source_size", "target", "rate", "each", (F.col("spare") - F.col("moved")).alias("spare"))
    place = F.row_number().over(W.partitionBy("source", "size", "at").orderBy("hash", "doc_id"))
    rows = rows.withColumn("i", place)
    rows = rows.join(moved, rows["source"].eqNullSafe(moved["s"]) & (rows["size"] == moved["z"]) & (rows["at"] == moved["a"]))
    rows = rows.withColumn("copies", F.col("each") + (F.col("i") <= F.col("spare")).cast("long"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies", "rate")
