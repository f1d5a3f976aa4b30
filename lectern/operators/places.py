"""Nearest anchors in plans, by a grid that grows coarser until the nearest is proven."""

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.operators.registry import Registry
from lectern.sources.stored import written
from lectern.sources.tables import table

query = Registry()

#: The first grid's cells are so much narrower than anchors would be apart if they were spread evenly: what is dense then is in many cells.
FINER = 16


def _cell(at: str, width: Column) -> Column:
    return F.floor(F.col(at) / width).cast("long")


def nearest_anchors(entities: DataFrame, anchors: DataFrame) -> DataFrame:
    """(plan, entity, anchor, distance, rank) of entities (plan, entity, x, y): the nearest of the plan's anchors (plan, anchor, x, y), ties to the least anchor; rank orders
    a plan's entities by distance, then by entity, and those without an anchor or a place last.

    No cross join: in a grid of cells as wide as w, all anchors within w of an entity lie in its cell or in the eight around it. An entity whose
    nearest there is at w or less is done; the others go on to cells twice as wide. Anchors of one place count once.
    """
    e = written(entities.select("plan", "entity", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "entities")
    finite = "x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND abs(x) < 1e300 AND abs(y) < 1e300"
    a = anchors.select("plan", "anchor", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter(finite)
    a = a.groupBy("plan", "x", "y").agg(F.min("anchor").alias("anchor"))
    extent = lambda c: F.max(c) - F.min(c)
    spread = F.greatest(extent("x"), extent("y"))
    sizes = a.groupBy("plan").agg(F.count(F.lit(1)).alias("n"), spread.alias("extent"), F.min("x").alias("ax"), F.max("x").alias("bx"), F.min("y").alias("ay"), F.max("y").alias("by"))
    width = F.greatest(F.col("extent") / F.sqrt(F.col("n").cast("double")) / FINER, F.lit(1e-9))
    a = written(a.join(sizes.select("plan", width.alias("w0")), "plan"), "anchors")
    placed = e.filter(finite).join(sizes.select("plan", width.alias("w0"), "ax", "bx", "ay", "by"), "plan")
    # an entity far from all anchors begins where its gap to their frame, which no anchor is nearer than, is a cell's width
    gap = F.greatest(F.col("ax") - F.col("x"), F.col("x") - F.col("bx"), F.col("ay") - F.col("y"), F.col("y") - F.col("by"), F.lit(0.0))
    first = F.greatest(F.lit(0), F.floor(F.log2(F.greatest(gap, F.col("w0")) / F.col("w0")))).cast("int")
    open_ = written(placed.select("plan", "entity", "x", "y", "w0", first.alias("level")), "open")
    done, level, steps = [], (open_.agg(F.min("level")).first()[0] or 0), range(-1, 2)
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in steps for j in steps])
    while not open_.isEmpty():
        w = F.col("w0") * math.pow(2, level)
        now = open_.filter(F.col("level") <= level)
        asks = now.select("plan", "entity", "x", "y", F.explode(near).alias("d"), _cell("x", w).alias("cx"), _cell("y", w).alias("cy"), w.alias("w"))
        asks = asks.select("plan", "entity", "x", "y", "w", (F.col("cx") + F.col("d.i")).alias("cx"), (F.col("cy") + F.col("d.j")).alias("cy"))
        cells = a.select("plan", F.col("x").alias("ox"), F.col("y").alias("oy"), "anchor", _cell("x", w).alias("cx"), _cell("y", w).alias("cy"))
        d = F.sqrt((F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy")))
        met = asks.join(cells, ["plan", "cx", "cy"]).groupBy("plan", "entity", "x", "y").agg(F.min(F.struct(d.alias("distance"), F.col("anchor"))).alias("best"), F.first("w").alias("w"))
        met = written(met.select("plan", "entity", "x", "y", "best.distance", "best.anchor", "w"), "met")
        proven = met.filter(F.col("distance") <= F.col("w")).select("plan", "entity", "x", "y", "distance", "anchor")
        done.append(proven)
        open_ = written(open_.join(proven.select("plan", "entity", "x", "y"), ["plan", "entity", "x", "y"], "left_anti"), "open")
        level += 1
    key = ["plan", "entity", "x", "y"]
    out = e.withColumn("distance", F.lit(None).cast("double")).withColumn("anchor", F.lit(None).cast(anchors.schema["anchor"].dataType))
    if done:
        found = done[0]
        for d in done[1:]:
            found = found.unionByName(d)
        out = e.join(found.distinct(), key, "left")
    rank = F.row_number().over(W.partitionBy("plan").orderBy(F.col("distance").asc_nulls_last(), "entity"))
    return out.select("plan", "entity", "anchor", "distance", rank.alias("rank"))


#: By how much of its value a dimension may differ from what is drawn, and the pixels that a box must have on its longer side.
TOLERANCE, LEAST_SIDE = 0.30, 4.0


def pixels_per_metre(dpi: Column, scale: Column) -> Column:
    """Pixels of a real metre on a page of dpi dots an inch, drawn at 1:scale; null unless both are positive."""
    return F.when((dpi > 0) & (scale > 0), dpi / 0.0254 / scale)


def checked_dimensions(dims: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """dims (value_m, x0, y0, x1, y1, dpi, scale, confidence, ...) with expected_m and needs_review: what the longer side of a dimension's box stands for in metres, and whether
    its value differs from that by more than tolerance of itself. Such a dimension keeps its value, and has half its confidence.

    expected_m is null, and nothing is in doubt, where the box, scale or resolution is missing, the box is below LEAST_SIDE pixels, or the value isn't positive.
    """
    side = F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")))
    whole = F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull()
    expected = F.when(whole & (side >= LEAST_SIDE), side / pixels_per_metre(F.col("dpi"), F.col("scale")))
    off = F.coalesce((F.col("value_m") > 0) & (F.abs(F.col("expected_m") - F.col("value_m")) / F.col("value_m") > tolerance), F.lit(False))
    rows = dims.withColumn("expected_m", expected).withColumn("needs_review", off)
    return rows.withColumn("confidence", F.when(F.col("needs_review"), F.round(F.col("confidence") * 0.5, 4)).otherwise(F.col("confidence")))


@query("""
WITH d AS (SELECT l_orderkey, l_linenumber, l_quantity AS value_m, CASE WHEN l_discount > 0.05 THEN 2 ELSE 1 END * l_quantity / 50 / 0.0254 * 300 AS side FROM lineitem)
SELECT l_orderkey, l_linenumber, round(side / (300 / 0.0254 / 50), 6) AS expected_m, abs(side / (300 / 0.0254 / 50) - value_m) / value_m > 0.3 AS needs_review, CASE WHEN abs(side / (300 / 0.0254 / 50) - value_m) / value_m > 0.3 THEN 0.45 ELSE 0.9 END::DOUBLE AS confidence FROM d
""")
def dimensions_against_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities as lengths drawn at 1:50 and 300 dots an inch, those with large discounts twice as long as they say."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("value_m"), "l_discount")
    side = F.when(F.col("l_discount") > 0.05, 2).otherwise(1) * F.col("value_m") / 50 / 0.0254 * 300
    dims = li.select("l_orderkey", "l_linenumber", "value_m", F.lit(10.0).alias("x0"), F.lit(5.0).alias("y0"), (side + 10).alias("x1"), F.lit(9.0).alias("y1"), F.lit(300.0).alias("dpi"), F.lit(50.0).alias("scale"), F.lit(0.9).alias("confidence"))
    return checked_dimensions(dims).select("l_orderkey", "l_linenumber", F.round("expected_m", 6).alias("expected_m"), "needs_review", "confidence")


@query("""
WITH p AS (SELECT label AS plan, vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
d AS (SELECT e.plan, e.vec_id AS entity, a.vec_id AS anchor, sqrt((e.x - a.x) * (e.x - a.x) + (e.y - a.y) * (e.y - a.y)) AS distance FROM p e JOIN p a ON a.plan = e.plan AND a.vec_id % 7 = 0 AND e.vec_id % 7 <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY plan, entity ORDER BY distance, anchor) AS k FROM d)
SELECT plan, entity, anchor, round(distance, 9) AS distance, row_number() OVER (PARTITION BY plan ORDER BY distance, entity)::INTEGER AS rank FROM n WHERE k = 1
""")
def plan_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands nearest to each entity: places from vectors' first components, one plan a label, every seventh an anchor."""
    p = table(spark, sf_dir, "embeddings").select(F.col("label").alias("plan"), "vec_id", F.get("embedding", F.lit(0)).alias("x"), F.get("embedding", F.lit(1)).alias("y"))
    e = p.filter("vec_id % 7 <> 0").withColumnRenamed("vec_id", "entity")
    return nearest_anchors(e, p.filter("vec_id % 7 = 0").withColumnRenamed("vec_id", "anchor")).withColumn("distance", F.round("distance", 9))
