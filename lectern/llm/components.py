"""Connected components of a link table, by least labels and pointer jumping."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut


#: A small table is kept in few parts, as many would cost more in files than in rows; large ones keep their partitions.
ROWS_A_PART = 20_000


def components(links: DataFrame) -> DataFrame:
    """(id, class): class is the least id of the component, for every id in links (a, b), in which order and repeats don't matter.

    Each round takes the least label among a row's neighbours, then its label's label, and ends when no label changes; labels
    only go down, so it ends, after a number of rounds that grows with the logarithm of a chain's length. A hub's neighbours are aggregated before the
    shuffle. Every round is cut from its lineage by a checkpoint. No links give no rows.
    """
    n = links.count()
    parts = 1 + n // ROWS_A_PART
    both = links.filter("a <> b").select("a", "b")
    both = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(parts).distinct().coalesce(parts))
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("c")).withColumnRenamed("a", "id").coalesce(parts))
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("c").alias("m"))
        low = cut(labels.join(near, labels["id"] == near["a"]).select("id", "c", F.least("c", "m").alias("m")).coalesce(parts))
        up = low.select(F.col("id").alias("root"), F.col("m").alias("r"))
        after = cut(low.join(up, low["m"] == up["root"], "left").select("id", F.least("m", F.coalesce("r", "m")).alias("m"), "c").coalesce(parts))
        changed = after.filter("m <> c").limit(1).count()
        labels = after.select("id", F.col("m").alias("c"))
        if not changed:
            return labels.select("id", F.col("c").alias("class"))
