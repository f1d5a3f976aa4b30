"""Where a quotation stands on its page: alignment of its words with the page's word boxes, and the boxes' union."""

import re
import unicodedata
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.registry import Registry
from lectern.sources.stored import written
from lectern.sources.tables import table

query = Registry()

#: What a pair of words gives that are the same (look-alike characters aside), nearly so, or neither, and what a word without a partner costs.
SAME, NEAR, OTHER, GAP = 2, 1, -1, -1
#: Words that an alignment may drift from its diagonal, diagonals that are tried, the share of a whole match that a quotation must reach, and quotations of a page in a task (about).
BAND, TRIED, LEAST, BLOCK = 8, 3, 0.5, 500
_LOOK_ALIKE = str.maketrans("0158|!", "olsbll")


def form(word: str) -> str:
    """A word without accents, case, marks, and the difference between characters that are read for one another."""
    w = unicodedata.normalize("NFKD", word.lower()).encode("ascii", "ignore").decode().translate(_LOOK_ALIKE)
    return re.sub("[^a-z0-9]", "", w.replace("rn", "m").replace("vv", "w"))


def near(a: str, b: str) -> bool:
    """Whether words of four characters and more differ in one at most."""
    if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :]


def align(quote: list[str], page: list[str], low: int, high: int) -> tuple[int, int, int]:
    """(score, first, last) of the best local alignment of forms on diagonals low to high (place on the page less place in the quotation); the first of equals, the shorter of these. last < first: none."""
    best, above = (0, 0, -1), {}
    for i, a in enumerate(quote):
        row = {}
        for j in range(max(0, i + low), min(len(page), i + high + 1)):
            b = page[j]
            step = SAME if a == b else NEAR if near(a, b) else OTHER
            score, start = above.get(j - 1, (0, j))
            x = (score + step, start if score > 0 else j)
            for s, f in (above.get(j, (0, 0)), row.get(j - 1, (0, 0))):
                if s + GAP > x[0]:
                    x = (s + GAP, f)
            if x[0] > 0:
                row[j] = x
                if x[0] > best[0] or x[0] == best[0] and (x[1], j) < best[1:]:
                    best = (x[0], x[1], j)
        above = row
    return best


def located(quote: list[str], page: list[str], places: dict[str, list[int]]) -> tuple[int, int, int] | None:
    """align() on the diagonals that most of the quotation's words vote for, rare words more; None below LEAST of a whole match. places: where each form is on the page."""
    votes: Counter = Counter()
    for i, w in enumerate(quote):
        for j in places.get(w, ()):
            votes[(j - i) // BAND] += 1 / len(places[w])
    found = []
    for d, _ in sorted(votes.items(), key=lambda v: (-(v[1] + votes.get(v[0] + 1, 0)), v[0]))[:TRIED]:
        found.append(align(quote, page, d * BAND - BAND, d * BAND + 2 * BAND))
    best = min(found, key=lambda x: (-x[0], x[1], x[2]), default=None)
    return best if best and best[0] >= LEAST * SAME * len(quote) else None


RESULT = "quote long, page long, first int, last int, score int, x0 double, y0 double, x1 double, y1 double"


def highlights(quotes: DataFrame, boxes: DataFrame) -> DataFrame:
    """(quote, page, first, last, score, x0, y0, x1, y1): the words of its page that each quotation (quote, page, text) stands for, and the union of their boxes (page, place, word, x0, y0, x1, y1).

    Words stand in the order of place, then of their boxes. A quotation that isn't found, or has no words, has no row. Null pages hold nothing; a null word is an empty one, and boxes with a null side don't count
    in the union. A page's words come to one task, and to several if very many quotations are of it.
    """
    q = written(quotes.select(F.col("quote").cast("long").alias("quote"), F.col("page").cast("long").alias("page"), "text").filter("page IS NOT NULL AND text IS NOT NULL"), "quotes")
    sizes = q.groupBy("page").agg((F.floor(F.count(F.lit(1)) / BLOCK) + 1).cast("int").alias("blocks"))
    q = q.join(sizes, "page").select("page", F.pmod(F.xxhash64("quote", "text"), F.col("blocks")).cast("int").alias("block"), "quote", "text")
    sides = ["x0", "y0", "x1", "y1"]
    b = boxes.select(F.col("page").cast("long").alias("page"), F.col("place").cast("long").alias("place"), F.coalesce("word", F.lit("")).alias("word"), *[F.col(s).cast("double").alias(s) for s in sides])
    b = b.join(sizes, "page").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).drop("blocks")

    def run(asked: pa.Table, words: pa.Table) -> pa.Table:
        rows = sorted(zip(*(words[c].to_pylist() for c in ("place", *sides, "word")), strict=True), key=lambda r: tuple((x is None, x) for x in r))
        page = [form(r[5]) for r in rows]
        places = defaultdict(list)
        for j, w in enumerate(page):
            if w:
                places[w].append(j)
        out = []
        for quote, of, text in zip(asked["quote"].to_pylist(), asked["page"].to_pylist(), asked["text"].to_pylist(), strict=True):
            said = [w for w in map(form, text.split()) if w]
            got = located(said, page, places) if said else None
            if got:
                own = [r[1:5] for r in rows[got[1] : got[2] + 1] if None not in r[1:5]]
                union = [f(r[k] for r in own) if own else None for k, f in ((0, min), (1, min), (2, max), (3, max))]
                out.append((quote, of, got[1], got[2], got[0], *union))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.float64()] * 4]
        return pa.table([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in RESULT.split(", ")])

    return q.groupBy("page", "block").cogroup(b.groupBy("page", "block")).applyInArrow(run, RESULT)


@query()
def source_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve words from the middle of each benchmark item, with characters misread, on the item laid out in lines of ten words."""
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("page"), w.alias("w"))
    boxes = items.select("page", F.posexplode("w").alias("place", "word"))
    x, y = F.col("place") % 10 * 50.0, F.floor(F.col("place") / 10) * 12.0
    boxes = boxes.select("page", "place", "word", x.alias("x0"), y.alias("y0"), (x + F.length("word") * 5.0).alias("x1"), (y + 10.0).alias("y1"))
    said = F.translate(F.array_join(F.slice("w", F.floor(F.size("w") / 3).cast("int") + 1, F.lit(12)), " "), "ol", "01")
    return highlights(items.select(F.col("page").alias("quote"), "page", said.alias("text")), boxes)
