"""Pages as blocks with boxes: rows and columns of tables, reading order, rooms' measures; and texts whose end repeats itself.

The given tables hold no boxes, so queries lay typed columns out as blocks and read them again.
"""

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lectern.functions import text as T
from lectern.operators.business import count
from lectern.operators.extraction import ROLES
from lectern.operators.records import LINES_SQL, lines
from lectern.operators.registry import Registry
from lectern.operators.textops import spanish
from lectern.sources.tables import table

query = Registry()

def cluster_rows(tops: list[float], height: float) -> list[int]:
    """A row number for each block, in the order of their tops: a block joins the row above if its top is within max(6, height / 40) of the row's median or last top."""
    tolerance, rows, number = max(6.0, height / 40), [], [0] * len(tops)
    for i in sorted(range(len(tops)), key=tops.__getitem__):
        y = tops[i]
        if rows and (y - rows[-1][-1] <= tolerance or y - rows[-1][len(rows[-1]) // 2] <= tolerance):
            rows[-1].append(y)
        else:
            rows.append([y])
        number[i] = len(rows) - 1
    return number


_ROLES = [(name, re.compile(pattern)) for name, pattern in ROLES.items()]
_DIGIT = re.compile("[0-9]")


def page_items(blocks: list[tuple[str, float, float, float, float]], height: float) -> list[dict]:
    """The items of a page's table: the first row with two known column names or more is its header; each later block goes to the nearest header's column.

    blocks: (text, x1, y1, x2, y2). A row without a number goes on with the description of the row above.
    """
    rows: dict[int, list[tuple[float, str, float]]] = {}
    for (t, x1, _, x2, _), k in zip(blocks, cluster_rows([b[2] for b in blocks], height), strict=True):
        rows.setdefault(k, []).append((x1, t, (x1 + x2) / 2))
    header, out = None, []
    for _, row in sorted(rows.items()):
        row.sort(key=lambda b: b[0])
        if header is None:
            known = [(next((r for r, p in _ROLES if p.fullmatch(t.strip().lower())), None), m) for _, t, m in row]
            header = [(r, m) for r, m in known if r] if sum(r is not None for r, _ in known) >= 2 else None
            continue
        item: dict = {}
        for _, t, m in row:
            name = min(header, key=lambda h: abs(h[1] - m))[0]
            item[name] = f"{item[name]} {t}" if name in item else t
        if any(_DIGIT.search(item.get(k, "")) for k in ("quantity", "unit_price", "total_price")):
            out.append(item)
        elif out and item.get("description"):
            out[-1]["description"] = f"{out[-1].get('description', '')} {item['description']}".strip()
    return out


_FIELDS = ["reference", "description", "quantity", "unit_price", "total_price"]


def _role(text: str) -> int:
    """The place in ROLES of what a column's name stands for, else -1."""
    return next((k for k, (_, p) in enumerate(_ROLES) if p.fullmatch(text.strip().lower())), -1)


def batch_items(page: np.ndarray, text: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, height: np.ndarray) -> tuple[list[int], list[int], list[list]]:
    """page_items() of many pages at once: (page, item, a list a field) of their items, in order. The arrays are blocks; page numbers pages from 0, height is by page."""
    n, at = len(height), np.lexsort((y1, page))
    of, top = page[at], y1[at]
    first = np.ones(len(at), bool)  # in its row: of its page, or too far below. A row's last top is its greatest, so its median is never nearer
    first[1:] = (of[1:] != of[:-1]) | (top[1:] - top[:-1] > np.maximum(6.0, height[of[1:]] / 40))
    row = np.empty(len(at), np.int64)
    row[at] = np.cumsum(first) - 1
    at = np.lexsort((x1, row))
    page, text, row, middle = page[at], text[at], row[at], (x1[at] + x2[at]) / 2
    rows = int(row[-1]) + 1 if len(row) else 0
    begins, page_of = np.searchsorted(row, np.arange(rows + 1)), np.zeros(rows, np.int64)
    page_of[row] = page
    # a page's header is its first row with two known names: row by row of the pages that have none yet
    known: dict[str, int] = {}
    header, ends, row_of = np.full(n, rows, np.int64), np.searchsorted(page_of, np.arange(n), "right"), np.searchsorted(page_of, np.arange(n))
    names, asked = [[] for _ in range(n)], np.flatnonzero(row_of < ends)
    while len(asked):
        for p in asked.tolist():
            found = []
            for k in range(begins[row_of[p]], begins[row_of[p] + 1]):
                t = text[k]
                role = known[t] if t in known else known.setdefault(t, _role(t))
                if role >= 0:
                    found.append((role, middle[k]))
            if len(found) >= 2:
                names[p], header[p] = found, row_of[p]
        asked = asked[header[asked] == rows]
        row_of[asked] += 1
        asked = asked[row_of[asked] < ends[asked]]
    # each block below goes to the nearest name of its page, of equals to the left one
    start = np.concatenate([[0], np.cumsum([len(x) for x in names], dtype=np.int64)]).astype(np.int64)
    wide, centre = np.array([r for x in names for r, _ in x], np.int64), np.array([m for x in names for _, m in x], float)
    below = np.flatnonzero(row > header[page])
    best, name = np.full(len(below), np.inf), np.zeros(len(below), np.int64)
    for k in range(max(map(len, names), default=0)):
        j = start[page[below]] + k
        inside = j < start[page[below] + 1]
        j = np.where(inside, j, 0)
        away = np.where(inside, np.abs(centre[j] - middle[below]), np.inf)
        name, best = np.where(away < best, wide[j], name), np.minimum(away, best)
    pages, numbers, out, last = [], [], [[] for _ in _FIELDS], -1
    places, digit = [list(ROLES).index(f) for f in _FIELDS], _DIGIT.search
    item: list = [None] * len(ROLES)

    def ended() -> None:
        p = int(page_of[last])
        own = [item[k] for k in places]
        if any(x and digit(x) for x in own[2:]):
            numbers.append(numbers[-1] + 1 if pages and pages[-1] == p else 0)
            pages.append(p)
            for to, x in zip(out, own, strict=True):
                to.append(x)
        elif pages and pages[-1] == p and own[1]:
            out[1][-1] = f"{out[1][-1] or ''} {own[1]}".strip()

    for r, f, t in zip(row[below].tolist(), name.tolist(), text[below].tolist(), strict=True):
        if r != last:
            if last >= 0:
                ended()
            item, last = [None] * len(ROLES), r
        item[f] = t if item[f] is None else f"{item[f]} {t}"
    if last >= 0:
        ended()
    return pages, numbers, out


def items_of_pieces(pieces: DataFrame) -> DataFrame:
    """items_of_pages() of pages in pieces (page, height, blocks: array of (text, x1, y1, x2, y2)), a page's pieces being next to each other in one partition.

    Python holds a batch of pieces, and the page that goes on in the next batch.
    """

    def read(b: pa.RecordBatch, begins: np.ndarray) -> pa.RecordBatch:
        blocks, sizes = b.column(2).flatten(), b.column(2).value_lengths().to_numpy()
        number = lambda k: blocks.field(k).cast(pa.float64()).to_numpy(zero_copy_only=False)
        page = np.repeat(np.cumsum(begins) - 1, sizes)
        at, item, fields = batch_items(page, blocks.field(0).to_numpy(zero_copy_only=False), number(1), number(2), number(3), b.column(1).cast(pa.float64()).to_numpy(zero_copy_only=False)[begins])
        key = b.column(0).take(pa.array(np.flatnonzero(begins)[at], pa.int64()))
        return pa.RecordBatch.from_arrays([key, pa.array(item, pa.int64()), *[pa.array(x, pa.string()) for x in fields]], ["page", "item", *_FIELDS])

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            b = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            begins = _begins(b.column(0))
            cut = int(np.flatnonzero(begins)[-1])
            held = b.slice(cut)
            if cut:
                yield read(b.slice(0, cut), begins[:cut])
        if held is not None:
            yield read(held, _begins(held.column(0)))

    raw = pieces.select("page", "height", "blocks").mapInArrow(run, "page long, item long, " + ", ".join(f"{x} string" for x in _FIELDS))
    return raw.select("page", "item", "reference", "description", T.quantity(F.col("quantity")).alias("quantity"), T.money(F.col("unit_price")).alias("unit_price"), T.money(F.col("total_price")).alias("total_price"))


def _begins(keys: pa.Array) -> np.ndarray:
    """Whether each key differs from the one before; nulls are equal."""
    v, null = keys.fill_null(0).to_numpy(zero_copy_only=False), keys.is_null().to_numpy(zero_copy_only=False)
    return np.concatenate([[True], (v[1:] != v[:-1]) | (null[1:] != null[:-1])])


def items_of_pages(blocks: DataFrame) -> DataFrame:
    """(page, item, reference, description, quantity, unit_price, total_price) of pages of blocks (page, height, text, x1, y1, x2, y2).

    Numbers are read in Spanish form; what can't be read is null. Blocks without a text are left out.
    """
    one = F.array(F.struct("text", "x1", "y1", "x2", "y2")).alias("blocks")
    return items_of_pieces(blocks.filter("text IS NOT NULL").select("page", "height", one).repartition("page").sortWithinPartitions("page"))


@query(f"""
WITH {LINES_SQL} SELECT parent_id AS page, (row_number() OVER (PARTITION BY parent_id ORDER BY line, reference, total, quantity) - 1)::BIGINT AS item, reference, description, quantity, unit_price, total AS total_price FROM lines
""")
def page_table_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines laid out as a page's blocks, and read from their boxes."""
    k = F.row_number().over(W.partitionBy("parent_id").orderBy("line", "reference", "total", "quantity"))
    number = lambda c: spanish(F.round(F.col(c) * 100).cast("long"))
    block = lambda t, x, y, wide: F.struct(t.alias("text"), F.lit(float(x)).alias("x1"), y.alias("y1"), F.lit(float(x + wide)).alias("x2"), (y + 8.0).alias("y2"))
    y = 100.0 + 20.0 * F.col("k")
    one = F.array(block(F.col("reference"), 10, y, 60), block(F.split_part("description", F.lit(" "), F.lit(1)), 100, y + 1.0, 80), block(F.col("quantity").cast("int").cast("string"), 320, y, 20), block(number("unit_price"), 400, y + 2.0, 50), block(number("total"), 500, y, 50), block(F.regexp_replace("description", r"^\S+ ?", ""), 100, y + 9.0, 90))
    names = F.array(*[block(F.lit(t), x, F.lit(100.0), w) for t, x, w in (("Ref", 10, 40), ("Descripcion", 100, 90), ("Cantidad", 310, 40), ("Precio unidad", 400, 60), ("Total", 510, 30))])
    rows = lines(spark, sf_dir).withColumn("k", k).select(F.col("parent_id").alias("page"), F.lit(200.0).alias("height"), "k", F.filter(one, lambda b: b["text"] != "").alias("blocks"))
    return items_of_pieces(rows.withColumn("blocks", F.when(F.col("k") == 1, F.concat(names, "blocks")).otherwise(F.col("blocks"))).sortWithinPartitions("page", "k"))


def reading_order(blocks: list[tuple[str, float, float, float, float]], width: float) -> tuple[list[str], int]:
    """(texts in reading order, number of columns) of a page: two columns if the middle three fifths have an empty strip, then left before right; else top to bottom."""
    down = sorted(blocks, key=lambda b: (b[2], b[1]))
    gap = vertical_gap(blocks, width)
    if gap is None:
        return [b[0] for b in down], 1
    return [b[0] for b in down if b[3] <= gap] + [b[0] for b in down if b[3] > gap], 2


def vertical_gap(blocks: list[tuple[str, float, float, float, float]], width: float, bins: int = 20) -> float | None:
    """Where the longest run of empty bins in the middle three fifths of a page lies, if it has blocks on both sides; None without one."""
    full = [False] * bins
    for _, a, _, b, _ in blocks:
        for k in range(max(0, int(a / width * bins)), min(bins - 1, int((b - 1e-9) / width * bins)) + 1):
            full[k] = True
    best, begin = (0, 0), None
    for k in range(bins // 5, bins - bins // 5 + 1):
        empty = k < bins - bins // 5 and not full[k]
        if empty and begin is None:
            begin = k
        if not empty and begin is not None:
            best, begin = max(best, (k - begin, -begin)), None
    if not best[0]:
        return None
    middle = (-best[1] + best[0] / 2) * width / bins
    return middle if any(b[3] <= middle for b in blocks) and any(b[1] >= middle for b in blocks) else None


@query("SELECT c_custkey AS page, c_name || ' izquierda ' || c_mktsegment || ' derecha' AS text, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS n_columns FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_name || ' ' || c_mktsegment || ' izquierda derecha', 1 FROM customer WHERE c_custkey % 2 = 1")
def page_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of four blocks, of two columns or of one, read in order."""
    right = F.when(F.col("c_custkey") % 2 == 0, 60.0).otherwise(40.0)
    block = lambda t, x, y: F.struct(t.alias("text"), x.alias("x1"), F.lit(y).alias("y1"), (x + 38.0).alias("x2"), F.lit(y + 5.0).alias("y2"))
    zero = F.when(F.col("c_custkey") % 2 == 0, 0.0).otherwise(5.0)
    four = F.array(block(F.col("c_mktsegment"), right, 10.0), block(F.lit("derecha"), right, 20.0), block(F.col("c_name"), zero, 10.0), block(F.lit("izquierda"), zero, 20.0))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page"), F.explode(four).alias("b")).select("page", "b.*")

    return read_pages(b.withColumn("width", F.lit(100.0)))


def read_pages(blocks: DataFrame) -> DataFrame:
    """(page, text, n_columns) of pages of blocks (page, width, text, x1, y1, x2, y2), the blocks' texts in reading order. A page's blocks are as many as fit on paper."""

    def run(frames):
        for f in frames:
            rows = []
            for page, width, own in zip(f["page"], f["width"], f["blocks"], strict=True):
                t, n = reading_order([tuple(b.values()) for b in own], width)
                rows.append((page, " ".join(t), n))
            yield pd.DataFrame(rows, columns=["page", "text", "n_columns"])

    pages = blocks.groupBy("page").agg(F.first("width").alias("width"), F.collect_list(F.struct("text", "x1", "y1", "x2", "y2")).alias("blocks"))
    return pages.mapInPandas(run, "page long, text string, n_columns long")


def without_repeats(text: str | None, least: int = 8000, period: int = 200, chars: int = 100, times: int = 5) -> str | None:
    """A text of least characters or more whose end is one piece of up to period characters, times or more in a row and chars long in all, with that piece once."""
    if text is None or len(text) < least:
        return text
    for p in range(1, period + 1):
        unit, n = text[-p:], 1
        while text[-p * (n + 1) : -p * n] == unit:
            n += 1
        if n >= times and n * p >= chars:
            return text[: len(text) - p * (n - 1)]
    return text


@F.pandas_udf(StringType())
def collapse_tail(s: pd.Series) -> pd.Series:
    """without_repeats() of a column. Python: no pattern matches a piece of any length at the end in linear time."""
    return s.map(without_repeats)


@query()
def repeated_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of which the long even ones have got an end that repeats itself forty times, which goes but for once; so do ends that repeat themselves anyway, so SQL has no form of it, and a test has cases by hand."""
    long = (F.col("doc_id") % 2 == 0) & (F.length("text") >= 7700)
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.when(long, F.concat("text", F.repeat(F.lit("abc xyz "), F.lit(40)))).otherwise(F.col("text")).alias("text"))
    return d.select("doc_id", F.md5(collapse_tail("text")).alias("text_md5"))


@query("SELECT sheet, count(*) AS n, string_agg(line, chr(10) ORDER BY k) AS markdown FROM (SELECT r_name AS sheet, 0 AS k, '| n_nationkey | n_name |' AS line FROM region UNION ALL SELECT r_name, 1, '| --- | --- |' FROM region UNION ALL SELECT r_name, 2 + n_nationkey, '| ' || n_nationkey || ' | ' || replace(n_name, '|', '\\|') || ' |' FROM nation JOIN region ON r_regionkey = n_regionkey) GROUP BY 1")
def sheets_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables as Markdown, one of each region's nations (which are few): a header, a rule, and rows with their pipes escaped."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return as_markdown(n.select(F.col("r_name").alias("sheet"), "n_nationkey", "n_name"), "sheet", ["n_nationkey", "n_name"])


def as_markdown(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, n, markdown): each key's rows as a Markdown table, in the order of the columns; n counts its lines. A null is an empty cell."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))
    body = F.transform(F.array_sort(F.collect_list(F.struct(*columns, row.alias("_row")))), lambda r: r["_row"])
    head = [F.lit("| " + " | ".join(columns) + " |"), F.lit("|" + " --- |" * len(columns))]
    return df.groupBy(key).agg((count() + 2).alias("n"), F.array_join(F.concat(F.array(*head), body), "\n").alias("markdown"))
