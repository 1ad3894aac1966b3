"""Layout of recognised text blocks: columns, lines, tables, pages.

Blocks are rows (doc_id, page, idx, text, confidence, x, y, w, h) with boxes from 0 to 1, the origin at the bottom
left. A page is small, so what depends on order within a page works on the page's array of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..formats.grid import table

PAGE = ["doc_id", "page"]
COLUMN_GAP, MOST_COLUMNS, LARGEST_SHARE, LINE_TOLERANCE = 0.15, 4, 0.80, 0.008
ROW_TOLERANCE, CENTRE_TOLERANCE, LEAST_BLOCKS, LEAST_ROWS = 0.012, 0.04, 6, 3
COLUMN_BREAK = "\n\n---\n\n"


def with_centres(blocks: DataFrame) -> DataFrame:
    """Blocks with text, and their middles."""
    middles = {"mx": F.col("x") + F.col("w") / 2, "my": F.col("y") + F.col("h") / 2}
    return blocks.filter("text IS NOT NULL").withColumns(middles)


def with_columns(blocks: DataFrame, forced: Column | None = None) -> DataFrame:
    """Blocks with ``col``: a column starts where the gap to the block before, from left to right, is wide.

    Pages with too many columns, or with most blocks in one, are one column, unless ``forced``.
    """
    across = Window.partitionBy(*PAGE).orderBy("mx", "idx")
    whole = Window.partitionBy(*PAGE)
    gap = F.col("mx") - F.lag("mx").over(across)
    out = with_centres(blocks).withColumn("starts", F.when(gap > COLUMN_GAP, 1).otherwise(0))
    out = out.withColumn("col", F.sum("starts").over(across.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("in_col", F.count("*").over(Window.partitionBy(*PAGE, "col")))
    odd = (F.max("col").over(whole) + 1 > MOST_COLUMNS) | (F.max("in_col").over(whole) / F.count("*").over(whole) > LARGEST_SHARE)
    one = odd & ~(F.lit(False) if forced is None else forced)
    return out.withColumn("col", F.when(one, F.lit(0)).otherwise(F.col("col")).cast("int")).drop("starts", "in_col")


def _folded(blocks: Column, tolerance: float) -> Column:
    """Blocks in order from the top as lines: a block joins while it is near the line's first block."""
    kind = "struct<y:double,lines:array<array<struct<my:double,mx:double,idx:int,text:string>>>>"
    start = F.lit(None).cast(kind)

    def step(held: Column, b: Column) -> Column:
        fresh = F.struct(b["my"].alias("y"), F.concat(F.coalesce(held["lines"], F.array().cast(kind[kind.index("array") : -1])), F.array(F.array(b))).alias("lines"))
        n = F.size(held["lines"])
        last = F.concat(F.element_at(held["lines"], -1), F.array(b))
        joined = F.struct(held["y"].alias("y"), F.concat(F.slice(held["lines"], 1, n - 1), F.array(last)).alias("lines"))
        near = held.isNotNull() & (F.abs(held["y"] - b["my"]) <= tolerance)
        return F.when(near, joined).otherwise(fresh).cast(kind)

    return F.aggregate(blocks, start, step)["lines"]


def lines_of(blocks: DataFrame, by: list[str]) -> DataFrame:
    """(by, line, mean_y, text): the lines of each group, from the top, words from the left.

    ``blocks`` have mx, my, idx and text.
    """
    held = F.collect_list(F.struct("my", "mx", F.col("idx").cast("int").alias("idx"), "text"))
    down = F.array_sort(held, lambda a, b: F.when(a["my"] != b["my"], F.when(a["my"] > b["my"], -1).otherwise(1)).otherwise(F.signum(a["idx"] - b["idx"]).cast("int")))
    grouped = blocks.groupBy(*by).agg(down.alias("blocks"))
    lines = grouped.select(*by, F.explode(_folded(F.col("blocks"), LINE_TOLERANCE)).alias("line"))
    mean = F.aggregate("line", F.lit(0.0), lambda a, b: a + b["my"]) / F.size("line")
    words = F.array_sort("line", lambda a, b: F.when(a["mx"] != b["mx"], F.when(a["mx"] < b["mx"], -1).otherwise(1)).otherwise(F.signum(a["idx"] - b["idx"]).cast("int")))
    text = F.array_join(F.transform(words, lambda b: b["text"]), " ")
    first = F.array_min(F.transform("line", lambda b: b["idx"]))
    out = lines.select(*by, mean.alias("mean_y"), text.alias("text"), first.alias("first_idx"))
    order = Window.partitionBy(*by).orderBy(F.desc("mean_y"), "first_idx")
    return out.select(*by, F.row_number().over(order).alias("line"), "mean_y", "text")


def _in_order(rows: DataFrame, by: list[str], order: list, text: str, between: str, name: str) -> DataFrame:
    held = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("t")))).alias("held"))
    return held.select(*by, F.array_join(F.transform("held", lambda x: x["t"]), between).alias(name))


def flow_text(blocks: DataFrame, forced: Column | None = None) -> DataFrame:
    """(doc_id, page, text): each page's blocks in reading order, column by column."""
    columns = with_columns(blocks, forced)
    places = columns.groupBy(*PAGE, "col").agg(F.avg("mx").alias("mean_x"))
    texts = _in_order(lines_of(columns, [*PAGE, "col"]), [*PAGE, "col"], ["line"], "text", "\n", "text")
    return _in_order(texts.join(places, [*PAGE, "col"]), PAGE, ["mean_x", "col"], "text", COLUMN_BREAK, "text")


def simple_text(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, text): blocks from the top, each a line of its own; those of one line go from the left."""
    centred = with_centres(blocks).withColumn("my", F.col("y")).withColumn("mx", F.col("x"))
    held = F.collect_list(F.struct("my", "mx", F.col("idx").cast("int").alias("idx"), "text"))
    down = F.array_sort(held, lambda a, b: F.when(a["my"] != b["my"], F.when(a["my"] > b["my"], -1).otherwise(1)).otherwise(F.signum(a["idx"] - b["idx"]).cast("int")))
    grouped = centred.groupBy(*PAGE).agg(down.alias("blocks"))
    line = F.transform(_folded(F.col("blocks"), LINE_TOLERANCE), lambda bs: F.array_join(
        F.transform(F.array_sort(F.transform(bs, lambda b: F.struct(b["mx"], b["idx"], b["text"]))), lambda b: b["text"]), "\n"))
    return grouped.select(*PAGE, F.array_join(line, "\n").alias("text"))


def tables_on_page(blocks: list[tuple[int, float, float, float, str]]) -> list[tuple[list[int], str, float]]:
    """(indices, Markdown, top) of each table among a page's (idx, mid x, mid y, top, text) blocks.

    A table is three neighbouring rows or more with as many blocks, at least two, whose middles lie under those of the
    first row.
    """
    held = sorted((b for b in blocks if b[4] and b[4].strip()), key=lambda b: (-b[2], b[0]))
    if len(held) < LEAST_BLOCKS:
        return []
    rows: list[list[tuple]] = []
    for b in held:
        if rows and abs(rows[-1][0][2] - b[2]) < ROW_TOLERANCE:
            rows[-1].append(b)
        else:
            rows.append([b])
    tops = [row[0][3] for row in rows]
    rows = [sorted(row, key=lambda b: (b[1], b[0])) for row in rows]
    out, k = [], 0
    while k < len(rows):
        first, end = rows[k], k + 1
        while end < len(rows) and len(first) >= 2 and len(rows[end]) == len(first):
            if any(abs(a[1] - b[1]) > CENTRE_TOLERANCE for a, b in zip(first, rows[end], strict=True)):
                break
            end += 1
        if end - k >= LEAST_ROWS:
            cells = [[b[4].replace("\n", " ").strip() for b in row] for row in rows[k:end]]
            out.append(([b[0] for row in rows[k:end] for b in row], table(cells), tops[k]))
            k = end
        else:
            k += 1
    return out


_TABLES = "doc_id long, page int, table_no int, indices array<int>, markdown string, top double"


def _page_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, page, blocks) to the tables of each page."""
    types = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.string(), pa.float64())
    names = [c.split()[0] for c in _TABLES.split(", ")]
    for batch in batches:
        rows = []
        for doc, page, blocks in zip(*(batch.column(k) for k in range(3)), strict=True):
            held = [(b["idx"], b["mx"], b["my"], b["top"], b["text"]) for b in blocks.as_py()]
            rows += [(doc.as_py(), page.as_py(), k, *found) for k, found in enumerate(tables_on_page(held), 1)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def detect_tables(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, table_no, indices, markdown, top): the tables of each page. Pages of too few blocks aren't looked at."""
    rows = with_centres(blocks).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("int").alias("page"),
        F.struct(F.col("idx").cast("int").alias("idx"), "mx", "my", (F.col("y") + F.col("h")).alias("top"), "text").alias("block"),
    )
    pages = rows.groupBy(*PAGE).agg(F.collect_list("block").alias("blocks")).filter(F.size("blocks") >= LEAST_BLOCKS)
    return pages.mapInArrow(_page_tables, _TABLES)


def outside_tables(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """The blocks that are in no table."""
    inside = tables.select(*PAGE, F.explode("indices").alias("idx"))
    return blocks.join(inside, [*PAGE, "idx"], "left_anti")


def page_text(blocks: DataFrame, image: bool = False, forced_first: bool = True) -> DataFrame:
    """(doc_id, page, text): the text outside tables, then the tables. The first page's columns are forced."""
    tables = detect_tables(blocks)
    rest = outside_tables(blocks, tables)
    flow = simple_text(rest) if image else flow_text(rest, (F.col("page") == 1) if forced_first else None)
    added = _in_order(tables, PAGE, ["table_no"], "markdown", "\n\n", "tables")
    pages = blocks.select(*PAGE).distinct().join(flow, PAGE, "left").join(added, PAGE, "left")
    tail = F.coalesce(F.concat(F.lit("\n\n"), "tables"), F.lit(""))
    return pages.select(*PAGE, F.concat(F.coalesce("text", F.lit("")), tail).alias("text"))


def assembled(pages: DataFrame) -> DataFrame:
    """(doc_id, markdown): pages with text as sections, in order."""
    shown = pages.filter(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    section = F.concat(F.lit("## Page "), F.col("page").cast("string"), F.lit("\n\n"), "text", F.lit("\n\n"))
    whole = _in_order(shown.withColumn("section", section), ["doc_id"], ["page"], "section", "", "markdown")
    return whole.select("doc_id", F.concat(F.regexp_replace("markdown", r"\A\s+|\s+\z", ""), F.lit("\n")).alias("markdown"))
