"""Documents from their parts as rows: styled runs, list items, book chapters, notebook cells, pages, mail headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tables import dense_row
from ..functions.text import collapse_blank_lines, safe_file_name, trimmed


def joined(rows: DataFrame, by: list[str], order: list, text: Column, between: str, name: str) -> DataFrame:
    """(by, name): texts of each group in order, with ``between`` between them."""
    held = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, text.alias("joined_text")))).alias("held"))
    return held.select(*by, F.array_join(F.transform("held", lambda x: x["joined_text"]), between).alias(name))


def dense_sheets(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, rows): cells (by, row, col, value) as rows of equal length, gaps filled with ''; empty rows at the end go.

    Cells meet by row, then rows by sheet, so the work grows with the sheet's area.
    """
    filled = F.coalesce("value", F.lit("")) != ""
    extent = cells.groupBy(*by).agg(F.max(F.when(filled, F.col("row"))).alias("last"), (F.max("col") + 1).alias("columns"))
    frame = extent.filter("last IS NOT NULL").select(*by, "columns", F.explode(F.sequence(F.lit(0), F.col("last").cast("int"))).alias("row"))
    held = cells.groupBy(*by, F.col("row").cast("int").alias("row")).agg(F.collect_list(F.struct("col", "value")).alias("cells"))
    lines = frame.join(held, [*by, "row"], "left").withColumn("line", dense_row(F.col("cells"), F.col("columns")))
    whole = lines.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("row", "line"))).alias("held"))
    return whole.select(*by, F.transform("held", lambda x: x["line"]).alias("rows"))


def list_markers(items: DataFrame, by: list[str], order: list, ordered: Column, level: Column, start: Column | None = None) -> DataFrame:
    """``items`` with ``marker``: an indent, then a bullet or a running number within ``by``."""
    running = F.count("*").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    number = running if start is None else running + start - 1
    sign = F.when(ordered, F.concat(number.cast("string"), F.lit(". "))).otherwise(F.lit("- "))
    return items.withColumn("marker", F.concat(F.repeat(F.lit("  "), level), sign))


def styled_to_markdown(runs: DataFrame) -> DataFrame:
    """(doc_id, markdown) from runs (doc_id, para, pos, text, font_size, bold, italic, link).

    The body's size is that of most characters. A paragraph that is all bold, of one size and clearly larger is a heading.
    """
    sizes = runs.groupBy("doc_id", "font_size").agg(F.sum(F.length("text")).alias("n"))
    body = sizes.groupBy("doc_id").agg(F.max_by("font_size", F.struct("n", -F.col("font_size"))).alias("body"))
    kind = F.concat(F.when(F.col("bold"), F.lit("**")).otherwise(F.lit("")), F.when(F.col("italic"), F.lit("*")).otherwise(F.lit("")))
    linked = F.coalesce(F.col("link"), F.lit("")) != ""
    whole = runs.withColumn("kind", kind).withColumn("linked", linked)
    held = whole.groupBy("doc_id", "para").agg(
        F.array_sort(F.collect_list(F.struct("pos", "text", "kind", "linked", "link"))).alias("runs"),
        F.min("font_size").alias("low"), F.max("font_size").alias("high"), F.bool_and("bold").alias("all_bold"),
    )
    held = held.join(body, "doc_id").withColumn("plain", F.array_join(F.transform("runs", lambda r: r["text"]), ""))
    ratio = F.col("high") / F.col("body")
    heading = F.when(F.col("all_bold") & (F.col("high") > F.col("body") * 1.1) & (F.col("high") - F.col("low") < 2),
        F.when(ratio >= 1.8, F.lit("# ")).when(ratio >= 1.4, F.lit("## ")).otherwise(F.lit("### "))).otherwise(F.lit(""))
    bullet = F.regexp_extract("plain", r"^[ \t]*(?:•[ \t]*|- )", 0)
    number = F.regexp_extract("plain", r"^[ \t]*(\d+)[.)]\s+", 1)
    skip = F.when(bullet != "", F.length(bullet)).otherwise(F.length(F.regexp_extract("plain", r"^[ \t]*\d+[.)]\s+", 0)))
    marker = F.when(bullet != "", F.lit("- ")).when(number != "", F.concat(number, F.lit(". "))).otherwise(F.lit(""))
    held = held.withColumns({"skip": skip, "lead": F.concat(heading, marker)})

    def shown(done: Column, r: Column) -> Column:
        left = F.greatest(F.col("skip") - done["seen"], F.lit(0))
        text = F.substr(r["text"], left + 1)
        mark = F.when(F.trim(text) == "", F.lit("")).otherwise(r["kind"])
        closing = F.reverse(mark)
        dressed = F.when(r["linked"], F.concat(F.lit("["), text, F.lit("]("), r["link"], F.lit(")"))).otherwise(F.concat(mark, text, closing))
        return F.struct((done["seen"] + F.length(r["text"])).alias("seen"), F.concat(done["out"], F.when(text == "", F.lit("")).otherwise(dressed)).alias("out"))

    start = F.struct(F.lit(0).alias("seen"), F.lit("").alias("out"))
    line = F.concat("lead", F.aggregate("runs", start, shown)["out"], F.lit("\n\n"))
    text = joined(held, ["doc_id"], ["para"], line, "", "markdown")
    return text.select("doc_id", F.concat(trimmed(collapse_blank_lines(F.col("markdown"))), F.lit("\n")).alias("markdown"))


def combine_chapters(spine: DataFrame, manifest: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, markdown) from spine (book_id, pos, item_id, linear), manifest (book_id, item_id, title, markdown) and
    books (book_id, title, authors array, language). Spine items that aren't linear or aren't in the manifest are left out."""
    from ..formats.books import AUTHOR_LABEL, LANGUAGE_LABEL

    chapters = spine.filter("linear IS NULL OR linear <> 'no'").join(manifest, ["book_id", "item_id"])
    text = F.concat(F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit("## "), "title", F.lit("\n\n"))).otherwise(F.lit("")), "markdown")
    text = F.when(F.endswith(text, F.lit("\n")), text).otherwise(F.concat(text, F.lit("\n")))
    body = joined(chapters, ["book_id"], ["pos"], text, "\n---\n\n", "body")
    authors = F.when(F.size("authors") > 0, F.concat(F.lit(AUTHOR_LABEL), F.array_join("authors", ", "), F.lit("\n\n"))).otherwise(F.lit(""))
    language = F.when(F.coalesce("language", F.lit("")) != "", F.concat(F.lit(LANGUAGE_LABEL), "language", F.lit("\n\n"))).otherwise(F.lit(""))
    head = F.concat(F.lit("# "), "title", F.lit("\n\n"), authors, language, F.lit("---\n\n"))
    return books.join(body, "book_id").select("book_id", F.concat(head, "body").alias("markdown"))


def chapter_names(chapters: DataFrame, by: str = "book_id", pos: str = "pos", title: str = "title") -> DataFrame:
    """``chapters`` with the file name of each: its number from 1 with two digits, then its title."""
    k = F.row_number().over(Window.partitionBy(by).orderBy(pos))
    number = F.lpad(k.cast("string"), F.greatest(F.lit(2), F.length(k.cast("string"))), F.lit("0"))
    safe = safe_file_name(F.coalesce(F.col(title), F.concat(F.lit("chapter_"), number)))
    return chapters.withColumn("file_name", F.concat(number, F.lit("_"), safe, F.lit(".md")))


def notebooks_to_markdown(cells: DataFrame, by: str, order: list, kind: Column, source: Column, language: str = "python", title: Column | None = None) -> DataFrame:
    """(by, markdown) from cells as rows; blank cells and unknown kinds are left out."""
    kept = cells.withColumn("cell_kind", kind).withColumn("cell_text", source)
    kept = kept.filter((trimmed(F.col("cell_text")) != "") & F.col("cell_kind").isin("markdown", "code", "raw"))
    text = F.col("cell_text")
    prose = F.when(F.endswith(text, F.lit("\n\n")), text).when(F.endswith(text, F.lit("\n")), F.concat(text, F.lit("\n"))).otherwise(F.concat(text, F.lit("\n\n")))
    code = F.concat(F.lit(f"```{language}\n"), text, F.lit("\n```\n\n"))
    shown = F.when(F.col("cell_kind") == "markdown", prose).when(F.col("cell_kind") == "code", code).otherwise(F.concat(text, F.lit("\n\n")))
    body = joined(kept, [by], order, shown, "", "body")
    head = F.col(by).cast("string") if title is None else title
    return body.select(by, F.concat(F.lit("# "), head, F.lit("\n\n"), "body").alias("markdown"))


def text_layer(pages: DataFrame) -> DataFrame:
    """(doc_id, text) from (doc_id, page, text): pages with text, if a document has any, parted by rules."""
    return joined(pages.filter(trimmed(F.col("text")) != ""), ["doc_id"], ["page"], F.col("text"), "\n\n---\n\n", "text")


def mail_headers(mails: DataFrame, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """``mails`` with ``headers`` (array of name, value structs in order) and ``body``, by expressions alone."""
    text = F.regexp_replace(F.col(content_col), "\r\n", "\n")
    at = F.instr(text, F.lit("\n\n"))
    block = F.when(at > 0, F.substr(text, F.lit(1), at - 1)).otherwise(text)
    body = F.when(at > 0, F.substr(text, at + 2)).otherwise(F.lit(""))
    lines = F.filter(F.split(F.regexp_replace(block, r"\n[ \t]+", " "), "\n", -1), lambda line: F.contains(line, F.lit(":")))
    pairs = F.transform(lines, lambda line: F.struct(
        F.trim(F.substring_index(line, ":", 1)).alias("name"), F.trim(F.substr(line, F.instr(line, F.lit(":")) + 1)).alias("value")))
    return mails.select(id_col, pairs.alias("headers"), body.alias("body"))


def header_value(headers: Column, name: str) -> Column:
    """The first value under ``name``, whatever its case; null without one."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), F.lit(0))["value"]


def header_summary(headers: Column) -> Column:
    subject = header_value(headers, "Subject")
    head = F.when(F.coalesce(subject, F.lit("")) != "", F.concat(F.lit("# "), subject, F.lit("\n\n"))).otherwise(F.lit(""))
    lines = [F.when(F.coalesce(header_value(headers, n), F.lit("")) != "", F.concat(F.lit(f"- **{n}:** "), header_value(headers, n))) for n in ("From", "To", "Cc", "Date")]
    return F.concat(head, F.array_join(F.array(*lines), "\n"))
