"""Claims, numbered paragraphs and cover data of patent texts, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import trimmed

#: Headings that open the claims, and headings that end them.
CLAIM_HEADINGS = (
    r"(?mi)^#{1,3}\s*claims\s*$",
    r"(?mi)^claims\s*$",
    r"(?mi)^what\s+is\s+claimed\s+is\s*:?\s*$",
    r"(?mi)^what\s+is\s+claimed\s*:?\s*$",
    r"(?mi)^the\s+claims?\s*:?\s*$",
)
END_HEADINGS = (
    r"(?mi)^#{1,3}\s*abstract\s*$",
    r"(?mi)^abstract\s*$",
    r"(?mi)^#{1,3}\s*description\s*$",
    r"(?mi)^#{1,3}\s*(?:brief\s+)?description\s+of\s+(?:the\s+)?drawings?\s*$",
    r"(?mi)^#{1,3}\s*drawings?\s*$",
    r"(?mi)^#{1,3}\s*figures?\s*$",
    r"(?mi)^#{1,3}\s*(?:detailed\s+)?description\s*$",
)
#: Forms of dates, the first that occurs wins.
_MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
DATES = (
    r"\d{4}-\d{2}-\d{2}",
    r"\d{1,2}\.\d{2}\.\d{4}",
    r"\d{4}\.\d{2}\.\d{2}",
    r"\d{1,2}/\d{2}/\d{4}",
    rf"\d{{1,2}}\s+{_MONTH}\s+\d{{4}}",
    rf"{_MONTH}\s+\d{{1,2}},?\s+\d{{4}}",
)
#: Labels that stand before a field's value.
LABELS = (
    "International Filing Date", "International Publication Date", "Publication Date", "Filing Date", "Applicant", "Applicants", "Inventor",
    "Inventors", "Title", "Designated States",
)
#: A first claim, a field's value after its code, an application number, and a class.
FIRST_CLAIM = r"(?m)(?:^|\n\n)1\.\s+(?:A\s|An\s|The\s)"
FIELD = r"\(\s*%s\s*\)\s*[:\-]?\s*([^\n\(]{2,120})"
APPLICATION_NUMBER = r"((?i)(?:PCT/[A-Z]{2}\d{4}/\d{4,6}|WO\s*\d{4}/\d{4,6}))"
CLASS = r"([A-H]\d{2}[A-Z]\s*\d{1,4}/\d{2,4})"
#: A label is a whole word at the start of a value, and goes with the marks around it.
LABEL = r"(?i)\A(?:" + "|".join(LABELS) + r")(?![\p{L}\p{N}])"
AROUND = r"\A[\s\p{Z}:;]+|[\s\p{Z}:;]+\z"


def _first_place(text: Column, patterns: tuple[str, ...], after: int = 0) -> Column:
    """The least place (from 1) of any pattern's first match that is past ``after``; null if there is none."""
    places = [F.regexp_instr(text, F.lit(p)) for p in patterns]
    return F.least(*[F.when(p > after, p) for p in places])


def claims_of(text: Column) -> Column:
    """The claims section, from its heading or its first claim to the next section; '' if there is none."""
    heading = _first_place(text, CLAIM_HEADINGS)
    numbered = F.regexp_instr(text, F.lit(FIRST_CLAIM))
    blank = F.when(F.substr(text, numbered, F.lit(2)) == "\n\n", numbered + 2).otherwise(numbered)
    start = F.coalesce(heading, F.when(numbered > 0, blank))
    tail = F.substr(text, start)
    end = _first_place(tail, END_HEADINGS, after=1)
    return F.coalesce(trimmed(F.when(end.isNull(), tail).otherwise(F.substr(tail, F.lit(1), end - 1))), F.lit(""))


def paragraphs_of(text: Column) -> Column:
    """(para_id, text) structs: what follows each [dddd] up to the next one, empty ones left out."""
    parts = F.split(F.concat(F.lit("\u0001"), text), r"(?=\[\d{4}\])", -1)
    parts = F.filter(parts, lambda p: ~F.startswith(p, F.lit("\u0001")))
    found = F.transform(parts, lambda p: F.struct(F.substr(p, F.lit(2), F.lit(4)).alias("para_id"), trimmed(F.substr(p, F.lit(7))).alias("text")))
    return F.filter(found, lambda p: p["text"] != "")


def paragraph_rows(pages: DataFrame, doc_col: str = "doc_id", page_col: str = "page", text_col: str = "text") -> DataFrame:
    """One row for each paragraph: doc, page, para_id, text. A paragraph never goes on to the next page."""
    rows = pages.select(pages[doc_col], pages[page_col], F.explode(paragraphs_of(pages[text_col])).alias("p"))
    return rows.select(doc_col, page_col, "p.para_id", F.col("p.text").alias("text"))


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def date_in(text: Column) -> Column:
    """The first date by the order of DATES; null if there is none."""
    return F.coalesce(*[_found(text, f"({p})", 1) for p in DATES])


def field_of(cover: Column, code: str, date: bool = False) -> Column:
    """The value after the field code, such as (54), without its label; null if there is none."""
    value = F.nullif(trimmed(F.regexp_extract(cover, FIELD % code, 1)), F.lit(""))
    if date:
        return F.coalesce(date_in(value), value)
    bare = F.regexp_replace(F.regexp_replace(value, LABEL, ""), AROUND, "")
    return F.when(F.rlike(value, F.lit(LABEL)) & (bare != ""), bare).otherwise(value)


def inventors_of(value: Column) -> Column:
    """Names parted by semicolons, else by lines, else one name."""

    def parts(by: str, longer: int) -> Column:
        return F.filter(F.transform(F.split(value, by, -1), trimmed), lambda x: F.length(x) > longer)

    names, lines = parts(";", 0), parts("\n", 2)
    one = F.when(trimmed(value) == "", F.array().cast("array<string>")).otherwise(F.array(trimmed(value)))
    return F.when(value.isNotNull(), F.when(F.size(names) > 1, names).when(F.size(lines) > 1, lines).otherwise(one))


def classes_of(value: Column) -> Column:
    """Classification codes in order without repeats, else the whole value."""
    codes = F.array_distinct(F.regexp_extract_all(value, F.lit(CLASS), F.lit(1)))
    whole = F.when(trimmed(value) == "", F.array().cast("array<string>")).otherwise(F.array(trimmed(value)))
    return F.when(value.isNotNull(), F.when(F.size(codes) > 0, codes).otherwise(whole))


def cover_of(cover: Column) -> Column:
    """A struct of the nine cover fields; those that aren't found are null."""
    return F.struct(
        _found(cover, APPLICATION_NUMBER, 1).alias("application_number"),
        field_of(cover, "22", date=True).alias("filing_date"),
        field_of(cover, "43", date=True).alias("publication_date"),
        field_of(cover, "71").alias("applicant"),
        inventors_of(field_of(cover, "72")).alias("inventors"),
        field_of(cover, "54").alias("title"),
        classes_of(field_of(cover, "51")).alias("classification"),
        F.coalesce(field_of(cover, "32", date=True), field_of(cover, "30", date=True)).alias("priority_date"),
        field_of(cover, "81").alias("designated_states"),
    )


def cover_rows(pages: DataFrame, doc_col: str = "doc_id", page_col: str = "page", text_col: str = "text", first_pages: int = 2) -> DataFrame:
    """One row for each document: doc and the cover fields, read from its first pages."""
    from pyspark.sql.window import Window

    ranked = pages.withColumn("__rank", F.row_number().over(Window.partitionBy(doc_col).orderBy(page_col, text_col)))
    held = ranked.filter(F.col("__rank") <= first_pages).groupBy(doc_col).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__rank", F.col(text_col).alias("t")))), lambda x: x["t"]), "\n").alias("cover")
    )
    return held.select(doc_col, cover_of(F.col("cover")).alias("m")).select(doc_col, "m.*")
