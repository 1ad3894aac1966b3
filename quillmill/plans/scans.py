"""Scanned documents: recognised blocks to repaired pages, a Markdown text, and structured outputs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extraction import claims_of, cover_rows, paragraph_rows
from ..functions.hyphens import DEFAULT_RULES, HyphenRules, hyphen_merger
from ..functions.tables import property_table
from ..functions.text import corrected, ended, fix_paragraph_brackets, repaired, trimmed
from ..operators import layout, quality
from ..operators.documents import text_layer
from ..settings import Settings
from ..tables import checkpointed


@dataclass(frozen=True)
class ScanResult:
    """Rows by page and document. Outputs that the preset leaves out are null."""

    pages: DataFrame  # doc_id, page, raw, text
    markdown: DataFrame  # doc_id, markdown
    corrections: DataFrame | None
    report: DataFrame | None
    claims: DataFrame | None
    paragraphs: DataFrame | None
    cover: DataFrame | None


def _repaired(text: Column, settings: Settings, rules: HyphenRules) -> Column:
    """The repairs that the preset's steps ask for."""
    preset = settings.preset
    return repaired(
        text, hyphen_merger(rules), half=settings.half_width and preset.enabled("punctuation_normalize"),
        special=preset.enabled("special_char_normalize"), hyphens=preset.enabled("hyphen_merge"), noise=preset.enabled("noise_removal"),
    )


def repair(pages: DataFrame, settings: Settings, rules: HyphenRules = DEFAULT_RULES, image: bool = False, column: str = "raw") -> DataFrame:
    """``pages`` with ``before`` (repaired) and ``text`` (also corrected), as the preset's steps say."""
    out = pages.withColumn("before", fix_paragraph_brackets(_repaired(F.col(column), settings, rules), image))
    correct = settings.correct and settings.preset.enabled("dictionary_correct")
    return out.withColumn("text", corrected(F.col("before"), settings.corrections) if correct else F.col("before"))


def process_scans(blocks: DataFrame, settings: Settings, vocabulary: DataFrame | None = None, terms: DataFrame | None = None) -> ScanResult:
    """Recognised blocks (doc_id, page, idx, text, confidence, x, y, w, h) through layout, repair and extraction.

    The repaired pages are written once to the session's checkpoint folder; all outputs are derived from them.
    """
    preset = settings.preset
    raw = layout.page_text(blocks, forced_first=preset.enabled("column_reconstruction")).withColumnRenamed("text", "raw")
    raw = raw.filter(trimmed(F.col("raw")) != "")
    pages = checkpointed(repair(raw, settings))
    corrections = quality.corrections_between(pages, "before", "text")
    report = None
    if preset.enabled("quality_report") and vocabulary is not None:
        confidence = quality.page_confidence(blocks, pages)
        report = quality.report(pages, confidence, quality.suspicious_tokens(pages, vocabulary, terms, context=False), corrections)
    whole = layout.assembled(pages)
    structured = preset.enabled("structured_output")
    wants = {n: structured and preset.parameter("structured_output", f"extract_{n}", "true") == "true" for n in ("claims", "metadata")}
    return ScanResult(
        pages.select("doc_id", "page", "raw", "text"), whole, corrections, report,
        whole.select("doc_id", claims_of(F.col("markdown")).alias("claims")) if wants["claims"] else None,
        paragraph_rows(pages) if structured else None, cover_rows(pages) if wants["metadata"] else None,
    )


def process_text_layer(pages: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, markdown) from a text layer (doc_id, page, text): repaired as the preset's steps say,
    without dictionary or report."""
    joined = text_layer(pages).withColumnRenamed("text", "raw")
    text = _repaired(F.col("raw"), settings, DEFAULT_RULES)
    return joined.select("doc_id", F.concat(trimmed(text), F.lit("\n")).alias("markdown"))


def process_images(images: DataFrame, blocks: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, status, markdown) from images (doc_id, name, properties array of property, value) and their blocks.

    A title, the properties as a table, a rule, and the text; an image with neither properties nor text has failed.
    """
    text = layout.page_text(blocks, image=True).select("doc_id", F.lit(1).alias("page"), F.col("text").alias("raw"))
    text = repair(text, settings, image=True).select("doc_id", "raw", "text")
    joined = images.join(text, "doc_id", "left")
    shown = property_table(F.col("properties"))
    has_text = trimmed(F.coalesce("raw", F.lit(""))) != ""
    table = F.when(shown != "", F.concat(shown, F.lit("\n"))).otherwise(F.lit(""))
    rule = F.when((shown != "") & has_text, F.lit("---\n\n")).otherwise(F.lit(""))
    whole = F.concat(F.lit("# "), "name", F.lit("\n\n"), table, rule, F.when(has_text, F.col("text")).otherwise(F.lit("")))
    failed = (shown == "") & ~has_text
    return joined.select(
        "doc_id", F.when(failed, F.lit("failed")).otherwise(F.lit("success")).alias("status"), F.when(~failed, ended(whole)).alias("markdown")
    )
