"""Quality of recognised text: confidence by page, suspicious tokens, corrections, and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Forms of technical terms.
TECHNICAL = (
    r"[0-9]+(?:\.[0-9]+)?",
    r"0[xX][0-9a-fA-F]+",
    r"[A-Z][A-Z0-9]{1,9}",
    r"[a-z][A-Z][A-Za-z0-9]{0,8}",
    r"[A-Z][A-Z0-9]*(?:_[A-Z][A-Z0-9]*)+",
    r"(?:TS|TR)\s*[0-9]{2}\.[0-9]+.*",
    r"PCT/[A-Z]{2}[0-9/]+.*",
    r"[0-9]{2}\.[0-9]{3}.*",
    r"\[[0-9]{3,5}\]",
    r"[A-Z][0-9]-[0-9]{6,7}",
    r"[A-Z0-9]+-[A-Z][A-Za-z0-9]*",
)
CONTEXT, SHOWN, LEAST_CONFIDENCE = 30, 50, 0.80


def is_technical(token: Column) -> Column:
    return F.rlike(token, F.lit("^(?:" + "|".join(TECHNICAL) + ")$"))


def tokens_of(text: Column) -> Column:
    """The tokens between white space."""
    return F.filter(F.split(text, r"[\s\p{Z}]+", -1), lambda t: t != "")


def bare(token: Column) -> Column:
    """A token without punctuation at its ends."""
    return F.regexp_replace(token, r"^\p{P}+|\p{P}+$", "")


def page_confidence(observations: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, confidence) of each page: the mean over its observations, 0 without any."""
    means = observations.groupBy("doc_id", "page").agg(F.avg("confidence").alias("mean"))
    return pages.select("doc_id", "page").join(means, ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce("mean", F.lit(0.0)).alias("confidence"))


def by_document(rows: DataFrame, by: str = "doc_id") -> DataFrame:
    """``rows`` dealt by document once, in parts of about 4 MB as they are stored, so that what is grouped or sorted by
    document later stays where it is and fits in a task's memory."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(max(2 * rows.sparkSession.sparkContext.defaultParallelism, size >> 22), by)


def word_counts(pages: DataFrame) -> DataFrame:
    """(doc_id, page, words)."""
    return pages.select("doc_id", "page", F.size(tokens_of(F.col("text"))).cast("long").alias("words"))


def vocabulary_of(pages: DataFrame, least: int = 3) -> DataFrame:
    """(word, documents): the words of a corpus that at least ``least`` of its documents hold, as a vocabulary to start from.

    Words are lower-cased tokens of letters alone. A document counts once for each word, and counts are combined in each
    task before they are dealt.
    """
    words = F.transform(tokens_of(F.col("text")), lambda t: F.lower(bare(t)))
    held = F.array_distinct(F.filter(words, lambda w: F.rlike(w, F.lit(r"^\p{L}{2,}$"))))
    each = pages.select("doc_id", F.explode(held).alias("word")).distinct()
    return each.groupBy("word").agg(F.count("*").alias("documents")).filter(F.col("documents") >= least)


def suspicious_tokens(pages: DataFrame, vocabulary: DataFrame, terms: DataFrame | None = None, context: bool = True) -> DataFrame:
    """(doc_id, page, line, place, token, context) of each token that is no known word and no technical term.

    ``vocabulary`` (word) and ``terms`` (term) hold lower-cased entries. Lines and places count from 1. The cheap tests
    run within the line's array, before the anti-joins; a vocabulary goes to every task only where Spark finds it small.
    Without ``context`` the rows have ``raw``, the token as it stands, from which ``with_context`` finds it later.
    """
    lines = _lines(pages)
    raw = F.transform(tokens_of(F.col("text")), lambda t, k: F.struct((k + 1).alias("place"), t.alias("raw"), bare(t).alias("token")))
    held = F.filter(raw, lambda t: (F.length(t["token"]) >= 2) & ~is_technical(t["token"]))
    found = lines.select("doc_id", "page", "line", *(["text"] if context else []), F.explode(held).alias("t"))
    found = found.select(*[c for c in found.columns if c != "t"], "t.*")
    found = found.withColumn("word", F.lower("token")).join(vocabulary.select("word").distinct(), "word", "left_anti")
    if terms is not None:
        found = found.join(terms.select(F.col("term").alias("word")).distinct(), "word", "left_anti")
    out = ["doc_id", "page", "line", "place", "token"]
    return found.select(*out, _context(F.col("text"), F.col("raw")).alias("context")) if context else found.select(*out, "raw")


def _lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page, line, text)."""
    lines = pages.select("doc_id", "page", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    return lines.withColumn("line", F.col("line") + 1)


def _context(line: Column, raw: Column) -> Column:
    at = F.instr(line, raw)
    start = F.greatest(at - CONTEXT, F.lit(1))
    return F.substr(line, start, at + F.length(raw) + CONTEXT - start)


def with_context(tokens: DataFrame, pages: DataFrame) -> DataFrame:
    """``tokens`` with what stands around each in its line of ``pages``, in place of ``raw``."""
    joined = tokens.join(_lines(pages), ["doc_id", "page", "line"])
    return joined.withColumn("context", _context(F.col("text"), F.col("raw"))).drop("text", "raw")


def top_with_context(tokens: DataFrame, pages: DataFrame, most: int = SHOWN) -> DataFrame:
    """``top_suspicious`` with context. A document's few tokens are one value, which meets its pages by doc_id alone:
    where pages lie by doc_id, nothing is shuffled for it."""
    if "context" in tokens.columns:
        return top_suspicious(tokens, most)
    top = top_suspicious(tokens, most)
    own = [c for c in top.columns if c != "doc_id"]
    held = top.groupBy("doc_id").agg(F.collect_list(F.struct(*own)).alias("top"), F.min("page").alias("first"), F.max("page").alias("last"))
    rows = pages.select("doc_id", F.col("page").alias("at"), "text").join(held, "doc_id").filter((F.col("at") >= F.col("first")) & (F.col("at") <= F.col("last")))
    found = rows.select("doc_id", F.split("text", "\n", -1).alias("lines"), F.explode(F.filter("top", lambda t: t["page"] == F.col("at"))).alias("t"))
    found = found.select("doc_id", "t.*", F.get("lines", F.col("t.line") - 1).alias("text"))
    return found.withColumn("context", _context(F.col("text"), F.col("raw"))).drop("text", "raw")


def corrections_between(pages: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """(doc_id, page, original, corrected) where texts of as many tokens differ in a token."""
    split = [F.split(c, r"[\s\p{Z}]", -1).alias(n) for c, n in ((before, "b"), (after, "a"))]
    rows = pages.select("doc_id", "page", *split).filter(F.size("a") == F.size("b"))
    pairs = rows.select("doc_id", "page", F.explode(F.filter(F.arrays_zip("b", "a"), lambda z: z["b"] != z["a"])).alias("z"))
    return pairs.select("doc_id", "page", F.col("z.b").alias("original"), F.col("z.a").alias("corrected"))


def correction_counts(corrections: DataFrame) -> DataFrame:
    """(doc_id, original, corrected, n)."""
    return corrections.groupBy("doc_id", "original", "corrected").agg(F.count("*").alias("n"))


def top_suspicious(tokens: DataFrame, most: int = SHOWN) -> DataFrame:
    """The first ``most`` suspicious tokens of each document, with their rank; a report's list."""
    order = Window.partitionBy("doc_id").orderBy("page", "line", "place")
    return tokens.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def summary(pages: DataFrame, tokens: DataFrame) -> DataFrame:
    """(doc_id, pages, words, suspicious, suspicious_percent)."""
    counts = word_counts(pages).groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum("words").alias("words"))
    found = tokens.groupBy("doc_id").agg(F.count("*").alias("suspicious"))
    joined = counts.join(found, "doc_id", "left").withColumn("suspicious", F.coalesce("suspicious", F.lit(0).cast("long")))
    percent = F.when(F.col("words") > 0, F.col("suspicious").cast("double") / F.col("words") * 100).otherwise(F.lit(0.0))
    return joined.select("doc_id", "pages", "words", "suspicious", F.format_string("%.2f", percent).alias("suspicious_percent"))


def _listed(rows: DataFrame, order: list, line: Column, name: str) -> DataFrame:
    held = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("line_text")))).alias("held"))
    return held.select("doc_id", F.array_join(F.transform("held", lambda x: x["line_text"]), "\n").alias(name))


def report(
    pages: DataFrame, confidence: DataFrame, tokens: DataFrame, corrections: DataFrame, name: Column | None = None
) -> DataFrame:
    """(doc_id, report): the text of each document's report. ``name`` is the file name shown, over ``doc_id``.

    ``tokens`` are those of suspicious_tokens; context is only found for those that are listed. All parts are grouped and
    joined by doc_id, or by it and more: over pages that were dealt by doc_id (``by_document``) nothing is shuffled again.
    """
    title = F.col("doc_id").cast("string") if name is None else name
    low = F.col("confidence") < LEAST_CONFIDENCE
    marked = F.concat(
        F.lit("  Page "), F.col("page").cast("string"), F.lit(": avg "), F.format_string("%.2f", F.col("confidence").cast("double")),
        F.when(low, F.lit(" ⚠️")).otherwise(F.lit(" ✓")),
        F.when(low & (F.col("page") == 1), F.lit(" (cover page - layout complexity)")).otherwise(F.lit("")),
    )
    by_page = _listed(confidence, ["page"], marked, "by_page")
    shown = F.format_string('  Page %d, Line %d: "%s" (context: ...%s...)', "page", "line", "token", "context")
    listed = _listed(top_with_context(tokens, pages), ["rank"], shown, "listed")
    counts = correction_counts(corrections)
    times = F.concat(F.col("n").cast("string"), F.lit(" occurrence"), F.when(F.col("n") == 1, F.lit("")).otherwise(F.lit("s")))
    change = F.concat(F.lit("  "), F.col("original"), F.lit(" → "), F.col("corrected"), F.lit(" ("), times, F.lit(")"))
    changes = _listed(counts.withColumn("less", -F.col("n")), ["less", "original", "corrected"], change, "changes")
    totals = counts.groupBy("doc_id").agg(F.sum("n").alias("changed"))
    whole = summary(pages, tokens)
    for part in (by_page, listed, changes, totals):
        whole = whole.join(part, "doc_id", "left")
    head = F.concat(
        F.lit("=== OCR Quality Report: "), title, F.lit(" ===\nPages processed: "), F.col("pages").cast("string"), F.lit("\nTotal words: "),
        F.format_number("words", 0), F.lit("\nSuspicious tokens: "), F.col("suspicious").cast("string"), F.lit(" ("),
        F.col("suspicious_percent"), F.lit("%)\n\nPer-page confidence:\n"), F.coalesce(F.concat("by_page", F.lit("\n")), F.lit("")),
    )
    more = F.when(F.col("suspicious") > SHOWN, F.concat(F.lit("\n  ... and "), (F.col("suspicious") - SHOWN).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    body = F.when(F.col("suspicious") > 0, F.concat(F.lit("\nSuspicious tokens:\n"), "listed", more, F.lit("\n"))).otherwise(F.lit(""))
    tail = F.when(F.col("changed") > 0, F.concat(F.lit("\nCorrections applied: "), F.col("changed").cast("string"), F.lit("\n"), "changes", F.lit("\n"))).otherwise(F.lit(""))
    return whole.select("doc_id", F.concat(head, body, tail).alias("report"))
