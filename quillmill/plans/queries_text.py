"""Queries over texts: repair, corrections, quality, extraction. Each has the SQL that gives the same rows.

The documents hold none of the marks that the repairs look for, so most queries first put them in, by the same
replacements in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extraction, text
from ..functions.hyphens import DEFAULT_RULES, hyphen_merger
from ..operators import quality
from ..tables import read_table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _sql(body: str, table: str = "documents") -> str:
    return f"SELECT doc_id, {body} FROM (SELECT doc_id, coalesce(text, '') AS text FROM {table})"


def _put(column: Column, *pairs: tuple[str, str]) -> Column:
    for a, b in pairs:
        column = F.replace(column, F.lit(a), F.lit(b))
    return column


def _put_sql(column: str, *pairs: tuple[str, str]) -> str:
    def quoted(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    for a, b in pairs:
        column = f"replace({column}, {quoted(a)}, {quoted(b)})"
    return column


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _text_query(name: str, function, body: str, *noise: tuple[str, str]) -> None:
    """A query that repairs each document's text after ``noise``; ``body`` is the SQL, with {x} for the noisy text."""
    QUERIES[name] = lambda spark, sf_dir: _documents(spark, sf_dir).select("doc_id", function(_put(F.col("text"), *noise)).alias("text"))
    ORACLE_SQL[name] = _sql(f"{body.replace('{x}', _put_sql('text', *noise))} AS text")


def whitespace_sql(x: str) -> str:
    trim = f"regexp_replace({x}, '[\\t\\v\\f\\r\\pZ]+(\\n|\\z)', '\\1', 'g')"
    ends = f"regexp_replace(regexp_replace(regexp_replace({trim}, '\\n{{4,}}', chr(10)||chr(10)||chr(10), 'g'), '\\A\\n{{3,}}', chr(10)||chr(10)), '\\n{{3,}}\\z', chr(10)||chr(10))"
    return f"CASE WHEN regexp_full_match({trim}, '\\n*') THEN substr({trim}, 1, 1) ELSE {ends} END"


BREAKS = ((". ", ".  \n\n\n\n"), (", ", ",\t\n"))
MARKS = ((", ", " — "), (" the ", " “the” "), (" of ", "… of ‘"))
WIDE = ((", ", "，"), (". ", "．"), (" the ", "（the）"), (" la ", "［la］"))

_text_query("text_whitespace", text.clean_whitespace, whitespace_sql("{x}"), *BREAKS)
_text_query("text_newlines", text.unix_newlines, "regexp_replace({x}, '\\r\\n?', chr(10), 'g')", (". ", ".\r\n"), (", ", ",\r"))
_text_query(
    "text_special_chars", text.plain_marks, "replace(translate({x}, '‘’“”–—«»', '''''\"\"--\"\"'), '…', '...')", *MARKS
)
_text_query("text_half_width", text.half_width, "translate({x}, '" + text.FULL_WIDTH + "', '" + text.HALF_WIDTH + "')", *WIDE)
_text_query(
    "text_noise_lines", text.without_noise_lines,
    "array_to_string(list_filter(string_split({x}, chr(10)), lambda l: NOT regexp_full_match(l, '[\\t\\p{Zs}]*[^\\pL\\pM\\pN\\t\\p{Zs}][\\t\\p{Zs}]*')), chr(10))",
    (". ", ".\n * \nx\n"), (", ", ",\n—\n"),
)
_text_query("text_collapse_blank", text.collapse_blank_lines, "regexp_replace({x}, '\\n{3,}', chr(10)||chr(10), 'g')", *BREAKS)
QUERIES["text_to_markdown"] = lambda spark, sf_dir: _documents(spark, sf_dir).select(
    "doc_id", text.plain_text_to_markdown(_put(F.col("text"), *BREAKS), F.lit("txt")).alias("text")
)
ORACLE_SQL["text_to_markdown"] = f"""
WITH a AS (SELECT doc_id, regexp_replace({_put_sql("coalesce(text, '')", *BREAKS)}, '\\r\\n?', chr(10), 'g') AS x FROM documents),
b AS (SELECT doc_id, {whitespace_sql("x")} AS y FROM a)
SELECT doc_id, CASE WHEN ends_with(y, chr(10)) THEN y ELSE y || chr(10) END AS text FROM b
"""
_text_query(
    "text_strip_tags", lambda x: F.coalesce(text.title_in_html(x), F.lit("")),
    "coalesce(nullif(trim(regexp_replace(regexp_extract({x}, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')), ''), "
    "nullif(trim(regexp_replace(regexp_extract({x}, '(?is)<h2[^>]*>(.*?)</h2>', 1), '<[^>]+>', '', 'g')), ''), '')",
    (". ", ".<h2> <b>x</b> "), (", ", " y</h2>"),
)


def bracket_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = _bracketed(F.col("text"), F.lpad(F.pmod("doc_id", F.lit(10000)).cast("string"), 4, "0"))
    return _documents(spark, sf_dir).select("doc_id", text.fix_paragraph_brackets(noisy).alias("text"), text.fix_paragraph_brackets(noisy, True).alias("image_text"))


def _bracketed(x: Column, n: Column) -> Column:
    return F.concat(F.lit("("), n, F.lit(") "), x, F.lit("\n["), n, F.lit("1 a ["), n, F.lit(" b ("), n, F.lit("] c\n("), n, F.lit(") d ["), n, F.lit("|"))


QUERIES["text_bracket_fix"] = bracket_fix
_N = "lpad((doc_id % 10000)::VARCHAR, 4, '0')"
_IMAGE = "regexp_replace(regexp_replace(x, '\\[(\\d{4})[1)|]', '[\\1]', 'g'), '\\[(\\d{4})(\\s)', '[\\1]\\2', 'g')"
ORACLE_SQL["text_bracket_fix"] = f"""
WITH a AS (SELECT doc_id, '(' || {_N} || ') ' || coalesce(text, '') || chr(10) || '[' || {_N} || '1 a [' || {_N} || ' b (' || {_N} || '] c' || chr(10)
  || '(' || {_N} || ') d [' || {_N} || '|' AS x FROM documents)
SELECT doc_id, {_IMAGE} AS image_text,
  regexp_replace(regexp_replace({_IMAGE}, '\\((\\d{{4}})\\]', '[\\1]', 'g'), '(?:\\A|\\n)\\((\\d{{4}})\\)', chr(10) || '[\\1]', 'g') AS text FROM a
"""


def hyphen_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of lower-case letters, parted in the middle at a line end."""
    merge = hyphen_merger()
    parted = F.regexp_replace("text", r"\b([a-z]{4})([a-z]{3,})\b", "$1-\n$2")
    return _documents(spark, sf_dir).select("doc_id", F.md5(merge(parted).cast("binary")).alias("text_md5"))


QUERIES["text_hyphen_merge"] = hyphen_merge
# A word that was parted ends its line; what stood behind it is the next line. After half-, over- and such lines stay parted.
_LEADS = "|".join(sorted(w for w in DEFAULT_RULES.leads if len(w) == 4))
ORACLE_SQL["text_hyphen_merge"] = f"""
WITH w AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '([\\pL\\pN_]+)', chr(3) || '\\1' || chr(4), 'g') AS x FROM documents),
a AS (SELECT doc_id, translate(regexp_replace(x, chr(3) || '([a-z]{{4}})([a-z]{{3,}})' || chr(4), '\\1' || chr(1) || '\\2' || chr(2), 'g'), chr(3) || chr(4), '') AS x FROM w),
b AS (SELECT doc_id, regexp_replace(x, '(\\A|[^\\pL\\pN])({_LEADS})' || chr(1) || '([a-z]+)' || chr(2), '\\1\\2-' || chr(10) || '\\3', 'g') AS x FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(replace(x, chr(1), ''), chr(2) || '[ \\t]*(\\n|\\z)', '\\1', 'g'), chr(2) || '[ \\t]*', chr(10), 'g') AS x FROM b)
SELECT doc_id, md5(x) AS text_md5 FROM c
"""

RULES = text.Corrections(
    spaced_words={"and the": "andthe", "of the": "ofthe"}, word_replacements={"er ": "re ", "the": "teh", "es ": "se "},
    patterns=((r"\bis\b", "IS", False), (r"TEH", "the", True)),
)


def corrections_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = _put(F.col("text"), (" to ", " loT "), (", ", " c.g., "))
    return _documents(spark, sf_dir).select("doc_id", text.corrected(noisy, RULES).alias("text"))


QUERIES["corrections_apply"] = corrections_apply


def _corrected_sql(x: str) -> str:
    x = _put_sql(x, *text.BUILT_IN_FIXES)
    for pairs in (RULES.spaced_words, RULES.word_replacements):
        x = _put_sql(x, *((k, pairs[k]) for k in sorted(pairs, key=lambda k: (-len(k), k))))
    return f"regexp_replace(regexp_replace({x}, '\\bis\\b', 'IS', 'g'), '(?i)TEH', 'the', 'g')"


ORACLE_SQL["corrections_apply"] = _sql(_corrected_sql(_put_sql("text", (" to ", " loT "), (", ", " c.g., "))) + " AS text")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a document as a page. Texts are dealt by document, so that their tokens never are."""
    return quality.by_document(_documents(spark, sf_dir)).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("page", "text")).withColumn("page", F.col("page") + 1)


_PAGES = """pages_of AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text,
  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1)::INT AS page FROM documents)"""


def correction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pages(spark, sf_dir).select("doc_id", "page", F.col("text").alias("before"), _put(F.col("text"), ("the", "teh"), ("er ", "re ")).alias("after"))
    return quality.correction_counts(quality.corrections_between(rows))


QUERIES["correction_counts"] = correction_counts
ORACLE_SQL["correction_counts"] = f"""
WITH {_PAGES}, s AS (SELECT doc_id, regexp_split_to_array(text, '[\\s\\pZ]') AS b,
  regexp_split_to_array({_put_sql("text", ("the", "teh"), ("er ", "re "))}, '[\\s\\pZ]') AS a FROM pages_of),
t AS (SELECT doc_id, unnest(list_zip(b, a)) AS z FROM s WHERE len(a) = len(b))
SELECT doc_id, z[1] AS original, z[2] AS corrected, count(*) AS n FROM t WHERE z[1] <> z[2] GROUP BY ALL
"""

WORDS = ("the", "of", "and", "to", "in", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "de", "la", "que", "le", "les", "und", "der", "die", "das", "el")


def _vocabulary(spark: SparkSession) -> DataFrame:
    """The words as a table whose size Spark knows when it plans, so that it goes to every task and no token is dealt by its word."""
    return spark.range(0, 1, 1, 1).select(F.explode(F.array(*[F.lit(w) for w in WORDS])).alias("word"))


def suspicious_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by document and token, and one place of each."""
    found = quality.suspicious_tokens(_pages(spark, sf_dir), _vocabulary(spark))
    return found.groupBy("doc_id", "token").agg(F.count("*").alias("n"), F.min("page").alias("first_page"))


def suspicious_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    top = quality.top_with_context(quality.suspicious_tokens(pages, _vocabulary(spark), context=False), pages)
    return top.select("doc_id", "page", "line", "place", "token", "context", "rank")


_TECH = "^(?:" + "|".join(quality.TECHNICAL) + ")$"
_TOKENS = f"""{_PAGES}, raw AS (SELECT doc_id, page, 1 AS line, text, list_filter(regexp_split_to_array(text, '[\\s\\pZ]+'), lambda t: t <> '') AS tokens FROM pages_of),
flat AS (SELECT doc_id, page, line, text, unnest(tokens) AS word, generate_subscripts(tokens, 1)::INT AS place FROM raw),
stripped AS (SELECT *, regexp_replace(word, '^\\pP+|\\pP+$', '', 'g') AS token FROM flat),
odd AS (SELECT * FROM stripped WHERE length(token) >= 2 AND NOT regexp_matches(token, '{_TECH}')
  AND lower(token) NOT IN ({", ".join(f"'{w}'" for w in WORDS)}))"""
QUERIES["suspicious_tokens"] = suspicious_tokens
ORACLE_SQL["suspicious_tokens"] = f"WITH {_TOKENS} SELECT doc_id, token, count(*) AS n, min(page) AS first_page FROM odd GROUP BY ALL"
QUERIES["suspicious_top50"] = suspicious_top
ORACLE_SQL["suspicious_top50"] = f"""
WITH {_TOKENS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, line, place)::INT AS rank, instr(text, word) AS p FROM odd)
SELECT doc_id, page, line, place, token, substr(text, greatest(p - 30, 1), p + length(word) + 30 - greatest(p - 30, 1)) AS context, rank FROM ranked WHERE rank <= 50
"""


def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    return quality.summary(pages, quality.suspicious_tokens(pages, _vocabulary(spark)))


QUERIES["quality_summary"] = quality_summary
ORACLE_SQL["quality_summary"] = f"""
WITH {_TOKENS}, c AS (SELECT doc_id, count(*) AS pages, sum(len(tokens))::BIGINT AS words FROM raw GROUP BY 1), s AS (SELECT doc_id, count(*) AS n FROM odd GROUP BY 1)
SELECT doc_id, pages, words, coalesce(n, 0)::BIGINT AS suspicious,
  printf('%.2f', round(CASE WHEN words > 0 THEN coalesce(n, 0)::DOUBLE / words * 100 ELSE 0.0 END, 2)) AS suspicious_percent FROM c LEFT JOIN s USING (doc_id)
"""


def claims_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with claims, by a heading in the text or by a first numbered claim, before an abstract."""
    kind = F.pmod("doc_id", F.lit(3))
    claims = F.when(kind == 0, F.lit("\n## Claims\n1. A method.\n")).when(kind == 1, F.lit("\n\n1. The device.\n")).otherwise(F.lit("\n"))
    whole = F.concat(F.lit("x "), "text", claims, F.lit("2. More.\n# Abstract\nEnd."))
    return _documents(spark, sf_dir).select("doc_id", extraction.claims_of(whole).alias("claims"))


QUERIES["claims_span"] = claims_span
ORACLE_SQL["claims_span"] = """
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '## Claims' || chr(10) || '1. A method.' || chr(10) || '2. More.'
  WHEN 1 THEN '1. The device.' || chr(10) || '2. More.' ELSE '' END AS claims FROM documents
"""


def paragraph_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _documents(spark, sf_dir).select("doc_id", F.lit(1).alias("page"), _numbered(F.col("text")).alias("text"))
    return extraction.paragraph_rows(pages)


def _numbered(x: Column) -> Column:
    return F.concat(F.lit("before "), F.replace(F.replace(x, F.lit(". "), F.lit(". [0012] ")), F.lit(", "), F.lit(" [0345] , ")))


QUERIES["paragraph_segments"] = paragraph_segments
ORACLE_SQL["paragraph_segments"] = """
WITH a AS (SELECT doc_id, 'before ' || replace(replace(coalesce(text, ''), '. ', '. [0012] '), ', ', ' [0345] , ') AS x FROM documents),
b AS (SELECT doc_id, unnest(string_split(regexp_replace(x, '(\\[\\d{4}\\])', chr(1) || '\\1', 'g'), chr(1))[2:]) AS p FROM a)
SELECT doc_id, 1 AS page, substr(p, 2, 4) AS para_id, regexp_replace(substr(p, 7), '\\A[\\s\\pZ]+|[\\s\\pZ]+\\z', '', 'g') AS text FROM b
WHERE regexp_replace(substr(p, 7), '\\A[\\s\\pZ]+|[\\s\\pZ]+\\z', '', 'g') <> ''
"""


def cover_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    day = F.lpad((F.pmod("doc_id", F.lit(27)) + 1).cast("string"), 2, "0")
    first = F.concat(F.lit("PCT/CN2024/"), F.lpad(n, 6, "0"), F.lit("\n(22) International Filing Date: "), day, F.lit(".03.2024\n(54) Title: Device "), n,
                     F.lit("\n(71) Applicants: Firm "), n, F.lit(" Ltd."))
    second = F.concat(F.lit("(72) Inventors: A B; C "), n, F.lit("\n(51) H04W 36/00 H04L 5/00 H04W 36/00\n(30) 15 March 2023\n(43) on 2024-05-"), day)
    pages = _documents(spark, sf_dir).select("doc_id", F.explode(F.array(
        F.struct(F.lit(1).alias("page"), first.alias("text")), F.struct(F.lit(2).alias("page"), second.alias("text")),
        F.struct(F.lit(3).alias("page"), F.lit("(81) never read").alias("text")))).alias("p")).select("doc_id", "p.*")
    rows = extraction.cover_rows(pages)
    return rows.withColumns({"inventors": F.array_join("inventors", "|"), "classification": F.array_join("classification", "|")})


QUERIES["cover_metadata"] = cover_metadata
ORACLE_SQL["cover_metadata"] = """
SELECT doc_id, 'PCT/CN2024/' || lpad(doc_id::VARCHAR, 6, '0') AS application_number, lpad((doc_id % 27 + 1)::VARCHAR, 2, '0') || '.03.2024' AS filing_date,
  '2024-05-' || lpad((doc_id % 27 + 1)::VARCHAR, 2, '0') AS publication_date, 'Firm ' || doc_id || ' Ltd.' AS applicant, 'A B|C ' || doc_id AS inventors,
  'Device ' || doc_id AS title, 'H04W 36/00|H04L 5/00' AS classification, '15 March 2023' AS priority_date, NULL::VARCHAR AS designated_states FROM documents
"""
