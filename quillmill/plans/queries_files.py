"""Queries over the byte readers: files made from orders, converted, and compared with Markdown that SQL writes."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extraction
from ..operators import quality
from ..sinks.files import write_files
from ..sources.files import slices
from ..streaming.folders import convert_stream, watched
from ..tables import read_table, shared_folder
from . import queries_text, samples
from .convert import convert
from .queries_documents import _LINES, _lines

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _made(make: Callable[[int, samples.Lines], bytes], kind: str) -> Callable:
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for piece in slices(batch):
                orders, held = piece.column(0).to_pylist(), piece.column(1)
                lines = list(zip(*(f.to_pylist() for f in held.flatten().flatten()), strict=True))
                ends = held.offsets.to_pylist()
                files = [make(o, lines[a - ends[0] : b - ends[0]]) for o, a, b in zip(orders, ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array([f"in/{o}.{kind}" for o in orders]), pa.array(files, pa.binary())], ["path", "content"])

    return batches


def _file_query(name: str, kind: str, make: Callable[[int, samples.Lines], bytes], markdown: str) -> None:
    """A file of ``kind`` for each order, converted; ``markdown`` is the SQL over the order's lines, grouped by ``o``."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_returnflag").alias("f"))
        orders = _lines(spark, sf_dir, dealt=True).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
        files = orders.mapInArrow(_made(make, kind), "path string, content binary")
        return convert(files).select("path", "kind", "status", "markdown")

    QUERIES[name] = query
    markdown = re.sub(r"\bnl\b", "chr(10)", markdown)  # string_agg takes no columns between parts
    ORACLE_SQL[name] = f"""
WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_returnflag AS f,
  row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS k FROM {_LINES})
SELECT 'in/' || o || '.{kind}' AS path, '{kind}' AS kind, 'success' AS status, {markdown} AS markdown FROM l GROUP BY o
"""


_file_query("docx_to_markdown", "docx", samples.docx, r"""'# Order ' || o || nl || nl
  || string_agg(CASE f WHEN 'A' THEN k || '. part ' || p WHEN 'R' THEN '**part ' || p || '**' ELSE 'part ' || p END, nl || nl ORDER BY n) || nl || nl
  || string_agg('| ' || n || ' | ' || f || '\|' || p || ' |' || CASE n WHEN 1 THEN nl || '| --- | --- |' ELSE '' END, nl ORDER BY n) || nl""")
_file_query("pptx_to_markdown", "pptx", samples.pptx, """string_agg('## Slide ' || n || nl || nl
  || CASE f WHEN 'R' THEN '**order ' || o || ' part ' || p || '**' ELSE 'order ' || o || ' part ' || p END || nl, nl || '---' || nl || nl ORDER BY n)""")
_file_query("xlsx_to_markdown", "xlsx", samples.xlsx, """'## Order ' || o || nl || nl || string_agg('| line ' || n || ' |  | ' || p || ' | '
  || CASE f WHEN 'R' THEN 'TRUE' ELSE 'FALSE' END || ' |' || CASE n WHEN 1 THEN nl || '| --- | --- | --- | --- |' ELSE '' END, nl ORDER BY n) || nl""")
_file_query("odt_to_markdown", "odt", samples.odt, """'## Order ' || o || nl || nl || string_agg('- part ' || p, nl ORDER BY n) || nl || nl
  || string_agg('line ' || n || ' **' || f || '**', nl || nl ORDER BY n) || nl""")
_file_query("epub_to_markdown", "epub", samples.epub, """'# Order ' || o || nl || nl || string_agg('---' || nl || nl || '## Line ' || n || nl || nl || '# Line ' || n || nl || nl
  || 'part *' || p || '*' || nl, nl ORDER BY n DESC)""")
_file_query("multipart_mail_to_markdown", "eml", samples.mail, """'# État ' || o || nl || nl || '- **From:** José <a' || o || '@example.org>' || nl || nl || '---' || nl || nl
  || string_agg('café ' || n || ' **' || p || '**', nl || nl ORDER BY n) || nl""")
_file_query("json_to_markdown", "json", samples.json_file, """'# ' || o || nl || nl || '```json' || nl || '{' || nl || '  "a/b": null,' || nl || '  "lines": [' || nl
  || string_agg('    {' || nl || '      "flag": "' || f || '",' || nl || '      "part": ' || p || nl || '    }', ',' || nl ORDER BY n) || nl
  || '  ],' || nl || '  "order": ' || o || nl || '}' || nl || '```' || nl""")
_file_query("xml_to_markdown", "xml", samples.xml, """'# ' || o || nl || nl || '```xml' || nl || '<?xml version="1.0" ?>' || nl || '<order key="' || o || '">' || nl
  || string_agg('  <line>' || nl || '    <part>' || p || '</part>' || nl || '  </line>' || nl, '' ORDER BY n) || '</order>' || nl || '```' || nl""")
_file_query("csv_file_to_markdown", "csv", samples.csv, r"""'# ' || o || nl || nl || '| key | part | note |' || nl || '| --- | --- | --- |' || nl
  || string_agg('| ' || o || ' | ' || p || ';' || f || ' | a\|"' || n || '"<br>b |' || nl, '' ORDER BY n) || '| end |  |  |' || nl""")
_file_query("rtf_to_markdown", "rtf", samples.rtf, """'# **Order ' || o || '**' || nl || nl || string_agg('**' || f || '** part ' || p || ' café', nl || nl ORDER BY n) || nl""")
_file_query("mobi_to_markdown", "mobi", samples.mobi, "string_agg('order ' || o || ' part ' || p, nl || nl ORDER BY n) || nl")
_file_query("msg_to_markdown", "msg", samples.msg, """'# Order ' || o || nl || nl || '- **From:** Ann <a@example.org>' || nl || nl || '---' || nl || nl
  || string_agg('part ' || p || ' ' || f, chr(13) || nl || chr(13) || nl ORDER BY n) || nl""")
_file_query("html_file_to_markdown", "html", samples.html, r"""'# Order ' || o || nl || nl
  || string_agg('part **' || p || '** & [more](u/' || n || ')  ' || nl || 'next' || nl || nl, '' ORDER BY n) || string_agg(n || '. item ' || n, nl ORDER BY n) || nl || nl
  || '| n | part |' || nl || '| --- | --- |' || nl || string_agg('| ' || n || ' | ' || f || '\|' || p || ' |', nl ORDER BY n) || nl || nl || '> said ' || o || nl || nl
  || '```' || nl || 'a' || nl || '  ' || o || nl || '```' || nl || nl || '---' || nl || nl || 'end' || nl""")


def cover_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cover fields whose values begin with a document's own words and hold labels; labels go only from the start."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"[^a-zA-Z]+", " ").alias("x"))
    words = F.trim(F.substring("x", 1, 40))
    cover = F.concat(F.lit("(54) Title: "), words, F.lit(" with subtitles and a Title\n(71) Applicants:: "), words, F.lit(" Applicant;\n(81) designated states "), words)
    rows = docs.select("doc_id", F.lit(1).alias("page"), cover.alias("text"))
    return extraction.cover_rows(rows).select("doc_id", "title", "applicant", "designated_states")


QUERIES["cover_labels"] = cover_labels
ORACLE_SQL["cover_labels"] = """
WITH a AS (SELECT doc_id, trim(substr(regexp_replace(coalesce(text, ''), '[^a-zA-Z]+', ' ', 'g'), 1, 40)) AS w FROM documents)
SELECT doc_id, trim(w || ' with subtitles and a Title') AS title, trim(w || ' Applicant') AS applicant, CASE WHEN w = '' THEN 'designated states' ELSE w END AS designated_states FROM a
"""


def quality_report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of each document: every line is a page, whose confidence is set by its number."""
    pages = queries_text._pages(spark, sf_dir)
    changed = queries_text._put(F.col("text"), ("the", "teh"), ("er ", "re "))
    corrections = quality.corrections_between(pages.select("doc_id", "page", F.col("text").alias("before"), changed.alias("after")))
    confidence = pages.select("doc_id", "page", (F.lit(0.5) + F.pmod("page", F.lit(2)) * 0.375).alias("confidence"))
    tokens = quality.suspicious_tokens(pages, queries_text._vocabulary(spark), context=False)
    return quality.report(pages, confidence, tokens, corrections)


QUERIES["quality_report_text"] = quality_report_text
ORACLE_SQL["quality_report_text"] = f"""
WITH {queries_text._TOKENS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, line, place)::INT AS rank, instr(text, word) AS p FROM odd),
listed AS (SELECT doc_id, string_agg('  Page ' || page || ', Line ' || line || ': "' || token || '" (context: ...'
  || substr(text, greatest(p - 30, 1), p + length(word) + 30 - greatest(p - 30, 1)) || '...)', chr(10) ORDER BY rank) AS listed FROM ranked WHERE rank <= 50 GROUP BY 1),
counts AS (SELECT doc_id, count(*) AS n FROM odd GROUP BY 1),
words AS (SELECT doc_id, count(*) AS pages, sum(len(tokens))::BIGINT AS words FROM raw GROUP BY 1),
by_page AS (SELECT doc_id, string_agg('  Page ' || page || ': avg ' || CASE page % 2 WHEN 1 THEN '0.88 ✓' WHEN 0 THEN '0.50 ⚠️' END, chr(10) ORDER BY page) AS by_page FROM pages_of GROUP BY 1),
s AS (SELECT doc_id, regexp_split_to_array(text, '[\\s\\pZ]') AS b,
  regexp_split_to_array({queries_text._put_sql("text", ("the", "teh"), ("er ", "re "))}, '[\\s\\pZ]') AS a FROM pages_of),
t AS (SELECT doc_id, unnest(list_zip(b, a)) AS z FROM s WHERE len(a) = len(b)),
c AS (SELECT doc_id, z[1] AS x, z[2] AS y, count(*) AS n FROM t WHERE z[1] <> z[2] GROUP BY ALL),
changes AS (SELECT doc_id, sum(n)::BIGINT AS changed, string_agg('  ' || x || ' → ' || y || ' (' || n || ' occurrence' || CASE n WHEN 1 THEN '' ELSE 's' END || ')', chr(10) ORDER BY n DESC, x, y) AS changes FROM c GROUP BY 1)
SELECT doc_id, '=== OCR Quality Report: ' || doc_id || ' ===' || chr(10) || 'Pages processed: ' || pages || chr(10) || 'Total words: ' || format('{{:,}}', words) || chr(10)
  || 'Suspicious tokens: ' || coalesce(n, 0) || ' (' || printf('%.2f', round(CASE WHEN words > 0 THEN coalesce(n, 0)::DOUBLE / words * 100 ELSE 0.0 END, 2)) || '%)' || chr(10) || chr(10)
  || 'Per-page confidence:' || chr(10) || by_page || chr(10)
  || CASE WHEN n > 0 THEN chr(10) || 'Suspicious tokens:' || chr(10) || listed || CASE WHEN n > 50 THEN chr(10) || '  ... and ' || (n - 50) || ' more' ELSE '' END || chr(10) ELSE '' END
  || CASE WHEN changed > 0 THEN chr(10) || 'Corrections applied: ' || changed || chr(10) || changes || chr(10) ELSE '' END AS report
FROM words LEFT JOIN counts USING (doc_id) LEFT JOIN listed USING (doc_id) LEFT JOIN by_page USING (doc_id) LEFT JOIN changes USING (doc_id)
"""


def folder_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's texts as files of a watched folder, converted by a stream that ends when all are done."""
    top = f"{shared_folder(spark)}/quillmill/stream-{uuid.uuid4().hex[:12]}"
    items = read_table(spark, sf_dir, "benchmark")
    write_files(items.select(F.concat(F.col("item_id").cast("string"), F.lit(".txt")).alias("path"), F.concat("text", F.lit("  \r\n")).alias("content")), f"{top}/in")
    convert_stream(watched(spark, f"{top}/in"), f"{top}/out", f"{top}/state", once=True).awaitTermination()
    return spark.read.parquet(f"{top}/out").select(F.substring_index("path", "/", -1).alias("file"), "status", "markdown")


QUERIES["folder_stream"] = folder_stream
ORACLE_SQL["folder_stream"] = f"""
WITH a AS (SELECT item_id, {queries_text.whitespace_sql("regexp_replace(text || '  ' || chr(13) || chr(10), '\\r\\n?', chr(10), 'g')")} AS y FROM benchmark)
SELECT item_id || '.txt' AS file, 'success' AS status, CASE WHEN ends_with(y, chr(10)) THEN y ELSE y || chr(10) END AS markdown FROM a
"""
