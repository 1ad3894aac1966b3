"""Findings of round 3, each by what failed before."""

import duckdb
import pytest

from quillmill.formats.html import html_to_markdown
from quillmill.plans import registry


def test_page_with_carriage_returns_is_read_as_its_sql_does(spark, tmp_path):
    page = "<body><h1>a\r\nb</h1><p>c\r\nd\re\tf</p></body>"
    assert html_to_markdown(page) == "# a b\n\nc d e f\n"
    spark.createDataFrame([(1, "u", page), (2, "u", None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = duckdb.sql(registry.ORACLE_SQL["html_to_markdown"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, registry.QUERIES["html_to_markdown"](spark, str(tmp_path)).collect())) == sorted(found)


def test_column_letters_of_any_number(spark, tmp_path):
    from pyspark.sql import functions as F

    from quillmill.formats import sheets
    from quillmill.functions.text import column_index, column_letters

    numbers = [-1, 0, 25, 26, 701, 702, 18277, 18278, 19999, 475253, 475254, 12356629, 12356630, 2**31 - 1]
    rows = spark.createDataFrame([(k,) for k in numbers], "p_partkey int")
    found = rows.select("p_partkey", column_letters(F.col("p_partkey")), column_index(column_letters(F.col("p_partkey")))).collect()
    assert [tuple(r) for r in found] == [(k, sheets.column_letters(k), k) for k in numbers]
    rows.filter("p_partkey BETWEEN 0 AND 12356629").write.parquet(f"{tmp_path}/part.parquet")
    shown = duckdb.sql(f"SELECT k, letters, back FROM ({registry.ORACLE_SQL['sheet_column_names'].replace('FROM part', f"FROM '{tmp_path}/part.parquet/*.parquet'")})").fetchall()
    assert sorted(map(tuple, registry.QUERIES["sheet_column_names"](spark, str(tmp_path)).collect())) == sorted(shown)


def test_files_of_a_query_are_made_once(spark):
    """Both branches of a union, for archives and for other files, used to make all files."""
    for name in ("xlsx_to_markdown", "mobi_to_markdown", "msg_to_markdown", "xml_to_markdown", "epub_to_markdown", "multipart_mail_to_markdown", "rtf_to_markdown", "html_file_to_markdown", "pptx_to_markdown", "json_to_markdown", "csv_file_to_markdown", "docx_to_markdown", "odt_to_markdown"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 2, name


def test_python_work_is_dealt_to_all_cores(spark):
    rows = registry.QUERIES["xlsx_to_markdown"](spark, "/root/testdata/sf0.01")
    assert rows.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_sample_archives_are_those_of_zipfile():
    import io
    import zipfile

    from quillmill.formats.package import Package
    from quillmill.plans import samples

    entries = {"a/é.xml": "<a>ü</a>", "b": ""}
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, content in {"a.xml": "<a>ü</a>", "b": ""}.items():
            z.writestr(zipfile.ZipInfo(name), content)
    assert samples._zipped({"a.xml": "<a>ü</a>", "b": ""}) == held.getvalue()
    with zipfile.ZipFile(held := io.BytesIO(), "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in entries.items():
            z.writestr(name, content)
    assert {n: Package(held.getvalue()).read(n).decode() for n in entries} == entries


def test_archive_of_a_later_version_is_a_row():
    from quillmill.plans import samples
    from quillmill.plans.convert import convert_one

    data = samples.xlsx(1, [(1, 2, "A")])
    at = data.index(b"PK\1\2") + 6
    assert convert_one("xlsx", data[:at] + b"\xff" + data[at + 1 :], "n")[:2] == ("failed", "unzip_failed")


def test_tokens_come_in_small_batches():
    import pyarrow as pa

    from quillmill.plans.queries_documents import MOST_TOKENS, _token_batches

    pages = pa.RecordBatch.from_arrays([pa.array([1, 2, 3], pa.int64()), pa.array(["<p>x</p>" * 5000, None, '<a href="u">t</a><A b=1>'])], ["page_id", "html"])
    found = list(_token_batches(iter([pages])))
    assert sum(b.num_rows for b in found) == 15004 and max(b.num_rows for b in found) <= MOST_TOKENS
    links = pa.Table.from_batches(list(_token_batches(iter([pages]), ("a",)))).to_pylist()
    assert [(r["page_id"], r["pos"], r["kind"], r["attributes"]) for r in links] == [(3, 0, "start", [("href", "u")]), (3, 3, "start", [("b", "1")])]


def _dealt_by(spark, name):
    """The keys of a query's exchanges, without their numbers."""
    import re

    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    return {tuple(re.sub(r"#\d+L?", "", k) for k in found.split(", ")[:-1]) for found in re.findall(r"hashpartitioning\(([^)]*)\)", plan)}


TOKEN_QUERIES = ("quality_report_text", "suspicious_top50", "suspicious_tokens")


def test_tokens_are_not_dealt(spark):
    """Texts are dealt by document once; what is found in them used to be dealt by document and page or token."""
    for name in TOKEN_QUERIES:
        assert _dealt_by(spark, name) <= {("doc_id",), ("word",)}, name
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "[word" not in "".join(x for x in plan.split("\n") if "SortMergeJoin" in x), name


def test_top_tokens_have_the_context_that_all_have(spark):
    from quillmill.operators import quality

    text = "\n".join(f"xq{k} the zz{k} yy" for k in range(40))
    pages = spark.createDataFrame([(1, p, text if p else "") for p in range(3)] + [(2, 1, "the"), (3, 7, "qq")], "doc_id long, page int, text string")
    words = spark.createDataFrame([("the",)], "word string")
    out = ("doc_id", "page", "line", "place", "token", "context", "rank")
    early = quality.top_suspicious(quality.suspicious_tokens(pages, words)).select(*out)
    late = quality.top_with_context(quality.suspicious_tokens(pages, words, context=False), pages).select(*out)
    assert sorted(map(tuple, late.collect())) == sorted(map(tuple, early.collect())) and late.count() == 51


def test_jobs_read_their_documents_once(spark):
    plan = registry.QUERIES["job_states"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("FileScan") == 1


def test_archives_are_made_in_slices():
    import pyarrow as pa

    from quillmill.plans.queries_documents import _archive_batches

    docs = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(["x"] * 3000)], ["doc_id", "text"])
    found = list(_archive_batches(iter([docs])))
    assert sum(b.num_rows for b in found) == 3000 and max(b.num_rows for b in found) <= 1024


def test_entries_of_archives_are_rows_as_before(spark):
    import io
    import zipfile

    from quillmill.plans.convert import convert

    with zipfile.ZipFile(held := io.BytesIO(), "w") as z:
        for name, content in (("a.TXT", b"x"), ("d/b.json", b"PK\3\4"), ("c.bin", b"0"), (".h.txt", b"h"), ("in.zip", b"PK")):
            z.writestr(name, content)
    files = spark.createDataFrame([("p/z.zip", bytearray(held.getvalue())), ("bad.zip", bytearray(b"PK\3\4")), ("t.txt", bytearray(b"t"))], "path string, content binary")
    found = sorted((r.path, r.kind, r.status, r.error) for r in convert(files).collect())
    assert found == [("bad.zip/", "", "failed", "unzip_failed"), ("p/z.zip/a.TXT", "txt", "success", None), ("p/z.zip/d/b.json", "zip", "unsupported", "unsupported_format"), ("t.txt", "txt", "success", None)]
