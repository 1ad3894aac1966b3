"""Names of outputs, sinks, preset steps, stream errors, cover labels, reports, and what is planned once."""

import os

import pytest
from pyspark.sql import functions as F

from quillmill.functions import extraction
from quillmill.operators import layout, quality
from quillmill.plans.convert import convert
from quillmill.plans.scans import process_scans, process_text_layer
from quillmill.settings import PRESETS, Settings
from quillmill.sinks.files import FolderWriter, companion_files, markdown_files, structured_files, write_files
from quillmill.streaming.folders import Progress, convert_stream, watched

from . import builders as b
from .test_operators import blocks

FILES = "path string, content binary"


def files(spark, held):
    return spark.createDataFrame([(p, bytearray(c)) for p, c in held.items()], FILES)


def test_outputs_lie_beside_their_sources(spark):
    held = {"file:/top/in/a/x.txt": b"1", "file:/top/in/b/x.docx": b.docx(b.para("2")), "file:/top/in/b/x.txt": b"3", "file:/top/in/z.zip": b.pack({"n/x.txt": "4", "x.md": "5"})}
    results = convert(files(spark, held))
    want = {"a/x.md": "1\n", "b/x.docx.md": "2\n", "b/x.txt.md": "3\n", "z.zip/n/x.md": "4\n", "z.zip/x.md": "5"}
    got = {r.path: r.content for r in markdown_files(results).collect()}
    assert {k: v.strip() for k, v in got.items()} == {k: v.strip() for k, v in want.items()}
    assert {r.path for r in markdown_files(results, "/top").collect()} == {f"in/{p}" for p in want}
    assert {r.path for r in markdown_files(results, "file:///top/").collect()} == {f"in/{p}" for p in want}
    assert [r.path for r in markdown_files(results.filter("path LIKE '%a/x.txt'")).collect()] == ["x.md"]
    assert markdown_files(results.limit(0)).count() == 0


def test_companions_of_equal_names(spark):
    relations = '<Relationship Id="i" Type="x/image" Target="media/p.png"/>'
    word = [b.docx(b.para("w"), relations=relations, **{"word/media/p.png": c}) for c in (b"one", b"two")]
    books = [b.epub({"a.xhtml": f"<h1>{t}</h1>"}, '<itemref idref="c0"/>') for t in ("One", "Two")]
    held = {"in/a/w.docx": word[0], "in/b/w.docx": word[1], "in/b/p.epub": books[0], "in/b/q.epub": books[1]}
    got = {r.path: bytes(r.content) for r in companion_files(files(spark, held)).collect()}
    assert got["a/w_assets/p.png"] == b"one" and got["b/w_assets/p.png"] == b"two"
    assert {p for p in got if p.endswith("index.md")} == {"b/Book (p.epub)/index.md", "b/Book (q.epub)/index.md"}


def test_failed_writes_leave_nothing(spark, tmp_path):
    with pytest.raises(Exception, match="outside"):
        write_files(spark.createDataFrame([("a.md", "x"), ("../y", "z")], "path string, content string").coalesce(1), str(tmp_path))
    assert not [n for n in os.listdir(tmp_path) if n.startswith(".staging")]
    write_files(spark.createDataFrame([("a/b/c.md", "x")], "path string, content string"), f"file://{tmp_path}")
    assert (tmp_path / "a" / "b" / "c.md").read_text() == "x" and not [n for n in os.listdir(tmp_path) if n.startswith(".")]
    FolderWriter(str(tmp_path / "none")).abort([])


@pytest.mark.parametrize(
    ("value", "title"),
    [
        ("Title: Device with subtitles", "Device with subtitles"), ("Titles of nobility", "Titles of nobility"), ("title", "title"), ("TITLE :; Thing;", "Thing"),
        ("Applicants: A Title Ltd", "A Title Ltd"), ("International Filing Date: x", "x"), ("A device", "A device"),
    ],
)
def test_labels_stand_at_the_start(spark, value, title):
    row = spark.range(1).select(extraction.field_of(F.lit(f"(54) {value}\n(71) x"), "54").alias("t")).first()
    assert row.t == title


def test_text_layer_honours_its_steps(spark):
    pages = spark.createDataFrame([(1, 1, "configur-\nation “q”\n*\nx")], "doc_id long, page int, text string")
    assert process_text_layer(pages, Settings()).first().markdown == 'configuration\n"q"\nx\n'
    preset = PRESETS[0]
    for step in ("hyphen_merge", "special_char_normalize", "noise_removal"):
        preset = preset.toggled(step, False) if preset.enabled(step) else preset
    assert process_text_layer(pages, Settings(preset=preset)).first().markdown == "configur-\nation “q”\n*\nx\n"


def test_stream_notes_failed_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "good.txt").write_text("one")
    (tmp_path / "in" / "bad.docx").write_bytes(b"PK\x03\x04 nope")
    progress = Progress()
    convert_stream(watched(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"), once=True, progress=progress).awaitTermination()
    assert progress.failed == 1 and "bad.docx" in progress.last_error


def test_stream_archives_originals(spark, tmp_path):
    for name in ("in", "done"):
        (tmp_path / name).mkdir()

    def run(name):
        (tmp_path / "in" / name).write_text(name)
        convert_stream(watched(spark, str(tmp_path / "in"), str(tmp_path / "done")), str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()

    for name in ("a.txt", "b.txt", "c.txt"):
        run(name)
    rows = spark.read.parquet(str(tmp_path / "out")).select("path").collect()
    assert sorted(r.path.rpartition("/")[2] for r in rows) == ["a.txt", "b.txt", "c.txt"]
    kept = {f for _, _, names in os.walk(tmp_path / "done") for f in names if not f.startswith(".")}
    assert "a.txt" in kept


def test_context_is_found_after_ranking(spark):
    pages = spark.createDataFrame([(1, 1, "aa bb\ncc aa"), (1, 2, "aa")], "doc_id long, page int, text string")
    words = spark.createDataFrame([("bb",)], "word string")
    early = quality.suspicious_tokens(pages, words)
    late = quality.with_context(quality.suspicious_tokens(pages, words, context=False), pages)
    columns = ["doc_id", "page", "line", "place", "token", "context"]
    assert sorted(early.select(*columns).collect()) == sorted(late.select(*columns).collect()) and early.count() == 4


def test_vocabulary_from_a_corpus(spark):
    rows = [(1, 1, "The net, the NET"), (1, 2, "net"), (2, 1, "a net x1"), (3, 1, "Net the")]
    pages = spark.createDataFrame(rows, "doc_id long, page int, text string")
    assert sorted(map(tuple, quality.vocabulary_of(pages, 2).collect())) == [("net", 3), ("the", 2)]


def test_tables_are_detected_once(spark):
    grid = [(f"{r}|{c}", 0.1 + 0.3 * c, 0.9 - 0.05 * r) for r in range(3) for c in range(2)]
    result = process_scans(blocks(spark, [*grid, ("# Claims", 0.1, 0.1)]), Settings(preset=PRESETS[1]), spark.createDataFrame([("x",)], "word string"))
    plan = structured_files(result)._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan
    assert result.markdown.first().markdown.startswith("## Page 1\n\n# Claims\n\n| 0\\|0")


def test_lines_of_uneven_pages(spark):
    """Rows whose blocks drift: the first block of a line holds the others, not their neighbours."""
    rows = blocks(spark, [(str(k), 0.1 * k, 0.9 - 0.005 * k) for k in range(6)])
    assert layout.flow_text(rows).first().text == "0 1\n2 3\n4 5"
