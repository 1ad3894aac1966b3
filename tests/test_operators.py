"""Layout, quality, documents, conversion, sinks, streams and the command line."""

import os

import pytest
from pyspark.sql import functions as F

from quillmill import cli
from quillmill.formats.styled import Run, runs_to_markdown
from quillmill.operators import documents, layout, quality
from quillmill.plans.convert import convert, exit_code, jobs
from quillmill.plans.scans import process_images, process_scans, process_text_layer
from quillmill.settings import PRESETS, Settings
from quillmill.sinks.files import companion_files, markdown_files, preset_files, structured_files, write_files
from quillmill.sources import files as sources
from quillmill.sources.kinds import EXTENSIONS, with_kind
from quillmill.streaming.folders import convert_stream, watched

from . import builders as b

BLOCKS = "doc_id long, page int, idx int, text string, confidence double, x double, y double, w double, h double"


def blocks(spark, rows):
    return spark.createDataFrame([(1, 1, k, t, 0.9, x, y, 0.1, 0.01) for k, (t, x, y) in enumerate(rows)], BLOCKS)


def test_lines_hold_to_their_first_block(spark):
    rows = blocks(spark, [("a", 0.1, 0.900), ("b", 0.3, 0.893), ("c", 0.2, 0.889), ("d", 0.1, 0.5)])
    centred = layout.with_centres(rows).withColumn("col", F.lit(0))
    got = [(r.line, r.text) for r in layout.lines_of(centred, ["doc_id", "page", "col"]).orderBy("line").collect()]
    assert got == [(1, "a b"), (2, "c"), (3, "d")]


def test_columns_and_guards(spark):
    two = blocks(spark, [("l1", 0.05, 0.9), ("r1", 0.6, 0.9), ("l2", 0.05, 0.8), ("r2", 0.6, 0.8)])
    assert layout.flow_text(two).first().text == "l1\nl2\n\n---\n\nr1\nr2"
    lopsided = blocks(spark, [("l", 0.05, 0.9 - k / 50) for k in range(9)] + [("r", 0.6, 0.9)])
    assert "---" not in layout.flow_text(lopsided).first().text
    assert "---" in layout.flow_text(lopsided, F.lit(True)).first().text
    many = blocks(spark, [(str(k), k * 0.2, 0.9) for k in range(5)])
    assert layout.flow_text(many).first().text == "0 1 2 3 4"


def test_tables_on_pages(spark):
    grid = [(f"{r}|{c}", 0.1 + 0.3 * c, 0.9 - 0.05 * r) for r in range(3) for c in range(2)]
    rows = blocks(spark, [*grid, ("tail", 0.1, 0.1)])
    found = layout.detect_tables(rows).first()
    assert found.markdown == "| 0\\|0 | 0\\|1 |\n| --- | --- |\n| 1\\|0 | 1\\|1 |\n| 2\\|0 | 2\\|1 |\n"
    assert layout.page_text(rows).first().text == "tail\n\n" + found.markdown
    assert layout.page_text(rows, image=True).first().text.startswith("tail")
    assert layout.detect_tables(blocks(spark, grid[:4])).count() == 0
    shifted = [*grid[:4], ("x", 0.2, 0.8), ("y", 0.5, 0.8)]
    assert layout.detect_tables(blocks(spark, shifted)).count() == 0
    assert layout.detect_tables(blocks(spark, [])).count() == 0


def test_scans_end_to_end(spark):
    rows = blocks(spark, [("# Claims", 0.1, 0.9), ("1. A configur-", 0.1, 0.8), ("ation mcthod [0001 x", 0.1, 0.7), ("(54) Title: Thing", 0.1, 0.6)])
    vocabulary = spark.createDataFrame([("title",), ("thing",), ("claims",)], "word string")
    held = Settings(preset=PRESETS[1], corrections=Settings().corrections.__class__(word_replacements={"mcthod": "method"}))
    result = process_scans(rows, held, vocabulary)
    assert result.markdown.first().markdown == "## Page 1\n\n# Claims\n1. A configuration\nmethod [0001] x\n(54) Title: Thing\n"
    assert result.claims.first().claims.startswith("# Claims")
    assert result.paragraphs.first().text == "x\n(54) Title: Thing"
    assert result.cover.first().title == "Thing"
    assert [tuple(r)[2:] for r in result.corrections.collect()] == [("mcthod", "method")]
    report = result.report.first().report
    assert "Pages processed: 1" in report and "Page 1: avg 0.90 ✓" in report and "mcthod → method (1 occurrence)" in report
    paths = {r.path for r in structured_files(result).collect()}
    assert paths == {f"1/{n}" for n in ("full.md", "raw_ocr.txt", "claims.md", "paragraphs.jsonl", "metadata.json", "quality_report.txt")}
    assert process_scans(rows, Settings(preset=PRESETS[2])).claims is None


def test_text_layer(spark):
    pages = spark.createDataFrame([(1, 2, "b “q”"), (1, 1, "a"), (1, 3, " \n")], "doc_id long, page int, text string")
    assert process_text_layer(pages, Settings()).first().markdown == 'a\n\n---\n\nb "q"\n'


def test_quality(spark):
    pages = spark.createDataFrame([(1, 1, "The qzx, UE 38.331 (word)\nqzx a"), (1, 2, "")], "doc_id long, page int, text string")
    vocabulary = spark.createDataFrame([("the",), ("word",)], "word string")
    found = quality.suspicious_tokens(pages, vocabulary).orderBy("line", "place").collect()
    assert [(r.line, r.place, r.token, r.context) for r in found] == [(1, 2, "qzx", "The qzx, UE 38.331 (word)"), (2, 1, "qzx", "qzx a")]
    row = quality.summary(pages, quality.suspicious_tokens(pages, vocabulary)).first()
    assert (row.pages, row.words, row.suspicious, row.suspicious_percent) == (2, 7, 2, "28.57")
    terms = spark.createDataFrame([("qzx",)], "term string")
    assert quality.suspicious_tokens(pages, vocabulary, terms).count() == 0


def test_styled_runs_agree(spark):
    runs = [Run(0, "Big", 24, True), Run(1, "• a ", 12), Run(1, "b", 12, False, True), Run(2, "1) c", 12, True, True), Run(3, "x", 12, link="u"), Run(3, " long enough body text", 12)]
    rows = [(1, r.paragraph, k, r.text, float(r.size), r.bold, r.italic, r.link or None) for k, r in enumerate(runs)]
    frame = spark.createDataFrame(rows, "doc_id long, para int, pos int, text string, font_size double, bold boolean, italic boolean, link string")
    assert documents.styled_to_markdown(frame).first().markdown == runs_to_markdown(runs)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("in")
    held = {"a.txt": b"x  \n", "b.docx": b.docx(b.para("w")), "c.odt": b.odt("<text:p>o</text:p>"), "d.zip": b.pack({"in/e.txt": "z", "f.odt": b.odt("<text:p>q</text:p>"),
            "g.zip": "no", ".h.txt": "no", "i.docx": "broken"}), "noext": b"%PDF-1.7", "j.ppt": bytes.fromhex("D0CF11E0A1B11AE1"), "k.csv": b" ", ".hidden.txt": b"no", "l.exe": b"x"}
    for name, data in held.items():
        (top / name).write_bytes(data)
    return str(top)


def test_convert_folder(spark, folder):
    got = {r.path.split(f"{os.path.basename(folder)}/", 1)[1]: r for r in convert(sources.read_supported(spark, folder)).collect()}
    states = {k: (r.kind, r.status, r.error) for k, r in got.items()}
    assert states == {
        "a.txt": ("txt", "success", None), "b.docx": ("docx", "success", None), "c.odt": ("odt", "success", None), "d.zip/in/e.txt": ("txt", "success", None),
        "d.zip/f.odt": ("odt", "success", None), "d.zip/i.docx": ("docx", "failed", "unzip_failed"), "j.ppt": ("ppt", "unsupported", "needs_outside_engine"),
        "k.csv": ("csv", "failed", "empty_input"),
    }
    assert got["d.zip/f.odt"].markdown == "q\n"


def test_kinds(spark):
    rows = spark.createDataFrame([("x/noext", bytearray(b"%PDF-1")), ("a.TXT", bytearray(b"BMx")), ("b.odt", bytearray(b"PK\x03\x04")), ("c.jpeg", bytearray(b"\xff\xd8\xff")),
                                  ("d.md", None)], "path string, content binary")
    assert [r.kind for r in with_kind(rows).collect()] == ["pdf", "bmp", "odt", "jpeg", "md"]
    assert len(EXTENSIONS) == 35


def test_jobs_sinks_and_archives(spark, folder, tmp_path):
    results = convert(sources.read_files(spark, f"{folder}/a.txt", f"{folder}/k.csv"))
    assert {(r.file_name, r.status, r.error) for r in jobs(results).collect()} == {("a.txt", "success", None), ("k.csv", "failed", "empty_input")}
    assert exit_code(results) == 1 and exit_code(results.filter("status = 'success'")) == 0
    write_files(markdown_files(results), str(tmp_path))
    assert os.listdir(tmp_path) == ["a.md"] and (tmp_path / "a.md").read_text() == "x\n"
    bad = spark.createDataFrame([("x.zip", bytearray(b"PK nope"))], "path string, content binary")
    assert sources.archive_entries(bad).first().error
    broken = spark.createDataFrame([("x.zip", bytearray(b"PK\x03\x04 nope"))], "path string, content binary")
    assert convert(broken).first().error == "unzip_failed"


def test_stream_converts_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one")
    (tmp_path / "in" / "b.exe").write_text("no")

    (tmp_path / "words.json").write_text('{"word_replacements": {"a": "b"}}')
    seen = []

    def run():
        query = convert_stream(
            watched(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"), dictionary=str(tmp_path / "words.json"),
            also=lambda rows, number, held: seen.append((rows.count(), held.corrections.word_replacements)), once=True,
        )
        query.awaitTermination()

    run()
    (tmp_path / "in" / "c.md").write_text("two")
    run()
    run()
    rows = spark.read.parquet(str(tmp_path / "out")).select("path", "markdown").collect()
    assert sorted((r.path.rpartition("/")[2], r.markdown) for r in rows) == [("a.txt", "one\n"), ("c.md", "two\n")]
    assert seen == [(1, {"a": "b"}), (1, {"a": "b"})]


def test_command_line(spark, folder, tmp_path, capsys):
    assert cli.main(["--list-formats"], spark) == 0
    assert capsys.readouterr().out.split() == sorted(EXTENSIONS)
    assert cli.main([], spark) == 2 and cli.main(["-x"], spark) == 2 and cli.main(["-"], spark) == 2
    assert cli.main(["-o", str(tmp_path / "o.md"), f"{folder}/a.txt", f"{folder}/b.docx"], spark) == 2
    assert cli.main(["-o", "-", f"{folder}/a.txt"], spark) == 0
    assert capsys.readouterr().out == "x\n"
    assert cli.main(["-o", str(tmp_path / "o.md"), f"{folder}/b.docx"], spark) == 0 and (tmp_path / "o.md").read_text() == "w\n"
    (tmp_path / "empty.txt").touch()
    assert cli.main([str(tmp_path / "empty.txt")], spark) == 1
    assert cli.main([f"{folder}/none.txt"], spark) == 1 and cli.main(["-o", "-", f"{folder}/k.csv"], spark) == 1


def test_lists_books_mails(spark):
    items = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "d int, p int, t string")
    got = documents.list_markers(items, ["d"], ["p"], F.lit(True), F.lit(1), F.lit(5)).orderBy("p").collect()
    assert [r.marker for r in got] == ["  5. ", "  6. "]
    mails = spark.createDataFrame([("1", "Subject: a\r\n b\r\nTo: x: y\r\n\r\nbody\n\nmore"), ("2", "no headers")], "id string, content string")
    first, second = documents.mail_headers(mails).orderBy("id").collect()
    assert [tuple(h) for h in first.headers] == [("Subject", "a b"), ("To", "x: y")] and first.body == "body\n\nmore"
    assert second.headers == [] and second.body == ""


def test_images_with_text(spark):
    images = spark.createDataFrame([(1, "pic", [("ImageSize", "1 × 2")]), (2, "none", []), (3, "only", [])], "doc_id long, name string, properties array<struct<property:string,value:string>>")
    rows = blocks(spark, [("right", 0.6, 0.9), ("left [0001 x", 0.1, 0.9), ("low", 0.1, 0.5)])
    got = {r.doc_id: (r.status, r.markdown) for r in process_images(images, rows, Settings()).collect()}
    assert got[1] == ("success", "# pic\n\n| Property | Value |\n| --- | --- |\n| ImageSize | 1 × 2 |\n\n---\n\nleft [0001] x\nright\nlow\n")
    assert got[2] == ("failed", None)


def test_companions_and_presets(spark, tmp_path):
    relations = '<Relationship Id="i" Type="x/image" Target="media/p.png"/>'
    word = b.docx(b.para("w"), relations=relations, **{"word/media/p.png": b"\x89png"})
    book = b.epub({"a.xhtml": "<h1>One</h1>"}, '<itemref idref="c0"/>')
    files = spark.createDataFrame([("in/w.docx", bytearray(word)), ("in/b.epub", bytearray(book)), ("in/x.docx", bytearray(b"PK"))], "path string, content binary")
    write_files(companion_files(files), str(tmp_path))
    assert (tmp_path / "w_assets" / "p.png").read_bytes() == b"\x89png"
    assert (tmp_path / "Book" / "index.md").read_text().endswith("- [One](01_One.md)\n")
    write_files(preset_files(list(PRESETS), spark), str(tmp_path))
    assert (tmp_path / "technical-spec.json").exists()
    with pytest.raises(Exception, match="outside"):
        write_files(spark.createDataFrame([("../x", "y")], "path string, content string"), str(tmp_path))
