"""Column functions against slow models in Python."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.formats.plain import clean_whitespace as model_clean
from quillmill.functions import extraction, tables, text
from quillmill.functions.hyphens import DEFAULT_RULES, hyphen_merger, read_compounds
from quillmill.operators.documents import dense_sheets
from quillmill.settings import PRESETS, Preset, Settings, corrections_from, presets_from


def column(spark, values, function):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in rows.select("k", function(F.col("v")).alias("x")).orderBy("k").select("x").collect()]


def test_whitespace_against_model(spark):
    rng = random.Random(1)
    values = ["".join(rng.choice(["a", " ", "\t", "\n", "\n\n", "　", "b "]) for _ in range(rng.randrange(14))) for _ in range(3000)]
    got = column(spark, values, text.clean_whitespace)
    assert got == [model_clean(v) for v in values]
    assert column(spark, got, text.clean_whitespace) == got


def test_marks(spark):
    assert column(spark, ["（a）！"], text.half_width) == ["(a)!"]
    assert column(spark, ["‘a’ “b” c–d—e «f» g… →"], text.plain_marks) == ["'a' \"b\" c-d-e \"f\" g... →"]
    assert column(spark, ["a\n * \n中\n—\n\nb", None], text.without_noise_lines) == ["a\n中\n\nb", None]
    assert column(spark, ["[00121 [0012 [0012| (0012] x\n(0013) (0014)", "(0001) a"], text.fix_paragraph_brackets) == [
        "[0012] [0012] [0012] [0012] x\n[0013] (0014)", "\n[0001] a"]


def test_corrections(spark):
    held = corrections_from('{"word_replacements": {"ab": "1", "abc": "2"}, "spaced_words": {"x y": "xy"}, "pattern_replacements": '
                            '[{"pattern": "(Q)+", "replacement": "$1", "case_insensitive": true}, {"pattern": "(", "replacement": ""}], "whitelist": 3}')  # fmt: skip
    assert column(spark, ["qQq"], lambda c: text.corrected(c, held)) == ["q"]
    assert column(spark, ["abc ab x y (c.g. loT z"], lambda c: text.corrected(c, held)) == ["2 1 xy (e.g. IoT z"]
    assert len(held.patterns) == 1 and not held.whitelist
    assert corrections_from("[]").patterns == () and corrections_from("{").word_replacements == {}


@pytest.mark.parametrize(
    ("before", "after"),
    [
        ("configur-\nation x", "configuration\nx"),
        ("RELAT-\nED", "RELATED"),
        ("Rel-\n17 y", "Rel-17\ny"),
        ("semi-\nstatic", "semi-\nstatic"),
        ("over-\nall", "over-\nall"),
        ("a-\n\nb", "a-\n\nb"),
        ("con-\nfigu-\nration", "configu\nration"),
        ("x\ny", "x\ny"),
    ],
)
def test_hyphens(before, after):
    assert DEFAULT_RULES.merged(before) == after


@given(st.text(alphabet="ab-\n A1", max_size=40))
@settings(max_examples=300, deadline=None)
def test_hyphens_never_add_lines(value):
    merged = DEFAULT_RULES.merged(value)
    assert merged.count("\n") <= value.count("\n")
    assert [c for c in merged if c.isalnum()] == [c for c in value if c.isalnum()]


def test_hyphen_column_and_words(spark):
    assert column(spark, ["a-\nb", None, "x"], hyphen_merger()) == ["ab", None, "x"]
    assert read_compounds([" my-word ", "# no", ""])[-1] == "my-word"


def test_tables(spark):
    rows = spark.createDataFrame([([["a", "b|"], ["1\n2"]],), ([],), (None,)], "r array<array<string>>")
    got = [r[0] for r in rows.select(tables.markdown_table(F.col("r"), tables.CSV)).collect()]
    assert got == ["| a | b\\| |\n| --- | --- |\n| 1<br>2 |  |\n", "", ""]
    assert rows.limit(1).select(tables.markdown_table(F.col("r"), tables.WEB, F.lit(False))).first()[0].startswith("|  |  |\n| --- | --- |\n| a |")
    cells = spark.createDataFrame([(1, 0, 1, "x"), (1, 2, 0, "y"), (1, 3, 0, ""), (2, 0, 0, None)], "s int, row int, col int, value string")
    assert [tuple(r) for r in dense_sheets(cells, ["s"]).collect()] == [(1, [["", "x"], ["", ""], ["y", ""]])]
    pairs = spark.createDataFrame([([("a", "b|c")],)], "p array<struct<property:string,value:string>>")
    assert pairs.select(tables.property_table(F.col("p"))).first()[0] == "| Property | Value |\n| --- | --- |\n| a | b\\|c |\n"


def test_names(spark):
    assert column(spark, ["A1", "ZZ3", "7"], lambda c: text.column_index(c)) == [0, 701, -1]
    numbers = spark.range(20000).select(F.col("id").cast("int").alias("k"))
    back = numbers.filter(text.column_index(text.column_letters(F.col("k"))) != F.col("k"))
    assert back.filter("k < 18278").count() == 0
    assert column(spark, ['a;b;"c,,,"', "a,b", ""], text.delimiter_of) == [";", ",", ","]
    assert column(spark, ["<h1> <b>x</b></h1><title>t</title>", "<h1></h1><TITLE>t</TITLE>", "n"], text.title_in_html) == ["x", "t", None]


def test_extraction(spark):
    claims = ["a\n## Claims\n1. x\n# Abstract\ny", "b\n\n1. An x\nDrawings\nz", "what is claimed is:\n1", "none", "CLAIMS\n1. x\nabstract"]
    assert column(spark, claims, extraction.claims_of) == ["## Claims\n1. x", "1. An x\nDrawings\nz", "what is claimed is:\n1", "", "CLAIMS\n1. x"]
    found = column(spark, ["pre [0001] a [0002]  [0003]b\n", ""], extraction.paragraphs_of)
    assert [(p.para_id, p.text) for p in found[0]] == [("0001", "a"), ("0003", "b")] and found[1] == []
    cover = "( 22 ) 2024-03-15\n(54) Title: A device\n(71) Applicants: X\n(72) A; B\n(51) H04W 36/00, G06F 15/16 H04W 36/00\n(43) March 5, 2024\n(32) none\nWO 2024/123456"
    row = column(spark, [cover], extraction.cover_of)[0]
    assert (row.filing_date, row.title, row.applicant, row.inventors) == ("2024-03-15", "A device", "X", ["A", "B"])
    assert row.classification == ["H04W 36/00", "G06F 15/16"] and row.publication_date == "March 5, 2024"
    assert (row.application_number, row.priority_date, row.designated_states) == ("WO 2024/123456", "none", None)


def test_settings():
    assert Settings().half_width and not Settings(primary_language="zh-Hans").half_width and Settings(punctuation="half", primary_language="zh").half_width
    default = PRESETS[0]
    assert default.enabled("hyphen_merge") and not default.enabled("nothing") and not default.toggled("hyphen_merge", False).enabled("hyphen_merge")
    assert Preset.from_json(default.to_json()) == default and PRESETS[1].file_name == "patent-3gpp.json"
    assert [p.name for p in presets_from({"a.json": "{", "b.txt": "x"})] == ["Default", "Patent-3GPP", "Technical-Spec"]
    assert presets_from({"a.json": PRESETS[2].to_json()}) == [PRESETS[2]]
    assert PRESETS[1].parameter("structured_output", "extract_claims") == "true"
