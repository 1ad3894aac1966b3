"""Results to files: one file a row, folders of structured outputs, and tables."""

from __future__ import annotations

import os
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.window import Window

from ..formats.books import chapter_files, read_book
from ..formats.errors import ConversionError
from ..formats.word import word_assets
from ..plans.scans import ScanResult
from ..settings import Preset
from ..sources.kinds import base_name, with_kind


@dataclass
class FileWritten(WriterCommitMessage):
    count: int


def _folder(place: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, by its URI or as a local path, and the folder's path there."""
    if "://" in place or place.startswith("file:"):
        return fs.FileSystem.from_uri(place)
    return fs.LocalFileSystem(), os.path.abspath(place)


class FolderWriter(DataSourceWriter):
    """Writes rows (path, content) as files below a folder that all executors reach: a path, or a URI of an object store.

    A file is written to a staging folder of the job and then moved into place, so a repeated task leaves whole files. The
    staging folder goes when the job ends, also when it fails.
    """

    def __init__(self, folder: str):
        self.folder = folder
        self.staging = f".staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        system, top = _folder(self.folder)
        system.create_dir(f"{top}/{self.staging}", recursive=True)
        made: set[str] = set()
        count = 0
        for row in iterator:
            path = posixpath.normpath(row["path"].lstrip("/"))
            if path.startswith("..") or path == ".":
                raise ValueError(f"{row['path']} lies outside the folder")
            place = f"{top}/{path}"
            if (parent := posixpath.dirname(place)) not in made:
                system.create_dir(parent, recursive=True)
                made.add(parent)
            held = f"{top}/{self.staging}/{uuid.uuid4().hex}"
            with system.open_output_stream(held) as file:
                file.write(bytes(row["content"] or b""))
            system.move(held, place)
            count += 1
        return FileWritten(count)

    def _cleared(self) -> None:
        system, top = _folder(self.folder)
        if system.get_file_info(f"{top}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{top}/{self.staging}")

    def commit(self, messages: list) -> None:
        self._cleared()

    def abort(self, messages: list) -> None:
        self._cleared()


class FolderSource(DataSource):
    """The format ``quillmill_files``: option ``path`` names a folder, or its URI."""

    @classmethod
    def name(cls) -> str:
        return "quillmill_files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FolderWriter(self.options["path"])


def write_files(rows: DataFrame, folder: str) -> None:
    """Rows (path, content) as files below ``folder``; existing ones are replaced."""
    rows.sparkSession.dataSource.register(FolderSource)
    rows.select("path", F.col("content").cast("binary").alias("content")).write.format("quillmill_files").mode("append").save(folder)


def _bare(path: Column) -> Column:
    return F.regexp_replace(path, r"^[a-zA-Z][a-zA-Z0-9+.-]*:/*(?=/)", "")


def _root_of(rows: DataFrame, root: str | None) -> str:
    """``root`` as it begins paths, or the deepest folder that all paths share."""
    if root is not None:
        return re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:/*(?=/)", "", root).rstrip("/") + "/"
    low, high = rows.agg(F.min(_bare(F.col("path"))), F.max(_bare(F.col("path")))).first()
    return os.path.commonprefix([low or "", high or ""]).rpartition("/")[0] + "/"


def _below(path: Column, root: str) -> Column:
    """A path below the root."""
    bare = _bare(path)
    inner = F.when(F.startswith(bare, F.lit(root)), F.substr(bare, F.lit(len(root) + 1))).otherwise(bare)
    return F.regexp_replace(inner, "^/+", "")


def markdown_files(results: DataFrame, root: str | None = None) -> DataFrame:
    """(path, content) of the successes of a conversion: each file's path below ``root`` with the ending .md.

    Without ``root`` paths start below the deepest folder that all share, which takes a pass over ``results``. Files of one
    folder whose names differ only in their extensions keep these: a.txt.md, a.docx.md.
    """
    root = _root_of(results, root)
    below = _below(F.col("path"), root)
    rows = results.filter("status = 'success'").select(below.alias("whole"), F.regexp_replace(below, r"(?<=[^/])\.[^./]*$", "").alias("stem"), "markdown")
    alone = F.count("*").over(Window.partitionBy("stem")) == 1
    return rows.select(F.concat(F.when(alone, F.col("stem")).otherwise(F.col("whole")), F.lit(".md")).alias("path"), F.col("markdown").alias("content"))


def structured_files(result: ScanResult, name: Column | None = None) -> DataFrame:
    """(path, content): for each document a folder with its text, claims, paragraphs, cover data, raw text and report."""
    folder = F.col("doc_id").cast("string") if name is None else name

    def at(rows: DataFrame, file: str, content: Column) -> DataFrame:
        return rows.select(F.concat(folder, F.lit(f"/{file}")).alias("path"), content.alias("content"))

    def listed(rows: DataFrame, order: list, line: Column, between: str) -> DataFrame:
        held = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("line_text")))).alias("held"))
        return held.select("doc_id", F.array_join(F.transform("held", lambda x: x["line_text"]), between).alias("content"))

    out = at(result.markdown, "full.md", F.col("markdown"))
    section = F.concat(F.lit("## Page "), F.col("page").cast("string"), F.lit("\n\n"), "raw", F.lit("\n\n"))
    out = out.unionByName(at(listed(result.pages, ["page"], section, ""), "raw_ocr.txt", F.col("content")))
    if result.claims is not None:
        out = out.unionByName(at(result.claims.filter("claims <> ''"), "claims.md", F.col("claims")))
    if result.paragraphs is not None:
        line = F.to_json(F.struct("page", "para_id", "text"))
        out = out.unionByName(at(listed(result.paragraphs, ["page", "para_id"], line, "\n"), "paragraphs.jsonl", F.col("content")))
    if result.cover is not None:
        fields = sorted(c for c in result.cover.columns if c != "doc_id")
        out = out.unionByName(at(result.cover, "metadata.json", F.to_json(F.struct(*fields), {"pretty": "true"})))
    if result.report is not None:
        out = out.unionByName(at(result.report, "quality_report.txt", F.col("report")))
    return out


def preset_files(presets: list[Preset], spark: SparkSession) -> DataFrame:
    """(path, content) of presets as JSON files."""
    return spark.createDataFrame([(p.file_name, p.to_json()) for p in presets], "path string, content string")


def _companions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for kind, name, content, source in zip(*(batch.column(k) for k in range(4)), strict=True):
            try:
                if kind.as_py() == "docx":
                    found = word_assets(content.as_py(), name.as_py())
                else:
                    found = [(path, text.encode()) for path, text in chapter_files(read_book(content.as_py(), name.as_py()))]
            except ConversionError:
                continue  # the conversion itself reports it
            if found:
                columns = [*zip(*found, strict=True), [source.as_py()] * len(found)]
                types = (pa.string(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["path", "content", "source"])


def companion_files(files: DataFrame, root: str | None = None) -> DataFrame:
    """(path, content) beside the Markdown: the images of Word documents, and books as an index with a file a chapter.

    They lie in the folders of their documents below ``root`` (see markdown_files). Where two documents of one folder
    would share a folder, such as books of one title, each has its file's name added.
    """
    root = _root_of(files, root)
    rows = with_kind(files.select("path", "content")).filter("kind IN ('docx', 'epub')")
    rows = rows.select("kind", base_name(F.col("path")).alias("name"), "content", _below(F.col("path"), root).alias("source"))
    made = rows.mapInArrow(_companions, "path string, content binary, source string")
    place = F.regexp_extract("source", r"^(.*/)?[^/]*$", 1)
    made = made.withColumn("folder", F.concat(place, F.substring_index("path", "/", 1)))
    rest = F.regexp_replace("path", "^[^/]*", "")
    one = F.min("source").over(Window.partitionBy("folder")) == F.max("source").over(Window.partitionBy("folder"))
    named = F.when(one, F.col("folder")).otherwise(F.concat("folder", F.lit(" ("), F.regexp_extract("source", r"([^/]*)$", 1), F.lit(")")))
    return made.withColumn("named", named).select(F.concat("named", rest).alias("path"), "content")


def write_table(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Rows as Parquet, in folders by the columns ``by``: the form for corpora too large for a file a document."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
