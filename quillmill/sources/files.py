"""Files as rows: folders and globs, one buffer, archives, JSON settings and page tables."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kinds import EXTENSIONS, extension_of

FILES = "path string, modificationTime timestamp, length long, content binary"


def read_files(spark: SparkSession, *paths: str, recursive: bool = False) -> DataFrame:
    """Files at paths or globs: path, modificationTime, length, content. Only what is selected is read.

    Spark's source leaves files of no bytes out.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(list(paths))


def read_supported(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """The folder's files with a known extension, hidden ones left out; others are never opened."""
    glob = "*.{" + ",".join(sorted({v for e in EXTENSIONS for v in (e, e.upper())})) + "}"
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob)
    files = reader.load(folder)
    return files.filter(~F.rlike(F.col("path"), F.lit(r"/\.[^/]*$")) & extension_of(F.col("path")).isin(*EXTENSIONS))


def from_buffer(spark: SparkSession, data: bytes, extension: str) -> DataFrame:
    """One file from bytes, such as standard input, under a hinted extension."""
    name = f"stdin.{extension.lower().strip('.')}"
    return spark.createDataFrame([(name, None, len(data), bytearray(data))], FILES)


def entries_in(data: bytes) -> Iterator[tuple[str, bytes | None, str | None]]:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            for info in archive.infolist():
                if info.is_dir() or any(p.startswith((".", "__MACOSX")) for p in info.filename.split("/")):
                    continue
                try:
                    yield info.filename, archive.read(info), None
                except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError, OSError) as e:
                    yield info.filename, None, str(e) or type(e).__name__
    except (zipfile.BadZipFile, NotImplementedError, ValueError, OSError) as e:
        yield "", None, str(e) or type(e).__name__


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "entry", "content", "error"]
    types = [pa.string(), pa.string(), pa.binary(), pa.string()]
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            rows, held = [], 0
            for entry in entries_in(content.as_py() or b""):
                rows.append((path.as_py(), *entry))
                held += len(entry[1] or b"")
                if held > 32 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def archive_entries(archives: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """The entries of zip archives: path, entry, content, error. Hidden entries and folders are left out; an archive
    that can't be read is one row with an error."""
    return archives.select(path_col, content_col).mapInArrow(_explode, "path string, entry string, content binary, error string")


def batch_of(archives: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """The convertible entries of archives as files named archive/entry; nested archives are left out, errors stay."""
    rows = archive_entries(archives, path_col, content_col)
    known = extension_of(F.col("entry"))
    kept = rows.filter(F.col("error").isNotNull() | (known.isin(*EXTENSIONS) & (known != "zip")))
    return kept.select(F.concat_ws("/", "path", "entry").alias("path"), "content", "error")


def slices(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most 1,024 rows and about ``most`` bytes, so that few values are Python objects at once."""
    step = max(1, min(1024, most * batch.num_rows // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A word list: one a line, blank lines and # comments left out."""
    lines = spark.read.text(path).select(F.trim("value").alias("word"))
    return lines.filter((F.col("word") != "") & ~F.startswith(F.col("word"), F.lit("#")))


def read_small_texts(spark: SparkSession, glob: str) -> dict[str, str]:
    """Small settings files by name, such as presets or a dictionary."""
    rows = spark.read.text(glob, wholetext=True).select(F.input_file_name().alias("path"), "value").collect()
    return {r.path.rpartition("/")[2]: r.value for r in rows}
