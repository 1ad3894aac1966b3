"""Files to Markdown: one map over the rows that takes each by its kind. Failures are rows, never failed tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..formats import books, html, images, mail, opendocument, outlook, plain, sheets, slides, styled, word
from ..formats.errors import ConversionError
from ..settings import Settings
from ..sources.files import entries_in, slices
from ..sources.kinds import EXTENSIONS, base_name, extension_in, kind_in, name_in, with_kind

RESULT = "path string, kind string, status string, error string, message string, markdown string"

Reader = Callable[[bytes, str], str]

READERS: dict[str, Reader] = {
    **dict.fromkeys(("html", "htm"), lambda data, name: page_to_markdown(data)),
    **dict.fromkeys(("md", "markdown"), lambda data, name: plain.text_to_markdown(data, "md")),
    **dict.fromkeys(("mobi", "azw", "azw3"), lambda data, name: books.mobi_to_markdown(data)),
    "txt": lambda data, name: plain.text_to_markdown(data),
    "csv": lambda data, name: plain.csv_to_markdown(data, name),
    "tsv": lambda data, name: plain.csv_to_markdown(data, name, "tsv"),
    "json": plain.json_to_markdown,
    "xml": plain.xml_to_markdown,
    "ipynb": plain.notebook_to_markdown,
    "eml": lambda data, name: mail.mail_to_markdown(data),
    "msg": lambda data, name: outlook.outlook_to_markdown(data),
    "docx": word.word_to_markdown,
    "pptx": lambda data, name: slides.slides_to_markdown(data),
    "xlsx": lambda data, name: sheets.sheets_to_markdown(data),
    "odt": lambda data, name: opendocument.open_to_markdown(data),
    "epub": books.epub_to_markdown,
    "rtf": lambda data, name: styled.rich_text_to_markdown(data),
    **dict.fromkeys(
        ("png", "jpg", "jpeg", "tif", "tiff", "gif", "bmp", "webp"), lambda data, name: image_to_markdown(data, name)
    ),
}
#: Kinds whose text only an outside engine can read: page text, recognised text, or styled runs come as tables.
OUTSIDE = frozenset(["pdf", "doc", "ppt", "xls", "heic", "heif"])


def page_to_markdown(data: bytes, escape_pipes: bool = True) -> str:
    if not data:
        raise ConversionError("empty_input")
    return html.bytes_to_markdown(data, escape_pipes=escape_pipes)


def image_to_markdown(data: bytes, name: str) -> str:
    """An image's title and metadata; its text comes from a table of recognised blocks (see layout)."""
    properties = images.image_properties(data)
    if not properties:
        raise ConversionError("image_without_content")
    return f"# {name}\n\n{images.property_table(properties)}\n"


def convert_one(kind: str | None, data: bytes | None, name: str, escape_pipes: bool = True) -> tuple[str, str | None, str | None, str | None]:
    """(status, error, message, markdown); status is success, failed or unsupported."""
    if kind in OUTSIDE:
        return "unsupported", "needs_outside_engine", f"{kind} needs an outside engine", None
    reader = READERS.get(kind or "")
    if reader is None:
        return "unsupported", "unsupported_format", f"no reader for {kind or 'files without extension'}", None
    try:
        if kind in ("html", "htm"):
            return "success", None, None, page_to_markdown(data or b"", escape_pipes)
        return "success", None, None, reader(data or b"", name)
    except ConversionError as e:
        return "failed", e.code, str(e), None
    except (RecursionError, MemoryError, ValueError, KeyError, IndexError, TypeError, AttributeError, OverflowError) as e:
        return "failed", "malformed", f"{type(e).__name__}: {e}", None


def _rows(path: str | None, kind: str | None, name: str | None, content: bytes | None, escape_pipes: bool) -> Iterator[tuple]:
    """A file's row of RESULT, or one for each convertible entry of an archive and for each that can't be unpacked."""
    if kind != "zip":
        yield (path, kind, *convert_one(kind, content, name or "", escape_pipes))
        return
    for entry, data, error in entries_in(content or b""):
        whole = entry if path is None else f"{path}/{entry}"
        if error is not None:
            yield whole, extension_in(whole), "failed", "unzip_failed", error, None
        elif (known := extension_in(entry)) in EXTENSIONS and known != "zip":
            found = kind_in(whole, data)
            yield (whole, found, *convert_one(found, data, name_in(whole), escape_pipes))


def convert_batches(batches: Iterator[pa.RecordBatch], escape_pipes: bool = True) -> Iterator[pa.RecordBatch]:
    """Batches of (path, kind, name, content) to RESULT, in pieces whose Markdown stays small."""
    names = [c.split()[0] for c in RESULT.split(", ")]
    for batch in batches:
        rows, held = [], 0
        for piece in slices(batch):
            for file in zip(*(piece.column(k).to_pylist() for k in range(4)), strict=True):
                for row in _rows(*file, escape_pipes):
                    rows.append(row)
                    held += len(row[-1] or "")
                    if held > 4 << 20 or len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names)


def convert(files: DataFrame, settings: Settings | None = None, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """``files`` (path, content) as rows of RESULT; archives give a row for each convertible entry.

    One map without shuffle: ``files`` is computed once, and archives are unpacked entry by entry where they are read. Of
    the settings, ``escape_pipes`` says whether pipes in web tables are protected.
    """
    escape_pipes = settings is None or settings.escape_pipes
    rows = with_kind(files.select(F.col(path_col).alias("path"), F.col(content_col).alias("content")))
    rows = rows.select("path", "kind", base_name(F.col("path")).alias("name"), "content")
    return rows.mapInArrow(lambda batches: convert_batches(batches, escape_pipes), RESULT)


def jobs(results: DataFrame) -> DataFrame:
    """Job records: path, file_name, status, output_path, error."""
    return results.select(
        "path", F.regexp_extract("path", r"([^/]*)$", 1).alias("file_name"), "status",
        F.when(F.col("status") == "success", F.concat(F.regexp_replace("path", r"\.[^./]*$", ""), F.lit(".md"))).alias("output_path"), "error",
    )


def exit_code(results: DataFrame) -> int:
    """0 if all rows are successes, else 1."""
    return int(results.filter("status <> 'success'").limit(1).count() > 0)


@dataclass(frozen=True)
class Supported:
    """What can be converted inside, and what needs an outside engine's tables."""

    inside: tuple[str, ...] = tuple(e for e in EXTENSIONS if e in READERS or e == "zip")
    outside: tuple[str, ...] = tuple(e for e in EXTENSIONS if e in OUTSIDE)
