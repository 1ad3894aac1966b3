"""Kinds of files: known extensions, leading bytes, and families that share a container."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The extensions that can be converted.
EXTENSIONS = (
    "docx", "doc", "pdf", "pptx", "ppt", "xlsx", "rtf", "html", "htm", "txt", "md", "markdown", "odt", "epub", "mobi", "azw", "azw3",
    "eml", "msg", "png", "jpg", "jpeg", "heic", "heif", "tiff", "tif", "bmp", "gif", "webp", "csv", "tsv", "json", "xml", "ipynb", "zip",
)

#: Leading bytes in hexadecimal, and the kind that they mean.
SIGNATURES = (
    ("25504446", "pdf"),
    ("504B0304", "zip"),
    ("D0CF11E0A1B11AE1", "msg"),
    ("89504E47", "png"),
    ("FFD8FF", "jpg"),
    ("47494638", "gif"),
    ("424D", "bmp"),
    ("49492A00", "tiff"),
    ("4D4D002A", "tiff"),
    ("7B5C727466", "rtf"),
)
BRANDS = ("heic", "heix", "mif1", "msf1", "heim", "heis")
#: Extensions that a kind found by its bytes doesn't overrule.
FAMILIES = {
    "zip": ("zip", "docx", "pptx", "xlsx", "epub", "odt"),
    "msg": ("msg", "doc", "xls", "ppt"),
    "tiff": ("tif", "tiff"),
    "jpg": ("jpg", "jpeg"),
    "heic": ("heic", "heif"),
}
HEAD = 16


def extension_of(path: Column) -> Column:
    """The lower-cased extension of a path's last part; '' without one."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def base_name(path: Column) -> Column:
    """The path's last part without its extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def magic_kind(head_hex: Column) -> Column:
    """The kind that leading bytes (hexadecimal, upper case) mean; null if none does."""
    out = None
    for prefix, kind in SIGNATURES:
        held = F.startswith(head_hex, F.lit(prefix))
        out = F.when(held, F.lit(kind)) if out is None else out.when(held, F.lit(kind))
    brand = F.lower(F.substring(head_hex, 17, 8))
    brands = [b.encode().hex() for b in BRANDS]
    is_heic = (F.substring(head_hex, 9, 8) == b"ftyp".hex()) & brand.isin(brands)
    is_webp = F.startswith(head_hex, F.lit(b"RIFF".hex())) & (F.substring(head_hex, 17, 8) == b"WEBP".hex().upper())
    return out.when(is_heic, F.lit("heic")).when(is_webp, F.lit("webp"))


def resolved_kind(extension: Column, head_hex: Column) -> Column:
    """The kind by leading bytes, unless the extension is of the same family; else the extension."""
    magic = magic_kind(head_hex)
    family = F.lit(False)
    for kind, members in FAMILIES.items():
        family = family | ((magic == kind) & extension.isin(*members))
    return F.when(magic.isNull() | family, extension).otherwise(magic)


def extension_in(path: str) -> str:
    """``extension_of`` in Python, for entries of archives that are unpacked there."""
    found = re.search(r"[^/]\.([^./]+)$", path)
    return found.group(1).lower() if found else ""


def name_in(path: str) -> str:
    """``base_name`` in Python."""
    return re.sub(r"(?<=.)\.[^.]*$", "", re.search(r"([^/]*)$", path).group(1))


def kind_in(path: str, head: bytes | None) -> str:
    """The kind in Python, as ``with_kind`` finds it."""
    extension = extension_in(path)
    if head is None:
        return extension
    known = head[:HEAD].hex().upper()
    magic = next((kind for prefix, kind in SIGNATURES if known.startswith(prefix)), None)
    if magic is None and head[4:8] == b"ftyp" and head[8:12].hex() in [b.encode().hex() for b in BRANDS]:
        magic = "heic"
    if magic is None and head.startswith(b"RIFF") and head[8:12] == b"WEBP":
        magic = "webp"
    return extension if magic is None or extension in FAMILIES.get(magic, ()) else magic


def is_supported(extension: Column) -> Column:
    return extension.isin(*EXTENSIONS)


def with_kind(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """``files`` with its kind, from the name and the first bytes."""
    head = F.hex(F.substring(F.col(content_col), 1, HEAD))
    return files.withColumn("kind", resolved_kind(extension_of(F.col(path_col)), head))


def formats(spark: SparkSession) -> DataFrame:
    """The extensions that can be converted, in order."""
    return spark.createDataFrame([(e,) for e in EXTENSIONS], "extension string").orderBy("extension")
