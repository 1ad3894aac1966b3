"""Bytes to text: byte-order marks, declared character sets, and ladders of guesses."""

from __future__ import annotations

import codecs
import re

#: Character sets that pages declare, and the codec that reads them.
DECLARED = {
    "utf-8": "utf-8", "utf8": "utf-8", "gb2312": "gb18030", "gbk": "gb18030", "gb18030": "gb18030", "big5": "big5",
    "big5-hkscs": "big5hkscs", "shift_jis": "shift_jis", "shift-jis": "shift_jis", "sjis": "shift_jis", "euc-jp": "euc_jp",
    "euc-kr": "euc_kr", "iso-8859-1": "latin-1", "latin1": "latin-1", "windows-1252": "cp1252", "cp1252": "cp1252",
    "utf-16": "utf-16", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be",
}
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?\s*([a-z0-9_\-]+)")


def _attempt(data: bytes, codec: str) -> str | None:
    try:
        return data.decode(codec)
    except (UnicodeDecodeError, LookupError):
        return None


def ladder(data: bytes, *codecs_in_order: str) -> str:
    """The first decoding that fits; Latin-1 always does."""
    for codec in codecs_in_order:
        text = _attempt(data, codec)
        if text is not None:
            return text
    return data.decode("latin-1")


def plain(data: bytes) -> str:
    """UTF-8, else Latin-1; a byte-order mark is dropped."""
    return ladder(data.removeprefix(codecs.BOM_UTF8), "utf-8")


def text_file(data: bytes) -> str:
    """By byte-order mark, else UTF-8, GB18030, Latin-1."""
    for mark, codec in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if data.startswith(mark):
            return ladder(data[len(mark) :], codec, "gb18030")
    return ladder(data, "utf-8", "gb18030")


def page(data: bytes) -> str:
    """The character set declared in the first 4 KB, quoted or not, else as a text file."""
    found = _CHARSET.search(data[:4096].lower())
    codec = DECLARED.get(found.group(1).decode("ascii")) if found else None
    text = _attempt(data, codec) if codec else None
    return text.removeprefix("﻿") if text is not None else text_file(data)


def named(data: bytes, charset: str | None) -> str | None:
    """Under the named character set (unknown: UTF-8); null if the bytes don't fit."""
    name = (charset or "utf-8").strip().strip("\"'").lower()
    codec = DECLARED.get(name, name)
    try:
        codecs.lookup(codec)
    except LookupError:
        codec = "utf-8"
    return _attempt(data, codec)
