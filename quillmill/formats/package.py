"""Zip packages: entries, relationships, XML without name spaces."""

from __future__ import annotations

import io
import posixpath
import struct
import zipfile
import zlib
from xml.etree import ElementTree

from .errors import reject

#: A package may unpack to at most so many bytes; beyond that it is refused.
MOST_BYTES = 2 << 30


_END, _ENTRY, _LOCAL = struct.Struct("<4s4H2LH"), struct.Struct("<4s4B4HL2L5H2L"), struct.Struct("<4s5H3L2H")


def _plain_entries(data: bytes) -> dict[str, tuple[int, int, int, int, int, int]] | None:
    """Name to (method, checksum, packed size, size, where the entry begins, where it ends at most) of a plain archive;
    null for all that zipfile had better read: comments, data in front, encryption, extra fields, odd orders, damage."""
    if len(data) < 22:
        return None
    mark, disk, first, here, count, length, start, comment = _END.unpack_from(data, len(data) - 22)
    if mark != b"PK\5\6" or disk or first or here != count or comment or start + length != len(data) - 22:
        return None
    out, at, before = {}, start, -1
    held = []
    for _ in range(count):
        if at + 46 > len(data) - 22:
            return None
        (sign, _, _, needed, _, flags, method, _, _, crc, packed, size, wide, extra, remark, _, _, _, place) = _ENTRY.unpack_from(data, at)
        if sign != b"PK\1\2" or needed > 20 or flags & ~0x80E or method not in (0, 8) or extra or not before < place < start or size == 0xFFFFFFFF:
            return None
        raw = data[at + 46 : at + 46 + wide]
        if len(raw) != wide or b"\0" in raw:
            return None
        try:
            name = raw.decode("utf-8" if flags & 0x800 else "cp437")
        except UnicodeDecodeError:
            return None
        if name in out:
            return None
        out[name] = ()
        held.append((name, method, crc, packed, size, place, raw))
        before, at = place, at + 46 + wide + remark
    if at != len(data) - 22:
        return None
    for k, (name, method, crc, packed, size, place, raw) in enumerate(held):
        end = held[k + 1][5] if k + 1 < count else start
        sign, _, _, _, _, _, _, _, _, wide, extra = _LOCAL.unpack_from(data, place)
        begin = place + 30 + wide + extra
        if sign != b"PK\3\4" or data[place + 30 : place + 30 + wide] != raw or begin + packed > end:
            return None
        out[name] = (method, crc, packed, size, begin, end)
    return out


class Package:
    def __init__(self, data: bytes):
        self.data, self.plain, self.zip = data, _plain_entries(data), None
        if self.plain is None:
            self._open()
            sizes = {i.filename: i.file_size for i in self.zip.infolist()}
            whole = sum(i.file_size for i in self.zip.infolist())
        else:
            sizes = {name: held[3] for name, held in self.plain.items()}
            whole = sum(sizes.values())
        if whole > MOST_BYTES:
            reject("unzip_failed", "too large")
        self.names = [n for n in sizes if not n.endswith("/")]

    def _open(self) -> None:
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(self.data))
        except (zipfile.BadZipFile, NotImplementedError, ValueError, OSError) as e:
            reject("unzip_failed", str(e))

    def _plain_read(self, name: str) -> bytes | None:
        """The bytes of an entry that holds what the archive says; null if it doesn't, so that zipfile says what is wrong."""
        method, crc, packed, size, begin, _ = self.plain[name]
        out = self.data[begin : begin + packed]
        if method == 8:
            try:
                out = zlib.decompressobj(-15).decompress(out, size + 1)
            except zlib.error:
                return None
        return out if len(out) == size and zlib.crc32(out) == crc else None

    def read(self, name: str) -> bytes | None:
        """An entry's bytes; null if it isn't there."""
        if name not in self.names:
            return None
        if self.plain is not None and (found := self._plain_read(name)) is not None:
            return found
        if self.zip is None:
            self._open()
        try:
            return self.zip.read(name)
        except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError, OSError) as e:
            reject("unzip_failed", str(e))

    def xml(self, name: str) -> ElementTree.Element | None:
        data = self.read(name)
        return None if data is None else parsed(data)

    def relations(self, part: str) -> dict[str, dict[str, str]]:
        """The relationships of a part: id to Type, Target (as a path in the package unless external) and TargetMode."""
        folder, _, file = part.rpartition("/")
        root = self.xml(f"{folder}/_rels/{file}.rels" if folder else f"_rels/{file}.rels")
        out = {}
        for r in root if root is not None else ():
            target = r.get("Target", "")
            if r.get("TargetMode") != "External":
                target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            out[r.get("Id", "")] = {"type": r.get("Type", ""), "target": target, "mode": r.get("TargetMode", "")}
        return out


def parsed(data: bytes) -> ElementTree.Element:
    """A document's root; names lose their name space. Documents that declare entities are refused."""
    if b"<!ENTITY" in data:
        reject("xml_error", "entities aren't expanded")
    try:
        root = ElementTree.fromstring(data)
    except (ElementTree.ParseError, ValueError, LookupError) as e:
        reject("xml_error", str(e))
    if b"xmlns" not in data and b"xml:" not in data and b"\0" not in data:
        return root  # no name has a space
    names: dict[str, str] = {}
    for element in root.iter():
        tag = element.tag
        if isinstance(tag, str):
            local = names.get(tag)
            if local is None:
                local = names[tag] = tag.rpartition("}")[2]
            if local is not tag:
                element.tag = local
            for name in element.keys():  # noqa: SIM118: elements aren't dictionaries
                if name[0] == "{":
                    element.attrib.setdefault(name.rpartition("}")[2], element.attrib[name])
    return root


def text_of(element: ElementTree.Element | None) -> str:
    if element is None:
        return ""
    return "".join(element.itertext()) if len(element) else element.text or ""
