"""Outlook messages: streams of a compound file, then the message's properties."""

from __future__ import annotations

import struct

from . import encodings
from .errors import reject
from .html import bytes_to_markdown, html_to_markdown

MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
END_OF_CHAIN, FREE, NO_STREAM = 0xFFFFFFFE, 0xFFFFFFFF, 0xFFFFFFFF
ROOT, STREAM, STORAGE = 5, 2, 1


class CompoundFile:
    """Reads a compound file's sectors; every chain is bounded by the number of sectors."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or len(data) < 512:
            reject("not_compound_file")
        self.data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        if not 7 <= shift <= 16 or not 2 <= mini_shift <= shift:
            reject("malformed_compound_file")
        self.size, self.mini_size = 1 << shift, 1 << mini_shift
        first_directory, _, self.cutoff, first_mini, _, first_more, _ = struct.unpack_from("<IIIIIII", data, 48)
        table = list(struct.unpack_from("<109I", data, 76))
        seen = set()
        while first_more < END_OF_CHAIN and first_more not in seen:  # further parts of the sector list
            seen.add(first_more)
            block = self._numbers(self.sector(first_more))
            table += block[:-1]
            first_more = block[-1] if block else END_OF_CHAIN
        self.next: list[int] = []
        for number in table:
            if number < END_OF_CHAIN:
                self.next += self._numbers(self.sector(number))
        self.mini_next = self._numbers(self.chain(first_mini))
        self.entries = self._entries(self.chain(first_directory))
        root = next((e for e in self.entries if e["kind"] == ROOT), None)
        if root is None:
            reject("malformed_compound_file")
        self.root = root
        self.mini = self.chain(root["start"])[: root["size"]]

    def sector(self, number: int) -> bytes:
        return self.data[(number + 1) * self.size : (number + 2) * self.size]

    @staticmethod
    def _numbers(data: bytes) -> list[int]:
        return list(struct.unpack_from(f"<{len(data) // 4}I", data))

    def _follow(self, start: int, following: list[int]) -> list[int]:
        out: list[int] = []
        while start < END_OF_CHAIN and start < len(following) and len(out) <= len(following):
            out.append(start)
            start = following[start]
        return out

    def chain(self, start: int) -> bytes:
        return b"".join(map(self.sector, self._follow(start, self.next)))

    def _entries(self, data: bytes) -> list[dict]:
        out = []
        for at in range(0, len(data) - 127, 128):
            name_bytes, kind = struct.unpack_from("<HB", data, at + 64)
            left, right, child = struct.unpack_from("<III", data, at + 68)
            start, size = struct.unpack_from("<II", data, at + 116)
            name = data[at : at + max(0, min(name_bytes, 64) - 2)].decode("utf-16-le", "replace")
            out.append({"name": name, "kind": kind, "left": left, "right": right, "child": child, "start": start, "size": size})
        return out

    def read(self, entry: dict) -> bytes:
        if entry["size"] >= self.cutoff:
            return self.chain(entry["start"])[: entry["size"]]
        pieces = self._follow(entry["start"], self.mini_next)
        return b"".join(self.mini[k * self.mini_size : (k + 1) * self.mini_size] for k in pieces)[: entry["size"]]

    def top_streams(self) -> dict[str, bytes]:
        """Streams directly under the root; if its tree is broken, all streams, the first of a name."""
        todo, seen, out = [self.root["child"]], set(), {}
        while todo:
            k = todo.pop()
            if k >= len(self.entries) or k in seen:
                continue
            seen.add(k)
            entry = self.entries[k]
            todo += [entry["left"], entry["right"]]
            if entry["kind"] == STREAM:
                out.setdefault(entry["name"], self.read(entry))
        if not out:
            for entry in self.entries:
                if entry["kind"] == STREAM:
                    out.setdefault(entry["name"], self.read(entry))
        return out


class Message:
    """A message's properties, by their numbers (four hexadecimal digits)."""

    def __init__(self, data: bytes):
        self.streams = CompoundFile(data).top_streams()

    def text(self, number: str) -> str:
        """A string property, wide or narrow, without zeros at its end; '' if there is none."""
        wide = self.streams.get(f"__substg1.0_{number}001F")
        if wide is not None:
            return wide.decode("utf-16-le", "replace").rstrip("\0")
        return encodings.plain(self.streams.get(f"__substg1.0_{number}001E", b"")).rstrip("\0")

    def binary(self, number: str) -> bytes:
        return self.streams.get(f"__substg1.0_{number}0102", b"")


def outlook_to_markdown(data: bytes) -> str:
    message = Message(data)
    subject = message.text("0037") or message.text("003D")
    name, address = message.text("0C1A"), message.text("0C1F")
    sender = f"{name} <{address}>" if name and address else name or address
    html, markup = message.text("1013"), message.binary("1013")
    body = html_to_markdown(html) if html else bytes_to_markdown(markup) if markup else message.text("1000")
    if not body.strip() and not subject:
        reject("no_body")
    date = next((line[5:].strip() for line in message.text("007D").replace("\r\n", "\n").split("\n") if line.lower().startswith("date:")), "")
    lines = [f"# {subject}", ""] if subject else []
    shown = (("From", sender), ("To", message.text("0E04")), ("Cc", message.text("0E03")), ("Date", date))
    lines += [f"- **{label}:** {value}" for label, value in shown if value]
    return "\n".join(lines) + f"\n\n---\n\n{body}{'' if body.endswith(chr(10)) else chr(10)}"
