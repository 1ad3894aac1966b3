"""E-mail messages: headers as an ordered list, the best body part, and its text."""

from __future__ import annotations

import base64
import binascii
import re
from dataclasses import dataclass

from . import encodings
from .errors import reject
from .html import html_to_markdown

Headers = list[tuple[str, str]]
_WORD = re.compile(r"=\?([^?\s]+)\?([bBqQ])\?([^?]*)\?=")
_BETWEEN = re.compile(r"(=\?[^?\s]+\?[bBqQ]\?[^?]*\?=)\s+(?==\?[^?\s]+\?[bBqQ]\?[^?]*\?=)")
SHOWN = ("From", "To", "Cc", "Date")
DEEPEST = 20


@dataclass(frozen=True)
class Part:
    content_type: str
    encoding: str
    body: str

    @property
    def mime(self) -> str:
        return self.content_type.split(";")[0].strip().lower()


def split_message(text: str) -> tuple[str, str]:
    """Header block and body, at the first blank line; without one all is headers."""
    if text.startswith("\n"):
        return "", text[1:]
    head, found, body = text.partition("\n\n")
    return (head, body) if found else (text, "")


def headers_of(block: str) -> Headers:
    """Name and value pairs in order, continuation lines joined by one blank."""
    out: Headers = []
    for line in block.split("\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return [(name, decoded_words(value)) for name, value in out]


def header(headers: Headers, name: str, default: str = "") -> str:
    """The first value under ``name``, whatever its case."""
    return next((value for held, value in headers if held.lower() == name.lower()), default)


def decoded_words(value: str) -> str:
    """Encoded words as text; blanks between two of them go, what can't be read stays."""

    def one(match: re.Match) -> str:
        charset, kind, payload = match.groups()
        try:
            if kind in "bB":
                data = base64.b64decode(payload + "=" * (-len(payload) % 4), validate=True)
            else:
                data = unquoted(payload.replace("_", " "))
        except (binascii.Error, ValueError):
            return match.group()
        text = encodings.named(data, charset.split("*")[0])
        return match.group() if text is None else text

    return _WORD.sub(one, _BETWEEN.sub(r"\1", value)) if "=?" in value else value


def unquoted(text: str) -> bytes:
    """Quoted-printable bytes; soft line breaks go, an equals sign without two hexadecimal digits stays."""
    raw = re.sub(r"=[ \t]*\n", "", text).encode("utf-8", "surrogatepass")
    return re.sub(rb"=([0-9A-Fa-f]{2})", lambda m: bytes([int(m.group(1), 16)]), raw)


def parameter(value: str, name: str) -> str | None:
    """A parameter of a structured header, split at its first equals sign, without quotes."""
    for piece in re.findall(r';\s*((?:[^;"]|"[^"]*")*)', value):
        key, found, held = piece.partition("=")
        if found and key.strip().lower() == name:
            held = held.strip()
            return held[1:-1] if len(held) >= 2 and held[0] == held[-1] == '"' else held
    return None


def parts_of(body: str, boundary: str) -> list[Part]:
    out = []
    for segment in ("\n" + body).split(f"\n--{boundary}")[1:]:
        if segment.startswith("--"):
            break
        segment = segment.lstrip(" \t").removeprefix("\n")
        if segment.strip():
            block, content = split_message(segment)
            own = headers_of(block)
            out.append(Part(header(own, "Content-Type", "text/plain"), header(own, "Content-Transfer-Encoding", "7bit"), content.strip()))
    return out


def decoded(part: Part) -> str:
    """The part's text under its transfer encoding and character set; what can't be read stays."""
    charset = parameter(part.content_type, "charset")
    encoding = part.encoding.strip().lower()
    data = None
    if encoding == "base64":
        try:
            data = base64.b64decode("".join(part.body.split()), validate=True)
        except (binascii.Error, ValueError):
            return part.body
    elif encoding == "quoted-printable":
        data = unquoted(part.body)
    elif charset and charset.lower() not in ("utf-8", "us-ascii"):
        try:
            data = part.body.encode("latin-1")
        except UnicodeEncodeError:
            return part.body
    text = None if data is None else encodings.named(data, charset)
    return part.body if text is None else text


def reflowed(text: str) -> str:
    """Lines of a paragraph joined by blanks; lines that touch a quotation stay apart."""
    out = []
    for paragraph in text.split("\n\n"):
        lines: list[str] = []
        for line in paragraph.split("\n"):
            if not lines or line.startswith(">") or lines[-1].startswith(">"):
                lines.append(line)
            else:
                lines[-1] += " " + line
        out.append("\n".join(lines))
    return "\n\n".join(out)


def rendered(part: Part, depth: int = 0) -> str:
    """HTML before plain text among direct parts, else the first nested multipart that has a body."""
    if not part.mime.startswith("multipart/"):
        text = decoded(part)
        return html_to_markdown(text) if part.mime == "text/html" else reflowed(text)
    boundary = parameter(part.content_type, "boundary")
    if not boundary:
        return reflowed(part.body)
    inside = parts_of(part.body, boundary)
    for wanted in ("text/html", "text/plain"):
        for p in inside:
            if p.mime == wanted:
                return rendered(p)
    for p in inside:
        if p.mime.startswith("multipart/") and depth < DEEPEST and (text := rendered(p, depth + 1)).strip():
            return text
    return ""


def summary(headers: Headers) -> str:
    """The subject as heading and a list of the headers that are shown."""
    subject = header(headers, "Subject")
    lines = [f"# {subject}", ""] if subject else []
    lines += [f"- **{name}:** {header(headers, name)}" for name in SHOWN if header(headers, name)]
    return "\n".join(lines)


def mail_to_markdown(data: bytes) -> str:
    block, body = split_message(encodings.plain(data).replace("\r\n", "\n"))
    headers = headers_of(block)
    text = rendered(Part(header(headers, "Content-Type", "text/plain"), header(headers, "Content-Transfer-Encoding", "7bit"), body))
    if not text.strip():
        reject("no_body")
    return f"{summary(headers)}\n\n---\n\n{text}{'' if text.endswith(chr(10)) else chr(10)}"
