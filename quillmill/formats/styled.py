"""Styled runs to Markdown, and rich text (RTF) to styled runs."""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

from .errors import reject

_HALVES = re.compile("[\ud800-\udfff]")
_NUMBERED = re.compile(r"(\d+)[.)]\s+")


class Run(NamedTuple):
    """``paragraph`` counts from 0."""

    paragraph: int
    text: str
    size: float = 12.0
    bold: bool = False
    italic: bool = False
    link: str = ""


def body_size(runs: list[Run]) -> float:
    """The font size of most characters; 12 without any, the smaller one in a tie."""
    sizes: Counter = Counter()
    for run in runs:
        sizes[run.size] += len(run.text)
    return min(sizes, key=lambda s: (-sizes[s], s)) if sizes else 12.0


def heading_mark(runs: list[Run], body: float) -> str:
    """The heading that a paragraph's look means: all bold, clearly larger than the body, of one size."""
    if not runs or not all(r.bold for r in runs):
        return ""
    low, high = min(r.size for r in runs), max(r.size for r in runs)
    if high <= body * 1.1 or high - low >= 2:
        return ""
    ratio = high / body
    return "# " if ratio >= 1.8 else "## " if ratio >= 1.4 else "### "


def list_mark(text: str) -> tuple[str, int]:
    """A list item's Markdown marker, and how many characters of the text it stands for."""
    lead = len(text) - len(text.lstrip(" \t"))
    rest = text[lead:]
    if rest.startswith("•"):
        return "- ", lead + 1 + len(rest[1:]) - len(rest[1:].lstrip(" \t"))
    if rest.startswith("- "):
        return "- ", lead + 2
    found = _NUMBERED.match(rest)
    return (f"{found.group(1)}. ", lead + found.end()) if found else ("", 0)


def _inline(runs: list[Run], skip: int) -> str:
    out = []
    for run in runs:
        text = run.text[skip:]
        skip = max(0, skip - len(run.text))
        if not text:
            continue
        if run.link:
            out.append(f"[{text}]({run.link})")
            continue
        mark = "***" if run.bold and run.italic else "**" if run.bold else "*" if run.italic else ""
        out.append(f"{mark}{text}{mark}" if text.strip() else text)
    return "".join(out)


def runs_to_markdown(runs: list[Run]) -> str:
    body = body_size(runs)
    paragraphs: dict[int, list[Run]] = {}
    for run in runs:
        paragraphs.setdefault(run.paragraph, []).append(run)
    out = []
    for held in paragraphs.values():
        marker, skip = list_mark("".join(r.text for r in held))
        out.append(heading_mark(held, body) + marker + _inline(held, skip) + "\n\n")
    return re.sub(r"\n{3,}", "\n\n", "".join(out)).strip() + "\n"


_RTF = re.compile(r"\\([a-z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)", re.IGNORECASE)
#: Groups without text of their own, and words that stand for characters.
_HIDDEN = frozenset(
    "fonttbl colortbl stylesheet info pict object header footer headerl headerr headerf footerl footerr footerf footnote listtable "
    "listoverridetable revtbl rsidtbl generator themedata colorschememapping datastore latentstyles xmlnstbl fldinst bkmkstart bkmkend "
    "shppict nonshppict filetbl".split()
)
_CHARACTERS = {
    "tab": "\t", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•",
    "emspace": " ", "enspace": " ", "line": "\n",
}


def rich_text_runs(data: bytes) -> list[Run]:
    """The text of a rich-text file with size, bold, italic and link."""
    source = data.decode("latin-1")
    if not source.lstrip().startswith("{\\rtf"):
        reject("not_rich_text")
    plain = {"size": 12.0, "bold": False, "italic": False, "hidden": False, "skip": 1, "link": ""}
    state, stack = dict(plain), []
    codec, paragraph, pending = "cp1252", 0, 0
    out: list[Run] = []
    starred, target = False, ""
    field_depth: list[int] = []
    instruction: list[str] | None = None

    def put(text: str) -> None:
        if instruction is not None:
            instruction.append(text)
        elif text and not state["hidden"]:
            out.append(Run(paragraph, text, state["size"], state["bold"], state["italic"], state["link"]))

    for match in _RTF.finditer(source):
        word, number, code, symbol, brace, text = match.groups()
        if brace == "{":
            stack.append(dict(state))
            starred = False
        elif brace == "}":
            if instruction is not None and state.get("instruction"):
                found = re.search(r'HYPERLINK\s+"([^"]*)"', "".join(instruction))
                target = found.group(1) if found else ""
                instruction = None
            if field_depth and len(stack) == field_depth[-1]:
                field_depth.pop()
                target = ""
            state = stack.pop() if stack else dict(plain)
        elif word:
            name, value = word.lower(), int(number) if number else None
            if name == "field":
                field_depth.append(len(stack))
            elif name == "fldinst":
                instruction = []
                state["instruction"] = True
            elif name == "fldrslt":
                state["link"] = target
            elif name in _HIDDEN or starred:
                state["hidden"] = True
            elif name == "par" or name == "sect" or name == "page":
                if not state["hidden"]:
                    paragraph += 1
            elif name == "pard" or name == "plain":
                if name == "plain":
                    state.update(size=12.0, bold=False, italic=False)
            elif name == "b":
                state["bold"] = value != 0
            elif name == "i":
                state["italic"] = value != 0
            elif name == "fs" and value:
                state["size"] = value / 2
            elif name == "ansicpg" and value:
                codec = f"cp{value}"
            elif name == "uc" and value is not None:
                state["skip"] = value
            elif name == "u" and value is not None:
                put(chr(value % 65536))
                pending = state["skip"]
            elif name in _CHARACTERS:
                put(_CHARACTERS[name])
            starred = False
        elif code:
            if pending:
                pending -= 1
            else:
                try:
                    put(bytes([int(code, 16)]).decode(codec, "replace"))
                except LookupError:
                    put(bytes([int(code, 16)]).decode("cp1252", "replace"))
        elif symbol:
            if symbol == "*":
                starred = True
            elif symbol in "\\{}":
                put(symbol)
            elif symbol == "~":
                put(" ")
            elif symbol in "\r\n" and not state["hidden"]:
                paragraph += 1
        elif text:
            skipped = min(pending, len(text))
            pending -= skipped
            put(text[skipped:])
    joined: list[Run] = []
    for run in out:  # surrogate halves meet, and neighbours of one look are one run
        last = joined[-1] if joined else None
        if last and (last.paragraph, last.size, last.bold, last.italic, last.link) == (run.paragraph, run.size, run.bold, run.italic, run.link):
            joined[-1] = Run(run.paragraph, last.text + run.text, run.size, run.bold, run.italic, run.link)
        else:
            joined.append(run)
    return [r._replace(text=r.text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")) if _HALVES.search(r.text) else r for r in joined]


def rich_text_to_markdown(data: bytes) -> str:
    runs = rich_text_runs(data)
    if not any(r.text.strip() for r in runs):
        reject("empty_input")
    return runs_to_markdown(runs)
