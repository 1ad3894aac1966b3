"""Markdown tables from rows in Python, for readers that already run there."""

from __future__ import annotations


def table(rows: list[list[str]], newline: str | None = None, escape: bool = True, ending: str = "\n") -> str:
    """Rows padded to the longest, the first one as header; '' without cells."""
    wide = max(map(len, rows), default=0)
    if not wide:
        return ""

    if escape:
        rows = [[value.replace("|", "\\|") for value in r] for r in rows]
    if newline is not None:
        rows = [[value.replace("\n", newline) for value in r] for r in rows]
    lines = ["| " + " | ".join(r if len(r) == wide else [*r, *[""] * (wide - len(r))]) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * wide, *lines[1:]]) + ending
