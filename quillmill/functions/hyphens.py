"""Words parted by a hyphen at a line end: joined, or joined with the hyphen kept, or left as compounds."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Compounds whose hyphen stays.
COMPOUNDS = (
    "point-to-multipoint", "UE-specific", "non-transitory", "semi-static", "half-duplex", "full-duplex", "re-establishment",
    "pre-configured", "multi-carrier", "single-carrier", "intra-frequency", "inter-frequency", "intra-cell", "inter-cell",
    "co-located", "per-UE", "per-cell", "end-to-end", "over-the-air",
)

_LAST = re.compile(r"[^\W_]*\Z")
_FIRST = re.compile(r"[^\W_]*")


@dataclass(frozen=True)
class HyphenRules:
    """``compounds``: lower-cased words that keep their hyphen; ``leads``: what stands before a hyphen in them."""

    compounds: frozenset[str]
    leads: frozenset[str]

    @staticmethod
    def of(words) -> HyphenRules:
        whole = frozenset(w.lower() for w in words)
        leads = frozenset(w[:k] for w in whole for k, c in enumerate(w) if c == "-")
        return HyphenRules(whole, leads)

    def keeps(self, first: str, second: str) -> bool:
        first = first.lower()
        return f"{first}-{second.lower()}" in self.compounds or first in self.leads

    def joint(self, before: str, after: str) -> str | None:
        """What stands between the parts in the joined word: '', '-', or None to leave the lines as they are."""
        first, second = _LAST.search(before).group(), _FIRST.match(after).group()
        if self.keeps(first, second):
            return None
        capitals = first and second and first == first.upper() and second == second.upper() and second[0].isalpha()
        if capitals or after[0].islower():
            return ""
        return "-" if first and second else None

    def merged(self, text: str) -> str:
        """The text with parted words joined; a joined line is looked at again."""
        waiting = text.split("\n")
        waiting.reverse()
        out = []
        while waiting:
            line = waiting.pop()
            while line.endswith("-") and waiting:
                after = waiting[-1].strip(" \t\u00a0\u3000")
                joint = self.joint(line[:-1], after) if after else None
                if joint is None:
                    break
                word = _FIRST.match(after).group()
                if not word and joint == "":
                    break
                line = line[:-1] + joint + word
                rest = after[len(word) :].strip(" \t\u00a0\u3000")
                if rest:
                    waiting[-1] = rest
                else:
                    waiting.pop()
            out.append(line)
        return "\n".join(out)


DEFAULT_RULES = HyphenRules.of(COMPOUNDS)


def read_compounds(lines) -> list[str]:
    """Words of a preserve list: one a line, blank lines and # comments left out, added to the built-in ones."""
    own = [line.strip() for line in lines]
    return [*COMPOUNDS, *(w for w in own if w and not w.startswith("#"))]


def hyphen_merger(rules: HyphenRules = DEFAULT_RULES):
    """A Column function. Texts without a hyphen at a line end keep their value as it is."""

    @F.arrow_udf("string")
    def merge(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else rules.merged(t) for t in texts.to_pylist()], pa.string())

    def apply(text: Column) -> Column:
        return F.when(F.contains(text, F.lit("-\n")), merge(text)).otherwise(text)

    return apply
