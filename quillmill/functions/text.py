"""Text repair as Column functions: everything here stays inside the JVM and never shuffles."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full-width punctuation and its ASCII form, character by character.
FULL_WIDTH = "（）［］：；，．＜＞＋－＝｛｝／＼！？"
HALF_WIDTH = "()[]:;,.<>+-={}/\\!?"

#: Typographic marks with a one-character ASCII form.
TYPOGRAPHIC = "‘’“”–—«»"
PLAIN = "''\"\"--\"\""

#: Misreadings that are always put right, in this order.
BUILT_IN_FIXES = [
    ("(c.g.", "(e.g."),
    ("c.g.,", "e.g.,"),
    ("c.g.", "e.g."),
    (" loT ", " IoT "),
    (" lOT ", " IoT "),
    ("loT ", "IoT "),
]

BLANK = r"[\t\x0B\f\r\p{Z}]"


def half_width(text: Column) -> Column:
    """Full-width punctuation as ASCII."""
    return F.translate(text, FULL_WIDTH, HALF_WIDTH)


def plain_marks(text: Column) -> Column:
    """Curly quotes, dashes, guillemets and the ellipsis as ASCII; arrows stay."""
    return F.replace(F.translate(text, TYPOGRAPHIC, PLAIN), F.lit("…"), F.lit("..."))


def unix_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def without_noise_lines(text: Column) -> Column:
    """Without the lines that, trimmed, are a single character that is neither letter, mark nor digit."""
    noise = r"^[\t\p{Zs}]*[^\p{L}\p{M}\p{N}\t\p{Zs}][\t\p{Zs}]*$"
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda line: ~F.rlike(line, F.lit(noise))), "\n")


def clean_whitespace(text: Column) -> Column:
    """Every line right-trimmed, and at most two blank lines in a row."""
    trimmed = F.regexp_replace(text, BLANK + r"+(\n|\z)", "$1")
    inner = F.regexp_replace(trimmed, r"\n{4,}", "\n\n\n")
    ends = F.regexp_replace(F.regexp_replace(inner, r"\A\n{3,}", "\n\n"), r"\n{3,}\z", "\n\n")
    return F.when(F.rlike(trimmed, F.lit(r"\A\n*\z")), F.substring(trimmed, 1, 1)).otherwise(ends)


def collapse_blank_lines(text: Column) -> Column:
    """At most one blank line in a row."""
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def ended(text: Column) -> Column:
    """With a newline at the end."""
    return F.when(F.endswith(text, F.lit("\n")), text).otherwise(F.concat(text, F.lit("\n")))


def trimmed(text: Column) -> Column:
    """Without white space at either end, line ends included."""
    return F.regexp_replace(text, r"\A[\s\p{Z}]+|[\s\p{Z}]+\z", "")


def plain_text_to_markdown(text: Column, kind: Column) -> Column:
    """A text file as Markdown: Markdown passes as it is, other text is cleaned; both end with a newline."""
    unix = unix_newlines(text)
    return ended(F.when(kind.isin("md", "markdown"), unix).otherwise(clean_whitespace(unix)))


def fix_paragraph_brackets(text: Column, image: bool = False) -> Column:
    """Misread paragraph numbers as [dddd]. Images get only the first two of the four repairs."""
    fixed = F.regexp_replace(text, r"\[(\d{4})[1)|]", "[$1]")
    fixed = F.regexp_replace(fixed, r"\[(\d{4})(?=\s)", "[$1]")
    if image:
        return fixed
    fixed = F.regexp_replace(fixed, r"\((\d{4})\]", "[$1]")
    return F.regexp_replace(fixed, r"(?:\A|\n)\((\d{4})\)", "\n[$1]")


@dataclass(frozen=True)
class Corrections:
    """A correction dictionary. Literal replacements run longest first, then by code point; patterns in their order.

    ``whitelist`` and ``hint_words`` are kept for callers, they change no text.
    """

    spaced_words: dict[str, str] = field(default_factory=dict)
    word_replacements: dict[str, str] = field(default_factory=dict)
    patterns: tuple[tuple[str, str, bool], ...] = ()
    whitelist: frozenset[str] = frozenset()
    hint_words: tuple[str, ...] = ()


def _replaced(text: Column, pairs: dict[str, str]) -> Column:
    order = sorted(pairs, key=lambda k: (-len(k), k))
    return reduce(lambda held, k: F.replace(held, F.lit(k), F.lit(pairs[k])), (k for k in order if k), text)


def built_in_fixes(text: Column) -> Column:
    return reduce(lambda held, pair: F.replace(held, F.lit(pair[0]), F.lit(pair[1])), BUILT_IN_FIXES, text)


def corrected(text: Column, corrections: Corrections) -> Column:
    """Built-in fixes, then spaced words, words and patterns."""
    fixed = _replaced(_replaced(built_in_fixes(text), corrections.spaced_words), corrections.word_replacements)
    for pattern, replacement, ignore_case in corrections.patterns:
        fixed = F.regexp_replace(fixed, ("(?i)" if ignore_case else "") + pattern, replacement)
    return fixed


def safe_file_name(title: Column, longest: int = 60) -> Column:
    """A title as part of a file name."""
    return F.substring(F.translate(title, "/:", "__"), 1, longest)


def without_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", "")


def title_in_html(html: Column) -> Column:
    """The first non-empty of h1, h2, h3 and title, without tags; null if there is none."""
    found = [
        trimmed(without_tags(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1))) for tag in ("h1", "h2", "h3", "title")
    ]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in found])


def delimiter_of(text: Column) -> Column:
    """The delimiter of a CSV text: a semicolon if it has more of them outside quotes than commas."""
    bare = F.regexp_replace(text, r'"[^"]*(?:"|\z)', "")
    return F.when(F.regexp_count(bare, F.lit(";")) > F.regexp_count(bare, F.lit(",")), F.lit(";")).otherwise(F.lit(","))


def column_index(letters: Column) -> Column:
    """A spreadsheet column's letters as its number from 0; -1 without letters."""
    letters = F.upper(F.regexp_extract(letters, "^([A-Za-z]*)", 1))
    values = F.filter(F.split(letters, ""), lambda c: c != "")
    return (F.aggregate(values, F.lit(0).cast("long"), lambda held, c: held * 26 + F.ascii(c) - 64) - 1).cast("int")


def column_letters(index: Column) -> Column:
    """The letters of a spreadsheet column from its number from 0, as many as it takes; '' for numbers below 0."""
    index, letters, first = index.cast("long"), [], 0
    for k in range(7):  # 26 to the 7th is beyond a 32-bit number
        place = F.pmod(F.floor((index - first) / float(26**k)), F.lit(26)) + 65
        letters.insert(0, F.when(index >= first, F.char(place.cast("long"))).otherwise(F.lit("")))
        first += 26 ** (k + 1)
    return F.concat(*letters)


def repaired(text: Column, merge_hyphens, half: bool = True, special: bool = True, hyphens: bool = True, noise: bool = True) -> Column:
    """The whole chain in order; ``merge_hyphens`` is the Column function for words parted at line ends."""
    out = half_width(text) if half else text
    out = plain_marks(out) if special else out
    out = merge_hyphens(out) if hyphens else out
    out = without_noise_lines(out) if noise else out
    return clean_whitespace(out)
