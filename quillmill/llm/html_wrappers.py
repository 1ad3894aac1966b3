"""Main text of web pages, by wrappers inferred for each host.

A wrapper is a union-free regular expression over a host's pages, held as a tree: an element, with its content in
order, where a part may be optional or repeated, and a text is either the same on all pages or a slot. It starts as
the host's first page. Every further page is aligned with it, level by level: equal neighbours, and equal runs of
neighbours, become a repeated group, parts without a partner become optional, and texts that differ become slots.

Tasks fold their pages into one wrapper for each host; these are merged in two steps, first by host and lot, so that
a host with a third of all pages needs no task that reads them all; wrappers are merged in the order of their text, so that
the same pages give the same wrapper on every run. The finished wrapper names where the host's
article lies and which texts are the same all over the host. A second pass takes each page apart with its host's
wrapper, whose size does not grow with the host's pages.

Defined results. A null html counts as empty and has no text. Null and odd urls share the host ''. Repeated rows are
extracted each. Broken markup never fails; elements nested deeper than LEVELS count as blocks of the one around them (see
html_tree). Tables may be empty, and other columns may have any name.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .html_tree import Element, blocks_of, tree_of
from .shared import Scratch, text_or_empty

LOTS = 64
#: The longest run of neighbours that is looked for as a repeated group.
LONGEST_GROUP = 8
#: Alignments of more than so many pairs of parts are first cut where keys occur once on both sides.
ALIGNED_PAIRS = 40_000
HELD_HOSTS = 500
#: Pages of different content that must share a text before it counts as the host's own.
SHARED_BY = 3

# A wrapper's node: [key, repeated, optional, pages, content, text, weight, seen]. A text's key is "#"; its text is the
# hash of its value, or None for a slot. Seen are the least SHARED_BY hashes of the contents of pages that hold the
# node, for texts that aren't slots and for whole pages. Lists, not objects: they are written as JSON.
KEY, REPEATED, OPTIONAL, PAGES, CONTENT, TEXT, WEIGHT, SEEN = range(8)


def _text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 11


def wrapper_of(page: Element) -> list:
    """The wrapper of one page. Elements outside of articles stand without their content, marked ones with it."""
    seen: list[int] = []  # one list for all of the page's texts; its hash is known at the end
    texts: list[int] = []

    def walk(element: Element, marked: bool = False) -> list:
        content, run = [], []

        def flush() -> None:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                value = _text_hash(text)
                if not marked:
                    texts.append(value)
                content.append(["#", False, False, 1, [], value, len(text), seen])

        for part in element.parts:
            if isinstance(part, str):
                run.append(part)
            else:
                flush()
                content.append([part.key, False, False, 1, [], None, 0, []] if part.outside else walk(part, marked or bool(part.marked)))
        flush()
        return [element.key, False, False, 1, content, None, sum(n[WEIGHT] for n in content), []]

    def folded(node: list) -> list:
        node[CONTENT] = fold([folded(n) for n in node[CONTENT]])
        return node

    whole = walk(page)
    seen.append(_text_hash(repr(texts)))
    whole[SEEN] = seen
    return folded(whole)


def fold(content: list) -> list:
    """Equal neighbours, and equal runs of neighbours, as one repeated group."""
    out: list = []
    for node in content:
        out.append(node)
        again = True
        while again:
            again = False
            for k in range(1, min(LONGEST_GROUP, len(out) // 2) + 1):
                if out[-1][KEY] == out[-1 - k][KEY] and [n[KEY] for n in out[-2 * k : -k]] == [n[KEY] for n in out[-k:]]:
                    out[-2 * k :] = [_repeated(x, y) for x, y in zip(out[-2 * k : -k], out[-k:], strict=True)]
                    again = True
                    break
    return out


def _repeated(a: list, b: list) -> list:
    node = merged(a, b)
    node[REPEATED], node[PAGES] = True, a[PAGES]
    return node


def merged(a: list, b: list) -> list:
    """The least wrapper that takes what ``a`` takes and what ``b`` takes; both have the same key."""
    text = a[TEXT] if a[TEXT] == b[TEXT] else None
    seen = a[SEEN] if a[SEEN] == b[SEEN] else sorted({*a[SEEN], *b[SEEN]})[:SHARED_BY]
    return [
        a[KEY], a[REPEATED] or b[REPEATED], a[OPTIONAL] or b[OPTIONAL], a[PAGES] + b[PAGES], aligned(a[CONTENT], b[CONTENT]), text,
        a[WEIGHT] + b[WEIGHT], [] if a[KEY] == "#" and text is None else seen,
    ]


def aligned(a: list, b: list) -> list:
    """Two contents in one: parts with the same keys in the same order are merged, the rest becomes optional."""
    out: list = []
    i = j = 0
    for x, y in _partners([n[KEY] for n in a], [n[KEY] for n in b]):
        out += [_optional(n) for n in a[i:x]] + [_optional(n) for n in b[j:y]]
        out.append(merged(a[x], b[y]))
        i, j = x + 1, y + 1
    if len(a) == len(b) == len(out) and i == len(a):
        return out
    return fold(out + [_optional(n) for n in a[i:]] + [_optional(n) for n in b[j:]])


def _partners(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of equal keys in both, rising: the longest common run, of small parts between keys that occur once."""
    if a == b:
        return [(k, k) for k in range(len(a))]
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    out = [(k, k) for k in range(low)]
    out += [(x + low, y + low) for x, y in _between(a[low : len(a) - high], b[low : len(b) - high])]
    return out + [(len(a) - k, len(b) - k) for k in range(high, 0, -1)]


def _between(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    if not a or not b:
        return []
    if len(a) * len(b) <= ALIGNED_PAIRS:
        return _longest(a, b)
    anchors = _rising(a, b)
    if not anchors:  # no key to hold on to: the next equal one
        out, at = [], 0
        places: dict[str, list[int]] = {}
        for y, key in enumerate(b):
            places.setdefault(key, []).append(y)
        for x, key in enumerate(a):
            k = bisect_left(places.get(key, []), at)
            if key in places and k < len(places[key]):
                out.append((x, places[key][k]))
                at = places[key][k] + 1
        return out
    out, i, j = [], 0, 0
    for x, y in [*anchors, (len(a), len(b))]:
        part = (a[i:x], b[j:y])
        inner = _longest(*part) if len(part[0]) * len(part[1]) <= ALIGNED_PAIRS else []
        out += [(i + p, j + q) for p, q in inner]
        if x < len(a):
            out.append((x, y))
        i, j = x + 1, y + 1
    return out


def _rising(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of keys that occur once in both, the longest rising run of them."""
    count_a, count_b = Counter(a), Counter(b)
    place = {key: y for y, key in enumerate(b) if count_b[key] == 1}
    pairs = [(x, place[key]) for x, key in enumerate(a) if count_a[key] == 1 and key in place]
    ends: list[int] = []  # place in b that ends the best run of each length
    last: list[int] = []
    back: list[int] = []
    for k, (_, y) in enumerate(pairs):
        n = bisect_left(ends, y)
        back.append(last[n - 1] if n else -1)
        ends[n : n + 1] = [y]
        last[n : n + 1] = [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _longest(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    rows, columns = len(a), len(b)
    best = [[0] * (columns + 1) for _ in range(rows + 1)]
    for i in range(rows - 1, -1, -1):
        for j in range(columns - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < rows and j < columns:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _optional(node: list) -> list:
    return [*node[:OPTIONAL], True, *node[PAGES:]]


@dataclass(frozen=True)
class Rules:
    """What a wrapper says of its host: paths of the article, texts that are the same on its pages, by path, and paths of
    marked elements that hold article text."""

    roots: frozenset[tuple[str, ...]]
    constants: frozenset[tuple[tuple[str, ...], int]]
    opened: frozenset[tuple[str, ...]] = frozenset()


def _is_article(key: str) -> bool:
    return key.split(".")[0].lstrip("~!") in ("article", "main")


def opened_of(wrapper: list) -> frozenset[tuple[str, ...]]:
    """Paths of marked elements that hold article text. If the host has article elements out of marked ones, only those
    that hold most varying text and aren't marked as comments or teasers; else all that hold an article or most text."""
    marked: dict[tuple[str, ...], tuple[int, bool]] = {}
    plain = 0

    def walk(node: list, path: tuple[str, ...], inside: bool, named: bool) -> tuple[int, bool]:
        nonlocal plain
        weight, holds = 0, False
        for child in node[CONTENT]:
            if child[KEY] == "#":
                varies = child[TEXT] is None or len(child[SEEN]) < SHARED_BY
                weight += child[WEIGHT] * varies
                plain += child[WEIGHT] * (varies and named and not inside)
                continue
            below, mark = (*path, child[KEY]), child[KEY][:1] in ("~", "!")
            article = _is_article(child[KEY])
            more, held = walk(child, below, inside or mark, named or article)
            held = held or (article and more > 0)
            if mark:
                old = marked.get(below, (0, False))
                marked[below] = (old[0] + more, old[1] or held)
            weight, holds = weight + more, holds or held
        return weight, holds

    total, _ = walk(wrapper, (), False, False)
    many = len(wrapper[SEEN]) >= SHARED_BY
    if plain:
        return frozenset(p for p, (w, _) in marked.items() if many and w * 2 > total and not any(k[0] == "!" for k in p))
    return frozenset(p for p, (w, holds) in marked.items() if holds or w * 2 > total)


def rules_of(wrapper: list) -> Rules:
    """The article is in article and main elements, if these hold half of the host's slot text or the host has too few
    pages to tell; else it is the deepest group of blocks that holds all slot text."""
    named: dict[tuple[str, ...], int] = {}
    constants = set()
    opened = opened_of(wrapper)
    slots: dict[tuple[str, ...], int] = {}

    def walk(node: list, path: tuple[str, ...]) -> int:
        weight = 0
        for child in node[CONTENT]:
            if child[KEY] == "#":
                if child[TEXT] is not None and len(child[SEEN]) >= SHARED_BY and not child[REPEATED]:
                    constants.add((path, child[TEXT]))
                else:
                    weight += child[WEIGHT]
                continue
            below = (*path, child[KEY])
            if child[KEY][:1] in ("~", "!") and below not in opened:
                continue
            more = walk(child, below)
            if _is_article(child[KEY]):
                named[below] = named.get(below, 0) + more
            weight += more
        if not path or any(child[KEY] != "#" for child in node[CONTENT]):
            slots[path] = slots.get(path, 0) + weight
        return weight

    total = walk(wrapper, ())
    held = sum(w for p, w in named.items() if not any(p[:k] in named for k in range(1, len(p))))
    if named and (len(wrapper[SEEN]) < SHARED_BY or held * 2 >= total):
        roots = {p for p, w in named.items() if w}
    else:
        inner = [p for p, w in slots.items() if w == total]
        roots = {max(inner, key=len)} if total else set()
    return Rules(frozenset(roots), frozenset(constants), opened)


def main_text(html: str, rules: Rules) -> str:
    """The article of a page by its host's rules, blocks parted by one newline; article and main elements without rules."""
    tree = tree_of(html)

    def closed(element: Element, path: tuple[str, ...]) -> bool:
        return element.outside or (bool(element.marked) and path not in rules.opened)

    def look(wanted) -> list[tuple[Element, tuple[str, ...]]]:
        found, todo = [], [(tree, ())]
        while todo:
            here, where = todo.pop()
            if wanted(here, where):
                found.append((here, where))
                continue
            below = [(p, (*where, p.key)) for p in here.parts if not isinstance(p, str)]
            todo.extend(x for x in reversed(below) if not closed(*x))
        return found

    def skip(path: tuple[str, ...], text: str) -> bool:
        return (path, _text_hash(text)) in rules.constants

    if rules == Rules(frozenset(), frozenset()):  # no text by which a wrapper could tell
        found = look(lambda e, p: e.tag in ("article", "main"))
        return "\n".join(max((blocks_of(e) for e, _ in found), key=lambda blocks: sum(map(len, blocks)), default=blocks_of(tree)))
    blocks = [block for e, p in look(lambda e, p: p in rules.roots) for block in blocks_of(e, skip, p, closed)]
    return "\n".join(blocks or blocks_of(tree, skip, closed=closed))


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url.cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


def _packed(wrapper: list) -> str:
    return json.dumps(wrapper, separators=(",", ":"))


@dataclass(frozen=True)
class Infer:
    """Batches of (host, html) to (host, wrapper): the task's pages of a host folded into one."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                wrapper = wrapper_of(tree_of(html.as_py()))
                held[host] = merged(held[host], wrapper) if host in held else wrapper
                if len(held) > HELD_HOSTS:
                    yield self._flushed(held)
                    held = {}
        if held:
            yield self._flushed(held)

    def _flushed(self, held: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held), pa.array([_packed(w) for w in held.values()])], ["host", "wrapper"])


def merge_wrappers(table: pa.Table) -> pa.Table:
    """Several wrappers of one host to one."""
    whole = None
    for text in sorted(table.column("wrapper").to_pylist()):
        wrapper = json.loads(text)
        whole = wrapper if whole is None else merged(whole, wrapper)
    return pa.table({"host": table.column("host")[:1], "wrapper": pa.array([_packed(whole)])})


@dataclass(frozen=True)
class Extract:
    """Batches of (page_id, url, html, wrapper) to (page_id, url, text)."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, Rules] = {}
        for batch in batches:
            texts = []
            for html, wrapper in zip(batch.column(2), batch.column(3), strict=True):
                packed = wrapper.as_py()
                if packed not in known:
                    if len(known) > HELD_HOSTS:
                        known.clear()
                    known[packed] = rules_of(json.loads(packed)) if packed else Rules(frozenset(), frozenset())
                texts.append(main_text(html.as_py(), known[packed]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def infer_wrappers(pages: DataFrame, scratch: Scratch, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper) for each host of ``pages``."""
    rows = pages.select(host_of(pages[url_col]).alias("host"), text_or_empty(pages[html_col]).alias("html"))
    parts = rows.mapInArrow(Infer(), "host string, wrapper string")
    parts = scratch.save(parts.withColumn("lot", F.pmod(F.xxhash64("wrapper"), F.lit(LOTS)).cast("int")), "parts")
    lots = parts.groupBy("host", "lot").applyInArrow(lambda t: merge_wrappers(t), "host string, wrapper string")
    wrappers = scratch.save(lots.groupBy("host").applyInArrow(lambda t: merge_wrappers(t), "host string, wrapper string"), "wrappers")
    scratch.keep("wrappers")
    return wrappers


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of ``pages``: page_id, url, text."""
    scratch = Scratch(pages.sparkSession, "html")
    wrappers = infer_wrappers(pages, scratch, url_col, html_col)
    rows = pages.select(
        pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"),
        text_or_empty(pages[html_col]).alias("html"), host_of(pages[url_col]).alias("host"),
    )
    joined = rows.join(wrappers, "host", "left").select("page_id", "url", "html", "wrapper")
    return joined.mapInArrow(Extract(), "page_id long, url string, text string")
