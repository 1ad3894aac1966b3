"""HTML as a tree of block elements: a tolerant scanner, elements that hold no article text, and the blocks of text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

#: Fixed values of the HTML standard: elements without an end tag, elements whose content is not markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
#: Elements that end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
#: What an opening tag closes: elements that end at it, and the elements beyond which it doesn't look.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
#: Elements that never hold article text; header and footer count only outside an article.
NEVER = frozenset("head nav aside button select option dialog menu noscript template svg math object canvas audio video fieldset".split())
#: Words of class and id that mark what surrounds an article, and of role.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "sidebar sidenav footer cookie cookies consent gdpr notice notification comment comments disqus reply replies respond share "
    "sharing social breadcrumb breadcrumbs related recommended newsletter subscribe subscription popup modal overlay widget toolbar "
    "pagination pager masthead topbar skip".split()
)
#: Those of them that mark comments and teasers, whatever element has them.
ASIDES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion comment comments disqus reply replies "
    "respond related recommended newsletter cookie cookies consent gdpr".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())

#: Levels of elements that are told apart; deeper ones are blocks of the last. Marked ones and outsiders have more room.
LEVELS, MARKED_LEVELS = 128, 192

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_REST = re.compile(r"""[^"'>]*+(?:"[^"]*+"[^"'>]*+|'[^']*+'[^"'>]*+)*+""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[a-z]+")
_LAYOUT = re.compile(r"(?<![a-z])(?:no|not|without|with|has|hide|show)[-_]+[a-z]+")


@dataclass
class Element:
    """A block element; ``parts`` holds elements and texts (with character references decoded) in page order.

    ``marked`` is "!" for comments and teasers, "~" for other words and forms that may surround an article, and begins
    the key: the host's wrapper says whether such an element holds article text after all.
    """

    key: str
    tag: str
    outside: bool
    article: bool
    marked: str = ""
    parts: list = field(default_factory=list)
    level: int = 0
    shares: bool = False


def _break() -> Element:
    return Element("hr", "hr", False, False)


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def is_outside(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    """Whether an element holds what surrounds an article rather than its text."""
    if tag in NEVER or (tag in ("header", "footer") and not in_article) or (tag == "footer"):
        return True
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or attrs.get("role", "").lower() in ROLES:
        return True
    style = attrs.get("style", "").replace(" ", "").lower()
    if "display:none" in style or "visibility:hidden" in style:
        return True
    return False


def mark_of(tag: str, attrs: dict[str, str]) -> str:
    """What class, id or a form say of an element, see Element; words of a layout such as no-sidebar say nothing."""
    if tag in ("html", "body", "main"):
        return ""
    named = _LAYOUT.sub(" ", f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()) if attrs else ""
    words = MARKS.intersection(_WORDS.findall(named)) if named else ()
    if words and not ASIDES.isdisjoint(words):
        return "!"
    return "~" if tag == "form" or (words and tag != "article") else ""


def _key(tag: str, attrs: dict[str, str]) -> str:
    classes = sorted(re.sub(r"\d+", "0", attrs.get("class", "")).split())
    return ".".join([tag, *classes])


def tree_of(html: str) -> Element:
    """The page as a tree. Broken markup never fails: what isn't a tag is text, and missing end tags are implied.

    The tree has at most MARKED_LEVELS levels. Deeper elements share the parts of the one around them, parted as blocks.
    """
    root = Element("", "", False, False)
    stack = [root]
    at, end = 0, len(html)
    while at < end:
        low = html.find("<", at)
        if low < 0:
            low = end
        if low > at:
            stack[-1].parts.append(unescape(html[at:low]))
        if low >= end:
            break
        mark = html[low + 1 : low + 2]
        if mark == "!" or mark == "?":
            if html.startswith("<!--", low):
                close = html.find("-->", low + 4)
                at = end if close < 0 else close + 3
            else:
                close = html.find(">", low)
                at = end if close < 0 else close + 1
            continue
        closing = mark == "/"
        name = _NAME.match(html, low + 1 + closing)
        if not name:
            if closing:  # a bogus comment
                close = html.find(">", low)
                at = end if close < 0 else close + 1
            else:
                stack[-1].parts.append("<")
                at = low + 1
            continue
        tag = name.group().lower()
        close = _REST.match(html, name.end()).end()
        if html[close : close + 1] != ">":  # a quote that never ends
            close = html.find(">", name.end())
            if close < 0:
                break
        inside = html[name.end() : close]
        at = close + 1
        if closing:
            if tag == "br":
                stack[-1].parts.append(" ")
            elif tag in BLOCK or tag in NEVER:
                _close(stack, tag)
            continue
        if tag in RAW:
            if not inside.endswith("/") or tag in ("script", "style", "textarea", "title"):
                found = re.compile(f"</{tag}", re.IGNORECASE).search(html, at)
                if not found:
                    break
                close = html.find(">", found.end())
                at = end if close < 0 else close + 1
            continue
        if tag == "br":
            stack[-1].parts.append(" ")
        elif tag == "hr":
            stack[-1].parts.append(_break())
        elif tag not in VOID:
            attrs = attributes(inside) if inside.strip(" /") else {}
            if tag in BLOCK or tag in NEVER:
                _imply(stack, tag)
                parent = stack[-1]
                marked = mark_of(tag, attrs)
                inside_article = parent.article or tag in ("article", "main")
                outside = is_outside(tag, attrs, parent.article)
                if parent.level >= (MARKED_LEVELS if outside or marked else LEVELS):
                    element = Element(parent.key, tag, parent.outside, inside_article, parent.marked, parent.parts, parent.level, True)
                    parent.parts.append(_break())
                else:
                    element = Element(marked + _key(tag, attrs), tag, outside, inside_article, marked, level=parent.level + 1)
                    parent.parts.append(element)
                if not inside.rstrip().endswith("/") or tag in BLOCK:
                    stack.append(element)
    return root


def _imply(stack: list[Element], tag: str) -> None:
    if tag in BLOCK:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag == "p":
                _cut(stack, depth)
                break
            if stack[depth].tag in ("td", "th", "li", "div", "article", "section", "button", "object"):
                break
    ends, limits = ENDS.get(tag, (frozenset(), frozenset()))
    if ends:
        cut = None
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in limits:
                break
            if stack[depth].tag in ends:
                cut = depth
        if cut is not None:
            _cut(stack, cut)


def _cut(stack: list[Element], depth: int) -> None:
    """Close the elements from ``depth`` on; what follows one that shares its parts is a block of its own."""
    shares = stack[depth].shares
    del stack[depth:]
    if shares:
        stack[-1].parts.append(_break())


def _close(stack: list[Element], tag: str) -> None:
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth].tag == tag:
            _cut(stack, depth)
            return


def shut(element: Element, path: tuple[str, ...]) -> bool:
    """Elements that are outside, and all that are marked."""
    return element.outside or bool(element.marked)


def blocks_of(element: Element, skip=lambda path, text: False, path: tuple[str, ...] = (), closed=shut) -> list[str]:
    """The texts of blocks in page order, white space made one space, without elements that are ``closed``.

    ``skip`` drops a block by the path of its element and its text.
    """
    out: list[str] = []
    todo: list = [(element, path, 0, [])]
    while todo:
        here, where, k, run = todo.pop()
        ended = False
        while k < len(here.parts):
            part = here.parts[k]
            k += 1
            if isinstance(part, str):
                run.append(part)
                continue
            _emit(run, out, skip, where)
            run = []
            below = (*where, part.key)
            if not closed(part, below):
                todo.append((here, where, k, run))
                todo.append((part, below, 0, []))
                ended = True
                break
        if not ended:
            _emit(run, out, skip, where)
    return out


def _emit(run: list[str], out: list[str], skip, where: tuple[str, ...]) -> None:
    text = " ".join("".join(run).split())
    if text and not skip(where, text):
        out.append(text)
