"""Elements of a page as intervals: where each opens and closes, with the attributes that nested facts need."""

from __future__ import annotations

from typing import NamedTuple

from webloom.functions.html_kernel import BLOCK, HEADINGS, VOID, collapse, tokens
from webloom.functions.url_kernel import UrlError, parse, parsed_base

# Elements whose start closes an open one of these names, with what such a search doesn't leave.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_WALLS = {"ul", "ol", "dl", "table", "select", "article", "section", "nav", "aside", "main", "body", "div"}
SECTIONS = {"article", "aside", "nav", "section"}
# Attributes that hold the value of a property, by element; the first group are URLs.
_URLS = {"a": "href", "area": "href", "link": "href", "audio": "src", "embed": "src", "iframe": "src", "img": "src", "source": "src", "track": "src", "video": "src", "object": "data"}
_VALUES = {"meta": "content", "data": "value", "meter": "value", "time": "datetime"}


class Element(NamedTuple):
    start: int  # place among all tokens
    end: int  # place at which it closes
    tag: str
    level: int | None
    itemscope: bool
    itemtype: str | None
    itemid: str | None
    itemprop: list[str]
    value: str | None
    text: str | None


class _Open:
    __slots__ = ("attributes", "parts", "start", "tag", "wanted")

    def __init__(self, start: int, tag: str, attributes: dict[str, str]):
        self.start, self.tag, self.attributes, self.parts = start, tag, attributes, []
        self.wanted = "itemscope" in attributes or "itemprop" in attributes or tag in HEADINGS or tag in SECTIONS


def _finished(e: _Open, end: int, base) -> Element:
    a, text, scope = e.attributes, collapse("".join(e.parts)), "itemscope" in e.attributes
    value = None
    if "itemprop" in a and not scope:
        if e.tag in _URLS:
            try:
                value = parse(a[_URLS[e.tag]], base).normalized if _URLS[e.tag] in a else ""
            except UrlError:
                value = None
        else:
            value = a.get(_VALUES.get(e.tag, ""), "" if e.tag == "meta" else text)
    return Element(e.start, end, e.tag, HEADINGS.get(e.tag), scope, a.get("itemtype"), a.get("itemid"), list(dict.fromkeys(a.get("itemprop", "").split())), value, text if e.tag in HEADINGS else None)


def nested_elements(page: str, url: str) -> list[Element]:
    """Items, properties, headings and sections in order; intervals of two elements are nested or apart.

    An end tag closes all that is open inside its element, one without an open element does
    nothing, and elements that never close end with the page.
    """
    base, stack, out, at = parsed_base(url), [], [], 0

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            e = stack.pop()
            if e.wanted:
                out.append(_finished(e, at, base))

    for kind, value, attributes, _ in tokens(page):
        at += 1
        if kind == "text":
            if not (stack and stack[-1].tag in ("script", "style")):
                for e in stack:
                    if e.wanted:
                        e.parts.append(value)
        elif kind == "start":
            closes = _CLOSES.get(value) or ({"p"} if value in BLOCK and value != "br" else ())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in closes:
                    close(i)
                    break
                if stack[i].tag in _WALLS:
                    break
            at += 1
            stack.append(_Open(at, value, attributes))
            if value in VOID:
                at += 1
                close(len(stack) - 1)
        else:
            found = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == value), None)
            if found is not None:
                close(found)
    at += 1
    close(0)
    return sorted(out)
