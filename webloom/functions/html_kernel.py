"""HTML facts from one pass over a page: a tokenizer and a collector, no tree kept.

The tokenizer follows the HTML standard where crawl facts depend on it: comments, raw text in
script and style, character references, attributes in all quotings, and void elements.  End
tags that the standard implies are applied to text collection only; deviations are stated
where they matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

from webloom.functions.url_kernel import Url, UrlError, parse, parsed_base

_MARK = re.compile(r"<!--|<!|<\?|</?[a-zA-Z]")
_NAME = re.compile(r"[^\s/>]+")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_SPACE = re.compile(r"[ \t\n\f\r]+")
RAW = {"script", "style", "xmp", "iframe", "noembed", "noframes"}
ESCAPABLE = {"title", "textarea"}
HIDDEN = {"head", "script", "style", "template", "noscript", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tr", "td", "th", "ul"}
HEADINGS = {f"h{i}": i for i in range(1, 7)}


def tokens(page: str) -> Iterator[tuple[str, str, dict[str, str] | None, int]]:
    """("start", name, attributes, offset), ("end", name, None, offset) and ("text", text, None, offset)."""
    at, n = 0, len(page)
    while at < n:
        found = _MARK.search(page, at)
        if not found:
            yield "text", unescape(page[at:]), None, at
            return
        if found.start() > at:
            yield "text", unescape(page[at : found.start()]), None, at
        here, mark = found.start(), found[0]
        if mark == "<!--":
            end = page.find("-->", here + 4)
            if page.startswith(("<!-->", "<!--->"), here):
                end = page.index(">", here) - 2
            at = n if end < 0 else end + 3
        elif mark in ("<!", "<?"):
            end = page.find(">", here)
            at = n if end < 0 else end + 1
        else:
            closing = mark[1] == "/"
            name_at = here + (2 if closing else 1)
            name = _NAME.match(page, name_at)[0].lower()
            at, attributes = _attributes(page, name_at + len(name))
            if closing:
                yield "end", name, None, here
                continue
            yield "start", name, attributes, here
            if name in RAW or name in ESCAPABLE:
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                stop = end.start() if end else n
                if stop > at:
                    yield "text", unescape(page[at:stop]) if name in ESCAPABLE else page[at:stop], None, at
                at = stop


def _attributes(page: str, at: int) -> tuple[int, dict[str, str]]:
    out: dict[str, str] = {}
    while True:
        found = _ATTRIBUTE.match(page, at)
        if not found:
            end = page.find(">", at)
            return (len(page) if end < 0 else end + 1), out
        value = next((v for v in found.groups()[1:] if v is not None), "")
        out.setdefault(found[1].lower(), unescape(value))
        at = found.end()


def collapse(text: str) -> str:
    return _SPACE.sub(" ", text).strip(" ")


def bounded(text: str, limit: int) -> dict:
    """Cuts after whole characters within ``limit`` UTF-8 bytes."""
    raw = text.encode("utf-8", "replace")
    if len(raw) <= limit:
        return {"text": text, "total_bytes": len(raw), "truncated": False}
    return {"text": raw[:limit].decode("utf-8", "ignore"), "total_bytes": len(raw), "truncated": True}


def parse_srcset(value: str) -> list[str]:
    """URLs of a srcset: candidates end at a comma after the URL or its descriptors; parentheses shield commas."""
    out, at, n = [], 0, len(value)
    while True:
        while at < n and value[at] in " \t\n\f\r,":
            at += 1
        if at >= n:
            return out
        begin = at
        while at < n and value[at] not in " \t\n\f\r":
            at += 1
        url = value[begin:at]
        if url.endswith(","):
            out.append(url.rstrip(","))
            continue
        out.append(url)
        depth = 0
        while at < n and (value[at] != "," or depth):
            depth += {"(": 1, ")": -1}.get(value[at], 0) if depth or value[at] == "(" else 0
            at += 1


def meta_refresh(content: str) -> tuple[float, str | None] | None:
    """Seconds and target of a refresh declaration."""
    found = re.match(r"\s*(\d+(?:\.\d*)?|\.\d+)\s*(?:[;,\s]\s*(.*))?$", content, re.S)
    if not found:
        return None
    rest = re.sub(r"^url\s*=\s*", "", (found[2] or "").strip(), flags=re.I)
    if rest[:1] in "'\"" and rest:
        rest = rest[1:].partition(rest[0])[0]
    return float(found[1]), rest.strip() or None


def robots_header(value: str) -> list[dict]:
    """Comma parts of X-Robots-Tag; an agent before a colon belongs to the first part only."""
    out = []
    for i, part in enumerate(value.split(",")):
        agent, colon, rule = part.partition(":")
        named = i == 0 and colon and not re.match(r"\s*(max-|unavailable_after)", part, re.I)
        out.append({"agent": agent.strip().lower() if named else None, "directive": (rule if named else part).strip().lower()})
    return [x for x in out if x["directive"]]


def rel_values(attributes: dict[str, str]) -> list[str]:
    return attributes.get("rel", "").lower().split()


class _Open:
    __slots__ = ("attributes", "name", "offset", "parts")

    def __init__(self, name: str, attributes: dict[str, str], offset: int):
        self.name, self.attributes, self.offset, self.parts = name, attributes, offset, []


class Page:
    """Facts of one page; everything is collected in a single pass."""

    def __init__(self, page: str, url: str, max_text: int = 1_000_000, product: str = "robot"):
        self.url, self.base_url = url, parsed_base(url)
        self.titles: list[str] = []
        self.metas: list[dict[str, str]] = []
        self.link_tags: list[dict[str, str]] = []
        self.anchors: list[dict] = []
        self.headings: list[dict] = []
        self.images: list[dict[str, str]] = []
        self.tags: list[tuple[str, dict[str, str]]] = []
        self.scripts: list[dict] = []
        self.styles: list[str] = []
        self.forms: list[dict[str, str]] = []
        self.lang: str | None = None
        self.charset: str | None = None
        self.bases: list[str] = []
        self.microdata: list[str | None] = []
        self.warnings: list[str] = []
        self.product = product
        visible, whole = self._collect(page)
        self.visible_text = bounded(collapse(visible), max_text)
        self.text_content = bounded(collapse(whole), max_text)
        self._set_base()

    def _collect(self, page: str) -> tuple[str, str]:
        visible: list[str] = []
        whole: list[str] = []
        hidden: list[str] = []
        texts: list[_Open] = []  # open elements whose text is a fact
        for kind, value, attributes, offset in tokens(page):
            if kind == "text":
                raw = texts and texts[-1].name in ("script", "style")
                if not raw:
                    whole.append(value)
                if not hidden:
                    visible.append(value)
                for t in texts if not raw else texts[-1:]:
                    t.parts.append(value)
            elif kind == "start":
                self._start(value, attributes, offset)
                if value == "body":
                    hidden = [h for h in hidden if h != "head"]
                if value in HEADINGS or value in ("a", "area", "title", "script", "style"):
                    if value == "a":
                        self._close("a", texts)
                    texts.append(_Open(value, attributes, offset))
                    if value == "area":
                        self._close("area", texts)
                if value in HIDDEN:
                    hidden.append(value)
                if value in BLOCK:
                    visible.append("\n")
                    whole.append("\n")
            else:
                self._close(value, texts)
                if value in hidden:
                    del hidden[len(hidden) - 1 - hidden[::-1].index(value) :]
                if value in BLOCK:
                    visible.append("\n")
                    whole.append("\n")
        while texts:
            self._close(texts[-1].name, texts)
        return "".join(visible), "".join(whole)

    def _start(self, name: str, a: dict[str, str], offset: int) -> None:
        if name == "html" and self.lang is None:
            self.lang = a.get("lang")
        elif name == "meta":
            self.metas.append(a)
            if self.charset is None and "charset" in a:
                self.charset = a["charset"].strip().lower()
        elif name == "link":
            self.link_tags.append(a)
        elif name == "base" and "href" in a:
            self.bases.append(a["href"])
        elif name == "img":
            self.images.append(a)
        elif name == "form":
            self.forms.append(a)
        if "itemscope" in a:
            self.microdata.append(a.get("itemtype"))
        self.tags.append((name, a))

    def _close(self, name: str, texts: list[_Open]) -> None:
        at = next((i for i in range(len(texts) - 1, -1, -1) if texts[i].name == name), None)
        if at is None:
            return
        done = texts.pop(at)
        text = "".join(done.parts)
        if name == "title":
            self.titles.append(text)
        elif name in HEADINGS:
            self.headings.append({"level": HEADINGS[name], "text": collapse(text), "id": done.attributes.get("id")})
        elif name in ("a", "area"):
            self.anchors.append({"tag": name, "attributes": done.attributes, "text": collapse(text), "offset": done.offset})
        elif name == "script":
            self.scripts.append({"attributes": done.attributes, "text": text})
        elif name == "style":
            self.styles.append(text)

    def _set_base(self) -> None:
        self.base_href = None
        for i, raw in enumerate(self.bases):
            try:
                self.base_href = parse(raw, self.base_url).resolved
            except UrlError:
                self.warnings.append("BASE_HREF_IGNORED")
                continue
            break

    def resolve(self, raw: str | None, base: Url | None = None) -> str | None:
        if raw is None:
            return None
        try:
            return parse(raw, base or self.base_url).normalized
        except UrlError:
            return None

    @property
    def title(self) -> str | None:
        return self.titles[0].strip() if self.titles else None

    def meta(self, name: str) -> str | None:
        """Content of the first meta of that name or property; the first one decides even without content."""
        for m in self.metas:
            if name in (m.get("name", "").lower(), m.get("property", "").lower()):
                return m.get("content")
        return None

    def first_link(self, rel: str) -> str | None:
        return next((a["href"] for a in self.link_tags if rel in rel_values(a) and "href" in a), None)

    @property
    def robots(self) -> list[str]:
        return [m.get("content", "") for m in self.metas if m.get("name", "").lower() in ("robots", self.product)]

    @property
    def refresh(self) -> tuple[float, str | None] | None:
        for m in self.metas:
            if m.get("http-equiv", "").lower() == "refresh" and (found := meta_refresh(m.get("content", ""))):
                return found
        return None

    @property
    def json_ld(self) -> list[str]:
        return [s["text"].strip() for s in self.scripts if s["attributes"].get("type", "").strip().lower() == "application/ld+json"]

    @property
    def outline(self) -> list[dict]:
        """Depth of each heading below the headings of lower level before it (an approximation of sectioning)."""
        out, stack = [], []
        for h in self.headings:
            while stack and stack[-1] >= h["level"]:
                stack.pop()
            stack.append(h["level"])
            out.append({"depth": len(stack), "tag": f"h{h['level']}", "text": h["text"]})
        return out

    def links(self) -> Iterator[dict]:
        """Links in collection order: source, kind, raw, rel, text."""

        def one(source: str, kind: str, raw: str | None, rel: list[str] = (), text: str | None = None) -> Iterator[dict]:
            if raw is not None:
                yield {"source": source, "kind": kind, "raw": raw, "rel": list(rel), "text": text}

        for a in sorted(self.anchors, key=lambda a: (a["tag"] == "area", a["offset"])):
            yield from one(f"{a['tag']}[href]", "navigation", a["attributes"].get("href"), rel_values(a["attributes"]), a["text"])
        for kind, wanted in (("canonical", "canonical"), ("alternate", "alternate"), ("hreflang", "alternate"), ("stylesheet", "stylesheet")):
            for a in self.link_tags:
                if wanted in rel_values(a) and (kind != "hreflang" or "hreflang" in a) and (kind != "alternate" or "hreflang" not in a):
                    yield from one("link[href]", kind, a.get("href"), rel_values(a))
        for a in self.images:
            yield from one("img[src]", "image", a.get("src"))
            for u in parse_srcset(a.get("srcset", "")):
                yield from one("img[srcset]", "image", u)
        for name, a in self.tags:
            if name == "source":
                yield from one("source[src]", "media", a.get("src"))
                for u in parse_srcset(a.get("srcset", "")):
                    yield from one("source[srcset]", "image", u)
        for wanted, attribute, kind in (("iframe", "src", "iframe"), ("script", "src", "script"), ("form", "action", "form")):
            for name, a in self.tags:
                if name == wanted:
                    yield from one(f"{name}[{attribute}]", kind, a.get(attribute))
        if self.refresh and self.refresh[1]:
            yield from one("meta-refresh", "navigation", self.refresh[1])
        yield from self._references(one)

    def _references(self, one) -> Iterator[dict]:
        # Elements and attributes that refer to resources.
        plain = {("audio", "src"): "media", ("video", "src"): "media", ("video", "poster"): "image", ("track", "src"): "media", ("object", "data"): "object", ("embed", "src"): "object", ("input", "src"): "image", ("input", "formaction"): "form", ("button", "formaction"): "form"}
        for name, a in self.tags:
            for (tag, attribute), kind in plain.items():
                if tag == name:
                    yield from one(f"{tag}[{attribute}]", kind, a.get(attribute))
            if name == "link":
                for rel in rel_values(a):
                    kind = {"manifest": "manifest", "preload": "preload", "modulepreload": "preload", "prefetch": "prefetch"}.get(rel)
                    if kind:
                        yield from one("link[href]", kind, a.get("href"), rel_values(a))
                for u in parse_srcset(a.get("imagesrcset", "")):
                    yield from one("link[imagesrcset]", "image", u)
            if name in ("image", "use"):
                yield from one("svg[href]", "image", a.get("href"))
                yield from one("svg[xlink:href]", "image", a.get("xlink:href"))
            if name == "iframe" and "srcdoc" in a:
                for inner in Page(a["srcdoc"], self.url).anchors:
                    yield from one("iframe[srcdoc]", "navigation", inner["attributes"].get("href"), (), inner["text"])
