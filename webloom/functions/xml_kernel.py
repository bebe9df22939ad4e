"""Sitemaps and feeds: namespace-aware, budgeted parsing; validation of their fields."""

from __future__ import annotations

import calendar
import re
import zlib
from xml.parsers import expat

from webloom.functions.url_kernel import Url, UrlError, parse, parsed_base

# Namespaces and vocabularies.
SITEMAP = "http://www.sitemaps.org/schemas/sitemap/0.9"
ATOM = "http://www.w3.org/2005/Atom"
CHANGE_FREQUENCIES = ["always", "hourly", "daily", "weekly", "monthly", "yearly", "never"]
LASTMOD = r"^(\d{4})(?:-(\d{2})(?:-(\d{2})(?:T(\d{2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?(?:Z|[+-](\d{2}):(\d{2})))?)?)?$"
PRIORITY = r"^(?:0(?:\.[0-9]+)?|1(?:\.0+)?)$"


class XmlBudgetError(ValueError):
    """A document beyond a limit."""


def inflate(data: bytes, limit: int) -> bytes:
    """Gzip members of a body up to a byte limit; a body without the gzip mark comes back as it is."""
    if data[:2] != b"\x1f\x8b":
        return data
    out, rest = b"", data
    while rest[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out += member.decompress(rest, limit - len(out) + 1)
        if len(out) > limit:
            raise XmlBudgetError("inflated body exceeds its limit")
        if not member.eof:
            raise ValueError("incomplete gzip body")
        rest = member.unused_data
    return out


class Node:
    __slots__ = ("attributes", "children", "name", "parts", "space")

    def __init__(self, space: str, name: str, attributes: dict[str, str]):
        self.space, self.name, self.attributes = space, name, attributes
        self.children: list[Node] = []
        self.parts: list[str] = []

    @property
    def text(self) -> str:
        return "".join(self.parts) + "".join(c.text for c in self.children)

    def all(self, name: str, space: str | None = None) -> list[Node]:
        return [c for c in self.children if c.name == name and (space is None or c.space == space)]

    def value(self, name: str, space: str | None = None) -> str | None:
        found = self.all(name, space)
        return found[0].text.strip() if found else None


def tree(data: bytes | str, max_nodes: int = 200_000, max_depth: int = 256) -> Node:
    parser = expat.ParserCreate(namespace_separator=" ")
    root: list[Node] = []
    stack: list[Node] = []
    count = 0

    def start(name: str, attributes: dict[str, str]) -> None:
        nonlocal count
        count += 1
        if count > max_nodes or len(stack) >= max_depth:
            raise XmlBudgetError("too many nodes" if count > max_nodes else "too deep")
        space, _, local = name.rpartition(" ")
        node = Node(space, local, attributes)
        (stack[-1].children if stack else root).append(node)
        stack.append(node)

    def refuse(*_: object) -> None:
        raise ValueError("entity declarations are refused")

    parser.StartElementHandler = start
    parser.EndElementHandler = lambda _: stack.pop()
    parser.CharacterDataHandler = lambda text: stack[-1].parts.append(text) if stack else None
    parser.EntityDeclHandler = refuse
    parser.Parse(data, True)
    return root[0]


def classify(root: Node) -> str:
    """sitemap, sitemap-index, feed or xml by exact root name and namespace."""
    if root.space == SITEMAP:
        return {"urlset": "sitemap", "sitemapindex": "sitemap-index"}.get(root.name, "xml")
    if (root.space, root.name) == (ATOM, "feed") or (root.space, root.name) == ("", "rss"):
        return "feed"
    return "xml"


def valid_lastmod(text: str) -> bool:
    """W3C date or date and time with a zone, on the calendar."""
    m = re.match(LASTMOD, text)
    if not m:
        return False
    year, month, day, hour, minute, second, zone_h, zone_m = (int(g) if g else None for g in m.groups())
    if month is not None and not 1 <= month <= 12:
        return False
    if day is not None and not 1 <= day <= (calendar.monthrange(year, month)[1] if year else 28):
        return False
    within = ((hour, 23), (minute, 59), (second, 59), (zone_h, 23), (zone_m, 59))
    return all(v is None or v <= top for v, top in within)


def _place(sitemap: Url, entry: Url) -> str | None:
    if sitemap.origin != entry.origin:
        return "other origin"
    return None if entry.path.startswith(sitemap.path[: sitemap.path.rfind("/") + 1]) else "outside path prefix"


def sitemap_entries(root: Node, url: str, limit: int = 50_000) -> tuple[list[dict], int]:
    """Entries of a sitemap or sitemap index, and how many the limit left out."""
    kind = "sitemap" if root.name == "sitemapindex" else "url"
    found, base, out = root.all(kind, SITEMAP), parsed_base(url), []
    for node in found[:limit]:
        warnings, normalized = [], None
        loc = node.value("loc", SITEMAP)
        if loc is None:
            warnings.append("missing loc")
        else:
            try:
                entry = parse(loc, base)
                normalized = entry.normalized
                if base and (place := _place(base, entry)):
                    warnings.append(place)
            except UrlError:
                warnings.append("invalid url")
        lastmod, frequency, priority = (node.value(n, SITEMAP) for n in ("lastmod", "changefreq", "priority"))
        if lastmod is not None and not valid_lastmod(lastmod):
            warnings.append("invalid lastmod")
        if frequency is not None and frequency not in CHANGE_FREQUENCIES:
            warnings.append("invalid changefreq")
            frequency = None
        if priority is not None and not re.match(PRIORITY, priority):
            warnings.append("invalid priority")
            priority = None
        out.append({"kind": kind, "loc": loc, "url": normalized, "lastmod": lastmod, "changefreq": frequency, "priority": None if priority is None else float(priority), "warnings": warnings})
    return out, max(0, len(found) - limit)


def feed_entries(root: Node, url: str) -> list[dict]:
    """Atom entries (their alternate link) or RSS items."""
    base, out = parsed_base(url), []
    if root.space == ATOM:
        for e in root.all("entry", ATOM):
            links = e.all("link", ATOM)
            link = next((n.attributes.get("href") for n in links if n.attributes.get("rel", "alternate") == "alternate"), None)
            out.append({"id": e.value("id", ATOM), "title": e.value("title", ATOM), "link": link, "published": e.value("published", ATOM) or e.value("updated", ATOM)})
    else:
        for channel in root.all("channel"):
            out += [{"id": i.value("guid"), "title": i.value("title"), "link": i.value("link"), "published": i.value("pubDate")} for i in channel.all("item")]
    for e in out:
        try:
            e["url"] = parse(e["link"], base).normalized if e["link"] is not None else None
        except UrlError:
            e["url"] = None
    return out


def extract(data: bytes | str | None, url: str, max_bytes: int = 10_485_760, limit: int = 50_000) -> dict:
    """kind, status (parsed, failed, budget), error, entries of a sitemap or feed."""
    out = {"kind": "xml", "status": "parsed", "error": None, "sitemap": [], "feed": [], "left_out": 0}
    try:
        raw = inflate(data.encode() if isinstance(data, str) else data or b"", max_bytes)
        if len(raw) > max_bytes:
            raise XmlBudgetError("body exceeds its limit")
        root = tree(raw)
    except XmlBudgetError as e:
        return out | {"status": "budget", "error": str(e)}
    except (ValueError, expat.ExpatError, zlib.error) as e:
        return out | {"status": "failed", "error": str(e)}
    out["kind"] = classify(root)
    if out["kind"].startswith("sitemap"):
        out["sitemap"], out["left_out"] = sitemap_entries(root, url, limit)
    elif out["kind"] == "feed":
        out["feed"] = feed_entries(root, url)
    return out
