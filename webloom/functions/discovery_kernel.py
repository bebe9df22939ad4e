"""URL discovery in style sheets, scripts and Link headers, with bounded ranked candidates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple


class Found(NamedTuple):
    url: str
    method: str
    confidence: str
    offset: int


# Ranks of evidence.
CSS_RANK = {"source-map": 3, "import": 2, "url": 1}
JS_RANK = {"fetch": 8, "xhr": 8, "import": 8, "url": 8, "source-map": 7, "absolute": 5, "relative": 4}
CONFIDENCE = {"high": 3, "medium": 2, "low": 1}
_LONGEST = 8192


def ranked(found: Iterator[Found], rank: dict[str, int], limit: int) -> list[Found]:
    """The best evidence for each URL, best first: method, confidence, earlier offset, then URL."""
    key = lambda f: (-rank[f.method], -CONFIDENCE[f.confidence], f.offset, f.url)
    best: dict[str, Found] = {}
    for f in found:
        if f.url not in best or key(f) < key(best[f.url]):
            best[f.url] = f
    return sorted(best.values(), key=key)[:limit]


_CSS = re.compile(
    r"""/\*(?P<comment>.*?)(?:\*/|\Z)|(?P<string>"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?)|@(?P<at>(?:[\w-]|[^\x00-\x7f]|\\[0-9a-fA-F]{1,6}\s?|\\[^\n])+)|(?P<name>(?:[\w-]|[^\x00-\x7f]|\\[0-9a-fA-F]{1,6}\s?|\\[^\n])+)""",
    re.S,
)
_GAP = r"(?:\s|/\*.*?\*/)*"
_QUOTED = re.compile(_GAP + r"""(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)')""", re.S)
_URL_BODY = re.compile(r"""\(\s*(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|((?:[^\s"'()\\]|\\.)*))\s*\)""", re.S)
_ESCAPED = re.compile(r"\\(?:([0-9a-fA-F]{1,6})\s?|(\r\n|\n|\r|\f)|(.))", re.S)


def css_text(raw: str) -> str:
    """Escapes of a style sheet resolved."""

    def plain(m: re.Match) -> str:
        if m[1]:
            code = int(m[1], 16)
            return "\ufffd" if code == 0 or code > 0x10FFFF or 0xD800 <= code <= 0xDFFF else chr(code)
        return "" if m[2] else m[3]

    return _ESCAPED.sub(plain, raw)


# Fixed value: a source-map declaration: a mark, the name, an equals sign, a target without blanks or stars.
_SOURCE_MAP = re.compile(r"[#@]\s*sourceMappingURL\s*=\s*([^\s*]+)", re.I | re.A)


def source_maps(text: str) -> Iterator[tuple[int, str]]:
    """Offset and target of every source-map declaration."""
    for found in _SOURCE_MAP.finditer(text):
        yield found.start(), found[1]


def _css(sheet: str) -> Iterator[Found]:
    at = 0
    while found := _CSS.search(sheet, at):
        at = found.end()
        if found["comment"] is not None:
            for at_map, url in source_maps(found["comment"]):
                yield Found(url, "source-map", "high", found.start() + 2 + at_map)
        elif found["at"] is not None and css_text(found["at"]).lower() == "import":
            if target := _QUOTED.match(sheet, at):
                yield Found(css_text(next(g for g in target.groups() if g is not None)), "import", "high", found.start())
                at = target.end()
            elif (name := re.compile(_GAP + r"((?:[\w-]|\\[0-9a-fA-F]{1,6}\s?|\\[^\n])+)", re.S).match(sheet, at)) and css_text(name[1]).lower() == "url" and (body := _URL_BODY.match(sheet, name.end())):
                yield Found(css_text(next(g for g in body.groups() if g is not None)), "import", "high", found.start())
                at = body.end()
        elif found["name"] is not None and css_text(found["name"]).lower() == "url" and (body := _URL_BODY.match(sheet, at)):
            yield Found(css_text(next(g for g in body.groups() if g is not None)), "url", "high", found.start())
            at = body.end()


def css_urls(sheet: str, limit: int = 500) -> list[Found]:
    """URLs of a style sheet; data:, javascript: and blob: URLs and overlong ones are left out."""
    usable = (f._replace(url=f.url.strip()) for f in _css(sheet))
    return ranked((f for f in usable if f.url and len(f.url) <= _LONGEST and not re.match("(data|javascript|blob):", f.url, re.I)), CSS_RANK, limit)


class _Literal(NamedTuple):
    start: int
    end: int  # after the closing quote
    value: str


def _literal(script: str, at: int) -> _Literal | None:
    """The string that opens at ``at``, with escaped quotes, slashes and backslashes resolved, if it closes on its line."""
    quote, parts, i, n = script[at], [], at + 1, len(script)
    while i < n:
        run = _ORDINARY.match(script, i)
        if run:
            parts.append(run[0])
            i = run.end()
            continue
        c = script[i]
        if c == quote:
            return _Literal(at, i + 1, "".join(parts))
        if c in "\r\n":
            return None
        if c == "\\":
            if i + 1 >= n or script[i + 1] in "\r\n":
                return None
            parts.append(script[i + 1] if script[i + 1] in _PLAIN_ESCAPES else script[i : i + 2])
            i += 2
        else:
            parts.append(c)
            i += 1
    return None


_ORDINARY = re.compile(r"[^\"'`\\\r\n]+")
_PLAIN_ESCAPES = "\"'`/\\"
_OPENING = re.compile(r"[\"'`]|/[/*]")


def _scan(script: str, comments: bool) -> Iterator[_Literal]:
    """String literals in order.  With ``comments`` also those in comments; else a template of several lines is skipped as one."""
    at = 0
    while found := _OPENING.search(script, at):
        at = found.end()
        if len(found[0]) == 2:
            if not comments:
                stop = script.find("*/" if found[0] == "/*" else "\n", at)
                at = len(script) if stop < 0 else stop + (2 if found[0] == "/*" else 0)
            else:
                at -= 1
            continue
        literal = _literal(script, found.start())
        if literal:
            yield literal
            at = literal.end
        elif found[0] == "`" and not comments:
            while (at := script.find("`", at)) >= 0 and script[at - 1] == "\\":
                at += 1
            at = len(script) if at < 0 else at + 1


# What stands before the first argument of a call that loads a URL.
_BEFORE = [
    ("fetch", re.compile(r"(?:^|[^\w$.])(?:(?:window|self|globalThis)\s*\.\s*)?fetch\s*\(\s*$")),
    ("import", re.compile(r"(?:^|[^\w$.])import\s*\(\s*$")),
    ("url", re.compile(r"(?:^|[^\w$.])new\s+URL\s*\(\s*$")),
]
_OPEN = re.compile(r"(?:^|[^\w$.])([A-Za-z_$][\w$]*)\s*\.\s*open\s*\(\s*$")
_MADE = re.compile(r"(?<![\w$.])([A-Za-z_$][\w$]*)\s*=(?!=)\s*(new\s+XMLHttpRequest\b)?")
_REACH = 120  # characters looked at before a literal


def literal_method(value: str) -> str | None:
    """absolute, relative, or None for a literal that names no URL."""
    if re.search(r"[\s<>{}|\\^]", value) or not 1 < len(value) <= _LONGEST:
        return None
    if re.match(r"(https?:)?//[^/]", value, re.I):
        return "absolute"
    return "relative" if re.match(r"(/|\.\.?/)[^/]?", value) else None


def _js_literals(script: str) -> Iterator[Found]:
    for x in _scan(script, comments=True):
        if method := literal_method(x.value):
            yield Found(x.value, method, "medium", x.start)


def _js_calls(script: str) -> Iterator[Found]:
    """First arguments of fetch, import and new URL, and second ones of open on receivers made only by new XMLHttpRequest."""
    requests, before = _only_requests(script), None
    for x in _scan(script, comments=False):
        lead = script[max(0, x.start - _REACH) : x.start]
        if "${" not in x.value:
            for method, pattern in _BEFORE:
                if m := pattern.search(lead):
                    yield Found(x.value, method, "high", x.start - len(lead) + m.start() + (not m[0][0].isalnum()))
                    break
            if before and before[1] in requests and before[0].value.isalnum() and script[before[0].end : x.start].strip() == ",":
                yield Found(x.value, "xhr", "high", before[0].start)
        opened = _OPEN.search(lead)
        before = (x, opened[1]) if opened else None


def _only_requests(script: str) -> set[str]:
    """Names to which nothing but a new XMLHttpRequest is assigned."""
    pieces, last = [], 0
    for x in _scan(script, comments=False):
        pieces.append(script[last : x.start])
        last = x.end
    pieces.append(script[last:])
    good, other = set(), set()
    for m in _MADE.finditer("''".join(pieces)):
        (good if m[2] else other).add(m[1])
    return good - other


def js_urls(script: str, mode: str = "hybrid", limit: int = 500) -> list[Found]:
    """URLs of a script: mode regex (literals), ast (calls, recognised token by token) or hybrid (both)."""

    def every() -> Iterator[Found]:
        if mode != "regex":
            yield from _js_calls(script)
        if mode != "ast":
            yield from _js_literals(script)
        yield from (Found(url, "source-map", "high", at) for at, url in source_maps(script))

    return ranked((f for f in every() if f.url), JS_RANK, limit)


# Kinds of link relations, first that applies.
LINK_KINDS = [("canonical", {"canonical"}), ("alternate", {"alternate"}), ("stylesheet", {"stylesheet"}), ("manifest", {"manifest"}), ("preload", {"preload", "modulepreload"}), ("prefetch", {"prefetch", "prerender"}), ("navigation", {"next", "prev"})]


def link_header(value: str) -> list[dict]:
    """Entries of a Link header: url, rel list, kind."""
    out = []
    for part in re.finditer(r"""<([^>]*)>((?:[^,"<]|"(?:[^"\\]|\\.)*")*)""", value):
        params = {k.lower(): (q.replace('\\"', '"') if q is not None else t) for k, q, t in ((m[1], m[2], m[3]) for m in re.finditer(r""";\s*([\w!#$&+.^`|~*-]+)\s*(?:=\s*(?:"((?:[^"\\]|\\.)*)"|([^\s;,"]*)))?""", part[2]))}
        rel = (params.get("rel") or "").lower().split()
        kind = next((k for k, names in LINK_KINDS if names & set(rel)), "asset")
        out.append({"url": part[1].strip(), "rel": rel, "kind": kind})
    return out
