"""URL parsing and normalisation after the WHATWG URL standard, for http and https."""

from __future__ import annotations

import ipaddress
import re
from functools import lru_cache
from typing import NamedTuple

PORTS = {"http": 80, "https": 443}
_EDGES = "".join(map(chr, range(33)))
_DROPPED = dict.fromkeys(map(ord, "\t\n\r"))
_SCHEME = re.compile(r"([a-zA-Z][a-zA-Z0-9+.\-]*):")
_BAD_HOST = re.compile(r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]")
# Characters that the standard percent-encodes in each part, beyond controls and non-ASCII.
PATH_ENCODED = ' "#<>?^`{}'
QUERY_ENCODED = " \"#<>'"
FRAGMENT_ENCODED = ' "<>`'


class Url(NamedTuple):
    scheme: str
    host: str
    port: int | None
    path: str
    query: str | None
    fragment: str | None

    @property
    def origin(self) -> str:
        return f"{self.scheme}://{self.host}" + (f":{self.port}" if self.port is not None else "")

    @property
    def normalized(self) -> str:
        return self.origin + self.path + (f"?{self.query}" if self.query is not None else "")

    @property
    def resolved(self) -> str:
        return self.normalized + (f"#{self.fragment}" if self.fragment is not None else "")


class UrlError(ValueError):
    """A text that is no URL this engine fetches."""


def encode(text: str, chars: str) -> str:
    if text.isascii() and text.isprintable() and not any(c in text for c in chars):
        return text
    return "".join(c if 0x20 <= ord(c) < 0x7F and c not in chars else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def _ipv4(host: str) -> str | None:
    """Dotted form of a host that the standard reads as an IPv4 number; None for a name."""
    parts = host.split(".")
    if parts[-1] == "" and len(parts) > 1:
        parts.pop()
    last = parts[-1]
    if not (last.isdigit() and last.isascii() or re.fullmatch(r"0[xX][0-9a-fA-F]*", last)):
        return None
    numbers = []
    for p in parts:
        if re.fullmatch(r"0[xX][0-9a-fA-F]*", p):
            numbers.append(int(p[2:] or "0", 16))
        elif re.fullmatch(r"0[0-7]*", p):
            numbers.append(int(p, 8))
        elif re.fullmatch(r"[1-9][0-9]*", p):
            numbers.append(int(p))
        else:
            raise UrlError("invalid IPv4 address")
    if len(numbers) > 4 or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        raise UrlError("invalid IPv4 address")
    value = numbers[-1] + sum(n << (8 * (3 - i)) for i, n in enumerate(numbers[:-1]))
    return str(ipaddress.IPv4Address(value))


@lru_cache(maxsize=50_000)
def parse_host(raw: str) -> str:
    if raw.startswith("["):
        if not raw.endswith("]"):
            raise UrlError("unclosed IPv6 address")
        try:
            return f"[{ipaddress.IPv6Address(raw[1:-1]).compressed}]"
        except ValueError as e:
            raise UrlError("invalid IPv6 address") from e
    host = re.sub(rb"%([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]), raw.encode()).decode("utf-8", "replace").lower()
    if not host.isascii():
        try:
            host = ".".join(label.encode("idna").decode() if label else "" for label in re.split("[.。．｡]", host))
        except UnicodeError as e:
            raise UrlError("invalid international host") from e
    if not host or _BAD_HOST.search(host):
        raise UrlError("invalid host")
    return _ipv4(host) or host


def _segments(path: str, base: list[str]) -> str:
    out = list(base)
    parts = path.split("/")
    for i, part in enumerate(parts):
        dots = re.sub("%2e", ".", part, flags=re.I)
        last = i == len(parts) - 1
        if dots == "..":
            if out:
                out.pop()
            if last:
                out.append("")
        elif dots == ".":
            if last:
                out.append("")
        else:
            out.append(encode(part, PATH_ENCODED))
    return "/" + "/".join(out)


def parse(raw: str, base: Url | None = None) -> Url:
    """Resolves ``raw`` against ``base``; raises UrlError where no http(s) URL without credentials results."""
    text = raw.strip(_EDGES).translate(_DROPPED)
    scheme = _SCHEME.match(text)
    if scheme:
        name, rest = scheme[1].lower(), text[scheme.end() :]
        if name not in PORTS:
            raise UrlError("unsupported protocol")
        if not (base and base.scheme == name and not re.match(r"[/\\]", rest)):
            rest = "//" + rest.lstrip("/\\")
            base = None
    else:
        if base is None:
            raise UrlError("relative URL without a base")
        name, rest = base.scheme, text
    rest, mark, fragment = rest.partition("#")
    fragment = encode(fragment, FRAGMENT_ENCODED) if mark else None
    rest, mark, query = rest.partition("?")
    query = encode(query, QUERY_ENCODED) if mark else None
    rest = rest.replace("\\", "/")
    if rest.startswith("//"):
        authority, slash, path = rest.lstrip("/").partition("/")
        if "@" in authority:
            raise UrlError("credentials in URL")
        found = re.fullmatch(r"(\[[^\]]*\]?|[^:]*)(?::([0-9]*))?", authority)
        if not found:
            raise UrlError("invalid authority")
        port = int(found[2]) if found[2] else None
        if port is not None and port > 65535:
            raise UrlError("invalid port")
        return Url(name, parse_host(found[1]), None if port == PORTS[name] else port, _segments(path, []) if slash else "/", query, fragment)
    assert base is not None
    if rest.startswith("/"):
        path = _segments(rest[1:], [])
    elif rest:
        path = _segments(rest, base.path[1:].split("/")[:-1])
    else:
        path, query = base.path, query if mark else base.query
    return Url(name, base.host, base.port, path, query, fragment)


@lru_cache(maxsize=20_000)
def parsed_base(text: str) -> Url | None:
    try:
        return parse(text)
    except UrlError:
        return None


def normalize(raw: str | None, base: str | None = None) -> str | None:
    """The normalised URL (no fragment), or None."""
    if raw is None:
        return None
    try:
        return parse(raw, parsed_base(base) if base else None).normalized
    except UrlError:
        return None


def failure(raw: str | None, base: str | None = None) -> str | None:
    """Why a text has no normalised URL; None where it has."""
    try:
        parse(raw or "", parsed_base(base) if base else None)
    except UrlError as e:
        return str(e)
    return None
