"""Character encodings of bodies: detection order, labels and decoding."""

from __future__ import annotations

import codecs
import re
from typing import NamedTuple

# Byte order marks, in order of test, and labels whose web meaning differs from the codec's name.
MARKS = [(b"\x00\x00\xfe\xff", "utf-32be"), (b"\xff\xfe\x00\x00", "utf-32le"), (b"\xef\xbb\xbf", "utf-8"), (b"\xfe\xff", "utf-16be"), (b"\xff\xfe", "utf-16le")]
WEB_LABELS = {"latin1": "cp1252", "latin-1": "cp1252", "iso-8859-1": "cp1252", "iso8859-1": "cp1252", "us-ascii": "cp1252", "ascii": "cp1252", "windows-1252": "cp1252", "unicode-1-1-utf-8": "utf-8", "utf8": "utf-8", "utf-16": "utf-16le", "ks_c_5601-1987": "cp949", "euc-kr": "cp949", "shift_jis": "cp932", "gb2312": "gbk", "x-sjis": "cp932", "iso-8859-9": "cp1254", "tis-620": "cp874", "x-gbk": "gbk"}
_META = re.compile(rb"<meta[^>]*?charset\s*=\s*[\"']?\s*([\w:.-]+)", re.I)
_XML = re.compile(rb"^\s*<\?xml[^>]*?encoding\s*=\s*[\"']([\w:.-]+)[\"']", re.I)


class Detected(NamedTuple):
    label: str
    source: str


class Decoded(NamedTuple):
    text: str | None
    label: str
    source: str
    replaced: bool
    warning: str | None


def http_charset(content_type: str | None) -> str | None:
    found = re.search(r";\s*charset\s*=\s*(?:\"([^\"]+)\"|([^\s;\"]+))", content_type or "", re.I)
    return (found[1] or found[2]).strip().lower() if found else None


def detect(body: bytes, content_type: str | None, kind: str) -> Detected:
    """Byte order mark, then HTTP charset, then the document's own declaration, then UTF-8."""
    for mark, label in MARKS:
        if body.startswith(mark):
            return Detected(label, "bom")
    if charset := http_charset(content_type):
        return Detected(charset, "http")
    if kind == "html" and (m := _META.search(body[:1024])):
        return Detected(m[1].decode("ascii").lower(), "meta")
    if kind == "xml":
        for start, label in ((b"\x00<\x00?", "utf-16be"), (b"<\x00?\x00", "utf-16le")):
            if body.startswith(start):
                return Detected(label, "signature")
        if m := _XML.match(body[:512]):
            return Detected(m[1].decode("ascii").lower(), "declaration")
    return Detected("utf-8", "default")


def codec(label: str) -> str | None:
    """The codec for a label; None for UTF-32 and unknown labels."""
    name = WEB_LABELS.get(label, label)
    try:
        found = codecs.lookup(name).name
    except LookupError:
        return None
    return None if found.startswith("utf-32") or found in ("utf-7", "base64", "hex", "rot13", "idna", "punycode") else found


def decode(body: bytes | None, content_type: str | None = None, kind: str = "html", fatal: bool = False) -> Decoded:
    """Text of a body.  Fatal: no text for unsupported labels or malformed bytes; else replacement characters."""
    body = body or b""
    label, source = detect(body, content_type, kind)
    for mark, marked in MARKS:
        if source == "bom" and marked == label:
            body = body[len(mark) :]
    name, warning = codec(label), None
    if name is None:
        if fatal:
            return Decoded(None, label, source, False, "unsupported encoding")
        name, warning = "utf-8", "unsupported encoding"
    try:
        return Decoded(body.decode(name), label if warning is None else "utf-8", source, False, warning)
    except UnicodeDecodeError:
        if fatal:
            return Decoded(None, label, source, False, "malformed bytes")
        return Decoded(body.decode(name, "replace"), label if warning is None else "utf-8", source, True, warning)
