"""WARC derivative builder (operator 4): metadata and plain-text conversion records of responses.

Every response yields one ``metadata`` record (title, language, charset, outgoing links and the
response's own HTTP headers) and one ``conversion`` record (the visible text).  Both name the
response in WARC-Refers-To, carry its target URI and date, and the digest of its payload;
record ids follow from the response's id, so a task that runs again writes the same records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.encoding_kernel import decode
from webloom.functions.html_kernel import BLOCK, HIDDEN, tokens
from webloom.shared import ship_package

_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_BLANK = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")
FIELDS = "record_id string, record_type string, refers_to string, target_uri string, date string, content_type string, content_length long, block_digest string, payload_digest string, record binary"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_urn(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(parts))}>"


@dataclass
class Derived:
    """What one pass over a page's tokens gives."""

    title: str | None = None
    language: str | None = None
    outlinks: list[str] = field(default_factory=list)
    text: str = ""


def extract(markup: str) -> Derived:
    """Title, language, targets of anchors and visible text, in time linear in the markup.

    Text in the elements of HIDDEN is left out, block elements break lines, other white space
    collapses.  An element that is never closed lasts to the end of the page, but a head ends
    where the body begins.
    """
    out, parts, hidden = Derived(), [], []
    for kind, value, attributes, _ in tokens(markup):
        if kind == "text":
            if hidden and hidden[-1] == "title" and out.title is None:
                out.title = " ".join(value.split())
            if not hidden:
                parts.append(value)
            continue
        if kind == "start":
            if value == "html" and out.language is None:
                out.language = attributes.get("lang") or None
            elif value == "a" and attributes.get("href") is not None:
                out.outlinks.append(" ".join(attributes["href"].split()))
            elif value == "body":
                hidden = [h for h in hidden if h != "head"]
            if value in HIDDEN:
                hidden.append(value)
        elif value in hidden:
            while hidden.pop() != value:
                pass
        if value in BLOCK:
            parts.append("\n")
    out.text = _LINES.sub("\n", _BLANK.sub(" ", "".join(parts))).strip()
    return out


def visible_text(markup: str) -> str:
    return extract(markup).text


def _content_type(headers: str) -> str | None:
    return next((h.partition(":")[2].strip() for h in headers.splitlines() if h.lower().startswith("content-type:")), None)


def serialise(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC/1.1 record; line breaks in header values become spaces."""
    lines = [f"{k}: {re.sub(r'[\r\n]+', ' ', v)}" for k, v in headers if v]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of uncompressed WARC bytes: headers and block."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines)
        size = int(headers["Content-Length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, size = [], 0
        for key, urn, uri, date, headers, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            payload, uri, date = payload or b"", uri or "", date or ""
            headers = headers or ""
            read = decode(payload, _content_type(headers))
            page, source = extract(read.text), digest(payload)
            fields = [f"source-header: {h}" for h in re.split(r"\r?\n", headers) if h]
            fields += [f"{n}: {v}" for n, v in (("title", page.title), ("language", page.language), ("charset", read.label)) if v]
            fields += [f"outlink: {u}" for u in page.outlinks]
            blocks = (("metadata", "application/warc-fields", "".join(f + "\r\n" for f in fields)), ("conversion", "text/plain; charset=utf-8", page.text))
            for kind, content_type, text in blocks:
                block, own = text.encode("utf-8", "replace"), record_urn(urn or "", uri, date, kind)
                named = [
                    ("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", urn or ""), ("WARC-Refers-To-Target-URI", uri),
                    ("WARC-Refers-To-Date", date), ("WARC-Source-Payload-Digest", source), ("WARC-Block-Digest", digest(block)), ("Content-Type", content_type),
                ]
                record = serialise(named, block)
                rows.append((key, own, kind, urn, uri, date, content_type, len(block), digest(block), source, record))
                size += len(record)
            if size > 4_000_000:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["key", *(f.split()[0] for f in FIELDS.split(", "))]
    kinds = {"key": pa.int64(), "content_length": pa.int64(), "record": pa.binary()}
    return pa.record_batch([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response rows of captured pages (page_id, url, html): key, record_id, target_uri, date, http_headers, payload."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    uuid_of = F.sha2(F.concat_ws("\x00", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit(""))).cast("binary"), 256)
    part = lambda a, n: F.substring(uuid_of, a, n)
    urn = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"))
    return pages.select(F.col("page_id").cast("long").alias("key"), urn.alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), headers.alias("http_headers"), payload.alias("payload"))


def derive(rows: DataFrame) -> DataFrame:
    """Metadata and conversion records of response rows (see ``responses``).

    Returns two rows a response: key and the columns of FIELDS; ``record`` is the whole WARC
    record.  A null payload is empty, and both records are still made; null URIs, dates and
    headers are left out of the records; repeated rows repeat their records (the same ids); an
    empty table gives an empty result.  More columns are ignored.  Payloads are decoded by byte
    order mark, HTTP charset, then their own declaration, else as UTF-8.  A very long payload is
    taken whole, in time linear in its length; records leave a task every 4 MB.
    """
    ship_package(rows.sparkSession)
    return rows.select("key", "record_id", "target_uri", "date", "http_headers", "payload").mapInArrow(_derive, f"key long, {FIELDS}")


def shards(records: DataFrame, per_shard: int = 20_000) -> DataFrame:
    """Groups records into numbered WARC shards within partitions: shard string, content binary (gzip members).

    Content is built per partition in bounded pieces; write the rows with any binary writer.
    """
    import gzip

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, no, members = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            for record in batch.column("record").to_pylist():
                members.append(gzip.compress(record, mtime=0))
                if len(members) == per_shard:
                    yield pa.record_batch([pa.array([f"part-{part:05d}-{no:05d}.warc.gz"]), pa.array([b"".join(members)], pa.binary())], ["shard", "content"])
                    no, members = no + 1, []
        if members:
            yield pa.record_batch([pa.array([f"part-{part:05d}-{no:05d}.warc.gz"]), pa.array([b"".join(members)], pa.binary())], ["shard", "content"])

    return records.select("record").mapInArrow(run, "shard string, content binary")


def op4_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    out = derive(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return out.select(F.col("key").alias("page_id"), *(f.split()[0] for f in FIELDS.split(", ")[:-1]), F.sha2("record", 256).alias("record_sha256"))
