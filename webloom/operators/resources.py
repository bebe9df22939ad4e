"""Stages between a fetched response and its records: preparation, routing, links, entries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import discovery_kernel, xml_kernel
from webloom.functions import urls as U
from webloom.functions.encoding_kernel import decode
from webloom.functions.url_kernel import UrlError, parse
from webloom.operators import classify as C
from webloom.operators.links import decision
from webloom.operators.scope import Scope, admit, scope_reason
from webloom.shared import ship_package

XML = ["xml", "sitemap", "sitemap-index", "feed"]


def is_html_like(kind: Column) -> Column:
    return kind == "html"


def is_xml_like(kind: Column) -> Column:
    return kind.isin(*XML)


def should_decode(kind: Column) -> Column:
    return kind.isin(*C.TEXT_LIKE)


def prepare(fetches: DataFrame, max_bytes: int = 10_485_760) -> DataFrame:
    """One resource row per fetch, in one pass over its body and without a shuffle.

    ``fetches``: request_id, requested_url, final_url, status, content_type, body (binary); more
    columns are kept.  Adds resource_id, resource_type, ok, body_bytes, inflated_bytes,
    raw_sha256 (of the bytes received), decoded_sha256 (of the text), encoding, replaced, text
    (of decoded types) and error (an XML body that doesn't inflate within ``max_bytes``, whose
    payload is then left out).
    """
    ship_package(fetches.sparkSession)
    url = F.coalesce("final_url", "requested_url")
    start = F.decode(F.substring("body", 1, 1024), "ISO-8859-1")
    rows = fetches.withColumn("final_url", url).withColumn("resource_type", C.resource_class(F.col("final_url"), F.col("status"), F.col("content_type"), start))

    @F.pandas_udf("inflated_bytes long, text string, encoding string, replaced boolean, error string")
    def inspect(body: pd.Series, content_type: pd.Series, kind: pd.Series) -> pd.DataFrame:
        def one(b: bytes | None, c: str | None, k: str) -> tuple:
            if b is None:
                return None, None, None, None, None
            size = None
            if k in XML and b[:2] == b"\x1f\x8b":
                try:
                    b = xml_kernel.inflate(b, max_bytes)
                    size = len(b)
                except ValueError as e:
                    return None, None, None, None, str(e)
            if k not in C.TEXT_LIKE:
                return size, None, None, None, None
            read = decode(b, c, "xml" if k in XML else "html" if k == "html" else "text")
            return size, read.text, read.label, read.replaced, None

        return pd.DataFrame([one(*r) for r in zip(body, content_type, kind, strict=True)], columns=["inflated_bytes", "text", "encoding", "replaced", "error"])

    rows = rows.withColumn("_seen", inspect("body", "content_type", "resource_type")).select(*rows.columns, "_seen.*")
    good = (F.col("status") >= 200) & (F.col("status") < 400) & F.col("error").isNull()
    key = F.concat(F.col("request_id").cast("string"), F.lit(":"), F.col("final_url"))
    return rows.select(
        U.make_id("res", key).alias("resource_id"), "*", F.coalesce(good, F.lit(False)).alias("ok"), F.octet_length("body").cast("long").alias("body_bytes"),
        F.when(F.col("error").isNull(), F.sha2("body", 256)).alias("raw_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def route(prepared: DataFrame, *, scripts: bool = True, styles: bool = True, max_asset_bytes: int = 1_048_576) -> dict[str, DataFrame]:
    """The prepared resources of each processor: html, xml, javascript, css.  Failed preparations go to none."""
    usable = prepared.where("error is null and body is not null")
    small = F.col("body_bytes") <= max_asset_bytes
    out = {"html": usable.where(is_html_like(F.col("resource_type"))), "xml": usable.where(is_xml_like(F.col("resource_type")))}
    out["javascript"] = usable.where((F.col("resource_type") == "javascript") & small & F.lit(scripts))
    out["css"] = usable.where((F.col("resource_type") == "css") & small & F.lit(styles))
    return out


def _discovered(rows: DataFrame, text: str, base: str, kind: str, limit: int, mode: str) -> DataFrame:
    """position, raw, to_url, method of the URLs in scripts or style sheets; kept columns first."""
    keep = [c for c in rows.columns if c != text]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)
    at = keep.index(base)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False, name=None):
                found = discovery_kernel.css_urls(r[-1] or "", limit) if kind == "css" else discovery_kernel.js_urls(r[-1] or "", mode, limit)
                for i, f in enumerate(found):
                    try:
                        to = parse(f.url, parse(r[at])).normalized
                    except UrlError:
                        to = None
                    out.append((*r[:-1], i, f.url, to, f.method))
            yield pd.DataFrame(out, columns=[*keep, "position", "raw", "to_url", "method"])

    return rows.select(*keep, text).mapInPandas(run, f"{fields}, position int, raw string, to_url string, method string")


def asset_links(assets: DataFrame, kind: str, limit: int = 500, mode: str = "hybrid") -> DataFrame:
    """Links in script or style sheet resources (from ``route``): request_id, from_url, position, raw, to_url, method."""
    ship_package(assets.sparkSession)
    return _discovered(assets.select("request_id", F.col("final_url").alias("from_url"), "text"), "text", "from_url", kind, limit, mode)


def header_links(fetches: DataFrame, column: str = "link_header") -> DataFrame:
    """Links in Link headers: request_id, from_url, position, raw, to_url, kind, rel."""
    ship_package(fetches.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, url, header in frame.itertuples(index=False, name=None):
                for i, link in enumerate(discovery_kernel.link_header(header)):
                    try:
                        to = parse(link["url"], parse(url)).normalized
                    except UrlError:
                        to = None
                    out.append((key, url, i, link["url"], to, link["kind"], link["rel"]))
            yield pd.DataFrame(out, columns=["request_id", "from_url", "position", "raw", "to_url", "kind", "rel"])

    rows = fetches.where(F.col(column).isNotNull()).select("request_id", "final_url", column)
    return rows.mapInPandas(run, "request_id long, from_url string, position int, raw string, to_url string, kind string, rel array<string>")


def decide_links(edges: DataFrame, requests: DataFrame, scope: Scope, *, known: DataFrame | None = None, limit: int = 1000, scripts: bool = False, styles: bool = False, **caps) -> DataFrame:
    """Every recorded link with what became of it: admission's status, asset_skipped or rejected_scope.

    ``edges``: page_id, position, to_url, kind (see ``link_edges``); ``requests``: page_id,
    depth, seed_url of the pages.  The first ``limit`` valid links of a page are recorded.  Adds
    seq, depth, seed_url, in_scope, enqueue_source and status; links are admitted in order of
    page and position, one row back for each by its seq.
    """
    rows = edges.where("to_url is not null").join(requests.select("page_id", "depth", "seed_url"), "page_id", "left")
    from webloom.operators.links import capped
    from webloom.operators.resource_graph import numbered

    rows = capped(rows, limit).withColumn("depth", F.coalesce("depth", F.lit(0)) + 1)
    inside = scope_reason(F.col("to_url"), F.col("depth"), F.col("seed_url"), scope).isNull() & F.col("seed_url").isNotNull()
    what = decision(F.col("to_url"), F.col("kind"), F.col("in_scope"), scripts, styles)
    rows = numbered(rows.withColumn("in_scope", F.coalesce(inside, F.lit(False))).withColumn("_what", what), ["page_id", "position"], "links-decided")
    asked = rows.where(~F.col("_what").isin("asset_skipped", "rejected_scope")).select("seq", F.col("to_url").alias("url"), "depth", "seed_url", F.col("_what").alias("source"))
    admitted = admit(asked, scope, known=known, **caps).select("seq", "status", F.col("source").alias("enqueue_source"))
    return rows.join(admitted, "seq", "left").withColumn("status", F.coalesce("status", "_what")).drop("_what")


def page_link_totals(decided: DataFrame) -> DataFrame:
    """Per page: recorded links, and how many lie inside and outside the scope."""
    return decided.groupBy("page_id").agg(F.count("*").alias("recorded"), F.count_if("in_scope").alias("in_scope"), F.count_if(~F.col("in_scope")).alias("out_of_scope"))


def feed_alternates(facts: DataFrame) -> DataFrame:
    """Alternates of a page that are feeds by their type: page_id, from_url, to_url, type."""
    rows = facts.select("page_id", F.col("final_url").alias("from_url"), F.explode("alternates").alias("a"))
    return rows.where(F.lower("a.type").rlike("rss|atom") & F.col("a.url").isNotNull()).select("page_id", "from_url", F.col("a.url").alias("to_url"), F.lower("a.type").alias("type"))


def entry_requests(extracted: DataFrame, requests: DataFrame, *, max_index_depth: int = 5, sitemap_entries: bool = True, feed_entries: bool = True) -> DataFrame:
    """Requests that the entries of sitemaps and feeds ask for.

    ``extracted``: see ``sitemaps.extract``; ``requests``: key, depth, seed_url, index_depth,
    ancestors (array of URLs).  Sitemap entries have depth 1; children of an index are one
    deeper in both senses and carry the index among their ancestors, unless that would exceed
    ``max_index_depth`` or lead back to the index or an ancestor; feed entries are one deeper.
    Returns key, place, url, source, depth, seed_url, index_depth, ancestors, status
    (enqueue, recursive, index_depth, unused).
    """
    base = extracted.join(requests, "key").where(F.col("seed_url").isNotNull())
    one = base.select("key", "source_url", "kind", "depth", "seed_url", "index_depth", "ancestors", F.posexplode("sitemap").alias("place", "e")).where("e.url is not null")
    index = F.col("kind") == "sitemap-index"
    back = index & ((F.col("e.url") == F.col("source_url")) | F.array_contains("ancestors", F.col("e.url")))
    status = F.when(back, "recursive").when(index & (F.col("index_depth") >= max_index_depth), "index_depth").when(index | F.lit(sitemap_entries), "enqueue").otherwise("unused")
    sitemaps = one.select(
        "key", "place", F.col("e.url").alias("url"), F.when(index, "sitemap-index").otherwise("sitemap").alias("source"), F.when(index, F.col("depth") + 1).otherwise(1).alias("depth"), "seed_url",
        F.when(index, F.col("index_depth") + 1).otherwise(0).alias("index_depth"), F.when(index, F.concat("ancestors", F.array("source_url"))).otherwise(F.array().cast("array<string>")).alias("ancestors"), status.alias("status"),
    )
    feeds = base.select("key", "depth", "seed_url", F.posexplode("feed").alias("place", "e")).where("e.url is not null")
    feeds = feeds.select(
        "key", "place", F.col("e.url").alias("url"), F.lit("feed").alias("source"), (F.col("depth") + 1).alias("depth"), "seed_url", F.lit(0).alias("index_depth"), F.array().cast("array<string>").alias("ancestors"),
        F.lit("enqueue" if feed_entries else "unused").alias("status"),
    )
    return sitemaps.unionByName(feeds)


def decide_entries(asked: DataFrame, scope: Scope, *, known: DataFrame | None = None, **caps) -> DataFrame:
    """What becomes of the requests that entries ask for (see ``entry_requests``): status is admission's, or why nothing was asked.

    Entries go through admission in order of their document (``key``) and place.
    """
    from webloom.operators.resource_graph import numbered

    rows = numbered(asked.withColumnRenamed("status", "_asked"), ["key", "place", "source", "url"], "entries-asked")
    admitted = admit(rows.where("_asked = 'enqueue'").select("seq", "url", "depth", "seed_url", "source"), scope, known=known, **caps).select("seq", "status")
    return rows.join(admitted, "seq", "left").withColumn("status", F.coalesce("status", "_asked")).drop("_asked")


def admit_feeds(alternates: DataFrame, requests: DataFrame, scope: Scope, *, known: DataFrame | None = None, **caps) -> DataFrame:
    """Feeds that pages name (see ``feed_alternates``) through admission, in order of page and URL, a level below their page."""
    from webloom.operators.resource_graph import numbered

    rows = alternates.join(requests.select("page_id", "depth", "seed_url"), "page_id").withColumn("depth", F.col("depth") + 1)
    rows = numbered(rows, ["page_id", "to_url"], "feeds-asked")
    admitted = admit(rows.select("seq", F.col("to_url").alias("url"), "depth", "seed_url", F.lit("feed").alias("source")), scope, known=known, **caps).select("seq", "status")
    return rows.join(admitted, "seq")
