"""Content classes, decoding and hashes of bodies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.functions.encoding_kernel import decode
from webloom.shared import ship_package

TEXT_LIKE = ["html", "xml", "sitemap", "sitemap-index", "feed", "json", "text", "javascript", "css"]
# Extensions and their classes, in order of test.
EXTENSIONS = [
    (r"\.html?$", "html"), (r"\.xml$", "xml"), (r"\.json$", "json"), (r"\.css$", "css"), (r"\.m?js$", "javascript"), (r"\.pdf$", "pdf"), (r"\.(png|jpe?g|gif|webp|svg|avif)$", "image"),
    (r"\.(woff2?|ttf|otf|eot)$", "font"), (r"\.(mp4|webm|mov)$", "video"), (r"\.(mp3|wav|ogg)$", "audio"), (r"\.(zip|gz|tar|tgz|7z)$", "archive"),
]


def _xml_by_url(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("sitemap")), "sitemap").when(F.contains(url, F.lit("feed")) | url.rlike(r"\.(rss|atom)$"), "feed").otherwise("xml")


def sniff(start: Column, url: Column) -> Column:
    head = F.lower(F.ltrim(F.substring(start, 1, 256)))
    return F.when(head.rlike(r"^<(!doctype html|html)"), "html").when(head.rlike(r"^<(\?xml|urlset|sitemapindex)"), _xml_by_url(url)).otherwise("text")


def resource_class(url: Column, status: Column, content_type: Column, body_start: Column) -> Column:
    """The class of a response from its status, URL, content type and first characters, in one chain."""
    lower = F.lower(url)
    path = F.lower(U.path(url))
    mime = F.lower(F.trim(F.split(F.coalesce(content_type, F.lit("")), ";")[0]))
    has = lambda *parts: mime.rlike("|".join(parts))
    by_extension = F.when(F.lit(False), "")
    for pattern, name in EXTENSIONS:
        by_extension = by_extension.when(path.rlike(pattern), _xml_by_url(lower) if name == "xml" else F.lit(name))
    sniffed = sniff(body_start, lower)
    by_extension = by_extension.otherwise(F.when(sniffed == "text", "unknown").otherwise(sniffed))
    return (
        F.when(status.isNull(), "error")
        .when(status.isin(204, 205) | (F.length(body_start) == 0), "empty")
        .when(path.rlike(r"\.xml\.gz$|sitemap.*\.gz$"), "sitemap")
        .when(has("html"), "html")
        .when(has("rss", "atom"), "feed")
        .when(has("xml"), _xml_by_url(lower))
        .when(has(r"^application/json$", r"\+json$"), "json")
        .when(has("^text/plain"), sniffed)
        .when(has("^text/css"), "css")
        .when(has("javascript"), "javascript")
        .when(has("^image/"), "image")
        .when(mime == "application/pdf", "pdf")
        .when(has("^font/", "woff"), "font")
        .when(has("^video/"), "video")
        .when(has("^audio/"), "audio")
        .when(has("zip", "tar", "gzip"), "archive")
        .otherwise(by_extension)
    )


def body_hash(body: Column) -> Column:
    return F.sha2(body.cast("binary"), 256)


def ok(status: Column, error: Column | None = None) -> Column:
    good = (status >= 200) & (status < 400)
    return good if error is None else good & error.isNull()


def is_redirect(status: Column) -> Column:
    return status.isin(301, 302, 303, 307, 308)


def is_retryable(status: Column) -> Column:
    return status.isin(429, 500, 502, 503, 504)


def storable(status: Column, body_bytes: Column, validator: Column) -> Column:
    """Whether a cache keeps a response: success, a body and an ETag or Last-Modified."""
    return (status >= 200) & (status < 300) & (body_bytes > 0) & validator.isNotNull()


def revalidated(fetches: DataFrame, cache: DataFrame) -> DataFrame:
    """Bodies after revalidation: 304 takes the cached body, failures may take it as stale.

    ``fetches``: url, status, body; ``cache``: url, cached_body.  Keys meet by hash of the URL.
    """
    key = F.sha2(F.col("url").cast("binary"), 256)
    left, right = fetches.withColumn("_key", key), cache.select(key.alias("_key"), "cached_body")
    joined = left.join(right, "_key", "left").drop("_key")
    source = F.when((F.col("status") == 304) & F.col("cached_body").isNotNull(), "revalidated").when((F.col("status").isNull() | (F.col("status") >= 500)) & F.col("cached_body").isNotNull(), "stale").otherwise("network")
    return joined.withColumn("source", source).withColumn("body", F.when(source == "network", F.col("body")).otherwise(F.col("cached_body"))).drop("cached_body")


def decoded(bodies: DataFrame, fatal: bool = False) -> DataFrame:
    """Adds text, encoding, encoding_source, replaced, warning to rows of body (binary), content_type, kind."""
    ship_package(bodies.sparkSession)
    schema = "text string, encoding string, encoding_source string, replaced boolean, warning string"

    @F.pandas_udf(schema)
    def run(body: pd.Series, content_type: pd.Series, kind: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode(b, c, k, fatal) for b, c, k in zip(body, content_type, kind, strict=True)], columns=["text", "encoding", "encoding_source", "replaced", "warning"])

    return bodies.withColumn("_decoded", run("body", "content_type", "kind")).select(*bodies.columns, "_decoded.*")


def duplicate_bodies(bodies: DataFrame, id_column: str, body_column: str) -> DataFrame:
    """Groups of equal bodies: hash, count, ids in order.  Only 64-character hashes are shuffled."""
    hashed = bodies.where(F.col(body_column).isNotNull()).select(body_hash(F.col(body_column)).alias("hash"), F.col(id_column).alias("id"))
    groups = hashed.groupBy("hash").agg(F.count("*").alias("count"), F.sort_array(F.collect_list("id")).alias("ids"))
    return groups.where("count > 1")
