"""Readers of input tables, and the crawl inputs that follow from them by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import urls as U


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fetches(pages: DataFrame) -> DataFrame:
    """Captured pages as fetch results: one row per page, body last so that it prunes."""
    url = U.without_fragment(F.col("url"))
    return pages.select(
        F.col("page_id").alias("request_id"),
        url.alias("requested_url"),
        url.alias("final_url"),
        F.when(F.col("page_id") % 17 == 0, 404).otherwise(200).alias("status"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        F.octet_length("html").cast("long").alias("body_bytes"),
        F.col("html").alias("body"),
    )


def anchors(pages: DataFrame) -> DataFrame:
    """Double-quoted anchors of pages in document order, on the JVM: page_id, from_url, position, href."""
    found = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", U.without_fragment(F.col("url")).alias("from_url"), F.posexplode(found).alias("position", "href"))


def encoded_path(path):
    """Non-ASCII characters of a path as percent escapes (ASCII ones as they are)."""
    return F.when(path.rlike(r"^[\x00-\x7F]*$"), path).otherwise(F.array_join(F.transform(F.split(path, ""), lambda c: F.when(c.rlike(r"^[\x00-\x7F]*$"), c).otherwise(F.url_encode(c))), ""))


def root_relative_links(pages: DataFrame) -> DataFrame:
    """Anchors whose href starts at the root, resolved without leaving the JVM: adds to_url."""
    return anchors(pages).where(F.col("href").startswith("/")).withColumn("to_url", F.concat(U.origin(F.col("from_url")), encoded_path(F.col("href"))))


def outcomes(events: DataFrame) -> DataFrame:
    """Request outcomes per origin from the event table: origin, seq, kind, latency_ms."""
    return events.select(
        F.concat(F.lit("https://o"), (F.col("user_id") % 20).cast("string"), F.lit(".example")).alias("origin"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "request-failed").otherwise("handled").alias("kind"),
        F.floor("value").cast("long").alias("latency_ms"),
    )


#: Journal record types of event types.
JOURNAL = {"signup": "enqueued", "view": "leased", "click": "renewed", "error": "released", "purchase": "handled"}


def journal(events: DataFrame, lease_seconds: int = 3600) -> DataFrame:
    """Frontier journal per request: request_id, sequence (dense from 1), type, at (epoch seconds), expires_at."""
    from pyspark.sql.window import Window

    kind = F.create_map(*(F.lit(x) for kv in JOURNAL.items() for x in kv))[F.col("event_type")]
    at = F.unix_timestamp("ts")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(
        F.col("user_id").alias("request_id"), F.row_number().over(order).cast("long").alias("sequence"), kind.alias("type"), at.alias("at"), F.when(kind.isin("leased", "renewed"), at + lease_seconds).alias("expires_at")
    )
