"""Sitemaps and feeds: extraction, field checks, entry caps and sources."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.functions import xml_kernel as X
from webloom.shared import ship_package

ENTRY = "array<struct<kind:string,loc:string,url:string,lastmod:string,changefreq:string,priority:double,warnings:array<string>>>"
FEED = "array<struct<id:string,title:string,link:string,published:string,url:string>>"


def extract(docs: DataFrame, limit: int = 50_000, max_bytes: int = 10_485_760) -> DataFrame:
    """Parses XML bodies (key, url, body): kind, status, error, sitemap and feed entries, entries left out."""
    ship_package(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [{"key": k, "source_url": u} | X.extract(b, u, max_bytes, limit) for k, u, b in frame.itertuples(index=False, name=None)]
            yield pd.DataFrame(rows, columns=["key", "source_url", "kind", "status", "error", "sitemap", "feed", "left_out"])

    return docs.select("key", "url", "body").mapInPandas(run, f"key long, source_url string, kind string, status string, error string, sitemap {ENTRY}, feed {FEED}, left_out int")


def entries(extracted: DataFrame, which: str, cap: int | None = None) -> DataFrame:
    """One row per sitemap or feed entry; with a cap, the first entries in order of document and place."""
    rows = extracted.select("key", "source_url", F.posexplode(which).alias("place", "e")).select("key", "source_url", "place", "e.*")
    return rows if cap is None else rows.orderBy("key", "place").limit(cap)


def running_cap(counts: DataFrame, cap: int) -> DataFrame:
    """How many entries each file (run, ordinal, entries) may still add under a run-wide cap."""
    before = F.coalesce(F.sum("entries").over(Window.partitionBy("run").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("taken", F.greatest(F.lit(0), F.least(F.col("entries"), F.lit(cap) - before)))


def valid_lastmod(text: Column) -> Column:
    """W3C date, or date and time with a zone, that exists on the calendar."""
    shape = text.rlike(r"^\d{4}(-\d{2}(-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2}))?)?)?$")
    month = F.length(text) < 7
    on_calendar = F.when(month, True).when(F.length(text) == 7, F.substring(text, 6, 2).between("01", "12")).otherwise(F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd").isNotNull())
    clock = F.when(F.length(text) > 10, (F.substring(text, 12, 2) <= "23") & (F.substring(text, 15, 2) <= "59") & (~F.substring(text, 17, 1).eqNullSafe(":") | (F.substring(text, 18, 2) <= "59"))).otherwise(True)
    return shape & on_calendar & clock


def priority(text: Column) -> Column:
    return F.when(text.rlike(X.PRIORITY), text.cast("double"))


def change_frequency(text: Column) -> Column:
    return F.when(text.isin(*X.CHANGE_FREQUENCIES), text)


def recursion(target: Column, own: Column, ancestors: Column) -> Column:
    """Whether an index entry leads back to its own file or an ancestor."""
    return (target == own) | F.array_contains(ancestors, target)


def sources(robots: DataFrame, origins: DataFrame, manual: DataFrame) -> DataFrame:
    """Sitemap URLs to start from: named in robots files, the usual place of every origin, and given ones."""
    usual = origins.select(F.concat(F.col(origins.columns[0]), F.lit("/sitemap.xml")).alias("url"))
    return robots.select("url").unionByName(usual).unionByName(manual.select("url")).distinct()
