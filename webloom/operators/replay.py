"""Replay of a run: pages, sitemaps and feeds extracted again from stored evidence under the run's own settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.operators.canonical import canonical_hash
from webloom.operators.links import extract_pages
from webloom.operators.sitemaps import extract

#: Facts of a record that replay compares, by kind; times and ids of the run are none.
PAGE_FACTS = ["title", "meta_description", "canonical", "html_lang", "robots", "headings", "outline", "hreflang", "open_graph", "json_ld", "microdata", "refresh", "visible_text", "warnings", "links"]
XML_FACTS = ["kind", "status", "error", "sitemap", "feed", "left_out"]


def _facts(columns: list[str]) -> Column:
    return canonical_hash(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def project(bodies: DataFrame, config: dict | None = None) -> DataFrame:
    """key, kind, facts, failed of bodies (key, kind, url, content), extracted under ``config``.

    ``kind``: html-page, sitemap or feed.  ``config``: the run's settings (``config.resolve``'s
    shape); of these ``html.maxTextBytes``, ``xml.maxEntries`` and ``xml.maxBytes`` count.
    """
    limits = config or {}
    text = limits.get("html", {}).get("maxTextBytes") or 1_000_000
    xml = limits.get("xml", {})
    pages = bodies.where("kind = 'html-page'").select(F.col("key").alias("page_id"), "url", F.decode("content", "UTF-8").alias("html"))
    html = extract_pages(pages, max_text=text).select(F.col("page_id").alias("key"), F.lit("html-page").alias("kind"), _facts(PAGE_FACTS).alias("facts"), F.lit(False).alias("failed"))
    docs = bodies.where("kind <> 'html-page'").select("key", "url", F.col("content").alias("body"))
    entries = extract(docs, xml.get("maxEntries") or 50_000, xml.get("maxBytes") or 10_485_760)
    again = entries.select("key", F.when(F.col("kind") == "feed", "feed").otherwise("sitemap").alias("kind"), _facts(XML_FACTS).alias("facts"), F.col("error").isNotNull().alias("failed"))
    return html.unionByName(again)


def replay_run(saved: DataFrame, evidence: DataFrame, config: dict | None = None) -> DataFrame:
    """key, kind, status of each saved record: matched, changed, failed, missing-evidence or corrupt-evidence.

    ``saved``: key (unique), kind, url, digest, facts (see ``project``); ``evidence``: digest,
    content.  Evidence is corrupt if its content has another digest than its name; it is missing
    if nothing is stored under the digest, or the record has none.  A body is shuffled once, to
    the records that refer to it.
    """
    named = evidence.select("digest", "content", (F.sha2("content", 256) == F.col("digest")).alias("_good")).dropDuplicates(["digest"])
    found = saved.join(named, "digest", "left")
    lost = found.where(F.col("_good").isNull() | ~F.col("_good")).select("key", "kind", F.when(F.col("_good").isNull(), "missing-evidence").otherwise("corrupt-evidence").alias("status"))
    again = project(found.where("_good").select("key", "kind", "url", "content"), config).select("key", F.col("facts").alias("_again"), "failed")
    compared = saved.select("key", "kind", "facts").join(again, "key")
    status = F.when(F.col("failed"), "failed").when(F.col("facts").eqNullSafe(F.col("_again")), "matched").otherwise("changed")
    return lost.unionByName(compared.select("key", "kind", status.alias("status")))


def replay_summary(items: DataFrame) -> DataFrame:
    """kind and the number of its records in each status."""
    status = F.col("status")
    return items.groupBy("kind").agg(*(F.count_if(status == s).alias(s.replace("-", "_")) for s in ("matched", "changed", "failed", "missing-evidence", "corrupt-evidence")))
