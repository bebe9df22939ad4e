"""Links of all resources (pages, style sheets, scripts, Link headers): decisions in order, and how assets hang from pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.operators.links import decision, extract_pages
from webloom.operators.resources import asset_links, header_links, route
from webloom.operators.scope import Scope, admit, scope_reason
from webloom.shared import discard, written

#: A resource's links come in this order: its Link header, then its body.
HEADER, BODY = 0, 1
_EDGE = ["request_id", "from_url", "stage", "position", "source", "kind", "raw", "to_url", "method", "rel", "text"]


def numbered(rows: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """Adds ``seq``: unique numbers that grow in the given order, whatever the ids are (nulls first).

    A range-partitioned sort whose rows are numbered where they lie, written once: numbers have
    gaps between partitions, and no row meets all others.
    """
    return written(rows.orderBy(*order).withColumn("seq", F.monotonically_increasing_id()), name)


def _edges(rows: DataFrame, **columns: Column) -> DataFrame:
    types = {"rel": "array<string>", "position": "int", "stage": "int"}
    return rows.select(*((columns[c] if c in columns else F.col(c) if c in rows.columns else F.lit(None)).cast(types.get(c, "long" if c == "request_id" else "string")).alias(c) for c in _EDGE))


def style_edges(sheets: DataFrame, limit: int = 500) -> DataFrame:
    """Links of style sheets (request_id, final_url, text), best evidence first."""
    kind = F.when(F.col("method") == "source-map", "source-map").otherwise("css-discovery")
    return _edges(asset_links(sheets, "css", limit), stage=F.lit(BODY), source=F.lit("style-content"), kind=kind)


def script_edges(scripts: DataFrame, limit: int = 500, mode: str = "hybrid") -> DataFrame:
    """Links of scripts (request_id, final_url, text), best evidence first."""
    kind = F.when(F.col("method") == "source-map", "source-map").otherwise("script-discovery")
    return _edges(asset_links(scripts, "javascript", limit, mode), stage=F.lit(BODY), source=F.lit("script-content"), kind=kind)


def header_edges(responses: DataFrame, column: str = "link_header") -> DataFrame:
    """Links of Link headers of any responses (request_id, final_url)."""
    return _edges(header_links(responses, column), stage=F.lit(HEADER), source=F.lit("http-link-header"), method=F.lit("link-header"))


def page_edges(pages: DataFrame) -> DataFrame:
    """Links of pages (request_id, final_url, text); targets resolve against the page's own URL."""
    facts = extract_pages(pages.select(F.col("request_id").alias("page_id"), F.col("final_url").alias("url"), F.col("text").alias("html")))
    links = facts.select(F.col("page_id").alias("request_id"), F.col("final_url").alias("from_url"), F.posexplode("links").alias("position", "l"))
    return _edges(links, stage=F.lit(BODY), source=F.col("l.source"), kind=F.col("l.kind"), raw=F.col("l.raw"), to_url=F.col("l.url"), rel=F.col("l.rel"), text=F.col("l.text"))


def resource_edges(prepared: DataFrame, *, scripts: bool = True, styles: bool = True, header: str | None = "link_header") -> DataFrame:
    """Every link of prepared resources (see ``resources.prepare``): request_id, from_url, stage, position, source, kind, raw, to_url, method, rel, text.

    Resources whose preparation failed have none; headers are read of all others, bodies by type.
    """
    to = route(prepared, scripts=scripts, styles=styles)
    parts = [page_edges(to["html"]), style_edges(to["css"]), script_edges(to["javascript"])]
    if header and header in prepared.columns:
        parts.append(header_edges(prepared.where("error is null"), header))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def decide_edges(
    edges: DataFrame, requests: DataFrame, scope: Scope, *, known: DataFrame | None = None, enqueue_styles: bool = False, enqueue_scripts: bool = False, page_scripts: bool = False, page_styles: bool = False, limit: int = 1000, **caps
) -> DataFrame:
    """Every recorded link with what became of it; adds seq, depth, seed_url, enqueue_source and status.

    ``edges``: see ``resource_edges``; ``requests``: request_id, depth, seed_url of the resources.
    Links are taken by request, header before body, then place.  Of pages and headers the first
    ``limit`` valid links are recorded: navigation in scope is asked for, scripts and style
    sheets too with ``page_scripts`` and ``page_styles``, others are asset_skipped or
    rejected_scope.  Links of style sheets and scripts are all asked for with
    ``enqueue_styles`` / ``enqueue_scripts`` where the resource has a seed, and else
    asset_skipped.  What is asked for goes through admission (``caps``: see ``admit``) with a
    depth one below its resource's.  Links without a valid URL of styles and scripts are
    invalid_url; those of pages are not recorded.
    """
    of_asset = F.col("source").isin("style-content", "script-content")
    rows = edges.where(of_asset | F.col("to_url").isNotNull()).join(requests.select("request_id", "depth", "seed_url"), "request_id", "left")
    rows = rows.withColumn("depth", F.coalesce("depth", F.lit(0)) + 1)
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("request_id", "from_url", "stage", of_asset).orderBy("position"))
    rows = rows.withColumn("_n", place).where(of_asset | (F.col("_n") <= limit)).drop("_n")
    inside = F.coalesce(scope_reason(F.col("to_url"), F.col("depth"), F.col("seed_url"), scope).isNull() & F.col("seed_url").isNotNull(), F.lit(False))
    asked = lambda on, name: F.when(F.lit(on) & F.col("seed_url").isNotNull(), name).otherwise("asset_skipped")
    what = F.when(F.col("source") == "style-content", asked(enqueue_styles, "css-static")).when(F.col("source") == "script-content", asked(enqueue_scripts, "javascript-static"))
    rows = numbered(rows.withColumn("_what", what.otherwise(decision(F.col("to_url"), F.col("kind"), inside, page_scripts, page_styles))), ["request_id", "stage", "position", "from_url", "raw"], "edges-decided")
    candidates = rows.where(~F.col("_what").isin("asset_skipped", "rejected_scope")).select("seq", F.col("to_url").alias("url"), "depth", "seed_url", F.col("_what").alias("source"))
    admitted = admit(candidates, scope, known=known, **caps).select("seq", "status", F.col("source").alias("enqueue_source"))
    return rows.join(admitted, "seq", "left").withColumn("status", F.coalesce("status", "_what")).drop("_what")


def attribute_assets(edges: DataFrame, pages: DataFrame, max_hops: int = 5) -> DataFrame:
    """The page that each asset hangs from, over style sheets that import others, scripts and so on.

    ``edges``: from_url, to_url (links that load something); ``pages``: url, ordinal.  Returns
    url, hops, ordinal and path (URLs from the page to the asset) of every URL that pages reach
    within ``max_hops`` links, pages themselves left out.  The least path wins: fewest hops,
    then the least ordinal, then the first in order of its URLs.  Each hop joins only URLs that
    were new in the one before, and a minimum per target is taken before the shuffle, so an
    asset that all pages share costs a row a task; cycles end by themselves.
    """
    links = written(edges.where("from_url <> to_url").select("from_url", "to_url").distinct(), "assets-links")
    now = pages.groupBy("url").agg(F.min("ordinal").alias("ordinal")).select("url", F.lit(0).alias("hops"), "ordinal", F.array("url").alias("path"))
    seen = written(now, "assets-0")
    found, last = seen, seen
    tables = [seen]
    for hop in range(1, max_hops + 1):
        ways = last.select(F.col("url").alias("from_url"), "ordinal", "path").join(links, "from_url").select(F.col("to_url").alias("url"), F.struct("ordinal", F.concat("path", F.array("to_url")).alias("path")).alias("way"))
        best = ways.groupBy("url").agg(F.min("way").alias("way")).join(found.select("url"), "url", "left_anti")
        last = written(best.select("url", F.lit(hop).alias("hops"), "way.ordinal", "way.path"), f"assets-{hop}")
        if last.isEmpty():
            discard(last)
            break
        tables.append(last)
        found = found.unionByName(last)
    discard(links)
    return found.where("hops > 0")


def internal_share(decided: DataFrame) -> DataFrame:
    """Per source of links: how many were extracted, lead inside or outside their origin, and were enqueued."""
    inside = U.origin(F.col("to_url")) == U.origin(F.col("from_url"))
    return decided.groupBy("source").agg(F.count("*").alias("extracted"), F.count_if(inside).alias("internal"), F.count_if(~F.coalesce(inside, F.lit(False))).alias("external"), F.count_if(F.col("status") == "enqueued").alias("enqueued"))
