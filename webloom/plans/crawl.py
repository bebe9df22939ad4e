"""A crawl over supplied fetch results: breadth-first rounds of DataFrame operators.

Fetching is a source (``fetches``: url, status, html); each round joins the frontier with it,
extracts links in one Python pass, and admits new URLs.  Every round's frontier is written to
the shared scratch folder, so the plan stays short however deep the crawl goes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.operators.links import capped, extract_pages, link_edges
from webloom.extensions import Extensions
from webloom.operators.resource_graph import numbered
from webloom.operators.scope import Scope, admit, resolve_seeds, robots_decisions
from webloom.shared import written


@dataclass
class CrawlResult:
    requests: DataFrame  # url, depth, seed_url, status of the decision, round
    facts: DataFrame
    edges: DataFrame
    decisions: DataFrame
    skipped: DataFrame  # url, reason: requests that robots rules or a middleware kept from being fetched


def crawl(
    fetches: DataFrame, seeds: DataFrame, scope: Scope = Scope(), *, max_depth: int = 5, run_cap: int = 1000, links_per_page: int = 1000, robots: DataFrame | None = None, token: str = "robot", extensions: Extensions | None = None
) -> CrawlResult:
    """``fetches``: page_id, url, html.  ``seeds``: ordinal, seed_url (normalised).  ``robots``: see ``robots_decisions``.

    Before a round's pages are read, robots rules and the extensions' middlewares decide on its
    requests; hooks are called on the driver as the round's tables come up.
    """
    ext = extensions or Extensions()
    ext.call("onRunStart", seeds)
    pages = fetches.withColumn("url", U.without_fragment(F.col("url")))
    start = seeds.select(F.col("ordinal").cast("long").alias("seq"), F.col("seed_url").alias("url"), F.lit(0).alias("depth"), F.col("seed_url"))
    frontier = written(admit(start, scope, max_depth=max_depth, run_cap=run_cap), "crawl-round")
    known = frontier.where("status = 'enqueued'").select("url", "depth", "seed_url")
    facts = edges = decisions = None
    skipped = known.limit(0).select("url", F.lit("").alias("reason"))
    left = run_cap - known.count()
    for depth in range(max_depth + 1):
        now = known.where(F.col("depth") == depth)
        if robots is not None:
            judged = written(robots_decisions(now, robots, token), "crawl-robots")
            skipped = skipped.unionByName(judged.where("not allowed").select("url", F.lit("ROBOTS_DISALLOWED").alias("reason")))
            now = judged.where("allowed").select(*now.columns)
        if ext.before_request:
            decided = written(ext.apply(now, "before_request"), "crawl-middleware")
            skipped = skipped.unionByName(decided.where("decision <> 'continue'").select("url", F.coalesce("reason", "decision").alias("reason")))
            now = ext.outcome(decided).select(*now.columns)
        ext.call("beforeRequest", now)
        got = written(extract_pages(pages.join(now.select("url"), "url", "left_semi").select("page_id", "url", "html")), "crawl-facts")
        ext.call("onHtmlParsed", got)
        found = link_edges(got)
        ext.call("onLinksExtracted", found)
        facts = got if facts is None else facts.unionByName(got)
        edges = found if edges is None else edges.unionByName(found)
        if depth == max_depth or left <= 0:
            break
        links = capped(found.where("kind = 'navigation'"), links_per_page).where(U.is_navigation(F.col("to_url")))
        links = numbered(links.select("page_id", "position", "to_url"), ["page_id", "position"], "crawl-links")
        candidates = resolve_seeds(links.select("seq", F.col("to_url").alias("url"), F.lit(depth + 1).alias("depth")), seeds)
        decided = written(admit(candidates, scope, known=known, max_depth=max_depth, run_cap=run_cap), "crawl-round")
        decisions = decided if decisions is None else decisions.unionByName(decided)
        new = decided.where("status = 'enqueued'").select("url", "depth", "seed_url")
        count = new.count()
        if not count:
            break
        ext.call("onRequestEnqueued", new)
        left -= count
        known = known.unionByName(new)
    result = CrawlResult(known, facts, edges, decisions if decisions is not None else frontier, skipped)
    ext.call("onRequestSkipped", skipped)
    ext.call("onRunFinish", result)
    return result
