"""Page extraction and the link graph."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.functions import urls as U
from webloom.functions.html_kernel import Page, robots_header
from webloom.shared import ship_package

FACTS = """page_id long, final_url string, title string, n_titles int, meta_description string, canonical string, html_lang string, charset string, viewport string,
base_href string, robots array<string>, headings array<struct<level:int,text:string,id:string>>, outline array<struct<depth:int,tag:string,text:string>>,
images int, iframes int, scripts int, stylesheets int, forms int, hreflang array<string>, open_graph map<string,string>, social map<string,string>, json_ld array<string>, microdata array<string>,
refresh struct<seconds:double,url:string>, robots_header array<struct<agent:string,directive:string>>,
visible_text struct<text:string,total_bytes:long,truncated:boolean>, text_content struct<text:string,total_bytes:long,truncated:boolean>, warnings array<string>,
alternates array<struct<type:string,url:string>>,
links array<struct<source:string,kind:string,raw:string,url:string,rel:array<string>,text:string>>"""


def _facts(page_id: int, url: str, html: str | None, header: str | None, max_text: int) -> dict:
    p = Page(html or "", url or "", max_text)
    metas = [(m.get("property", m.get("name", "")).lower(), m.get("content")) for m in p.metas]
    refresh = p.refresh
    names = [n for n, _ in p.tags]
    return {
        "page_id": page_id, "final_url": url, "title": p.title, "n_titles": len(p.titles), "meta_description": p.meta("description"), "canonical": p.resolve(p.first_link("canonical")), "html_lang": p.lang,
        "charset": p.charset, "viewport": p.meta("viewport"), "base_href": p.base_href, "robots": p.robots, "headings": p.headings, "outline": p.outline, "images": len(p.images), "iframes": names.count("iframe"),
        "scripts": len(p.scripts), "stylesheets": sum("stylesheet" in a.get("rel", "").lower().split() for a in p.link_tags), "forms": len(p.forms), "hreflang": [a["hreflang"] for a in p.link_tags if "hreflang" in a],
        "open_graph": {k: v for k, v in metas if k.startswith("og:")}, "social": {k: v for k, v in metas if k.startswith("twitter:")}, "json_ld": p.json_ld, "microdata": [m for m in p.microdata if m],
        "refresh": {"seconds": refresh[0], "url": p.resolve(refresh[1])} if refresh else None, "robots_header": robots_header(header or ""), "visible_text": p.visible_text, "text_content": p.text_content, "warnings": p.warnings,
        "alternates": [{"type": a.get("type", ""), "url": p.resolve(a["href"])} for a in p.link_tags if "alternate" in a.get("rel", "").lower().split() and "href" in a],
        "links": [link | {"url": p.resolve(link["raw"])} for link in p.links()],
    }


def extract_pages(pages: DataFrame, *, robots_column: str | None = None, max_text: int = 1_000_000) -> DataFrame:
    """Facts and links of each page (page_id, url, html), parsed once.  Bodies never reach a shuffle."""
    ship_package(pages.sparkSession)
    header = F.col(robots_column) if robots_column else F.lit(None).cast("string")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [_facts(*r, max_text) for r in frame.itertuples(index=False, name=None)]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in _split_fields()])

    return pages.select("page_id", U.without_fragment(F.col("url")).alias("url"), "html", header.alias("header")).mapInPandas(run, FACTS)


def _split_fields() -> list[str]:
    out, depth, begin = [], 0, 0
    for i, c in enumerate(FACTS):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(FACTS[begin:i].strip())
            begin = i + 1
    return [*out, FACTS[begin:].strip()]


def link_edges(facts: DataFrame, run_id: str = "run") -> DataFrame:
    """One row per link with its flags; targets resolve against the page's own URL, not its base."""
    rows = facts.select("page_id", F.col("final_url").alias("from_url"), F.posexplode("links").alias("position", "link"))
    flag = lambda rel: F.array_contains("link.rel", rel)
    key = F.concat(F.col("from_url"), F.lit("->"), F.col("link.raw"), F.lit(":"), F.col("link.source"), F.lit(":"), F.col("link.kind"))
    to = F.col("link.url")
    return rows.select(
        U.make_id("link", key).alias("link_id"), "page_id", "from_url", "position", F.col("link.source").alias("source"), F.col("link.kind").alias("kind"), F.col("link.raw").alias("raw"), to.alias("to_url"),
        F.col("link.text").alias("text"), flag("nofollow").alias("nofollow"), flag("sponsored").alias("sponsored"), flag("ugc").alias("ugc"), (U.origin(to) == U.origin(F.col("from_url"))).alias("internal"),
    )


def capped(edges: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` valid candidates of each page, in collection order; invalid ones use no room."""
    order = Window.partitionBy("page_id").orderBy("position")
    return edges.where("to_url is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("rank")


def degrees(edges: DataFrame, side: str) -> DataFrame:
    """Number of links per target (side to_url) or per source (side from_url)."""
    return edges.groupBy(side).agg(F.count("*").alias("links"))


def adjacent(edges: DataFrame, url: str, side: str = "from_url", limit: int = 1000) -> DataFrame:
    return edges.where(F.col(side) == url).limit(max(1, min(10_000, limit)))


def two_hops(edges: DataFrame, then: DataFrame | None = None) -> DataFrame:
    """Pairs of pages joined through a middle page: distinct sources and targets.

    ``then`` holds the second edges where they aren't the same.  Repeated edges meet once.
    """
    first = edges.select("from_url", F.col("to_url").alias("via")).distinct()
    second = (edges if then is None else then).select(F.col("from_url").alias("via"), "to_url").distinct()
    return first.join(second, "via").select("from_url", "to_url").distinct()


def urls_only_in(links: DataFrame, include: str, exclude: str, limit: int = 10_000) -> DataFrame:
    """URLs that one source class names and the other doesn't, in order."""
    a = links.where(F.col("source") == include).select(F.col("to_url").alias("url"))
    b = links.where(F.col("source") == exclude).select(F.col("to_url").alias("url"))
    return a.join(b, "url", "left_anti").distinct().orderBy("url").limit(limit)


def page_counts(edges: DataFrame, limit: int) -> DataFrame:
    """Per page: discovered, recorded and truncated links, and how many lead outside its origin."""
    total = edges.groupBy("page_id").agg(F.count("*").alias("discovered"), F.count_if(F.col("internal")).alias("internal"), F.count_if(~F.col("internal")).alias("external"))
    return total.withColumn("recorded", F.least("discovered", F.lit(limit))).withColumn("truncated", F.col("discovered") - F.col("recorded"))


def decision(url: Column, kind: Column, in_scope: Column, scripts: bool = False, styles: bool = False) -> Column:
    """What becomes of a link: its enqueue source, or asset_skipped, or rejected_scope."""
    out = F.when(~in_scope, "rejected_scope")
    if scripts:
        out = out.when(kind == "script", "javascript-static")
    if styles:
        out = out.when(kind == "stylesheet", "css-static")
    return out.when((kind == "navigation") & U.is_navigation(url), "html-link").otherwise("asset_skipped")


def should_render(text_bytes: Column, navigation_links: Column, rendered_before: Column, mode: str = "auto", minimum: int = 200, cap: int = 100) -> Column:
    if mode == "never":
        return F.lit(False)
    few = (text_bytes < minimum) | (navigation_links == 0)
    return (rendered_before < cap) & (F.lit(True) if mode == "always" else few)
