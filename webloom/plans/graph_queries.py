"""Queries over the links of style sheets, scripts and headers, and over nested facts of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.operators import nesting as N
from webloom.operators import resource_graph as G
from webloom.operators.scope import Scope, resolve_seeds
from webloom.plans.page_queries import UNESCAPE, A
from webloom.plans.registry import query
from webloom.sources.tables import anchors, table

# Each page's own style element and script start a sheet and a script of the page; its links end them.
_BODIES = f"""{A}, h AS (SELECT page_id, from_url, regexp_extract(from_url, '^(https?://[^/?#]+)', 1) AS o, href, to_url, position FROM e)"""


def _bodies(spark, d, kind):
    """request_id, final_url, text (or link_header): a resource of every page with a link, made of the page's own parts."""
    pages = table(spark, d, "pages")
    hrefs = anchors(pages).groupBy("page_id", "from_url").agg(F.array_sort(F.collect_list(F.struct("position", "href"))).alias("links"))
    cut = lambda tag: F.regexp_extract("html", f"<{tag}>([\\s\\S]*?)</{tag}>", 1)
    rows = pages.select("page_id", cut("style").alias("style"), cut("script").alias("script")).join(hrefs, "page_id")
    href = lambda x: x["href"]
    if kind == "css":
        rule = lambda x: F.when(x["position"] == 0, F.concat(F.lit('@import "'), href(x), F.lit('.css";'))).otherwise(F.concat(F.lit(" i{background:url("), href(x), F.lit(".png)}")))
        text = F.concat(F.array_join(F.transform("links", rule), "\n"), F.lit("/*"), "style", F.lit("*/"))
    elif kind == "js":
        text = F.concat("script", F.array_join(F.transform("links", lambda x: F.concat(F.lit("fetch('"), href(x), F.lit("');"))), "\n"))
    else:
        text = F.array_join(F.transform("links", lambda x: F.concat(F.lit("<"), href(x), F.when(x["position"] % 2 == 0, ">; rel=next").otherwise(">; rel=preload"))), ", ")
    url = F.col("from_url") if kind == "header" else F.concat(U.origin(F.col("from_url")), F.lit(f"/{kind}/"), F.col("page_id").cast("string"), F.lit(f".{kind}"))
    return rows.select(F.col("page_id").alias("request_id"), url.alias("final_url"), text.alias("link_header" if kind == "header" else "text"))


def _edges(spark, d, kind):
    return {"css": G.style_edges, "js": G.script_edges, "header": G.header_edges}[kind](_bodies(spark, d, kind))


def _pick(edges):
    return edges.select("request_id", "from_url", F.col("position").cast("long").alias("position"), "source", "kind", "raw", "to_url", "method")


_CSS = """css AS (SELECT page_id AS request_id, o || '/css/' || page_id || '.css' AS from_url, row_number() OVER (PARTITION BY page_id ORDER BY min(position)) - 1 AS position, 'style-content' AS source, 'css-discovery' AS kind, href || ext AS raw, to_url || ext AS to_url,
 CASE WHEN ext = '.css' THEN 'import' ELSE 'url' END AS method FROM (SELECT *, CASE WHEN position = 0 THEN '.css' ELSE '.png' END AS ext FROM h) GROUP BY page_id, o, href, to_url, ext)"""
_JS = """js AS (SELECT page_id AS request_id, o || '/js/' || page_id || '.js' AS from_url, row_number() OVER (PARTITION BY page_id ORDER BY min(position)) - 1 AS position, 'script-content' AS source, 'script-discovery' AS kind, href AS raw, to_url, 'fetch' AS method FROM h GROUP BY page_id, o, href, to_url)"""
_HEADER = """header AS (SELECT page_id AS request_id, from_url, position, 'http-link-header' AS source, CASE WHEN position % 2 = 0 THEN 'navigation' ELSE 'preload' END AS kind, href AS raw, to_url, 'link-header' AS method FROM h)"""


@query(f"WITH {_BODIES}, {_CSS} SELECT * FROM css")
def css_edges(spark, d):
    """Links of style sheets, resolved against the sheet, best evidence of each URL."""
    return _pick(_edges(spark, d, "css"))


@query(f"WITH {_BODIES}, {_JS} SELECT * FROM js")
def js_edges(spark, d):
    return _pick(_edges(spark, d, "js"))


@query(f"WITH {_BODIES}, {_HEADER} SELECT * FROM header")
def header_edges(spark, d):
    return _pick(_edges(spark, d, "header"))


_ALL_SEEDS = "o AS (SELECT regexp_extract(u, '^(https?://[^/?#]+)', 1) AS origin, min_by(u, page_id) AS seed_url FROM p GROUP BY 1)"


@query(f"""WITH {_BODIES}, {_CSS}, {_JS}, {_HEADER}, s AS (SELECT *, 0 AS stage FROM header UNION ALL SELECT *, 1 FROM css UNION ALL SELECT *, 1 FROM js),
w AS (SELECT *, CASE WHEN request_id % 7 = 0 THEN 6 ELSE 2 END AS depth, row_number() OVER (ORDER BY request_id, stage, position, from_url, raw) AS n, CASE source WHEN 'style-content' THEN 'css-static' WHEN 'script-content' THEN 'javascript-static' ELSE CASE WHEN kind = 'navigation' THEN 'html-link' ELSE 'asset_skipped' END END AS what FROM s),
d AS (SELECT n, depth <= 5 AND count(*) FILTER (depth <= 5) OVER (PARTITION BY to_url ORDER BY n) = 1 AS first, count(*) FILTER (depth <= 5) OVER (PARTITION BY to_url ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS seen FROM w WHERE what <> 'asset_skipped')
SELECT request_id, source, CAST(position AS BIGINT) AS position, to_url, CASE WHEN what = 'asset_skipped' THEN what WHEN seen THEN 'already_seen' WHEN depth > 5 THEN 'max_depth' ELSE 'enqueued' END AS status FROM w LEFT JOIN d USING (n)""")
def asset_admission(spark, d):
    """Links of headers, sheets and scripts through admission, in order of request, header before body."""
    edges = _edges(spark, d, "header").unionByName(_edges(spark, d, "css")).unionByName(_edges(spark, d, "js"))
    own = table(spark, d, "pages").select(F.col("page_id").alias("request_id"), U.without_fragment(F.col("url")).alias("url"), F.when(F.col("page_id") % 7 == 0, 5).otherwise(1).alias("depth"))
    seeds = own.groupBy(U.origin(F.col("url")).alias("origin")).agg(F.min("request_id").alias("ordinal"), F.min_by("url", "request_id").alias("seed_url"))
    decided = G.decide_edges(edges, resolve_seeds(own, seeds.select("ordinal", "seed_url")), Scope(), enqueue_styles=True, enqueue_scripts=True, run_cap=1_000_000)
    return decided.select("request_id", "source", F.col("position").cast("long").alias("position"), "to_url", "status")


@query(f"""WITH {_BODIES}, {_CSS}, {_JS}, x AS (SELECT from_url, to_url FROM css UNION SELECT from_url, to_url FROM js UNION SELECT from_url, o || '/css/' || page_id || '.css' FROM h UNION SELECT from_url, o || '/js/' || page_id || '.js' FROM h),
r AS (SELECT u AS url, min(page_id) AS ordinal FROM p GROUP BY 1),
one AS (SELECT to_url AS url, 1 AS hops, min({{'ordinal': ordinal, 'path': [r.url, to_url]}}) AS way FROM r JOIN x ON x.from_url = r.url WHERE to_url NOT IN (SELECT url FROM r) GROUP BY 1),
two AS (SELECT to_url AS url, 2 AS hops, min({{'ordinal': way.ordinal, 'path': list_append(way.path, to_url)}}) AS way FROM one JOIN x ON x.from_url = one.url WHERE to_url NOT IN (SELECT url FROM r) AND to_url NOT IN (SELECT url FROM one) GROUP BY 1)
SELECT url, CAST(hops AS BIGINT) AS hops, way.ordinal AS ordinal, array_to_string(way.path, ' ') AS path FROM (FROM one UNION ALL FROM two)""")
def asset_attribution(spark, d):
    """The least path from a page to each asset: page, its sheet or script, what these name."""
    css, js = _edges(spark, d, "css"), _edges(spark, d, "js")
    pages = table(spark, d, "pages").select("page_id", U.without_fragment(F.col("url")).alias("url"))
    own = anchors(table(spark, d, "pages")).select("page_id", "from_url").distinct()
    asset = lambda kind: F.concat(U.origin(F.col("from_url")), F.lit(f"/{kind}/"), F.col("page_id").cast("string"), F.lit(f".{kind}"))
    loads = own.select("from_url", F.explode(F.array(asset("css"), asset("js"))).alias("to_url"))
    edges = loads.unionByName(css.select("from_url", "to_url")).unionByName(js.select("from_url", "to_url"))
    out = G.attribute_assets(edges, pages.select("url", F.col("page_id").alias("ordinal")))
    return out.select("url", F.col("hops").cast("long").alias("hops"), "ordinal", F.array_join("path", " ").alias("path"))


_MARKED = [("<body>", '<body itemscope itemtype="WebPage">'), ("<nav>", '<nav itemscope itemtype="Navigation">'), ("<li>", '<li itemprop="entry" itemscope>'), ("<a href", '<a itemprop="url" href'), ("<article>", '<article itemprop="mainEntity" itemscope itemtype="Article">'), ("<h1>", '<h1 itemprop="headline name">')]


def _marked(spark, d):
    """Pages whose own elements are marked as items and properties; every third page has no item around all."""
    html = F.col("html")
    for i, (plain, marked) in enumerate(_MARKED):
        html = F.replace(html, F.lit(plain), F.lit(marked)) if i else F.when(F.col("page_id") % 3 == 0, html).otherwise(F.replace(html, F.lit(plain), F.lit(marked)))
    return table(spark, d, "pages").withColumn("html", html)


@query(f"""WITH {A}, t AS (SELECT page_id, page_id % 3 <> 0 AS whole, html, {UNESCAPE.format("trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1))")} AS head FROM pages)
SELECT page_id, 'Navigation' AS parent_type, 'entry' AS name, CAST(NULL AS VARCHAR) AS value, true AS of_item FROM e UNION ALL SELECT page_id, NULL, 'url', to_url, false FROM e
UNION ALL SELECT page_id, 'Article', unnest(['headline', 'name']), head, false FROM t WHERE html LIKE '%<h1>%' UNION ALL SELECT page_id, CASE WHEN whole THEN 'WebPage' END, 'mainEntity', NULL, true FROM t WHERE html LIKE '%<article>%'""")
def microdata_properties(spark, d):
    """Properties of nested items with the type of the item that each belongs to."""
    found = N.microdata(N.nested(_marked(spark, d)))[1]
    return found.select("page_id", "parent_type", "name", "value", F.col("value_item").isNotNull().alias("of_item"))


@query("""SELECT page_id, CAST(len(regexp_extract_all(html, '<li>')) + 2 + (page_id % 3 <> 0)::INT AS BIGINT) AS items, CAST(len(regexp_extract_all(html, '<li>')) + CASE WHEN page_id % 3 <> 0 THEN 2 ELSE 0 END AS BIGINT) AS nested FROM pages""")
def microdata_items(spark, d):
    items = N.microdata(N.nested(_marked(spark, d)))[0]
    return items.groupBy("page_id").agg(F.count("*").alias("items"), F.count("parent").alias("nested"))


@query(f"""WITH t AS (SELECT page_id, {UNESCAPE.format("trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1))")} AS head, len(regexp_extract_all(html, '<p>')) AS n FROM pages)
SELECT page_id, 'nav' AS tag, NULL AS text, NULL AS parent FROM t UNION ALL SELECT page_id, 'article', NULL, NULL FROM t UNION ALL SELECT page_id, 'h1', head, 'article' FROM t UNION ALL SELECT page_id, 'h3', 'Part', 'h1' FROM t WHERE page_id % 2 = 0
UNION ALL SELECT page_id, 'h2', 'Next', 'h1' FROM t UNION ALL SELECT page_id, 'h4', 'Deep', 'h2' FROM t UNION ALL SELECT page_id, 'aside', NULL, 'article' FROM t WHERE page_id % 5 = 0 UNION ALL SELECT page_id, 'h2', 'Beside', 'aside' FROM t WHERE page_id % 5 = 0""")
def page_outline(spark, d):
    """Headings and sections of pages as a tree, with more headings put at the article's end."""
    more = F.concat(F.when(F.col("page_id") % 2 == 0, "<h3>Part</h3>").otherwise(""), F.lit("<h2>Next</h2><h4>Deep</h4>"), F.when(F.col("page_id") % 5 == 0, "<aside><h2>Beside</h2></aside>").otherwise(""), F.lit("</article>"))
    nodes = N.outline(N.nested(table(spark, d, "pages").withColumn("html", F.replace("html", F.lit("</article>"), more))))
    tags = nodes.select("page_id", F.col("node").alias("parent"), F.col("tag").alias("of"))
    return nodes.join(tags, ["page_id", "parent"], "left").select("page_id", "tag", "text", F.col("of").alias("parent"))
