"""Queries over captured pages: URLs, facts, links."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.operators import classify as C
from webloom.operators import links as L
from webloom.operators import resources as Re
from webloom.plans.registry import query
from webloom.sources.tables import fetches, root_relative_links, table

# Building blocks of the checking SQL.
P = "SELECT page_id, regexp_replace(url, '#.*$', '') AS u, html FROM pages"
ENC = "(CASE WHEN unicode(c) < 128 THEN c ELSE url_encode(c) END)"
A = f"""p AS ({P}),
a AS (SELECT page_id, u AS from_url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) - 1 AS position FROM p),
e AS (SELECT page_id, from_url, CAST(position AS BIGINT) AS position, href, regexp_extract(from_url, '^(https?://[^/?#]+)', 1) || array_to_string(list_transform(string_split(href, ''), lambda c: {ENC}), '') AS to_url FROM a)"""
UNESCAPE = "replace(replace(replace(replace({}, '&quot;', '\"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&')"
PATHQ = "CASE WHEN regexp_extract(u, '^https?://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(u, '^https?://[^/?#]+([^?#]*)', 1) END"


def _facts(spark, d):
    return L.extract_pages(table(spark, d, "pages"))


@query(f"WITH {A} SELECT page_id, from_url, position, href AS raw, to_url FROM e")
def link_edges(spark, d):
    edges = L.link_edges(_facts(spark, d)).where("source = 'a[href]'")
    return edges.select("page_id", "from_url", F.col("position").cast("long").alias("position"), "raw", "to_url")


@query(f"WITH {A} SELECT page_id, position, to_url, 'link_' || substr(sha256(from_url || '->' || href || ':a[href]:navigation'), 1, 24) AS link_id FROM e")
def link_ids(spark, d):
    edges = L.link_edges(_facts(spark, d)).where("source = 'a[href]'")
    return edges.select("page_id", F.col("position").cast("long").alias("position"), "to_url", "link_id")


@query(f"WITH {A} SELECT page_id, position, to_url FROM e")
def link_edges_native(spark, d):
    """The same edges without leaving the JVM, where all hrefs start at the root."""
    return root_relative_links(table(spark, d, "pages")).select("page_id", F.col("position").cast("long").alias("position"), "to_url")


@query(f"WITH {A} SELECT to_url, count(*) AS links FROM e GROUP BY 1")
def link_in_degree(spark, d):
    return L.degrees(root_relative_links(table(spark, d, "pages")), "to_url")


@query(f"WITH {A} SELECT from_url, count(*) AS links FROM e GROUP BY 1")
def link_out_degree(spark, d):
    return L.degrees(root_relative_links(table(spark, d, "pages")), "from_url")


@query(f"""WITH {A}, o AS (SELECT page_id, from_url, to_url, page_id % 3 = 0 AS far FROM e)
SELECT page_id, count(*) AS discovered, CAST(count(*) FILTER (NOT far) AS BIGINT) AS internal, CAST(count(*) FILTER (far) AS BIGINT) AS external, least(count(*), 4) AS recorded, count(*) - least(count(*), 4) AS truncated FROM o GROUP BY 1""")
def link_counts(spark, d):
    links = root_relative_links(table(spark, d, "pages"))
    to = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("to_url", "^https?://[^/]+", "https://other.example")).otherwise(F.col("to_url"))
    edges = links.withColumn("internal", U.origin(to) == U.origin(F.col("from_url")))
    return L.page_counts(edges, 4)


@query(f"WITH {A} SELECT page_id, position, to_url FROM e QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY position) <= 3")
def link_cap(spark, d):
    return L.capped(root_relative_links(table(spark, d, "pages")), 3).select("page_id", F.col("position").cast("long").alias("position"), "to_url")


@query(f"WITH {A}, g AS (SELECT DISTINCT regexp_extract(from_url, '^https?://([^/?#:]+)', 1) AS h, regexp_extract(to_url, '[^/]*$') AS w FROM e) SELECT x.h AS from_url, y.h AS to_url FROM g x JOIN g y ON x.w = y.w GROUP BY ALL")
def link_two_hops(spark, d):
    """Hosts joined through an equal last path part (in and out edges composed)."""
    links = root_relative_links(table(spark, d, "pages")).select(U.host(F.col("from_url")).alias("h"), F.regexp_extract("to_url", "[^/]*$", 0).alias("w")).distinct()
    out, back = links.select(F.col("h").alias("from_url"), F.col("w").alias("to_url")), links.select(F.col("w").alias("from_url"), F.col("h").alias("to_url"))
    return L.two_hops(out, back)


@query(f"WITH {A} SELECT page_id, position, to_url FROM e")
def link_adjacency(spark, d):
    """Links of every page that was captured, found by their source."""
    pages = table(spark, d, "pages")
    captured = pages.select(U.without_fragment(F.col("url")).alias("from_url")).distinct()
    return root_relative_links(pages).join(captured, "from_url", "left_semi").select("page_id", F.col("position").cast("long").alias("position"), "to_url")


@query(f"WITH {A} SELECT page_id, position, to_url FROM e ORDER BY from_url, position, page_id")
def link_adjacency_all(spark, d):
    """Links of all pages, in the order of their URL and place."""
    return root_relative_links(table(spark, d, "pages")).orderBy("from_url", "position", "page_id").select("page_id", F.col("position").cast("long").alias("position"), "to_url")


@query(f"""WITH {A}, l AS (SELECT CASE WHEN page_id % 2 = 0 THEN 'sitemap' ELSE 'html' END AS s, regexp_extract(to_url, '/[^/]*$') AS url FROM e)
SELECT DISTINCT url FROM l x WHERE s = 'sitemap' AND NOT EXISTS (SELECT 1 FROM l y WHERE y.s = 'html' AND y.url = x.url) ORDER BY url LIMIT 10000""")
def urls_only_in_sitemap(spark, d):
    links = root_relative_links(table(spark, d, "pages"))
    rows = links.select(F.when(F.col("page_id") % 2 == 0, "sitemap").otherwise("html").alias("source"), F.regexp_extract("to_url", "/[^/]*$", 0).alias("to_url"))
    return L.urls_only_in(rows, "sitemap", "html")


@query(f"WITH {A} SELECT page_id, position, CASE WHEN page_id % 11 = 0 THEN 'rejected_scope' WHEN page_id % 5 = 0 THEN 'asset_skipped' ELSE 'html-link' END AS decision FROM e")
def asset_decision(spark, d):
    links = root_relative_links(table(spark, d, "pages"))
    url = F.when(F.col("page_id") % 5 == 0, F.concat("to_url", F.lit(".PNG"))).otherwise(F.col("to_url"))
    return links.select("page_id", F.col("position").cast("long").alias("position"), L.decision(url, F.lit("navigation"), F.col("page_id") % 11 != 0).alias("decision"))


@query(f"WITH p AS ({P}) SELECT page_id, u AS normalized FROM p")
def url_normalize(spark, d):
    return table(spark, d, "pages").select("page_id", U.normalize_url(F.col("url"), F.lit(None).cast("string")).alias("normalized"))


@query(f"""WITH p AS ({P}), q AS (SELECT page_id, u, {PATHQ} AS path FROM p)
SELECT page_id, regexp_extract(u, '^(https?://[^/?#]+)', 1) AS origin, regexp_extract(u, '^https?://([^/?#:]+)', 1) AS host, path, regexp_extract(path, '^(.*/)', 1) AS directory,
 CAST(len(list_filter(string_split(path, '/'), lambda s: s <> '')) AS BIGINT) AS segments, CAST(len(list_filter(string_split(regexp_extract(u, '[?]([^#]*)', 1), '&'), lambda s: s <> '')) AS BIGINT) AS params FROM q""")
def url_parts(spark, d):
    url = U.without_fragment(F.col("url"))
    return table(spark, d, "pages").select(
        "page_id", U.origin(url).alias("origin"), U.host(url).alias("host"), U.path(url).alias("path"), U.directory(url).alias("directory"), U.path_segments(url).cast("long").alias("segments"), U.query_param_count(url).cast("long").alias("params")
    )


@query(f"""WITH p AS ({P}), q AS (SELECT page_id, {PATHQ} AS path, regexp_extract(u, '[?]([^#]*)', 1) AS qs FROM p)
SELECT page_id, array_to_string(list_transform(string_split(path, '/'), lambda s: CASE WHEN regexp_full_match(s, '[0-9]+') THEN ':number' WHEN length(s) > 24 THEN ':long' ELSE s END), '/') AS path_pattern,
 array_to_string(list_sort(list_transform(list_filter(string_split(qs, '&'), lambda s: s <> ''), lambda s: string_split(s, '=')[1])), '&') AS query_pattern FROM q""")
def path_pattern(spark, d):
    url = U.without_fragment(F.col("url"))
    return table(spark, d, "pages").select("page_id", U.path_pattern(url).alias("path_pattern"), U.query_pattern(url).alias("query_pattern"))


@query("""WITH p AS (SELECT page_id, page_id % 8 AS k, html FROM pages) SELECT page_id, CASE WHEN page_id % 17 = 0 THEN 'error' WHEN k = 0 THEN 'html' WHEN k = 1 THEN 'feed' WHEN k = 2 THEN 'sitemap' WHEN k = 3 THEN 'json' WHEN k = 4 THEN 'image'
 WHEN k = 5 THEN 'html' WHEN k = 6 THEN 'archive' ELSE 'html' END AS resource_type FROM p""")
def classify_responses(spark, d):
    k = F.col("page_id") % 8
    url = F.concat(U.without_fragment(F.regexp_replace("url", r"\?.*$", "")), F.when(k == 2, "/sitemap-1.xml").when(k == 4, "/a.PNG").when(k == 6, "/x.tar").otherwise(""))
    content = F.when(k == 0, "text/HTML; charset=utf-8").when(k == 1, "application/rss+xml").when(k == 2, "text/xml").when(k == 3, "application/ld+json").when(k == 5, "text/plain").when(k == 6, "application/octet-stream")
    status = F.when(F.col("page_id") % 17 == 0, F.lit(None).cast("int")).otherwise(200)
    return table(spark, d, "pages").select("page_id", C.resource_class(url, status, content, F.substring("html", 1, 1024)).alias("resource_type"))


@query(f"""SELECT page_id, {UNESCAPE.format("trim(regexp_extract(html, '<title>([^<]*)</title>', 1))")} AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS html_lang, regexp_extract(html, '<meta charset="([^"]*)"', 1) AS charset FROM pages""")
def page_titles(spark, d):
    return _facts(spark, d).select("page_id", "title", "html_lang", "charset")


@query(f"""SELECT page_id, CAST(1 AS BIGINT) AS level, {UNESCAPE.format("trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1))")} AS text FROM pages WHERE regexp_matches(html, '<h1>')""")
def page_headings(spark, d):
    return _facts(spark, d).select("page_id", F.explode("headings").alias("h")).select("page_id", F.col("h.level").cast("long").alias("level"), F.col("h.text").alias("text"))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<script')) AS BIGINT) AS scripts, CAST(len(regexp_extract_all(html, '<a href')) AS BIGINT) AS anchors, CAST(len(regexp_extract_all(html, '<h[1-6]')) AS BIGINT) AS headings FROM pages")
def page_fact_counts(spark, d):
    f = _facts(spark, d)
    return f.select("page_id", F.col("scripts").cast("long").alias("scripts"), F.size(F.filter("links", lambda x: x["source"] == "a[href]")).cast("long").alias("anchors"), F.size("headings").cast("long").alias("headings"))


@query(f"""WITH t AS (SELECT page_id, {UNESCAPE.format("trim(regexp_extract(html, '<title>([^<]*)</title>', 1))")} AS s FROM pages)
SELECT page_id, CAST(strlen(s) AS BIGINT) AS total_bytes, strlen(s) > 40 AS truncated FROM t""")
def page_text_bounds(spark, d):
    """Byte-bounded text: the title as text of a page of its own."""
    pages = table(spark, d, "pages").withColumn("html", F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return L.extract_pages(pages, max_text=40).select("page_id", F.col("visible_text.total_bytes").alias("total_bytes"), F.col("visible_text.truncated").alias("truncated"))


@query("""WITH t AS (SELECT page_id, page_id % 4 AS k FROM pages) SELECT page_id, CAST(CASE WHEN k = 0 THEN 5.0 WHEN k = 1 THEN 0.5 ELSE NULL END AS DOUBLE) AS seconds, CASE WHEN k = 0 THEN '/next' WHEN k = 1 THEN '/q x' END AS target FROM t""")
def meta_refresh(spark, d):
    k = F.col("page_id") % 4
    content = F.when(k == 0, "5; URL=/next").when(k == 1, ".5;url='/q x'").when(k == 2, "soon").otherwise("")
    tag = F.concat(F.lit('<head><META http-equiv=Refresh content="'), content, F.lit('">'))
    pages = table(spark, d, "pages").withColumn("url", F.lit("http://h/")).withColumn("html", F.replace("html", F.lit("<head>"), tag))
    target = F.replace(F.replace("refresh.url", F.lit("http://h"), F.lit("")), F.lit("%20"), F.lit(" "))
    return L.extract_pages(pages).select("page_id", "refresh.seconds", target.alias("target"))


@query("SELECT page_id, regexp_extract(url, '[^/]*$') || '.css' AS url, 'import' AS method FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages) UNION ALL SELECT page_id, '/i/' || page_id || '.png', 'url' FROM pages UNION ALL SELECT page_id, 'm.map', 'source-map' FROM pages")
def css_discovery(spark, d):
    name = F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), "[^/]*$", 0)
    sheet = F.concat(F.lit('/* x */ @\\69mport "'), name, F.lit('.css"; a{background:u\\72l( /i/'), F.col("page_id").cast("string"), F.lit(".png )} b{c:url(data:image/png,x)} /*# sourceMappingURL=m.map */"))

    assets = table(spark, d, "pages").select(F.col("page_id").alias("request_id"), F.lit("http://h/").alias("final_url"), sheet.alias("text"))
    return Re.asset_links(assets, "css").select(F.col("request_id").alias("page_id"), F.col("raw").alias("url"), "method")


@query("SELECT page_id, '/api/' || page_id AS url, 'fetch' AS method FROM pages UNION ALL SELECT page_id, '/lit', 'relative' FROM pages UNION ALL SELECT page_id, '/x', 'xhr' FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, '/x', 'relative' FROM pages WHERE page_id % 2 = 1")
def js_discovery(spark, d):
    call = F.when(F.col("page_id") % 2 == 0, "var r = new XMLHttpRequest(); r.open('GET', '/x');").otherwise("var r = other(); r.open('GET', '/x');")
    script = F.concat(F.lit("fetch('/api/"), F.col("page_id").cast("string"), F.lit("'); var a = '/lit'; "), call)

    assets = table(spark, d, "pages").select(F.col("page_id").alias("request_id"), F.lit("http://h/").alias("final_url"), script.alias("text"))
    return Re.asset_links(assets, "javascript").select(F.col("request_id").alias("page_id"), F.col("raw").alias("url"), "method")


@query("SELECT page_id, '/c/' || page_id AS url, CASE WHEN page_id % 3 = 0 THEN 'canonical' WHEN page_id % 3 = 1 THEN 'preload' ELSE 'asset' END AS kind FROM pages UNION ALL SELECT page_id, '/n', 'navigation' FROM pages")
def link_headers(spark, d):
    rel = F.when(F.col("page_id") % 3 == 0, "alternate canonical").when(F.col("page_id") % 3 == 1, "preload").otherwise("author")
    header = F.concat(F.lit("</c/"), F.col("page_id").cast("string"), F.lit('>; title="a, b"; rel="'), rel, F.lit('", </n>; rel=next'))

    responses = table(spark, d, "pages").select(F.col("page_id").alias("request_id"), F.lit("http://h/").alias("final_url"), header.alias("link_header"))
    return Re.header_links(responses).select(F.col("request_id").alias("page_id"), F.col("raw").alias("url"), "kind")


@query(f"WITH {A}, n AS (SELECT page_id, count(*) AS k FROM e GROUP BY 1) SELECT p.page_id, strlen(html) < 3000 OR coalesce(k, 0) = 0 AS render FROM p LEFT JOIN n USING (page_id)")
def render_decision(spark, d):
    pages = fetches(table(spark, d, "pages"))
    n = root_relative_links(table(spark, d, "pages")).groupBy("page_id").agg(F.count("*").alias("k"))
    return pages.join(n, pages["request_id"] == n["page_id"], "left").select(F.col("request_id").alias("page_id"), L.should_render(F.col("body_bytes"), F.coalesce("k", F.lit(0)), F.lit(0), minimum=3000).alias("render"))
