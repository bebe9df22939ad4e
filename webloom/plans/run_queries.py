"""Queries over whole stages: policies, redirects, prepared resources, link decisions, entries, run comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom import contracts as Ct
from webloom.extensions import Extensions, decide
from webloom.functions import urls as U
from webloom.operators import diff as D
from webloom.operators import links as L
from webloom.operators import policy as Po
from webloom.operators import records as R
from webloom.operators import resources as Re
from webloom.operators import sitemaps as S
from webloom.operators.scope import Scope, resolve_seeds
from webloom.plans.crawl_queries import _admission_sql, _seeds
from webloom.plans.page_queries import P
from webloom.plans.registry import query
from webloom.sources.tables import fetches, table

# Decisions of the policy chain on every page.
_SLOW = "CASE WHEN page_id % 13 = 0 THEN 'ftp://h/' ELSE u END"


@query(f"""WITH p AS ({P}), r AS (SELECT page_id, {_SLOW} AS u, page_id % 3 AS depth, page_id % 4 = 0 AS own FROM p),
d AS (SELECT *, CASE WHEN own AND depth > 1 THEN 'seed.maxDepth' WHEN u LIKE 'ftp:%' THEN 'protocol' WHEN length(u) > CASE WHEN own THEN 45 ELSE 60 END THEN 'maxUrlLength' WHEN NOT own AND u LIKE '%/de/%' THEN 'exclude' END AS rule FROM r)
SELECT page_id, CASE WHEN rule IS NOT NULL THEN 'SCOPE_REJECTED' WHEN page_id % 7 = 0 THEN 'NETWORK_SAFETY_REJECTED' WHEN page_id % 5 = 0 THEN 'ROBOTS_DISALLOWED' ELSE 'allow' END AS decision,
 CASE WHEN rule IS NOT NULL THEN rule WHEN page_id % 7 = 0 THEN 'networkSafety' WHEN page_id % 5 = 0 THEN 'robots' END AS policy,
 CASE rule WHEN 'seed.maxDepth' THEN 'Seed depth limit exceeded' WHEN 'protocol' THEN 'Unsupported protocol ftp:' WHEN 'maxUrlLength' THEN 'URL length exceeds maximum' WHEN 'exclude' THEN 'URL matched exclude pattern' ELSE CASE WHEN page_id % 7 = 0 THEN 'address is not public' WHEN page_id % 5 = 0 THEN 'disallowed by robots rules' END END AS detail FROM d""")
def request_policy(spark, d):
    rows = table(spark, d, "pages").select("page_id", U.without_fragment(F.col("url")).alias("u")).withColumn("url", F.expr(_SLOW))
    rows = rows.withColumn("depth", F.col("page_id") % 3).withColumn("seed_url", F.when(F.col("page_id") % 4 == 0, "http://own/").otherwise("http://any/"))
    default = Scope(mode="custom", max_url_length=60, exclude=("*/de/*",))
    rows = Po.scope_decisions(rows, default, {"http://own/": Scope(mode="custom", max_url_length=45)}, {"http://own/": 1})
    rows = rows.withColumn("safe", F.col("page_id") % 7 != 0).withColumn("robots_allowed", F.col("page_id") % 5 != 0)
    return Po.request_decisions(rows).select("page_id", "decision", "policy", "detail")


@query(f"WITH p AS ({P}) SELECT page_id, length(u) <= 50 AND page_id % 7 <> 0 AND page_id % 5 <> 0 AS allowed, length(u) <= 50 AS scope_allowed, page_id % 7 <> 0 AS network_safety_allowed, CASE WHEN length(u) <= 50 AND page_id % 7 <> 0 THEN page_id % 5 <> 0 END AS robots_allowed, length(u) <= 50 AND page_id % 7 <> 0 AS for_robots FROM p")
def redirect_policy(spark, d):
    rows = table(spark, d, "pages").select("page_id", U.without_fragment(F.col("url")).alias("url"), F.lit(0).alias("depth"), F.lit("http://any/").alias("seed_url"))
    rows = Po.scope_decisions(rows, Scope(mode="custom", max_url_length=50))
    rule, safe = F.col("scope_rule"), F.col("page_id") % 7 != 0
    rows = rows.withColumn("x", Po.redirect_decision(rule, safe, F.col("page_id") % 5 != 0)).withColumn("for_robots", Po.redirect_decision(rule, safe)["allowed"])
    return rows.select("page_id", "x.*", "for_robots")


def _redirects(spark, d):
    node = lambda n: F.concat(F.lit("https://r/"), n.cast("string"))
    keys = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 97).alias("n"))
    responses = keys.select("n").distinct().select(node(F.col("n")).alias("url"), F.when(F.col("n") % 5 == 0, 200).otherwise(301).alias("status"), node((F.col("n") * 3 + 1) % 97).alias("location"))
    starts = keys.select(F.col("c_custkey").alias("request_id"), node(F.col("n")).alias("url"))
    return Po.follow_redirects(starts, responses, max_hops=4, target_allowed=lambda u: F.substring_index(u, "/", -1).cast("int") % 11 != 0)


_CHAIN = """WITH RECURSIVE k AS (SELECT c_custkey AS request_id, c_custkey % 97 AS n FROM customer), r AS (SELECT DISTINCT n, CASE WHEN n % 5 = 0 THEN 200 ELSE 301 END AS status, (n * 3 + 1) % 97 AS t FROM k),
g AS (SELECT request_id, n, [n] AS visited, 0 AS hop, CAST(NULL AS VARCHAR) AS error FROM k
 UNION ALL SELECT g.request_id, r.t, list_append(visited, r.t), hop + 1, CASE WHEN hop = 4 THEN 'TOO_MANY_REDIRECTS' WHEN list_contains(visited, r.t) THEN 'REDIRECT_LOOP' WHEN r.t % 11 = 0 THEN 'REDIRECT_TARGET_REJECTED' END FROM g JOIN r ON r.n = g.n WHERE g.error IS NULL AND r.status = 301)"""


@query(f"""{_CHAIN}, e AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY hop DESC) = 1)
SELECT request_id, 'https://r/' || CASE WHEN error = 'TOO_MANY_REDIRECTS' THEN visited[-2] ELSE e.n END AS final_url, CASE WHEN error IS NOT NULL THEN 301 ELSE CAST(r.status AS INTEGER) END AS status, CASE WHEN error = 'TOO_MANY_REDIRECTS' THEN 4 ELSE hop END AS hops, error FROM e LEFT JOIN r ON r.n = e.n""")
def redirect_outcomes(spark, d):
    return _redirects(spark, d)[1].select("request_id", "final_url", "status", "hops", "error")


@query(f"""{_CHAIN} SELECT request_id, hop - 1 AS hop_index, 'https://r/' || visited[-2] AS from_url, 'https://r/' || n AS to_url, error IS DISTINCT FROM 'REDIRECT_LOOP' AS valid_target FROM g WHERE hop > 0 AND error IS DISTINCT FROM 'TOO_MANY_REDIRECTS'""")
def redirect_hops(spark, d):
    return _redirects(spark, d)[0].select("request_id", "hop_index", "from_url", "to_url", "valid_target")


def _prepared(spark, d):
    kind = F.when(F.col("request_id") % 3 == 0, "text/html; charset=utf-8").when(F.col("request_id") % 3 == 1, "image/png").otherwise("application/json")
    return Re.prepare(fetches(table(spark, d, "pages")).withColumn("content_type", kind).withColumn("body", F.col("body").cast("binary")).drop("body_bytes"))


_PREPARED = f"""p AS ({P}), r AS (SELECT page_id AS request_id, CASE page_id % 3 WHEN 0 THEN 'html' WHEN 1 THEN 'image' ELSE 'json' END AS resource_type, page_id % 17 <> 0 AS ok, CAST(strlen(html) AS BIGINT) AS body_bytes, sha256(html) AS raw_sha256, CASE WHEN page_id % 3 <> 1 THEN sha256(html) END AS decoded_sha256, CASE WHEN page_id % 3 <> 1 THEN 'utf-8' END AS encoding, 'res_' || substr(sha256(page_id || ':' || u), 1, 24) AS resource_id FROM p)"""


@query(f"WITH {_PREPARED} SELECT * FROM r")
def resource_preparation(spark, d):
    return _prepared(spark, d).select("request_id", "resource_type", "ok", "body_bytes", "raw_sha256", "decoded_sha256", "encoding", "resource_id")


@query(f"WITH {_PREPARED} SELECT 'html' AS processor, count(*) AS resources FROM r WHERE resource_type = 'html' UNION ALL SELECT x, 0 FROM (SELECT unnest(['xml', 'javascript', 'css']) AS x)")
def resource_routes(spark, d):
    parts = [rows.agg(F.count("*").alias("resources")).select(F.lit(name).alias("processor"), "resources") for name, rows in Re.route(_prepared(spark, d)).items()]
    return R.union(*parts)


@query(f"SELECT seq // 1000 AS page_id, seq % 1000 AS position, status FROM ({_admission_sql(10_000, 10_000, 1_000_000, 1000)})")
def link_decisions(spark, d):
    pages = table(spark, d, "pages")
    edges = L.link_edges(L.extract_pages(pages)).where("source = 'a[href]'")
    own = pages.select("page_id", U.without_fragment(F.col("url")).alias("url"), F.when(F.col("page_id") % 7 == 0, 8).otherwise(0).alias("depth"))
    requests = resolve_seeds(own, _seeds(pages).select("ordinal", "seed_url"))
    return Re.decide_links(edges, requests, Scope()).select("page_id", F.col("position").cast("long").alias("position"), "status")


@query(f"WITH p AS ({P}) SELECT page_id, u AS from_url, regexp_extract(u, '^(https?://[^/?#]+)', 1) || '/feed/' || page_id AS to_url, CASE WHEN page_id % 3 = 0 THEN 'application/rss+xml' ELSE 'application/atom+xml' END AS type FROM p WHERE page_id % 3 <> 2")
def feed_alternates(spark, d):
    kind = F.when(F.col("page_id") % 3 == 0, "application/RSS+xml").when(F.col("page_id") % 3 == 1, "application/atom+xml").otherwise("application/json")
    link = F.concat(F.lit('<head><link rel="Alternate" type="'), kind, F.lit('" href="/feed/'), F.col("page_id").cast("string"), F.lit('">'))
    pages = table(spark, d, "pages").withColumn("html", F.replace("html", F.lit("<head>"), link))
    return Re.feed_alternates(L.extract_pages(pages))


@query(f"""WITH p AS ({P}), s AS (SELECT page_id, regexp_extract(u, '^(https?://[^/?#]+)', 1) AS o FROM p), f AS (SELECT page_id AS key, o || '/s' || page_id || '.xml' AS src, o, page_id % 4 AS depth, page_id % 3 AS k FROM s)
SELECT key, src AS url, 'sitemap-index' AS source, depth + 1 AS depth, 1 + key % 4 AS index_depth, 'recursive' AS status, 1 AS ancestors FROM f WHERE k = 0
UNION ALL SELECT key, o || '/c' || key || '.xml', 'sitemap-index', depth + 1, 1 + key % 4, CASE WHEN key % 4 >= 3 THEN 'index_depth' ELSE 'enqueue' END, 1 FROM f WHERE k = 0
UNION ALL SELECT key, o || '/a' || key, 'sitemap', 1, 0, 'enqueue', 0 FROM f WHERE k = 1
UNION ALL SELECT key, o || '/f' || key, 'feed', depth + 1, 0, 'enqueue', 0 FROM f WHERE k = 2""")
def entry_requests(spark, d):
    docs, requests = _xml_documents(spark, d, F.col("page_id"))
    out = Re.entry_requests(docs, requests, max_index_depth=3)
    return out.select("key", "url", "source", F.col("depth").cast("long").alias("depth"), F.col("index_depth").cast("long").alias("index_depth"), "status", F.size("ancestors").alias("ancestors"))


def _xml_documents(spark, d, number):
    """Of every page a sitemap index, a sitemap or a feed of its origin, extracted, and the request of each."""
    page, number = F.col("page_id").cast("string"), number.cast("string")
    own = F.concat("o", F.lit("/s"), page, F.lit(".xml"))
    loc = lambda letter, end="": F.concat(F.lit("<loc>"), F.col("o"), F.lit(f"/{letter}"), number, F.lit(f"{end}</loc>"))
    space = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    body = (
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(f"<sitemapindex {space}><sitemap><loc>"), own, F.lit("</loc></sitemap><sitemap>"), loc("c", ".xml"), F.lit("</sitemap></sitemapindex>")))
        .when(F.col("page_id") % 3 == 1, F.concat(F.lit(f"<urlset {space}><url>"), loc("a"), F.lit("</url></urlset>")))
        .otherwise(F.concat(F.lit('<rss version="2.0"><channel><item><title>t</title><link>'), F.col("o"), F.lit("/f"), number, F.lit("</link></item></channel></rss>")))
    )
    pages = table(spark, d, "pages").withColumn("o", U.origin(F.col("url")))
    docs = S.extract(pages.select(F.col("page_id").alias("key"), own.alias("url"), body.cast("binary").alias("body")))
    requests = pages.select(F.col("page_id").alias("key"), (F.col("page_id") % 4).alias("depth"), F.lit("http://any/").alias("seed_url"), (F.col("page_id") % 4).alias("index_depth"), F.array().cast("array<string>").alias("ancestors"))
    return docs, requests


@query(f"""WITH p AS ({P}), s AS (SELECT page_id, regexp_extract(u, '^(https?://[^/?#]+)', 1) AS o FROM p), f AS (SELECT page_id AS key, o, page_id % 4 AS depth, page_id % 3 AS k FROM s),
r AS (SELECT key, 0 AS place, o || '/s' || key || '.xml' AS url, 'sitemap-index' AS source, depth + 1 AS depth, 'recursive' AS status FROM f WHERE k = 0
 UNION ALL SELECT key, 1, o || '/c' || key % 5 || '.xml', 'sitemap-index', depth + 1, CASE WHEN key % 4 >= 3 THEN 'index_depth' ELSE 'enqueue' END FROM f WHERE k = 0
 UNION ALL SELECT key, 0, o || '/a' || key % 5, 'sitemap', 1, 'enqueue' FROM f WHERE k = 1 UNION ALL SELECT key, 0, o || '/f' || key % 5, 'feed', depth + 1, 'enqueue' FROM f WHERE k = 2),
g AS (SELECT *, row_number() OVER (PARTITION BY status = 'enqueue', url, depth <= 3 ORDER BY key, place) AS n, min(CASE WHEN status = 'enqueue' AND depth <= 3 THEN key END) OVER (PARTITION BY url) AS first FROM r)
SELECT key, url, source, CASE WHEN status <> 'enqueue' THEN status WHEN first < key THEN 'already_seen' WHEN depth > 3 THEN 'max_depth' ELSE 'enqueued' END AS status FROM g""")
def entry_admission(spark, d):
    """What becomes of the entries of sitemaps, their indexes and feeds: asked for in order of document and place, then admitted."""
    docs, requests = _xml_documents(spark, d, F.col("page_id") % 5)
    out = Re.decide_entries(Re.entry_requests(docs, requests, max_index_depth=3), Scope(mode="custom"), max_depth=3, run_cap=1_000_000)
    return out.select("key", "url", "source", "status")


def _own(url, key):
    """A URL of each page alone: some pages share theirs."""
    return F.concat(url, F.lit("?k="), key.cast("string"))


def _page_runs(spark, d):
    pages = table(spark, d, "pages")
    edit = F.when(F.col("page_id") % 6 == 0, F.replace("html", F.lit("<title>"), F.lit("<title>new "))).otherwise(F.col("html"))
    edited = pages.withColumn("html", edit).withColumn("html", F.when(F.col("page_id") % 5 == 2, F.replace("html", F.lit("<h1>"), F.lit("<h1>new "))).otherwise(F.col("html")))
    pick = lambda rows: D.last_wins(L.extract_pages(rows).withColumn("url", _own(F.col("final_url"), F.col("page_id"))), ["url"], ["page_id"])
    return pick(pages.where("page_id % 10 <> 0")), pick(edited.where("page_id % 10 <> 1"))


_CHANGED = f"""p AS ({P}), h AS (SELECT page_id, u || '?k=' || page_id AS key, page_id % 10 = 0 AS new, page_id % 10 = 1 AS gone FROM p),
pages_changed AS (SELECT key, 'appeared' AS kind FROM h WHERE new UNION ALL SELECT key, 'disappeared' FROM h WHERE gone UNION ALL SELECT key, 'title-changed' FROM h WHERE NOT new AND NOT gone AND page_id % 6 = 0
 UNION ALL SELECT key, unnest(['headings-changed', 'text-changed']) FROM h WHERE NOT new AND NOT gone AND page_id % 5 = 2)"""


@query(f"WITH {_CHANGED} SELECT 'html-page' AS entity, kind, key, 'change_' || substr(sha256('html-page:' || kind || ':' || key), 1, 24) AS id FROM pages_changed")
def diff_pages(spark, d):
    base, target = _page_runs(spark, d)
    return D.compare_runs({"html-page": base}, {"html-page": target}).select("entity", "kind", "key", "id")


def _whole_runs(spark, d):
    pages = fetches(table(spark, d, "pages")).withColumn("id", F.col("request_id")).withColumn("url", _own(F.col("final_url"), F.col("id"))).withColumn("body_hash", F.sha2(F.col("body").cast("binary"), 256)).drop("body")
    moved = pages.withColumn("final_url", F.when(F.col("id") % 9 == 3, "http://moved/").otherwise(F.col("final_url"))).withColumn("content_type", F.when(F.col("id") % 9 == 4, "text/plain").otherwise(F.col("content_type")))
    maps = pages.select("id", F.concat(F.lit("https://s/"), (F.col("id") % 5).cast("string")).alias("sitemap_url"), "url", F.lit("url").alias("kind"))
    links = pages.select("id", F.col("url").alias("from_url"), F.concat("url", F.lit("#x")).alias("to_url"), F.lit("navigation").alias("kind"))
    robots = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("https://o"), F.col("s_suppkey").cast("string")).alias("origin"), F.lit("allowed").alias("status"))
    altered = robots.withColumn("status", F.when(F.col("id") % 3 == 0, "error").otherwise(F.col("status")))
    page_base, page_target = _page_runs(spark, d)
    base = {"resource": pages.where("id % 10 <> 0"), "html-page": page_base, "link": links.where("id % 4 <> 0"), "sitemap": maps.where("id % 4 <> 2"), "robots": robots.where("id % 8 <> 0").drop("id")}
    target = {"resource": moved.where("id % 10 <> 1"), "html-page": page_target, "link": links.where("id % 4 <> 1"), "sitemap": maps.where("id % 4 <> 3"), "robots": altered.where("id % 8 <> 1").drop("id")}
    return D.compare_runs(base, target)


@query("""WITH p AS (SELECT page_id AS i FROM pages), s AS (SELECT s_suppkey AS i FROM supplier)
SELECT (SELECT count(*) FROM p WHERE i % 10 = 0) * 2 + (SELECT count(*) FROM s WHERE i % 8 = 0) AS appeared, (SELECT count(*) FROM p WHERE i % 10 = 1) * 2 + (SELECT count(*) FROM s WHERE i % 8 = 1) AS disappeared,
 (SELECT count(*) FROM p WHERE i % 4 = 0) AS links_added, (SELECT count(*) FROM p WHERE i % 4 = 1) AS links_removed, (SELECT count(*) FROM p WHERE i % 4 = 2) AS sitemap_added, (SELECT count(*) FROM p WHERE i % 4 = 3) AS sitemap_removed,
 (SELECT CAST(sum(CASE WHEN i % 9 IN (3, 4) THEN 1 ELSE 0 END + CASE WHEN i % 6 = 0 THEN 1 ELSE 0 END + CASE WHEN i % 5 = 2 THEN 2 ELSE 0 END) AS BIGINT) FROM p WHERE i % 10 > 1) + (SELECT count(*) FROM s WHERE i % 8 > 1 AND i % 3 = 0) AS modified""")
def diff_report(spark, d):
    return D.report_summary(_whole_runs(spark, d))


@query(f"""WITH p AS ({P}), k AS (SELECT page_id, u, CASE page_id % 4 WHEN 0 THEN upper(u) WHEN 1 THEN replace(u, 'e', 'é') WHEN 2 THEN replace(u, '/', '_') ELSE u END || '#' || page_id AS key, CASE WHEN page_id % 3 = 0 THEN 'link' ELSE 'resource' END AS entity FROM p)
SELECT entity, key, place FROM (SELECT entity, key, CAST(row_number() OVER (PARTITION BY entity ORDER BY key COLLATE en) AS BIGINT) AS place FROM k) WHERE place <= 500""")
def diff_order(spark, d):
    """The head of a comparison's report, in the order of Unicode's collation: keys differ in case, accents and signs."""
    u = U.without_fragment(F.col("url"))
    k = F.col("page_id") % 4
    key = F.when(k == 0, F.upper(u)).when(k == 1, F.replace(u, F.lit("e"), F.lit("é"))).when(k == 2, F.replace(u, F.lit("/"), F.lit("_"))).otherwise(u)
    changes = table(spark, d, "pages").select(
        F.col("page_id").cast("string").alias("id"), F.when(F.col("page_id") % 3 == 0, "link").otherwise("resource").alias("entity"), F.lit("added").alias("kind"), F.concat(key, F.lit("#"), F.col("page_id").cast("string")).alias("key")
    )
    return D.first_changes(changes, 500).select("entity", "key", F.col("place").cast("long").alias("place"))


@query("SELECT count(*) FILTER (page_id % 9 > 2) AS matched, count(*) FILTER (page_id % 9 = 2) AS changed, count(*) FILTER (page_id % 9 = 0) AS missing_evidence, count(*) FILTER (page_id % 9 = 1) AS failed FROM pages")
def replay_xml(spark, d):
    """Sitemaps extracted again from stored bodies: some bodies are gone, broken or altered."""
    pages = table(spark, d, "pages").withColumn("o", U.origin(F.col("url")))
    space = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    doc = lambda name: F.concat(F.lit(f"<urlset {space}><url><loc>"), F.col("o"), F.lit(f"/{name}"), F.col("page_id").cast("string"), F.lit("</loc></url></urlset>"))
    rows = pages.select(F.col("page_id").alias("key"), F.concat("o", F.lit("/map.xml")).alias("url"), doc("a").cast("binary").alias("body"))
    k = F.col("page_id") % 9
    later = pages.select(F.col("page_id").alias("key"), F.concat("o", F.lit("/map.xml")).alias("url"), F.when(k == 1, F.lit("<urlset>")).when(k == 2, doc("b")).otherwise(doc("a")).cast("binary").alias("body")).where("key % 9 <> 0")
    again = S.extract(later).withColumn("failed", F.col("error").isNotNull())
    return D.replay_counts(D.replay(S.extract(rows), again, "key"))


_STATES = "CASE page_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' WHEN 2 THEN 'cancelled' ELSE 'handled' END"


@query(f"""WITH p AS (SELECT *, {_STATES} AS state, page_id % 4 AS attempts FROM pages), r AS (SELECT c_custkey AS k FROM customer),
c AS (SELECT 'requestsScheduled' AS counter, count(*) AS value FROM p UNION ALL SELECT 'requestsAttempted', count(*) FILTER (attempts > 0) FROM p UNION ALL SELECT 'requestsFetched', count(*) FILTER (page_id % 5 > 2) FROM p
 UNION ALL SELECT 'requestsTransportFailed', count(*) FILTER (page_id % 10 = 0) FROM p UNION ALL SELECT 'requestsPolicySkipped', count(*) FILTER (page_id % 5 = 1) FROM p UNION ALL SELECT 'requestsCancelled', count(*) FILTER (page_id % 5 = 2) FROM p
 UNION ALL SELECT 'requestsFailed', count(*) FILTER (page_id % 5 = 0) FROM p UNION ALL SELECT 'retries', CAST(sum(greatest(attempts - 1, 0)) AS BIGINT) FROM p
 UNION ALL SELECT 'urlsSkipped', count(*) FROM r UNION ALL SELECT 'robotsDisallowedUrls', count(*) FILTER (k % 4 = 0) FROM r UNION ALL SELECT 'scopeRejectedUrls', count(*) FILTER (k % 4 = 1) FROM r UNION ALL SELECT 'networkSafetyRejectedUrls', count(*) FILTER (k % 4 = 2) FROM r)
SELECT * FROM c""")
def run_counters(spark, d):
    k = F.col("page_id")
    requests = table(spark, d, "pages").select(F.expr(_STATES).alias("state"), (k % 4).alias("attempts"), F.when(k % 10 == 0, "transport").alias("error"))
    n = F.col("c_custkey") % 4
    skipped = table(spark, d, "customer").select(F.when(n == 0, "ROBOTS_DISALLOWED").when(n == 1, "SCOPE_REJECTED").when(n == 2, "NETWORK_SAFETY_REJECTED").otherwise("INVALID_URL").alias("reason"))
    return R.run_counters({"requests": requests, "skipped": skipped})


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN [] WHEN 1 THEN ['missing url', 'wrong type of status'] WHEN 2 THEN ['unknown extra', 'wrong schema'] ELSE ['not JSON'] END AS faults FROM orders""")
def record_contracts(spark, d):
    contract = Ct.Contract("example.fetch", 2, {"url": "string", "status": "integer?", "price": "number"})
    key = F.col("o_orderkey").cast("string")
    price = F.concat(F.lit(',"price":'), F.col("o_totalprice").cast("string"))
    text = (
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit('{"schemaId":"example.fetch","schemaVersion":2,"url":"u'), key, F.lit('","status":null'), price, F.lit("}")))
        .when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit('{"schemaId":"example.fetch","schemaVersion":2,"status":"200"'), price, F.lit("}")))
        .when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit('{"schemaId":"example.fetch","schemaVersion":1,"url":"","extra":1,"status":'), key, price, F.lit("}")))
        .otherwise(F.concat(F.lit("{"), key))
    )
    return Ct.checked(table(spark, d, "orders").select("o_orderkey", text.alias("json")), "json", [contract]).select("o_orderkey", "faults")


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN 'digest' WHEN 1 THEN CASE WHEN l_partkey % 2 = 0 THEN 'complete length' END WHEN 2 THEN CASE WHEN l_partkey % 2 = 1 THEN 'truncated length' END WHEN 3 THEN 'length' ELSE 'capture' END AS fault FROM lineitem""")
def evidence_references(spark, d):
    k, odd = F.col("l_linenumber") % 5, F.col("l_partkey") % 2
    digest = F.sha2(F.concat_ws(":", "l_orderkey", "l_linenumber").cast("binary"), 256)
    fault = Ct.evidence_fault(F.when(k == 0, F.upper(F.concat(F.lit("x"), digest))).otherwise(digest), F.when(k == 3, -1).otherwise(10), F.when(k == 1, "complete").when(k == 2, "truncated").when(k == 3, "complete").otherwise("partial"), F.lit(11) - F.when((k == 1) | (k == 2), (odd == 1).cast("int")).otherwise(0))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fault.alias("fault"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'skip' WHEN c_custkey % 6 = 1 THEN 'fail' ELSE 'continue' END AS decision, CASE WHEN c_custkey % 6 = 0 THEN 'closed' WHEN c_custkey % 6 = 1 THEN 'invalid decision delay' END AS reason, CAST(CASE WHEN c_custkey % 6 = 2 THEN 50 ELSE 0 END AS BIGINT) AS delay_ms FROM customer""")
def middleware_decisions(spark, d):
    k = F.col("c_custkey") % 6
    ext = Extensions(before_request=[lambda rows: F.when(k == 0, decide("skip", "closed")), lambda rows: F.when(k == 2, decide("delay", "slow", 50)).when(k == 1, decide("delay", "bad", -1)), lambda rows: rows["missing"]])
    out = ext.apply(table(spark, d, "customer").select("c_custkey"), "before_request")
    return out.select("c_custkey", "decision", "reason", "delay_ms")
