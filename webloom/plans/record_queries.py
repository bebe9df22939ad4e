"""Queries over records, runs, evidence, sitemaps and encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.operators import classify as C
from webloom.operators import diff as D
from webloom.operators import records as R
from webloom.operators import resources as Re
from webloom.operators import sitemaps as S
from webloom.plans.page_queries import A, P
from webloom.plans.registry import query
from webloom.sources.tables import fetches, root_relative_links, table

FETCH = f"""p AS ({P}), f AS (SELECT page_id AS request_id, u AS final_url, CASE WHEN page_id % 17 = 0 THEN 404 ELSE 200 END AS status, CAST(strlen(html) AS BIGINT) AS body_bytes, html AS body FROM p)"""


def _records(spark, d):
    f = fetches(table(spark, d, "pages")).drop("body").withColumn("resource_type", F.when(F.col("request_id") % 3 == 0, "feed").otherwise("html"))
    links = root_relative_links(table(spark, d, "pages")).select(F.col("from_url").alias("source_url"), F.col("to_url").alias("target_url"), "position", "page_id")
    day = lambda c: F.timestamp_seconds(F.lit(1_700_000_000) + c)
    resources = R.envelope(f, "resource", F.col("request_id"), request_id=F.col("request_id"), url=F.col("final_url"), status_code=F.col("status"), created_at=day(F.col("request_id")))
    edges = R.envelope(links, "link", U.make_id("link", F.concat_ws(":", "page_id", "position")), url=F.col("target_url"), from_url=F.col("source_url"), to_url=F.col("target_url"), created_at=day(F.col("page_id")))
    return R.union(resources, edges)


REC = f"""{A.replace("p AS", "p AS", 1)}, r AS (SELECT 'resource' AS kind, CAST(page_id AS VARCHAR) AS record_id, u AS url, CASE WHEN page_id % 17 = 0 THEN 404 ELSE 200 END AS status_code, NULL AS from_url, NULL AS to_url, page_id AS t FROM p
UNION ALL SELECT 'link', 'link_' || substr(sha256(page_id || ':' || position), 1, 24), to_url, NULL, from_url, to_url, page_id FROM e)"""


@query(f"WITH {REC} SELECT kind, record_id, url, CAST(status_code AS BIGINT) AS status_code, from_url, to_url FROM r")
def records_envelope(spark, d):
    return _records(spark, d).select("kind", "record_id", "url", F.col("status_code").cast("long").alias("status_code"), "from_url", "to_url")


@query(f"WITH {REC} SELECT record_id, url FROM r WHERE kind = 'resource' AND status_code = 404 ORDER BY t, record_id LIMIT 25")
def record_query(spark, d):
    return R.CrawlIndex(_records(spark, d)).query(25, kind="resource", status_code=404).select("record_id", "url")


@query(f"WITH {REC} SELECT count(*) AS records FROM r WHERE kind = 'resource' AND status_code = 200")
def record_count(spark, d):
    return R.CrawlIndex(_records(spark, d)).count(kind="resource", status_code=200)


@query(f"WITH {REC} SELECT record_id, url FROM r WHERE kind = 'resource' AND t % 3 = 0 ORDER BY t, record_id LIMIT 1000")
def resources_by_type(spark, d):
    return R.CrawlIndex(_records(spark, d)).resources_by_type("feed").select("record_id", "url")


@query("SELECT k AS kind, CASE WHEN k = 'resource' THEN (SELECT count(*) FROM pages) WHEN k = 'link' THEN (SELECT CAST(sum(len(regexp_extract_all(html, '<a href=\"[^\"]*\"'))) AS BIGINT) FROM pages) ELSE 0 END AS records FROM (SELECT unnest(['request','request-state','discovery','resource','html-page','xml-resource','link','skipped','error','robots','sitemap-entry','feed-entry']) AS k)")
def counts_by_kind(spark, d):
    return R.CrawlIndex(_records(spark, d)).counts_by_kind()


@query(f"WITH {A}, r AS (SELECT to_url AS record_id, page_id * 1000 + position AS seq, page_id FROM e) SELECT record_id, seq, page_id FROM r QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY seq) = 1")
def insert_first_wins(spark, d):
    rows = root_relative_links(table(spark, d, "pages")).select(F.lit("link").alias("kind"), F.col("to_url").alias("record_id"), (F.col("page_id") * 1000 + F.col("position")).alias("seq"), "page_id")
    return R.first_wins(rows).drop("kind")


@query("SELECT sha256(text) AS hash, count(*) AS count, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_bodies(spark, d):
    return C.duplicate_bodies(table(spark, d, "documents"), "doc_id", "text").select("hash", "count", F.array_join("ids", ",").alias("ids"))


@query("SELECT sha256(text) AS digest, CAST(max(strlen(text)) AS BIGINT) AS byte_length, count(*) AS \"references\", 'evidence/sha256/' || substr(sha256(text), 1, 2) || '/' || sha256(text) AS path FROM documents WHERE text IS NOT NULL GROUP BY text")
def evidence_store(spark, d):
    return R.evidence_store(table(spark, d, "documents"), "text")


@query("WITH o AS (SELECT strlen(text) AS b, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text) SELECT count(*) AS objects, CAST(sum(b) AS BIGINT) AS total_bytes, CAST(sum(b * n) AS BIGINT) AS referenced_bytes FROM o")
def evidence_totals(spark, d):
    return R.bundle_totals(R.evidence_store(table(spark, d, "documents"), "text"))


@query("SELECT doc_id AS request_id, CASE WHEN doc_id % 10 = 6 THEN 'X' ELSE '' END || sha256(text || '@' || doc_id) AS digest, CASE WHEN doc_id % 10 = 3 THEN 'missing' WHEN doc_id % 10 = 4 THEN 'digest' WHEN doc_id % 10 = 6 THEN 'malformed-digest' ELSE 'length' END AS fault FROM documents WHERE doc_id % 10 IN (3, 4, 5, 6) AND text IS NOT NULL")
def evidence_faults(spark, d):
    """Associations whose object is gone, altered, of another length or badly named; each has a body of its own."""
    body = F.concat("text", F.lit("@"), F.col("doc_id").cast("string"))
    k = F.col("doc_id") % 10
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", body.alias("body"))
    digest = F.sha2(F.col("body").cast("binary"), 256)
    associations = docs.select(F.col("doc_id").alias("request_id"), F.concat(F.when(k == 6, "X").otherwise(""), digest).alias("digest"), (F.octet_length("body") + F.when(k == 5, 1).otherwise(0)).cast("long").alias("byte_length"))
    objects = docs.where(k != 3).select(digest.alias("digest"), F.when(k == 4, F.concat("body", F.lit("!"))).otherwise(F.col("body")).cast("binary").alias("content"))
    return R.evidence_faults(associations, objects)


@query("WITH o AS (SELECT DISTINCT sha256(text) AS digest FROM documents WHERE text IS NOT NULL) SELECT 'evidence/sha256/' || substr(digest, 1, 2) || '/' || digest AS path FROM o WHERE substr(digest, 1, 1) = 'a'")
def bundle_unlisted(spark, d):
    store = R.evidence_store(table(spark, d, "documents"), "text").select("path", "digest")
    return R.unlisted(store.select("path"), store.where("substring(digest, 1, 1) <> 'a'"))


@query(f"""WITH {A}, g AS (SELECT count(*) AS links_discovered, count(DISTINCT to_url) AS distinct_targets FROM e)
SELECT count(*) AS fetched, count(*) FILTER (page_id % 17 <> 0) AS succeeded, count(*) FILTER (page_id % 17 = 0) AS failed, CAST(sum(strlen(html)) AS BIGINT) AS body_bytes, count(DISTINCT regexp_extract(u, '^(https?://[^/?#]+)', 1)) AS origins,
 any_value(links_discovered) AS links_discovered, any_value(distinct_targets) AS distinct_targets, CAST(floor(sum(strlen(html)) / count(*)) AS BIGINT) AS mean_body_bytes FROM p, g""")
def crawl_stats(spark, d):
    pages = table(spark, d, "pages")
    return R.crawl_stats(fetches(pages), root_relative_links(pages))


@query("SELECT user_id, CASE WHEN user_id % 7 = 0 THEN 'failed' WHEN user_id % 5 = 0 THEN 'aborted' WHEN user_id % 3 = 0 THEN 'stopped_by_limit' WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'partial' ELSE 'completed' END AS status FROM events GROUP BY 1")
def run_status(spark, d):
    runs = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("failed"))
    return runs.select("user_id", R.run_status(F.col("user_id") % 7 == 0, F.col("user_id") % 5 == 0, F.col("user_id") % 3 == 0, F.col("failed")).alias("status"))


def _runs(spark, d):
    f = fetches(table(spark, d, "pages")).withColumn("body_hash", C.body_hash(F.col("body"))).drop("body")
    base = f.where("request_id % 10 <> 0")
    target = f.where("request_id % 10 <> 1").withColumn("status", F.when(F.col("request_id") % 7 == 0, 500).otherwise(F.col("status"))).withColumn("body_hash", F.when(F.col("request_id") % 6 == 0, F.lit("x")).otherwise(F.col("body_hash")))
    return tuple(D.last_wins(x, ["final_url"], ["request_id"]) for x in (base, target))


RUNS = f"""{FETCH}, b0 AS (SELECT *, sha256(body) AS h FROM f WHERE request_id % 10 <> 0 QUALIFY row_number() OVER (PARTITION BY final_url ORDER BY request_id DESC) = 1),
t0 AS (SELECT request_id, final_url, CASE WHEN request_id % 7 = 0 THEN 500 ELSE status END AS status, CASE WHEN request_id % 6 = 0 THEN 'x' ELSE sha256(body) END AS h FROM f WHERE request_id % 10 <> 1 QUALIFY row_number() OVER (PARTITION BY final_url ORDER BY request_id DESC) = 1),
j AS (SELECT coalesce(b.final_url, t.final_url) AS key, b.final_url AS bu, t.final_url AS tu, b.status AS bs, t.status AS ts, b.h AS bh, t.h AS th FROM b0 b FULL OUTER JOIN t0 t ON b.final_url = t.final_url),
changes AS (SELECT 'resource' AS entity, key, 'appeared' AS kind FROM j WHERE bu IS NULL UNION ALL SELECT 'resource', key, 'disappeared' FROM j WHERE tu IS NULL
 UNION ALL SELECT 'resource', key, 'status-changed' FROM j WHERE bu IS NOT NULL AND tu IS NOT NULL AND bs <> ts UNION ALL SELECT 'resource', key, 'body-changed' FROM j WHERE bu IS NOT NULL AND tu IS NOT NULL AND bh <> th)"""


@query(f"WITH {RUNS} SELECT * FROM changes")
def diff_resources(spark, d):
    base, target = _runs(spark, d)
    return D.compare(base, target, "resource", "final_url", {"status": "status", "body": "body_hash"})


@query(f"WITH {RUNS} SELECT entity, count(*) AS changes, count(*) FILTER (kind = 'appeared') AS appeared, count(*) FILTER (kind = 'disappeared') AS disappeared, CAST(0 AS BIGINT) AS added, CAST(0 AS BIGINT) AS removed, count(*) FILTER (kind LIKE '%-changed') AS modified FROM changes GROUP BY 1")
def diff_summary(spark, d):
    base, target = _runs(spark, d)
    return D.summary(D.compare(base, target, "resource", "final_url", {"status": "status", "body": "body_hash"}))


@query(f"""WITH {A}, b AS (SELECT DISTINCT from_url || chr(0) || to_url AS key FROM e WHERE page_id % 10 <> 0), t AS (SELECT DISTINCT from_url || chr(0) || to_url AS key FROM e WHERE page_id % 10 <> 1)
SELECT 'link' AS entity, replace(key, chr(0), ' ') AS key, 'added' AS kind FROM t WHERE key NOT IN (SELECT key FROM b) UNION ALL SELECT 'link', replace(key, chr(0), ' '), 'removed' FROM b WHERE key NOT IN (SELECT key FROM t)""")
def diff_links(spark, d):
    links = root_relative_links(table(spark, d, "pages"))
    return D.membership(links.where("page_id % 10 <> 0"), links.where("page_id % 10 <> 1"), "link", ["from_url", "to_url"]).withColumn("key", F.replace("key", F.lit("\x00"), F.lit(" ")))


@query(f"WITH {FETCH} SELECT request_id AS key, CASE WHEN request_id % 9 = 0 THEN 'missing-evidence' WHEN request_id % 9 = 1 THEN 'failed' WHEN request_id % 9 = 2 THEN 'changed' ELSE 'matched' END AS status FROM f")
def replay_status(spark, d):
    from webloom.operators.links import extract_pages

    pages = table(spark, d, "pages")
    pick = lambda rows: extract_pages(rows).select("page_id", "final_url", "title", "headings", "html_lang")
    saved = pick(pages)
    edited = pages.where("page_id % 9 <> 0").withColumn("html", F.when(F.col("page_id") % 9 == 2, F.regexp_replace("html", "<title>", "<title>new ")).otherwise(F.col("html")))
    again = pick(edited).withColumn("failed", F.col("page_id") % 9 == 1)
    return D.replay(saved, again, "page_id")


@query("""WITH s AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 0 THEN '2023-11-31' WHEN o_orderkey % 13 = 1 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M') || 'Z' WHEN o_orderkey % 13 = 2 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') WHEN o_orderkey % 13 = 3 THEN strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS t FROM orders)
SELECT k, regexp_full_match(t, '[0-9]{4}(-[0-9]{2}(-[0-9]{2}(T[0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?(Z|[+-][0-9]{2}:[0-9]{2}))?)?)?') AND (length(t) < 10 OR try_cast(substr(t, 1, 10) AS DATE) IS NOT NULL) AS valid FROM s""")
def lastmod_valid(spark, d):
    k, day = F.col("o_orderkey"), lambda f: F.date_format("o_orderdate", f)
    text = F.when(k % 13 == 0, "2023-11-31").when(k % 13 == 1, F.concat(day("yyyy-MM-dd'T'HH:mm"), F.lit("Z"))).when(k % 13 == 2, day("yyyy-MM-dd'T'HH:mm:ss")).when(k % 13 == 3, day("yyyy")).otherwise(day("yyyy-MM-dd"))
    return table(spark, d, "orders").select(k.alias("k"), S.valid_lastmod(text).alias("valid"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 13 = 0 THEN '1e0' WHEN l_orderkey % 13 = 1 THEN '1.00' ELSE '0.' || lpad(CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR), 2, '0') END AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN regexp_full_match(t, '0([.][0-9]+)?|1([.]0+)?') THEN CAST(round(CAST(t AS DOUBLE) * 100) AS BIGINT) END AS hundredths FROM s""")
def priority_parse(spark, d):
    k = F.col("l_orderkey") % 13
    text = F.when(k == 0, "1e0").when(k == 1, "1.00").otherwise(F.concat(F.lit("0."), F.lpad(F.round(F.col("l_discount") * 100).cast("long").cast("string"), 2, "0")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.priority(text) * 100).cast("long").alias("hundredths"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'daily' WHEN o_orderkey % 4 = 1 THEN 'never' END AS changefreq FROM orders")
def changefreq_parse(spark, d):
    k = F.col("o_orderkey") % 4
    return table(spark, d, "orders").select("o_orderkey", S.change_frequency(F.when(k == 0, "daily").when(k == 1, "never").when(k == 2, "Often").otherwise("often")).alias("changefreq"))


@query(f"""WITH p AS ({P}) SELECT page_id, u AS url, CASE WHEN page_id % 3 = 0 THEN '2024-01-02' END AS lastmod, CASE WHEN page_id % 5 = 0 THEN 'invalid changefreq' ELSE '' END AS warnings FROM p""")
def sitemap_entries(spark, d):
    u = U.without_fragment(F.col("url"))
    entry = F.concat(
        F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>'), F.replace(u, F.lit("&"), F.lit("&amp;")), F.lit("</loc>"), F.when(F.col("page_id") % 3 == 0, "<lastmod>2024-01-02</lastmod>").otherwise(""),
        F.when(F.col("page_id") % 5 == 0, "<changefreq>Often</changefreq>").otherwise("<changefreq>daily</changefreq>"), F.lit("</url></urlset>"),
    )
    docs = table(spark, d, "pages").select(F.col("page_id").alias("key"), F.concat(U.origin(u), F.lit("/sitemap.xml")).alias("url"), entry.cast("binary").alias("body"))
    rows = S.entries(S.extract(docs), "sitemap")
    return rows.select(F.col("key").alias("page_id"), "url", "lastmod", F.array_join("warnings", ",").alias("warnings"))


@query(f"""WITH p AS ({P}) SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'sitemap-index' WHEN page_id % 4 = 1 THEN 'feed' WHEN page_id % 4 = 2 THEN 'xml' ELSE 'xml' END AS kind, CASE WHEN page_id % 4 = 3 THEN 'failed' ELSE 'parsed' END AS status, CAST(CASE WHEN page_id % 4 < 2 THEN 1 ELSE 0 END AS BIGINT) AS entries FROM p""")
def xml_resources(spark, d):
    k = F.col("page_id") % 4
    text = (
        F.when(k == 0, '<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>/a.xml</loc></sitemap></sitemapindex>')
        .when(k == 1, '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>t</title><link href="/x"/></entry></feed>')
        .when(k == 2, '<urlset xmlns="http://other.example/"><url/></urlset>')
        .otherwise("<urlset><url></urlset>")
    )
    docs = table(spark, d, "pages").select(F.col("page_id").alias("key"), U.without_fragment(F.col("url")).alias("url"), text.cast("binary").alias("body"))
    out = S.extract(docs)
    return out.select(F.col("key").alias("page_id"), "kind", "status", (F.size("sitemap") + F.size("feed")).cast("long").alias("entries"))


@query(f"""WITH p AS ({P}), s AS (SELECT DISTINCT regexp_extract(u, '^(https?://[^/?#]+)', 1) AS o FROM p) SELECT o || '/sitemap.xml' AS url FROM s UNION SELECT o || '/robots-map.xml' FROM s UNION SELECT u FROM p WHERE u LIKE '%?%'""")
def sitemap_sources(spark, d):
    u = U.without_fragment(F.col("url"))
    pages = table(spark, d, "pages").select("page_id", u.alias("u"), U.origin(u).alias("o"))
    return S.sources(pages.select(F.concat("o", F.lit("/robots-map.xml")).alias("url")), pages.select("o"), pages.where("u LIKE '%?%'").select(F.col("u").alias("url")))


@query("SELECT doc_id, sha256(text) AS text_hash, CASE WHEN doc_id % 3 = 0 THEN 'bom' WHEN doc_id % 3 = 1 THEN 'http' ELSE 'default' END AS encoding_source, CASE WHEN doc_id % 3 = 1 THEN 'utf-16le' ELSE 'utf-8' END AS encoding FROM documents")
def body_decoding(spark, d):
    k = F.col("doc_id") % 3
    body = F.when(k == 0, F.concat(F.lit(b"\xef\xbb\xbf"), F.col("text").cast("binary"))).when(k == 1, F.encode("text", "UTF-16LE")).otherwise(F.col("text").cast("binary"))
    rows = table(spark, d, "documents").select("doc_id", body.alias("body"), F.when(k == 1, 'text/html; charset="UTF-16LE"').alias("content_type"), F.lit("html").alias("kind"))
    return C.decoded(rows).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"), "encoding_source", "encoding")


@query(f"""WITH {FETCH} SELECT request_id, CASE WHEN request_id % 4 = 1 AND request_id % 3 = 0 THEN 'revalidated' WHEN request_id % 4 = 2 AND request_id % 3 = 0 THEN 'stale' ELSE 'network' END AS source FROM f""")
def cache_revalidation(spark, d):
    f = fetches(table(spark, d, "pages")).select("request_id", F.concat(F.col("final_url"), F.lit("#"), F.col("request_id").cast("string")).alias("url"), F.when(F.col("request_id") % 4 == 1, 304).when(F.col("request_id") % 4 == 2, 503).otherwise(200).alias("status"), "body")
    cache = f.where("request_id % 3 = 0").select("url", F.col("body").alias("cached_body"))
    return C.revalidated(f, cache).select("request_id", "source")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'missing b' WHEN event_id % 3 = 1 THEN 'wrong type of a' END AS fault FROM events WHERE event_id % 3 < 2")
def contract_validation(spark, d):
    text = F.when(F.col("event_id") % 3 == 0, '{"a": 1}').when(F.col("event_id") % 3 == 1, '{"a": "1", "b": true}').otherwise('{"a": 1, "b": false}')
    rows = R.contract_faults(table(spark, d, "events").select("event_id", text.alias("json")), "json", {"a": "number", "b": "boolean"})
    return rows.select("event_id", F.array_join("faults", ",").alias("fault"))


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN false END AS public FROM customer")
def network_safety(spark, d):
    from webloom.operators.scope import public_address

    k = F.col("c_custkey") % 5
    address = F.when(k == 0, "10.1.2.3").when(k == 1, "93.184.216.34").when(k == 2, "::1").when(k == 3, "169.254.1.1").otherwise("host")
    return table(spark, d, "customer").select("c_custkey", public_address(address).alias("public"))


def _gzip_bodies(orders):
    """Sitemap bodies packed by one stage and inflated by preparation."""
    import gzip

    @F.pandas_udf("binary")
    def packed(text):
        return text.map(lambda t: gzip.compress(t.encode(), 1, mtime=0))

    text = F.concat(F.lit("<urlset>"), F.when(F.col("o_orderkey") % 2 == 0, "a b").otherwise("é"), F.col("o_orderkey").cast("string"), F.lit("</urlset>"))
    url = F.lit("http://h/s.xml.gz")
    rows = orders.select(F.col("o_orderkey").alias("request_id"), url.alias("requested_url"), url.alias("final_url"), F.lit(200).alias("status"), F.lit(None).cast("string").alias("content_type"), packed(text).alias("body"))
    return Re.prepare(rows, max_bytes=100).select(F.col("request_id").alias("o_orderkey"), "text")


_INFLATED = "SELECT o_orderkey, '<urlset>' || CASE WHEN o_orderkey % 2 = 0 THEN 'a b' ELSE 'é' END || o_orderkey || '</urlset>' AS text FROM orders"


@query(_INFLATED)
def gzip_bodies(spark, d):
    """Inflation of gzip bodies within a budget."""
    return _gzip_bodies(table(spark, d, "orders"))


@query(_INFLATED)
def gzip_bodies_all(spark, d):
    """The same under its other name."""
    return _gzip_bodies(table(spark, d, "orders"))
