"""Queries over admission, the frontier, robots, throttling and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.operators import frontier as T
from webloom.operators import scope as Sc
from webloom.plans.page_queries import PATHQ, A, P
from webloom.plans.registry import query
from webloom.sources.tables import journal, outcomes, root_relative_links, table

SEEDS = f"""{A}, o AS (SELECT regexp_extract(u, '^(https?://[^/?#]+)', 1) AS origin, min(page_id) AS ordinal, min_by(u, page_id) AS seed_url FROM p WHERE u LIKE 'https:%' GROUP BY 1)"""


def _seeds(pages):
    """The first page of every origin that is reached by https; other origins have no seed."""
    p = pages.where("url LIKE 'https:%'").select("page_id", U.without_fragment(F.col("url")).alias("u"))
    return p.groupBy(U.origin(F.col("u")).alias("origin")).agg(F.min("page_id").alias("ordinal"), F.min_by("u", "page_id").alias("seed_url"))


def _inputs(spark, d):
    """Anchors as enqueue inputs: seq, url, depth, seed_url."""
    pages = table(spark, d, "pages")
    rows = root_relative_links(pages).select((F.col("page_id") * 1000 + F.col("position")).alias("seq"), F.col("to_url").alias("url"), F.when(F.col("page_id") % 7 == 0, 9).otherwise(1).alias("depth"))
    return Sc.resolve_seeds(rows, _seeds(pages).select("ordinal", "seed_url"))


INPUTS = f"""{SEEDS}, i AS (SELECT page_id * 1000 + position AS seq, to_url AS url, CASE WHEN page_id % 7 = 0 THEN 9 ELSE 1 END AS depth, seed_url FROM e LEFT JOIN o ON o.origin = regexp_extract(to_url, '^(https?://[^/?#]+)', 1))"""


@query(f"WITH {INPUTS} SELECT seq, url, seed_url FROM i")
def seed_resolution(spark, d):
    return _inputs(spark, d).select("seq", "url", "seed_url")


@query(f"""WITH p AS ({P}), q AS (SELECT page_id, u, {PATHQ} AS path, regexp_extract(u, '^https?://([^/?#:]+)', 1) AS h FROM p)
SELECT page_id, CASE WHEN length(u) > 60 THEN 'url-length' WHEN len(list_filter(string_split(path, '/'), lambda s: s <> '')) > 2 THEN 'path-segments' WHEN len(list_filter(string_split(regexp_extract(u, '[?]([^#]*)', 1), '&'), lambda s: s <> '')) > 1 THEN 'query-params'
 WHEN u LIKE '%/de/%' THEN 'exclude' WHEN NOT (u LIKE 'http%/%') THEN 'include' WHEN h <> 'example.com' AND NOT h LIKE '%.example.com' THEN 'scope' END AS reason FROM q""")
def scope_decision(spark, d):
    u = U.without_fragment(F.col("url"))
    scope = Sc.Scope(mode="domain", max_url_length=60, max_segments=2, max_query_params=1, exclude=("*/de/*",), include=("http*/*",))
    return table(spark, d, "pages").select("page_id", Sc.scope_reason(u, F.lit(0), F.lit("http://example.com/"), scope).alias("reason"))


def _admission_sql(directory: int, pattern: int, seed: int, run: int, files: int = 1_000_000, queue: int = 1_000_000, source: str = "'html-link'") -> str:
    """Decides row by row: each step of the recursion takes the next candidate and carries what was enqueued so far."""
    path = PATHQ.replace("extract(u,", "extract(url,")
    return f"""WITH RECURSIVE {INPUTS},
x AS (SELECT row_number() OVER (ORDER BY seq) AS i, *, hash(url) AS ku, hash(seed_url) AS ks, hash(seed_url, regexp_extract({path}, '^(.*/)', 1)) AS kd,
 hash(seed_url, array_to_string(list_transform(string_split({path}, '/'), lambda s: CASE WHEN regexp_full_match(s, '[0-9]+') THEN ':number' WHEN length(s) > 24 THEN ':long' ELSE s END), '/')) AS kp, {source} IN ('robots-sitemap', 'sitemap-index') AS file FROM i),
g(i, seq, url, status, us, ss, ds, ps, fs) AS (
 SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), '', CAST([] AS UBIGINT[]), CAST([] AS UBIGINT[]), CAST([] AS UBIGINT[]), CAST([] AS UBIGINT[]), CAST(0 AS BIGINT)
 UNION ALL SELECT i, seq, url, status, CASE WHEN status = 'enqueued' THEN list_append(us, ku) ELSE us END, CASE WHEN status = 'enqueued' THEN list_append(ss, ks) ELSE ss END,
 CASE WHEN status = 'enqueued' THEN list_append(ds, kd) ELSE ds END, CASE WHEN status = 'enqueued' THEN list_append(ps, kp) ELSE ps END, CASE WHEN status = 'enqueued' AND file THEN fs + 1 ELSE fs END
 FROM (SELECT x.i, x.seq, x.url, ku, ks, kd, kp, file, us, ss, ds, ps, fs, CASE WHEN x.seed_url IS NULL THEN 'rejected_scope' WHEN list_contains(us, ku) THEN 'already_seen' WHEN file AND fs >= {files} THEN 'trap_guard' WHEN len(us) >= {run} THEN 'queue_limit'
 WHEN len(list_filter(ss, lambda y: y = ks)) >= {seed} THEN 'queue_limit' WHEN len(list_filter(ds, lambda y: y = kd)) >= {directory} THEN 'trap_guard' WHEN len(list_filter(ps, lambda y: y = kp)) >= {pattern} THEN 'trap_guard'
 WHEN depth > 5 THEN 'max_depth' WHEN len(us) >= {queue} THEN 'queue_limit' ELSE 'enqueued' END AS status FROM g JOIN x ON x.i = g.i + 1))
SELECT seq, url, status FROM g WHERE i > 0"""


@query(_admission_sql(10_000, 10_000, 1_000_000, 1000))
def admission(spark, d):
    return Sc.admit(_inputs(spark, d), Sc.Scope()).select("seq", "url", "status")


@query(_admission_sql(3, 10_000, 1_000_000, 1_000_000))
def admission_directory_cap(spark, d):
    return Sc.admit(_inputs(spark, d), Sc.Scope(max_per_directory=3), run_cap=1_000_000).select("seq", "url", "status")


@query(_admission_sql(10_000, 1, 1_000_000, 1_000_000))
def admission_pattern_cap(spark, d):
    return Sc.admit(_inputs(spark, d), Sc.Scope(max_per_pattern=1), run_cap=1_000_000).select("seq", "url", "status")


@query(_admission_sql(10_000, 10_000, 5, 40))
def admission_seed_and_run_caps(spark, d):
    return Sc.admit(_inputs(spark, d), Sc.Scope(), seed_cap=5, run_cap=40).select("seq", "url", "status")


SOURCES = "CASE seq % 4 WHEN 0 THEN 'robots-sitemap' WHEN 1 THEN 'sitemap-index' ELSE 'html-link' END"


@query(_admission_sql(4, 10_000, 1_000_000, 1_000_000, 30, 90, SOURCES))
def admission_sitemap_and_queue_caps(spark, d):
    rows = _inputs(spark, d).withColumn("source", F.expr(SOURCES))
    return Sc.admit(rows, Sc.Scope(max_per_directory=4), run_cap=1_000_000, sitemap_cap=30, queue_cap=90).select("seq", "url", "status")


def _requests(spark, d):
    k = F.col("page_id") % 4
    source = F.when(k == 0, "seed").when(k == 1, "sitemap").when(k == 2, "html-link").otherwise("feed")
    u = U.without_fragment(F.col("url"))
    return table(spark, d, "pages").select(
        F.col("page_id").alias("seq"), U.origin(u).alias("origin"), u.alias("url"), T.priority(source).alias("priority"), (F.col("page_id") % 3).alias("depth"), F.when(F.col("page_id") % 5 == 0, "handled").when(F.col("page_id") % 5 == 1, "in_progress").otherwise("pending").alias("state"), (F.col("page_id") * 10).alias("expires_at")
    )


REQ = f"""WITH p AS ({P}), q AS (SELECT page_id AS seq, regexp_extract(u, '^(https?://[^/?#]+)', 1) AS origin, u AS url, CASE page_id % 4 WHEN 0 THEN 100 WHEN 1 THEN 70 WHEN 2 THEN 60 ELSE 40 END AS priority, page_id % 3 AS depth, CASE WHEN page_id % 5 = 0 THEN 'handled' WHEN page_id % 5 = 1 THEN 'in_progress' ELSE 'pending' END AS state, page_id * 10 AS expires_at FROM p)"""


@query(f"{REQ}, b AS (SELECT * FROM q WHERE state = 'pending' QUALIFY row_number() OVER (PARTITION BY origin ORDER BY priority DESC, depth, seq) = 1) SELECT seq, origin, url FROM b ORDER BY priority DESC, depth, seq LIMIT 128")
def frontier_ready(spark, d):
    return T.ready(_requests(spark, d)).select("seq", "origin", "url")


@query(f"{REQ} SELECT seq, origin, url FROM q WHERE state = 'pending' QUALIFY row_number() OVER (PARTITION BY origin ORDER BY seq) = 1 ORDER BY seq LIMIT 20")
def frontier_bfs(spark, d):
    return T.ready(_requests(spark, d), "bfs", 20).select("seq", "origin", "url")


@query(f"{REQ} SELECT seq, origin, url FROM q WHERE state = 'pending' QUALIFY row_number() OVER (PARTITION BY origin ORDER BY seq DESC) = 1 ORDER BY seq DESC LIMIT 20")
def frontier_dfs(spark, d):
    return T.ready(_requests(spark, d), "dfs", 20).select("seq", "origin", "url")


@query(f"{REQ} SELECT count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'in_progress') AS in_progress, count(*) FILTER (state <> 'handled') AS outstanding, count(*) FILTER (state = 'handled') AS terminal, min(expires_at) FILTER (state = 'in_progress') AS next_expiry FROM q")
def frontier_state_counts(spark, d):
    return T.state_counts(_requests(spark, d))


@query(f"{REQ} SELECT origin, count(*) AS requests FROM q GROUP BY 1")
def seed_request_counts(spark, d):
    return _requests(spark, d).groupBy("origin").agg(F.count("*").alias("requests"))


@query(f"WITH {INPUTS} SELECT seq, CASE WHEN row_number() OVER (PARTITION BY url ORDER BY seq) = 1 THEN 'enqueued' ELSE 'already_seen' END AS status FROM i")
def enqueue_dedupe(spark, d):
    return T.first_sightings(_inputs(spark, d)).select("seq", "status")


JOURNAL = """j AS (SELECT user_id AS request_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, CASE event_type WHEN 'signup' THEN 'enqueued' WHEN 'view' THEN 'leased' WHEN 'click' THEN 'renewed' WHEN 'error' THEN 'released' ELSE 'handled' END AS type, CAST(floor(epoch(ts)) AS BIGINT) AS "at" FROM events)"""
NOW = 1_706_000_000


@query(f"""WITH {JOURNAL}, l AS (SELECT request_id, count(*) AS records, arg_max(type, sequence) AS type, arg_max(CASE WHEN type IN ('leased', 'renewed') THEN "at" + 3600 ELSE -1 END, sequence) AS x FROM j GROUP BY 1)
SELECT request_id, records, CASE WHEN type IN ('leased', 'renewed') THEN CASE WHEN x <= {NOW} THEN 'pending' ELSE 'deferred' END WHEN type IN ('enqueued', 'released') THEN 'pending' ELSE 'terminal' END AS state, type IN ('leased', 'renewed') AND x <= {NOW} AS recovered FROM l""")
def lease_recovery(spark, d):
    out = T.recover(journal(table(spark, d, "events")), NOW)
    return out.withColumn("recovered", F.coalesce("recovered", F.lit(False)))


@query(f"""WITH {JOURNAL}, s AS (SELECT *, sha256(request_id || '|' || sequence || '|' || type || '|' || "at") AS checksum FROM j) SELECT request_id, sequence, checksum, lag(checksum) OVER (PARTITION BY request_id ORDER BY sequence) AS previous FROM s""")
def journal_chain(spark, d):
    return T.chained(journal(table(spark, d, "events"))).select("request_id", "sequence", "checksum", "previous")


@query(f"""WITH {JOURNAL}, m AS (SELECT request_id, max(sequence) AS n FROM j GROUP BY 1) SELECT j.request_id, sequence, CASE WHEN sequence = 5 THEN 'checksum' ELSE 'previous' END AS fault FROM j WHERE request_id % 4 = 0 AND sequence = 5 UNION ALL SELECT j.request_id, sequence, 'sequence' FROM j WHERE request_id % 4 = 1 AND sequence = 4""")
def journal_faults(spark, d):
    rows = T.chained(journal(table(spark, d, "events")))
    # One journal in four has an edited record, one in four lacks its third record.
    edited = rows.withColumn("type", F.when((F.col("request_id") % 4 == 0) & (F.col("sequence") == 5), "forged").otherwise(F.col("type")))
    kept = edited.where("not (request_id % 4 = 1 and sequence = 3)")
    return T.chain_faults(kept).select("request_id", "sequence", "fault")


@query(f"""WITH {JOURNAL}, b AS (SELECT *, lag(type) OVER (PARTITION BY request_id ORDER BY sequence) AS before FROM j)
SELECT request_id, sequence, before FROM b WHERE NOT ((before IS NULL AND type = 'enqueued') OR (before = 'enqueued' AND type = 'leased') OR (before IN ('leased', 'renewed') AND type IN ('renewed', 'released', 'handled')) OR (before = 'released' AND type = 'leased')) OR (before = 'handled') OR (before IS NULL AND type <> 'enqueued')""")
def journal_transitions(spark, d):
    return T.transition_faults(journal(table(spark, d, "events"))).select("request_id", "sequence", "before")


OUT = """o AS (SELECT 'https://o' || (user_id % 20) || '.example' AS origin, event_id AS seq, CASE WHEN event_type = 'error' THEN 'request-failed' ELSE 'handled' END AS kind, CAST(floor(value) AS BIGINT) AS latency_ms FROM events)"""


@query(f"WITH {OUT} SELECT origin, count(*) AS requests, count(*) FILTER (kind <> 'handled') AS failures, CAST(floor(sum(latency_ms) / count(*)) AS BIGINT) AS mean_latency_ms, max(latency_ms) AS max_latency_ms FROM o GROUP BY 1")
def origin_stats(spark, d):
    return T.origin_stats(outcomes(table(spark, d, "events")))


@query(f"""WITH {OUT}, l AS (SELECT origin, count(*) AS outcomes, list(CASE WHEN kind = 'handled' THEN CAST(latency_ms AS DOUBLE) ELSE -1 - CAST(latency_ms AS DOUBLE) END ORDER BY seq) AS s FROM o GROUP BY 1)
SELECT origin, outcomes, CAST(list_reduce(s, lambda a, x: CASE WHEN x >= 0 THEN floor(greatest(0.0, least(30000.0, a * (1 - 0.3) + least(30000.0, x) * 0.3)) + 0.5) ELSE greatest(a, least(30000.0, -1 - x), least(30000.0, a * 2)) END, CAST(100.0 AS DOUBLE)) AS BIGINT) AS delay_ms FROM l""")
def throttle_delay(spark, d):
    return T.throttled(outcomes(table(spark, d, "events")))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 7000 ELSE CAST(1000 * pow(2, event_id % 4) AS BIGINT) END END AS delay_ms FROM events""")
def retry_delay(spark, d):
    k = F.col("event_id")
    status = F.when(k % 3 == 0, 503).otherwise(200)
    return table(spark, d, "events").select("event_id", T.retry_delay(status, F.when(k % 2 == 0, "7"), k % 4, F.lit(0)).alias("delay_ms"))


@query("""WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT user_id, count(*) FILTER (n <= 16) AS kept, count(*) FILTER (n > 16) AS dropped, min(event_id) FILTER (n <= 16) AS least_kept_event FROM n GROUP BY 1""")
def event_drop(spark, d):
    return T.dropped_events(table(spark, d, "events"), 16)


@query("""WITH s AS (SELECT ts AS "at", 1 AS v FROM events UNION ALL SELECT ts + INTERVAL 10 MINUTE, -1 FROM events), r AS (SELECT sum(v) OVER (ORDER BY "at", v) AS n FROM s) SELECT CAST(max(n) AS BIGINT) AS peak FROM r""")
def peak_concurrency(spark, d):
    events = table(spark, d, "events").select("ts", (F.col("ts") + F.expr("interval 10 minutes")).alias("until"))
    return T.peak(events, "ts", "until").select(F.col("peak").cast("long").alias("peak"))


@query(f"""WITH {A}, r AS (SELECT CASE WHEN page_id % 4 = 0 THEN 'SCOPE_REJECTED' WHEN page_id % 4 = 1 THEN 'ROBOTS_DISALLOWED' WHEN page_id % 4 = 2 THEN 'DUPLICATE' ELSE 'ASSET_SKIPPED' END AS reason FROM e) SELECT reason, count(*) AS skipped FROM r GROUP BY 1""")
def skip_reasons(spark, d):
    k = F.col("page_id") % 4
    reason = F.when(k == 0, "SCOPE_REJECTED").when(k == 1, "ROBOTS_DISALLOWED").when(k == 2, "DUPLICATE").otherwise("ASSET_SKIPPED")
    return root_relative_links(table(spark, d, "pages")).groupBy(reason.alias("reason")).agg(F.count("*").alias("skipped"))


@query(f"""WITH p AS ({P}), q AS (SELECT page_id, {PATHQ} AS path, regexp_extract(u, '^(https?://[^/?#]+)', 1) AS o FROM p), m AS (SELECT o, min(page_id) % 4 AS k FROM q GROUP BY 1)
SELECT page_id, CASE WHEN k = 0 THEN NOT (path LIKE '/en/%') OR path LIKE '/en/1%' WHEN k = 1 THEN NOT regexp_matches(path, '5$') WHEN k = 2 THEN true ELSE false END AS allowed, CASE WHEN k = 0 THEN 2.5 END AS crawl_delay FROM q JOIN m USING (o)""")
def robots_decisions(spark, d):
    u = U.without_fragment(F.col("url"))
    pages = table(spark, d, "pages").select("page_id", F.regexp_replace(u, r"\?.*$", "").alias("url"))
    k = F.col("least") % 4
    text = F.when(k == 0, "User-agent: *\nDisallow: /en/\nAllow: /en/1\nCrawl-delay: 2.5\n").when(k == 1, "User-agent: other\nDisallow: /\nUser-agent: bot\nDisallow: /*5$\n").when(k == 2, "User-agent: *\nDisallow: /\n")
    status = F.when(k == 2, 404).when(k == 3, 503).otherwise(200)
    robots = pages.groupBy(U.origin(F.col("url")).alias("origin")).agg(F.min("page_id").alias("least")).select("origin", status.alias("status"), text.alias("text"), F.lit(None).cast("string").alias("error"))
    return Sc.robots_decisions(pages, robots, "TestBot").select("page_id", "allowed", "crawl_delay")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS events FROM events GROUP BY ALL")
def event_windows(spark, d):
    """Tumbling windows: additive, the reference has no event time."""
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("events")).select(F.col("w.start").alias("hour"), "event_type", "events")


@query("WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1), c AS (SELECT max(ts) - INTERVAL 1 DAY AS cut FROM events) SELECT user_id, last < cut AS stale FROM l, c")
def stale_workers(spark, d):
    events = table(spark, d, "events")
    last = events.groupBy("user_id").agg(F.max("ts").alias("last"))
    cut = last.agg((F.max("last") - F.expr("interval 1 day")).alias("cut"))
    return last.join(F.broadcast(cut)).select("user_id", (F.col("last") < F.col("cut")).alias("stale"))


@query("""WITH c AS (SELECT user_id % 6 AS run, user_id AS ordinal, count(*) AS entries FROM events GROUP BY 1, 2), b AS (SELECT *, coalesce(sum(entries) OVER (PARTITION BY run ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT run, ordinal, entries, CAST(greatest(0, least(entries, 50 - before)) AS BIGINT) AS taken FROM b""")
def sitemap_entry_cap(spark, d):
    from webloom.operators.sitemaps import running_cap

    counts = table(spark, d, "events").groupBy((F.col("user_id") % 6).alias("run"), F.col("user_id").alias("ordinal")).agg(F.count("*").alias("entries"))
    return running_cap(counts, 50).select("run", "ordinal", "entries", F.col("taken").cast("long").alias("taken"))


@query(f"""WITH p AS ({P}), s AS (SELECT regexp_extract(u, '^(https?://[^/?#]+)', 1) AS key, min(page_id) AS m FROM p GROUP BY 1)
SELECT 'robots' AS entity, key, CASE WHEN m % 4 = 0 THEN 'appeared' WHEN m % 4 = 1 THEN 'disappeared' ELSE 'robots-changed' END AS kind FROM s WHERE m % 4 < 3""")
def diff_robots(spark, d):
    from webloom.operators.diff import compare

    u = U.without_fragment(F.col("url"))
    origins = table(spark, d, "pages").groupBy(U.origin(u).alias("origin")).agg(F.min("page_id").alias("m"))
    rules = origins.withColumn("groups", F.lit(1)).withColumn("sitemaps", F.array(F.lit("a")))
    base, target = rules.where("m % 4 <> 0"), rules.where("m % 4 <> 1").withColumn("groups", F.when(F.col("m") % 4 == 2, 2).otherwise(F.col("groups")))
    return compare(base, target, "robots", "origin", {"robots": F.struct("groups", "sitemaps")})


@query("""SELECT event_id, s BETWEEN 200 AND 399 AS ok, s IN (301, 302, 303, 307, 308) AS redirect, s IN (429, 500, 502, 503, 504) AS retryable FROM (SELECT event_id, list_extract([200, 204, 301, 304, 308, 404, 429, 503], CAST(event_id % 8 + 1 AS BIGINT)) AS s FROM events)""")
def status_predicates(spark, d):
    from webloom.operators import classify as C

    status = F.element_at(F.array(*(F.lit(x) for x in (200, 204, 301, 304, 308, 404, 429, 503))), (F.col("event_id") % 8 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", C.ok(status).alias("ok"), C.is_redirect(status).alias("redirect"), C.is_retryable(status).alias("retryable"))


@query(f"""WITH p AS ({P}), h AS (SELECT page_id, regexp_extract(u, '^https?://([^/?#:]+)', 1) AS h, regexp_extract(u, '^(https?://[^/?#]+)', 1) AS o FROM p)
SELECT page_id, o = 'https://example.com' AS by_origin, h = 'example.com' AS by_host, h = 'example.com' OR h LIKE '%.example.com' AS by_domain FROM h""")
def scope_modes(spark, d):
    u, seed = U.without_fragment(F.col("url")), F.lit("https://example.com/x")
    return table(spark, d, "pages").select("page_id", *(Sc.in_mode(u, seed, m).alias(f"by_{m}") for m in ("origin", "host", "domain")))


@query(f"""WITH {SEEDS} SELECT origin, ordinal, seed_url FROM o""")
def seeds(spark, d):
    return _seeds(table(spark, d, "pages")).select("origin", "ordinal", "seed_url")


@query(f"""WITH {INPUTS}, g AS (SELECT seed_url, url, count(*) OVER (PARTITION BY url) AS c FROM i) SELECT coalesce(seed_url, '-') AS seed_url, count(*) AS discovered, count(DISTINCT url) AS distinct_urls FROM g GROUP BY 1""")
def discovery_counts(spark, d):
    rows = _inputs(spark, d)
    return rows.groupBy(F.coalesce("seed_url", F.lit("-")).alias("seed_url")).agg(F.count("*").alias("discovered"), F.countDistinct("url").alias("distinct_urls"))
