"""Record envelope, index queries, statistics, evidence and validation."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.functions import urls as U

# Record kinds.
KINDS = ["request", "request-state", "discovery", "resource", "html-page", "xml-resource", "link", "skipped", "error", "robots", "sitemap-entry", "feed-entry"]
ENVELOPE = ["kind", "record_id", "request_id", "url", "status_code", "from_url", "to_url", "created_at", "json"]


def envelope(rows: DataFrame, kind: str, record_id: Column | None = None, **columns: Column) -> DataFrame:
    """Rows of one kind as index rows; a record without an id of its own is named by its content."""
    payload = F.to_json(F.struct(*rows.columns))
    names = {"request_id": "string", "url": "string", "status_code": "int", "from_url": "string", "to_url": "string", "created_at": "timestamp"}
    own = record_id if record_id is not None else F.sha2(payload.cast("binary"), 256)
    return rows.select(F.lit(kind).alias("kind"), own.cast("string").alias("record_id"), *((columns[n] if n in columns else F.lit(None)).cast(t).alias(n) for n, t in names.items()), payload.alias("json"))


def union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def first_wins(records: DataFrame, order: str = "seq") -> DataFrame:
    """One row per (kind, record_id): the first inserted."""
    nth = F.row_number().over(Window.partitionBy("kind", "record_id").orderBy(order))
    return records.withColumn("_n", nth).where("_n = 1").drop("_n")


class CrawlIndex:
    """Lazy queries over index rows (see ``envelope``)."""

    def __init__(self, records: DataFrame):
        self.records = records

    def _where(self, kind=None, request_id=None, url=None, status_code=None, from_url=None, to_url=None) -> DataFrame:
        out = self.records
        for column, value in (("kind", kind), ("request_id", request_id), ("url", url), ("status_code", status_code), ("from_url", from_url), ("to_url", to_url)):
            if value is not None:
                out = out.where(F.col(column) == value)
        return out

    def query(self, limit: int = 1000, **equal) -> DataFrame:
        """Rows that equal all given values, by time and id; the limit is kept within 1 and 10,000."""
        return self._where(**equal).orderBy("created_at", "record_id").limit(max(1, min(10_000, limit)))

    def count(self, **equal) -> DataFrame:
        return self._where(**equal).agg(F.count("*").alias("records"))

    def resources_by_type(self, resource_type: str, limit: int = 1000) -> DataFrame:
        return self._where(kind="resource").where(F.get_json_object("json", "$.resource_type") == resource_type).orderBy("created_at", "record_id").limit(max(1, min(10_000, limit)))

    def outgoing_links(self, url: str, limit: int = 1000) -> DataFrame:
        return self.query(limit, kind="link", from_url=url)

    def incoming_links(self, url: str, limit: int = 1000) -> DataFrame:
        return self.query(limit, kind="link", to_url=url)

    def counts_by_kind(self) -> DataFrame:
        """Rows of every kind, zero included."""
        kinds = self.records.sparkSession.createDataFrame([(k,) for k in KINDS], "kind string")
        return kinds.join(self.records.groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("records"))


def crawl_stats(fetches: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of run counters."""
    ok = F.col("status").between(200, 399)
    a = fetches.agg(F.count("*").alias("fetched"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.sum("body_bytes").alias("body_bytes"), F.countDistinct(U.origin(F.col("final_url"))).alias("origins"))
    b = edges.agg(F.count("*").alias("links_discovered"), F.countDistinct("to_url").alias("distinct_targets"))
    # Two one-row aggregates meet on a constant.
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k").withColumn("mean_body_bytes", F.when(F.col("fetched") > 0, F.floor(F.col("body_bytes") / F.col("fetched"))).otherwise(0).cast("long"))


#: Counters by table: name, and the condition or sum over the table's rows.
COUNTERS = {
    "requests": {"requestsScheduled": "true", "requestsAttempted": "attempts > 0", "requestsFetched": "state = 'handled'", "requestsTransportFailed": "error = 'transport'", "requestsPolicySkipped": "state = 'skipped'", "requestsCancelled": "state = 'cancelled'", "requestsFailed": "state = 'failed'"},
    "skipped": {"urlsSkipped": "true", "robotsDisallowedUrls": "reason = 'ROBOTS_DISALLOWED'", "scopeRejectedUrls": "reason = 'SCOPE_REJECTED'", "networkSafetyRejectedUrls": "reason = 'NETWORK_SAFETY_REJECTED'"},
    "resources": {"resourcesRecorded": "true", "htmlPagesParsed": "resource_type = 'html'", "xmlResourcesParsed": "resource_type in ('xml', 'sitemap', 'sitemap-index', 'feed')", "sitemapsFetched": "resource_type in ('sitemap', 'sitemap-index')", "feedsFetched": "resource_type = 'feed'", "javascriptResourcesParsed": "resource_type = 'javascript'", "cssStylesheetsParsed": "resource_type = 'css'", "decodeErrors": "replaced", "responseCount": "status is not null"},
    "links": {"linksExtracted": "true", "internalLinksExtracted": "internal", "externalLinksExtracted": "not internal", "javascriptLinksExtracted": "source = 'javascript'", "cssLinksExtracted": "source = 'css'"},
    "entries": {"sitemapEntriesDiscovered": "source = 'sitemap'", "feedEntriesDiscovered": "source = 'feed'", "sitemapFilesDiscovered": "source in ('robots-sitemap', 'sitemap-index')"},
    "redirects": {"redirectsFollowed": "allowed", "redirectsBlocked": "not allowed"},
    "robots": {"robotsFilesFetched": "true"},
    "leases": {"recoveredLeases": "type = 'recovered'", "renewedLeases": "type = 'renewed'", "releasedLeases": "type = 'released'"},
    "errors": {"parserErrors": "code = 'parser'"},
}
SUMS = {"requests": {"retries": "greatest(attempts - 1, 0)"}, "resources": {"bytesDownloaded": "body_bytes", "responseTimeMsTotal": "response_time_ms"}}


def run_counters(tables: dict[str, DataFrame]) -> DataFrame:
    """counter, value: the counters of every table of a run that is given, each table read once."""
    out = []
    for name, rows in tables.items():
        sums = {k: F.coalesce(F.sum(F.expr(e)), F.lit(0)).cast("long") for k, e in SUMS.get(name, {}).items()}
        one = rows.agg(*(F.count_if(F.expr(e)).alias(k) for k, e in COUNTERS[name].items()), *(c.alias(k) for k, c in sums.items()))
        pairs = F.array(*(F.struct(F.lit(k).alias("counter"), F.col(k).alias("value")) for k in one.columns))
        out.append(one.select(F.inline(pairs)))
    return union(*out)


def run_status(fatal: Column, aborted: Column, limited: Column, failed: Column) -> Column:
    return F.when(fatal, "failed").when(aborted, "aborted").when(limited, "stopped_by_limit").when(failed > 0, "partial").otherwise("completed")


def evidence_store(bodies: DataFrame, body: str) -> DataFrame:
    """Content-addressed objects: digest, byte_length, path, references; equal bodies once."""
    raw = F.col(body).cast("binary")
    rows = bodies.where(F.col(body).isNotNull()).select(F.sha2(raw, 256).alias("digest"), F.octet_length(raw).cast("long").alias("byte_length"))
    return rows.groupBy("digest").agg(F.max("byte_length").alias("byte_length"), F.count("*").alias("references")).withColumn("path", F.concat(F.lit("evidence/sha256/"), F.substring("digest", 1, 2), F.lit("/"), F.col("digest")))


def evidence_faults(associations: DataFrame, objects: DataFrame) -> DataFrame:
    """Why an association (request_id, digest, byte_length) isn't backed by its object (digest, content)."""
    stored = objects.select("digest", F.sha2("content", 256).alias("_actual"), F.octet_length("content").cast("long").alias("_size"))
    fault = F.when(~F.col("digest").rlike("^[0-9a-f]{64}$"), "malformed-digest").when(F.col("_actual").isNull(), "missing").when(F.col("_actual") != F.col("digest"), "digest").when(F.col("_size") != F.col("byte_length"), "length")
    return associations.join(stored, "digest", "left").withColumn("fault", fault).where("fault is not null").select("request_id", "digest", "fault")


def unlisted(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files on disk that a bundle's manifest doesn't list."""
    return files.join(manifest.select("path"), "path", "left_anti")


def bundle_totals(objects: DataFrame) -> DataFrame:
    return objects.agg(F.count("*").alias("objects"), F.sum("byte_length").alias("total_bytes"), F.sum(F.col("byte_length") * F.col("references")).alias("referenced_bytes"))


def contract_faults(values: DataFrame, column: str, required: dict[str, str], optional: dict[str, str] | None = None) -> DataFrame:
    """Problems of JSON objects against an exact shape of field types (string, number, integer, boolean, object, array)."""
    optional = optional or {}
    kinds = {"string": str, "number": (int, float), "integer": int, "boolean": bool, "object": dict, "array": list}

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        def check(text: str | None) -> list[str]:
            try:
                value = json.loads(text or "")
            except ValueError:
                return ["not JSON"]
            if not isinstance(value, dict):
                return ["not an object"]
            out = [f"missing {k}" for k in required if k not in value] + [f"unknown {k}" for k in value if k not in required and k not in optional]
            for k, kind in {**required, **optional}.items():
                if k in value and (not isinstance(value[k], kinds[kind]) or isinstance(value[k], bool) != (kind == "boolean")):
                    out.append(f"wrong type of {k}")
            return sorted(out)

        return texts.map(check)

    return values.withColumn("faults", run(F.col(column))).where(F.size("faults") > 0)


def export(records: DataFrame, folder: str) -> DataFrame:
    """Writes one NDJSON folder per kind present; returns rows written per kind."""
    rows = records.select("kind", F.col("json").alias("value"))
    rows.repartition("kind", F.pmod(F.xxhash64("value"), F.lit(64))).write.partitionBy("kind").mode("overwrite").text(folder)
    return records.groupBy("kind").agg(F.count("*").alias("records"))
