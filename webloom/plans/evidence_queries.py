"""Queries over journals and evidence in files, canonical JSON, and the replay of a whole run."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from webloom import contracts as Ct
from webloom.functions import urls as U
from webloom.operators import canonical as Ca
from webloom.operators import replay as Rp
from webloom.plans.page_queries import P
from webloom.plans.registry import query
from webloom.shared import scratch_dir
from webloom.sources import run_source as Rs
from webloom.sources.tables import table


_TYPES = ["enqueued", "leased", "renewed", "released", "handled"]


@query(f"SELECT conv_id AS request_id, count(*) AS records, max(turn) + 1 AS last, max_by(list_extract({_TYPES}, turn % 5 + 1), turn) AS type FROM conversations GROUP BY 1")
def journal_files(spark, d):
    """Journals, one of every conversation with a record a turn, written as JSON lines and read again in ranges of bytes."""
    path = f"{scratch_dir(spark)}/journal-{uuid.uuid4().hex}"
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("turn") % 5 + 1).cast("int"))
    table(spark, d, "conversations").select(F.to_json(F.struct(F.col("conv_id").alias("request_id"), (F.col("turn") + 1).alias("sequence"), kind.alias("type"), F.lit(0).alias("at")))).write.text(path)
    rows = Rs.read_journal(spark, path, "request_id long, sequence long, type string, at long", bytes_per_partition=1 << 20)
    return rows.where("not malformed").groupBy("request_id").agg(F.count("*").alias("records"), F.max("sequence").alias("last"), F.max_by("type", "sequence").alias("type"))


@query("""WITH o AS (SELECT sha256(text) AS digest, max(conv_id % 3) AS m FROM conversations WHERE role = 'system' AND text IS NOT NULL GROUP BY 1) SELECT 'evidence/sha256/' || substr(digest, 1, 2) || '/' || digest AS path, 'unlisted' AS fault FROM o WHERE m = 0""")
def evidence_bundle(spark, d):
    """The system prompts of all conversations as a bundle, written twice, the second time with fewer: objects that only the first listed lie there unlisted."""
    path = f"{scratch_dir(spark)}/bundle-{uuid.uuid4().hex}"
    prompts = table(spark, d, "conversations").where("role = 'system'")
    Rs.write_bundle(prompts, path, column="text")
    Rs.write_bundle(prompts.where("conv_id % 3 <> 0"), path, column="text")
    return Rs.bundle_faults(spark, path)


@query("""WITH o AS (SELECT doc_id, rtrim(rtrim(printf('%.2f', n_chars / 100), '0'), '.') AS price FROM documents) SELECT doc_id, sha256('{"a":{"x":[null,true],"y":' || doc_id || '},"b":' || price || ',"é":"/\\"1.50"}') AS hash FROM o""")
def stable_hashes(spark, d):
    """Hashes of JSON whose keys, blanks and number forms differ from row to row."""
    key = F.col("doc_id").cast("string")
    price = F.format_string("%.2f", F.col("n_chars") / 100)
    a, b, c = F.concat(F.lit('"a": {"y":'), key, F.when(F.col("doc_id") % 2 == 0, ".0").otherwise(""), F.lit(', "x" : [null, true]}')), F.concat(F.lit('"b":'), price, F.when(F.col("doc_id") % 5 == 0, "000").otherwise("")), F.lit('"\\u00e9":"\\/\\"1.50"')
    text = F.when(F.col("doc_id") % 3 == 0, F.concat_ws(",", a, b, c)).when(F.col("doc_id") % 3 == 1, F.concat_ws(" ,\n", c, a, b)).otherwise(F.concat_ws(",", b, c, a))
    return table(spark, d, "documents").select("doc_id", Ca.canonical_hash(F.concat(F.lit("{"), text, F.lit("}"))).alias("hash"))


@query(f"""WITH p AS ({P}), s AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'html-page' WHEN 1 THEN 'sitemap' ELSE 'feed' END AS kind, page_id // 3 % 7 AS k FROM p)
SELECT page_id AS key, kind, CASE WHEN k = 0 THEN 'missing-evidence' WHEN k = 1 THEN 'corrupt-evidence' WHEN k = 2 THEN 'changed' WHEN k = 3 AND kind <> 'html-page' THEN 'failed' ELSE 'matched' END AS status FROM s""")
def replay_run(spark, d):
    """Pages, sitemaps and feeds of one run extracted again from evidence: some of it gone, altered or broken, some facts saved from other bodies."""
    o, page = U.origin(F.col("url")), F.col("page_id").cast("string")
    space = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    sitemap = F.concat(F.lit(f"<urlset {space}><url><loc>"), o, F.lit("/p"), page, F.lit("</loc><lastmod>2024-01-02</lastmod></url></urlset>"))
    feed = F.concat(F.lit('<rss version="2.0"><channel><item><title>t</title><link>'), o, F.lit("/f"), page, F.lit("</link></item></channel></rss>"))
    kind = F.when(F.col("page_id") % 3 == 0, "html-page").when(F.col("page_id") % 3 == 1, "sitemap").otherwise("feed")
    k = F.floor(F.col("page_id") / 3) % 7
    body = F.when(kind == "html-page", F.col("html")).when(kind == "sitemap", sitemap).otherwise(feed)
    rows = table(spark, d, "pages").select(F.col("page_id").alias("key"), kind.alias("kind"), U.without_fragment(F.col("url")).alias("url"), body.alias("body"), k.alias("k"))
    old = F.when(F.col("k") == 2, F.replace(F.replace("body", F.lit("<title>"), F.lit("<title>old ")), F.lit("/p"), F.lit("/old"))).otherwise(F.col("body"))
    now = F.when((F.col("k") == 3) & (F.col("kind") != "html-page"), F.concat(F.substring("body", 1, 40), F.lit("<!--"), F.col("key").cast("string"))).otherwise(F.col("body"))
    stored = rows.select("key", "kind", "url", "k", old.cast("binary").alias("old"), now.cast("binary").alias("now"), F.sha2(now.cast("binary"), 256).alias("digest"))
    facts = Rp.project(stored.select("key", "kind", "url", F.col("old").alias("content"))).select("key", "facts")
    saved = stored.select("key", "kind", "url", "digest").join(facts, "key")
    evidence = stored.where("k <> 0").select("digest", F.when(F.col("k") == 1, F.concat("now", F.lit(b"!"))).otherwise(F.col("now")).alias("content"))
    return Rp.replay_run(saved, evidence)


_KINDS = ["request", "request-state", "discovery", "resource", "html-page", "xml-resource", "link", "skipped", "error", "robots", "sitemap-entry", "feed-entry", "manifest", "stats", "journal"]
_VALUES = {"string": '"@"', "number": "@", "integer": "@", "boolean": "true", "object": '{"k":@}', "array": "[@,null]", "strings": '["@"]', "texts": '{"k":"@"}', "any": "[]"}


@query(f"""WITH k AS (SELECT doc_id, doc_id % 15 AS i, doc_id // 15 % 8 AS m FROM documents), n AS (SELECT *, list_extract({_KINDS}, (i + 1)::BIGINT) AS kind FROM k)
SELECT doc_id, kind, CASE m WHEN 0 THEN [] WHEN 1 THEN ['missing schemaVersion', 'wrong schema'] WHEN 2 THEN ['unknown more'] WHEN 3 THEN ['wrong schema'] WHEN 4 THEN ['not JSON'] WHEN 5 THEN ['unknown schema']
 WHEN 6 THEN ['missing ' || CASE kind WHEN 'request' THEN 'id' WHEN 'link' THEN 'id' WHEN 'error' THEN 'code' WHEN 'journal' THEN 'type' ELSE 'runId' END] ELSE ['wrong type of ' || CASE kind WHEN 'request' THEN 'id' WHEN 'link' THEN 'id' WHEN 'error' THEN 'code' WHEN 'journal' THEN 'type' ELSE 'runId' END] END AS faults FROM n""")
def kind_contracts(spark, d):
    """Records of every kind, built from the contracts and altered in eight ways, checked as columns."""
    known = Ct.record_contracts()
    key = F.col("doc_id").cast("string")
    way = F.floor(F.col("doc_id") / 15) % 8

    def record(kind):
        fields = known[kind].fields
        first = next(iter(fields))

        def value(name, spec):
            before, found, after = _VALUES[spec.rstrip("?~")].partition("@")
            whole = F.concat(F.lit(f',"{name}":{before}'), key if found else F.lit(""), F.lit(after))
            whole = F.when(F.col("doc_id") % 2 == 0, F.lit(f',"{name}":null')).otherwise(whole) if "?" in spec else whole
            whole = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(whole) if "~" in spec else whole
            return F.when(way == 6, F.lit("")).when(way == 7, F.lit(f',"{name}":7')).otherwise(whole) if name == first else whole

        version = F.when(way == 1, F.lit("")).when(way == 3, F.lit(',"schemaVersion":2')).otherwise(F.lit(',"schemaVersion":1'))
        schema = F.when(way == 5, F.lit('{"schemaId":"other"')).otherwise(F.lit(f'{{"schemaId":"webloom.{kind}"'))
        return F.concat(schema, version, *(value(k, t) for k, t in fields.items()), F.when(way == 2, F.lit(',"more":1')).otherwise(F.lit("")), F.when(way == 4, F.lit("")).otherwise(F.lit("}")))

    i = F.col("doc_id") % 15
    text, kinds = F.lit(None), F.lit(None)
    for n, kind in enumerate(_KINDS):
        text, kinds = F.when(i == n, record(kind)).otherwise(text), F.when(i == n, F.lit(kind)).otherwise(kinds)
    rows = table(spark, d, "documents").select("doc_id", kinds.alias("kind"), text.alias("json"))
    return Ct.checked(rows, "json", known.values()).select("doc_id", "kind", "faults")
