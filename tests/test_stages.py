"""Extension points, contracts, reports, and long or empty inputs of the stages."""

import json

import pytest
from pyspark.sql import functions as F

from webloom import contracts
from webloom.extensions import HOOKS, ExtensionFailure, Extensions, RunAborted, decide
from webloom.operators import diff, policy, resources


def test_hooks_and_failure_modes():
    seen = []
    ext = Extensions(hooks={h: lambda *a, h=h: seen.append(h) for h in HOOKS})
    for h in HOOKS:
        ext.call(h, "run")
    assert seen == HOOKS
    broken = {"onEvent": lambda *a: 1 / 0}
    quiet = Extensions(hooks=broken)
    quiet.call("onEvent", scope="request")
    assert quiet.errors[0]["code"] == "EXTENSION_ERROR" and not quiet.errors[0]["fatal"]
    loud = Extensions(hooks=broken, failure_mode="fail-request")
    with pytest.raises(ExtensionFailure):
        loud.call("onEvent")
    assert loud.errors[0]["fatal"]
    for bad in ({"failure_mode": "x"}, {"hooks": {"onX": print}}):
        with pytest.raises(ValueError):
            Extensions(**bad)
    with pytest.raises(TypeError):
        Extensions(event_buffer=0)


def test_middlewares(spark):
    rows = spark.range(4)
    ext = Extensions(after_resource=[lambda r: F.when(F.col("id") == 1, decide("skip-processing", "old")), lambda r: F.when(F.col("id") == 2, decide("abort", "enough"))])
    decided = ext.apply(rows, "after_resource")
    assert {r.id: r.decision for r in decided.collect()} == {0: "continue", 1: "skip-processing", 2: "abort", 3: "continue"}
    with pytest.raises(RunAborted):
        ext.outcome(decided)
    assert [r.id for r in ext.outcome(decided.where("id <> 2")).orderBy("id").collect()] == [0, 3]
    assert Extensions().apply(rows, "before_request").where("decision = 'continue' and delay_ms = 0").count() == 4


def test_contracts():
    c = contracts.Contract("example.a", 1, {"n": "integer", "s": "string?"})
    assert c.faults({"schemaId": "example.a", "schemaVersion": 1, "n": 1, "s": None}) == []
    assert c.faults({"schemaId": "example.a", "schemaVersion": 1, "n": True}) == ["missing s", "wrong type of n"]
    schema = c.json_schema()
    assert schema["properties"]["s"] == {"type": ["string", "null"]} and schema["required"] == ["schemaId", "schemaVersion", "n", "s"] and schema["additionalProperties"] is False
    with pytest.raises(ValueError):
        contracts.lookup([c, c])


def test_redirects(spark):
    responses = spark.createDataFrame([("a", 301, "b"), ("b", 302, "c"), ("c", 200, None), ("l", 301, "l"), ("x", 308, "no"), ("m", 301, None)], "url string, status int, location string")
    starts = spark.createDataFrame([(1, "a"), (2, "l"), (3, "x"), (4, "gone"), (5, "m")], "request_id long, url string")
    hops, ends = policy.follow_redirects(starts, responses, target_allowed=lambda u: u != "no")
    assert {(r.request_id, r.final_url, r.status, r.hops, r.error) for r in ends.collect()} == {(1, "c", 200, 2, None), (2, "l", 301, 1, "REDIRECT_LOOP"), (3, "no", 308, 1, "REDIRECT_TARGET_REJECTED"), (4, "gone", None, 0, None), (5, "m", 301, 0, None)}
    assert [tuple(r) for r in hops.where("request_id = 1").orderBy("hop_index").select("hop_index", "from_url", "to_url").collect()] == [(0, "a", "b"), (1, "b", "c")]
    _, few = policy.follow_redirects(starts, responses, max_hops=1)
    assert few.where("request_id = 1").first().error == "TOO_MANY_REDIRECTS"
    assert policy.follow_redirects(starts.limit(0), responses)[1].count() == 0


def test_preparation_of_compressed_and_broken_bodies(spark):
    import gzip

    xml = b"<urlset/>"
    rows = [(1, "http://h/s.xml.gz", gzip.compress(xml)), (2, "http://h/t.xml.gz", gzip.compress(xml)[:-6]), (3, "http://h/u.xml.gz", gzip.compress(b"x" * 5000)), (4, "http://h/e", b""), (5, None, None)]
    df = spark.createDataFrame([(i, u, u, 200, None, b) for i, u, b in rows], "request_id long, requested_url string, final_url string, status int, content_type string, body binary")
    got = {r.request_id: r for r in resources.prepare(df, max_bytes=1000).collect()}
    assert (got[1].resource_type, got[1].text, got[1].inflated_bytes, got[1].ok) == ("sitemap", xml.decode(), 9, True)
    assert got[2].error and got[3].error and not got[2].ok and got[3].raw_sha256 is None
    assert got[4].resource_type == "empty" and got[5].text is None
    assert {k: v.count() for k, v in resources.route(resources.prepare(df, max_bytes=1000)).items()} == {"html": 0, "xml": 1, "javascript": 0, "css": 0}


def test_report_files(spark, tmp_path):
    changes = spark.createDataFrame([("2", "link", "link-added", "k"), ("1", "html-page", "title-changed", "k")], "id string, entity string, kind string, key string")
    diff.write_report(changes, str(tmp_path / "r"))
    lines = [json.loads(x) for f in sorted((tmp_path / "r" / "changes").glob("*.json")) for x in f.read_text().splitlines()]
    assert [x["entity"] for x in lines] == ["html-page", "link"]
    assert spark.read.json(str(tmp_path / "r" / "summary")).first().modified == 1
