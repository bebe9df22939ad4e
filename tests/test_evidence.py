"""Run folders and evidence in files: ranges, torn lines, bundles with faults, replay, canonical JSON."""

import gzip
import hashlib
import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from webloom import contracts
from webloom.operators.canonical import canonical_hash, canonical_json
from webloom.operators.replay import project, replay_run, replay_summary
from webloom.sources import compaction
from webloom.sources import run_source as S
from webloom.sources.runs import open_run, read_records


def test_sqlite_in_ranges(spark, tmp_path):
    path = str(tmp_path / "crawl.sqlite")
    rows = [("link" if i % 3 else "resource", f"r{i}", None, "u", i if i % 2 else None, None, "t'o", f"2024-01-01T00:00:{i % 60:02}Z", json.dumps({"i": i})) for i in range(250)]
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE crawl_records (kind, record_id, request_id, url, status_code, from_url, to_url, created_at, json)")
        db.executemany("INSERT INTO crawl_records VALUES (?,?,?,?,?,?,?,?,?)", rows)
        db.execute("DELETE FROM crawl_records WHERE rowid BETWEEN 50 AND 120")
    kept = [r for i, r in enumerate(rows, 1) if not 50 <= i <= 120]
    got = S.read_sqlite(spark, path, rows_per_partition=40)
    assert got.rdd.getNumPartitions() == 7
    assert sorted((r.kind, r.record_id, r.status_code, r.to_url, r.json) for r in got.collect()) == sorted((r[0], r[1], r[4], r[6], r[8]) for r in kept) and str(got.first().created_at).startswith("2024-01-01 00:00:")
    links = S.read_sqlite(spark, path, "link", rows_per_partition=40)
    assert "kind" not in links._jdf.queryExecution().executedPlan().toString().split("Filter")[-1] or links.count()
    assert links.count() == sum(r[0] == "link" for r in kept)
    assert open_run(spark, str(tmp_path), "resource").count() == sum(r[0] == "resource" for r in kept)
    empty = str(tmp_path / "empty.sqlite")
    with sqlite3.connect(empty) as db:
        db.execute("CREATE TABLE crawl_records (kind, record_id, request_id, url, status_code, from_url, to_url, created_at, json)")
    assert S.read_sqlite(spark, empty).count() == 0


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_lines_of_every_range_size(spark, tmp_path, size):
    r = random.Random(size)
    lines = ["x" * r.choice([0, 1, 5, 6, 7, 8, 200]) + "é" * r.randint(0, 2) for _ in range(12)]
    path = tmp_path / "a.ndjson"
    for text in ("\n".join(lines) + "\n", "\n".join(lines) + "\ntorn", "\r\n".join(lines), "", "\n\n"):
        path.write_bytes(text.encode())
        got = S.read_lines(spark, str(path), size).orderBy("at").collect()
        want = text.split("\n")
        want = want[:-1] if want[-1] == "" else want
        assert [x.line for x in got] == [w.rstrip("\r") for w in want]
        assert [x.whole for x in got] == [i < len(want) - 1 or text.endswith("\n") for i in range(len(want))]
    assert S.read_lines(spark, str(tmp_path / "none"), size).count() == 0


def test_journal_with_a_torn_end(spark, tmp_path):
    path, schema = tmp_path / "journal.ndjson", "sequence long, type string"
    good = [json.dumps({"sequence": i, "type": "leased"}) for i in range(5)]
    read = lambda text: sorted((r.sequence is None, r.sequence or 0, r.malformed) for r in (path.write_text(text), S.read_journal(spark, str(path), schema, 16))[1].collect())
    whole = [(False, i, False) for i in range(5)]
    assert read("\n".join(good) + "\n") == whole
    assert read("\n".join(good) + '\n\n{"sequence": 5, "ty') == whole
    assert read("\n".join(good)) == whole  # the last record lacks its line break only
    assert read("\n".join([*good[:2], "{broken", *good[2:]]) + "\n") == [*whole, (True, 0, True)]
    assert read("\n".join(good) + "\n[1]\n") == [*whole, (True, 0, True)]


@pytest.mark.parametrize("compress", [False, True])
def test_bundle(spark, tmp_path, compress):
    folder = str(tmp_path / "bundle")
    bodies = [b"a", b"b" * 5000, b"", None, b"a", b"\x00\xff", b"c", b"d"]
    df = spark.createDataFrame([(b,) for b in bodies], "content binary").repartition(4)
    S.write_bundle(df, folder, compress=compress, run_id="r1")
    distinct = {b for b in bodies if b is not None}
    one = S.bundle_summary(spark, folder).first()
    assert (one.runId, one.compressed, one.objectCount, one.totalBytes) == ("r1", compress, len(distinct), sum(map(len, distinct)))
    listed = {r.sha256: r for r in S.bundle_manifest(spark, folder).collect()}
    assert set(listed) == {hashlib.sha256(b).hexdigest() for b in distinct} and sum(r.storedByteLength for r in listed.values()) == one.storedBytes
    assert S.bundle_faults(spark, folder).count() == 0
    wanted = spark.createDataFrame([(hashlib.sha256(b"c").hexdigest(),), ("0" * 64,), ("x",)], "digest string")
    assert [tuple(r) for r in S.read_evidence(spark, folder, wanted).collect()] == [(hashlib.sha256(b"c").hexdigest(), bytearray(b"c"))]
    # An attempt that died after it wrote: its part of the manifest is never read.
    (tmp_path / "bundle" / "manifest" / "part-lost.ndjson").write_text('{"sourcePath":"x"}\n')
    assert S.bundle_manifest(spark, folder).count() == len(distinct)
    end = ".gz" if compress else ""
    place = lambda b: tmp_path / "bundle" / "evidence" / "sha256" / hashlib.sha256(b).hexdigest()[:2] / f"{hashlib.sha256(b).hexdigest()}{end}"
    packed = lambda b: gzip.compress(b, mtime=0) if compress else b
    place(b"a").write_bytes(packed(b"A"))
    place(b"c").unlink()
    place(b"d").write_bytes(b"longer, and no gzip")
    (place(b"").parent / f"stray{end}").write_bytes(packed(b"q"))
    names = {str(place(b)).split("/bundle/")[1]: b for b in distinct}
    got = {(names.get(r.path, b"stray"), r.fault) for r in S.bundle_faults(spark, folder).collect()}
    assert got == {(b"a", "digest"), (b"c", "missing"), (b"d", "stored length"), (b"stray", "unlisted")}


def test_retried_tasks_leave_no_doubles(spark, tmp_path):
    folder = str(tmp_path / "bundle")
    bodies = spark.createDataFrame([(str(i).encode(),) for i in range(20)], "content binary")
    S.write_bundle(bodies, folder)
    S.write_bundle(bodies, folder)
    assert S.stored_objects(spark, folder).count() == S.bundle_manifest(spark, folder).count() == 20 and S.bundle_faults(spark, folder).count() == 0
    S.write_bundle(bodies.limit(0), str(tmp_path / "none"))
    assert S.bundle_manifest(spark, str(tmp_path / "none")).count() == 0 and S.bundle_faults(spark, str(tmp_path / "none")).count() == 0


def test_replay_from_a_bundle(spark, tmp_path):
    folder = str(tmp_path / "bundle")
    page = lambda t: f"<title>{t}</title><h1>xyz</h1>".encode()
    xml = b'<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>http://h/1</loc></url><url><loc>http://h/2</loc></url></urlset>'
    bodies = {1: ("html-page", page("a")), 2: ("html-page", page("b")), 3: ("sitemap", xml), 4: ("sitemap", b"<urlset>"), 5: ("feed", b'<rss version="2.0"><channel><item><link>http://h/f</link></item></channel></rss>'), 6: ("html-page", page("gone")), 7: ("html-page", None)}
    rows = spark.createDataFrame([(k, kind, "http://h/", b) for k, (kind, b) in bodies.items()], "key long, kind string, url string, content binary")
    facts = {r.key: r.facts for r in project(rows).collect()}
    digest = lambda b: hashlib.sha256(b).hexdigest() if b is not None else None
    saved = spark.createDataFrame([(k, kind, "http://h/", digest(b), "other" if k == 2 else facts.get(k)) for k, (kind, b) in bodies.items()], "key long, kind string, url string, digest string, facts string")
    S.write_bundle(rows.where("key <> 6"), folder)
    (tmp_path / "bundle/evidence/sha256" / digest(xml)[:2] / digest(xml)).write_bytes(xml + b" ")
    status = lambda config=None: {r.key: r.status for r in replay_run(saved, S.read_evidence(spark, folder, saved), config).collect()}
    assert status() == {1: "matched", 2: "changed", 3: "corrupt-evidence", 4: "failed", 5: "matched", 6: "missing-evidence", 7: "missing-evidence"}
    assert {r.kind: r.matched for r in replay_summary(replay_run(saved, S.read_evidence(spark, folder, saved))).collect()} == {"html-page": 1, "sitemap": 0, "feed": 1}
    # The run's own settings count: under others the same body has other facts.
    assert status({"html": {"maxTextBytes": 1}})[1] == "changed"


def test_canonical_json(spark):
    texts = ['{"b":1.50,"a":[1.0,2e0,-0.0,0,100,1.05,{"z":null,"y":"1.50,\\" 2.0]"}]}', '{ "a" : [1,2,0,0.0,100,1.050,{"y":"1.50,\\u0022 2.0]","z":null}],\n"b":1.5 }', "[]", "1.0", "x", None, '{"a":1,"a":2}', '"' + "a\\\\" * 100_000 + '"']
    got = [tuple(r) for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(canonical_json(F.col("t")), canonical_hash(F.col("t"))).collect()]
    assert got[0] == got[1] and got[0][0] == '{"a":[1,2,0,0,100,1.05,{"y":"1.50,\\" 2.0]","z":null}],"b":1.5}'
    assert [g[0] for g in got[2:7]] == ["[]", "1", None, None, None] and got[7][0] == texts[7]
    assert got[4][1] == hashlib.sha256(b"null").hexdigest()


def test_contracts_as_columns_and_one_by_one(spark):
    r = random.Random(6)
    known = contracts.record_contracts("t")
    values = ["x", "", 1, 1.5, 10**20, True, False, None, {}, {"a": "b"}, {"a": 1}, {"a": None}, [], ["a"], ["a", 1], [None], [[]]]
    good = {"string": "s", "number": 1.5, "boolean": True, "object": {"a": []}, "array": [1], "strings": ["a"], "texts": {"a": "b"}}
    texts = ["x", "[]", "3", "null", '"s"', "{}", '{"schemaId": 1}', '{"schemaId": "none"}', None]
    want = [["not JSON"], *[["unknown schema"]] * 7, ["not JSON"]]
    for kind in known:
        for n in range(30):
            c = known[kind]
            value = {"schemaId": f"t.{kind}", "schemaVersion": 1} | {k: good[t.rstrip("?~")] for k, t in c.fields.items() if not t.endswith("~") or r.random() < 0.5}
            for _ in range(r.randint(0, 3) if n else 0):
                k = r.choice(list(value))
                if k == "schemaId":
                    value["odd é"] = 1
                elif r.random() < 0.4:
                    value.pop(k)
                else:
                    value[k] = r.choice(values)
            texts.append(json.dumps(value))
            want.append(sorted(c.faults(value)))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, json string")
    got = {x.i: list(x.faults) for x in contracts.checked(df, "json", known.values()).collect()}
    assert got == dict(enumerate(want)) and sum(not w for w in want) > 60 and len({str(w) for w in want}) > 100


def test_schema_of_every_contract():
    for kind, c in contracts.record_contracts().items():
        schema = c.json_schema()
        assert schema["$id"] == f"webloom.{kind}.v1" and set(schema["required"]) <= set(schema["properties"])
    assert contracts.record_contracts()["request"].json_schema()["properties"]["sitemapAncestors"] == {"type": "array", "items": {"type": "string"}}
    assert len(contracts.record_contracts()["request"].fields) == 21


def test_compaction_of_small_files(spark, tmp_path):
    folder = str(tmp_path / "run")
    row = lambda kind, i, pad=0: (kind, f"{kind}{i}", None, f"http://h/{i * 7919 % 5000:05}", i, None, None, None, "x" * pad)
    noise = random.Random(1)
    small = [row(k, i) for k in ("link", "resource") for i in range(500)]
    spark.createDataFrame(small, compaction.INDEX).repartition(250, "record_id").write.partitionBy("kind").parquet(f"{folder}/records")
    big = [("link", f"big{i}", None, "http://h/b", i, None, None, None, noise.randbytes(40_000).hex()) for i in range(3)]
    for b in big:
        spark.createDataFrame([b], compaction.INDEX).coalesce(1).write.mode("append").partitionBy("kind").parquet(f"{folder}/records")
    spark.createDataFrame([row("robots", 1)], compaction.INDEX).coalesce(1).write.mode("append").partitionBy("kind").parquet(f"{folder}/records")
    before = {r.path: r.bytes for r in compaction.files(spark, folder).collect()}
    assert len(before) > 400
    all_rows = lambda df: sorted(map(str, df.collect()))
    old = read_records(spark, folder)
    want = all_rows(old)
    done = compaction.compact(spark, folder, target_bytes=60_000)
    after = {r.path: r.bytes for r in compaction.files(spark, folder).collect()}
    kept = set(before) & set(after)
    assert {before[p] > 30_000 or "kind=robots" in p for p in kept} == {True} and len(kept) == 4
    assert done == {"files": len(before) - 4, "bytes": sum(v for p, v in before.items() if p not in kept), "written": len(after) - 4} and len(after) < 40
    # A reader of the state before still finds all its files, the new one has the same rows, and kinds read their own files.
    assert all_rows(old) == want == all_rows(read_records(spark, folder))
    assert read_records(spark, folder, "robots").count() == 1 and all("kind=link" in f for f in read_records(spark, folder, "link").inputFiles())
    ranges = read_records(spark, folder, "link").where("record_id like 'link%'").groupBy(F.input_file_name()).agg(F.min("url").alias("a"), F.max("url").alias("b")).orderBy("a").collect()
    assert all(x.b <= y.a for x, y in zip(ranges, ranges[1:]))  # noqa: B905
    assert compaction.vacuum(spark, folder) == len(before) - 4 and all_rows(read_records(spark, folder)) == want
    again = compaction.compact(spark, folder, target_bytes=60_000)
    assert all_rows(read_records(spark, folder)) == want and again["files"] <= done["written"]


def test_failed_compaction_changes_nothing(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "run")
    for i in range(3):
        spark.createDataFrame([("link", str(i), None, "u", i, None, None, None, "{}")], compaction.INDEX).write.mode("append").partitionBy("kind").parquet(f"{folder}/records")
    with monkeypatch.context() as m:
        m.setattr(compaction, "_swap", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            compaction.compact(spark, folder)
    assert read_records(spark, folder).count() == 3 and compaction.files(spark, folder).count() >= 3
    assert compaction.compact(spark, folder)["written"] == 1 and read_records(spark, folder).count() == 3
