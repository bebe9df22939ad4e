import json
import random
import sqlite3

import pytest

from webloom import cli, config, ops
from webloom.operators import scope
from webloom.extensions import Extensions, decide
from webloom.operators.records import CrawlIndex, envelope
from webloom.operators.scope import SITEMAP_FILES, Scope, admit
from webloom.plans.crawl import crawl
from webloom.sources.runs import import_sqlite, open_run, read_ndjson, read_records, write_ndjson, write_records
from pyspark.sql import functions as F


def test_rounds_against_a_simulator(spark):
    pages = {f"http://h/{i}": [f"http://h/{(i * 3 + k) % 40}" for k in range(3)] + ["http://other/", "/x.png", f"/{i}#f"] for i in range(40)}
    rows = [(i, u, "".join(f'<a href="{x}">t</a>' for x in links)) for i, (u, links) in enumerate(pages.items())]
    fetches = spark.createDataFrame(rows, "page_id long, url string, html string")
    seeds = spark.createDataFrame([(0, "http://h/1")], "ordinal int, seed_url string")
    got = crawl(fetches, seeds, Scope(), max_depth=2, run_cap=1000)
    depth, level = {"http://h/1": 0}, ["http://h/1"]
    for d in (1, 2):
        level = [x for u in level for x in pages[u][:3] if depth.setdefault(x, d) == d]
    assert {r.url: r.depth for r in got.requests.collect()} == depth
    assert {r.status for r in got.decisions.collect()} >= {"enqueued", "already_seen", "rejected_scope"}
    assert crawl(fetches, seeds, Scope(), max_depth=5, run_cap=4).requests.count() == 4


def test_robots_and_extensions(spark):
    rows = [(i, f"http://h/{i}", "".join(f'<a href="/{(i * 2 + k) % 12}">t</a>' for k in range(3))) for i in range(12)]
    fetches = spark.createDataFrame(rows, "page_id long, url string, html string")
    seeds = spark.createDataFrame([(0, "http://h/1")], "ordinal int, seed_url string")
    robots = spark.createDataFrame([("http://h", 200, "User-agent: *\nDisallow: /3", None)], "origin string, status int, text string, error string")
    seen = []
    ext = Extensions(before_request=[lambda r: F.when(F.col("url").endswith("/4"), decide("skip", "closed"))], hooks={"onHtmlParsed": lambda t: seen.extend(x.page_id for x in t.select("page_id").collect()), "onRunFinish": lambda r: seen.append("end")})
    got = crawl(fetches, seeds, max_depth=2, robots=robots, extensions=ext)
    assert {tuple(x) for x in got.skipped.collect()} == {("http://h/3", "ROBOTS_DISALLOWED"), ("http://h/4", "closed")}
    assert seen[0] == 1 and seen[-1] == "end" and not {3, 4} & set(seen)


def one_by_one(rows, known, caps, max_depth=3):
    """Decisions taken in order, with counts of what was enqueued."""
    seen = {u for u, _ in known}
    counts = {}

    def keys(url, seed):
        path = url[len("http://h") :]
        return {"seed": seed, "place": (seed, path.rsplit("/", 1)[0]), "shape": (seed, "/".join("\n" if p.isdigit() else p for p in path.split("/")))}

    def add(url, seed):
        for k in keys(url, seed).items():
            counts[k] = counts.get(k, 0) + 1

    for u, s in known:
        add(u, s)
    files, out = 0, {}
    for seq, url, depth, seed, source in sorted(rows):
        full = lambda k: counts.get((k, keys(url, seed)[k]), 0) >= caps[k]  # noqa: B023, E731
        file = source in SITEMAP_FILES
        status = (
            "rejected_scope" if seed is None else "invalid_url" if url is None else "already_seen" if url in seen else "trap_guard" if file and files >= caps["files"] else "queue_limit" if len(seen) >= caps["run"] else "rejected_scope" if not url.startswith("http://h/")
            else "queue_limit" if full("seed") else "trap_guard" if full("place") or full("shape") else "max_depth" if depth > max_depth else "queue_limit" if len(seen) >= caps["queue"] else "enqueued"
        )
        out[seq] = status
        if status == "enqueued":
            seen.add(url)
            add(url, seed)
            files += file
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_admission_one_by_one(spark, seed):
    r = random.Random(seed)
    seeds = ["http://h/", "http://h/s", None]
    rows = [(i, r.choice([None, "http://x/"] + [f"http://h/{r.choice('abc')}/{r.randrange(12)}" for _ in range(12)]), r.choice([0, 1, 9]), r.choice(seeds[:2] * 3 + seeds), r.choice(["html-link", "sitemap-index", "robots-sitemap"])) for i in range(300)]
    known = [("http://h/a/1", "http://h/"), ("http://h/k/1", "http://h/s")]
    schema = "seq long, url string, depth int, seed_url string, source string"
    # The depth-9 sighting leaves no trace: the later one is enqueued.
    first = admit(spark.createDataFrame([(0, "http://h/a", 9, "http://h/", ""), (1, "http://h/a", 1, "http://h/", "")], schema), Scope())
    assert [x.status for x in first.orderBy("seq").collect()] == ["max_depth", "enqueued"]
    caps = {"files": 7, "run": r.choice([15, 100]), "seed": 14, "place": 5, "shape": 6, "queue": r.choice([11, 100])}
    scope = Scope(max_per_directory=caps["place"], max_per_pattern=caps["shape"])
    got = admit(spark.createDataFrame(rows, schema), scope, known=spark.createDataFrame(known, "url string, seed_url string"), max_depth=3, run_cap=caps["run"], seed_cap=caps["seed"], sitemap_cap=caps["files"], queue_cap=caps["queue"])
    assert {x.seq: x.status for x in got.collect()} == one_by_one(rows, known, caps)


def test_admission_of_chains(spark, monkeypatch):
    """Each row of a chain waits for the one before it; the number of written tables doesn't grow with its length."""
    names = []
    keep = scope.written
    monkeypatch.setattr(scope, "written", lambda df, name: names.append(name) or keep(df, name))
    chain = [(i, f"http://h/{i // 2}/n{(i + 1) // 2}", 1, "http://h/", "html-link") for i in range(2000)]
    r = random.Random(5)
    mixed = [(5000 + i, f"http://h/{r.randrange(40)}/n{r.randrange(60)}", r.choice([1, 1, 1, 9]), r.choice(["http://h/", "http://h/s", "http://h/t"]), r.choice(["html-link", "html-link", "sitemap-index"])) for i in range(1500)]
    schema = "seq long, url string, depth int, seed_url string, source string"
    known = [("http://h/3/n9", "http://h/"), ("http://h/1999/n1999", "http://h/t"), ("http://h/5/n5", "http://h/s")]
    frame, old = spark.createDataFrame(chain + mixed, schema), spark.createDataFrame(known, "url string, seed_url string")
    for caps in ({"place": 1, "shape": 1, "seed": 10**6, "files": 10**6, "run": 10**6, "queue": 10**6}, {"place": 2, "shape": 3, "seed": 700, "files": 40, "run": 1900, "queue": 1100}):
        names.clear()
        limits = {"seed_cap": caps["seed"], "sitemap_cap": caps["files"], "run_cap": caps["run"], "queue_cap": caps["queue"]}
        got = admit(frame, Scope(max_per_directory=caps["place"], max_per_pattern=caps["shape"]), known=old, max_depth=3, **limits)
        assert {x.seq: x.status for x in got.collect()} == one_by_one(chain + mixed, known, caps)
        assert len(names) <= 10 and "admission-settled" in names


def test_admission_without_room(spark):
    rows = spark.createDataFrame([(0, "http://h/a", 1, "http://h/", "sitemap-index"), (1, "http://h/b", 1, "http://h/", "x")], "seq long, url string, depth int, seed_url string, source string")
    status = lambda scope=Scope(), **caps: [x.status for x in admit(rows, scope, **caps).orderBy("seq").collect()]  # noqa: B008, E731
    assert status(run_cap=0) == ["queue_limit"] * 2
    assert status(queue_cap=0) == ["queue_limit"] * 2
    assert status(seed_cap=0) == ["queue_limit"] * 2
    assert status(sitemap_cap=0) == ["trap_guard", "enqueued"]
    assert status(Scope(max_per_directory=0)) == ["trap_guard"] * 2
    assert admit(rows.limit(0), Scope()).count() == 0


def records(spark):
    rows = spark.createDataFrame([(1, "http://a/", 200, "html"), (2, "http://b/", 404, "feed")], "id long, url string, status int, resource_type string")
    return envelope(rows, "resource", F.col("id"), url=F.col("url"), status_code=F.col("status"), created_at=F.timestamp_seconds("id"))


def test_run_folders(spark, tmp_path):
    run = str(tmp_path / "run")
    write_records(records(spark), run)
    assert read_records(spark, run, "resource").count() == 2 and open_run(spark, run, "link").count() == 0
    assert write_ndjson(read_records(spark, run), str(tmp_path / "out"))["resource"] == 2
    assert read_ndjson(spark, str(tmp_path / "out"), "resource", "id long, url string").where("id = 2").first().url == "http://b/"
    assert read_ndjson(spark, str(tmp_path / "out"), "link").count() == 0
    assert ops.inspect(spark, run)["records"]["resource"] == 2
    assert ops.status(ops.validate(spark, run)) == "warning"
    ops.compact(spark, run, str(tmp_path / "small"))
    assert read_records(spark, str(tmp_path / "small")).count() == 2
    index = CrawlIndex(read_records(spark, run))
    assert [r.record_id for r in index.query(limit=0).collect()] == ["1"] and index.resources_by_type("feed").count() == 1


def test_sqlite_import(spark, tmp_path):
    path = str(tmp_path / "crawl.sqlite")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE crawl_records (kind, record_id, request_id, url, status_code, from_url, to_url, created_at, json)")
        db.executemany("INSERT INTO crawl_records VALUES (?,?,?,?,?,?,?,?,?)", [("resource", str(i), None, "u", 200, None, None, f"2024-01-0{i}T00:00:00Z", "{}") for i in (2, 1)])
    assert [r.record_id for r in import_sqlite(spark, path).orderBy("created_at").collect()] == ["1", "2"]


def test_config():
    done = config.resolve({"limits": {"maxDepth": 2}, "session": {"bearer": "s", "headers": {"X": "y"}}})
    assert done["limits"]["maxDepth"] == 2 and done["limits"]["maxFetched"] == 1000
    assert config.redact(done)["session"] == {"headers": {"X": "[redacted]"}, "bearer": "[redacted]", "basic": None}
    for bad in ({"x": 1}, {"limits": {"maxDepth": "2"}}, {"limits": {"maxDepth": -1}}, {"scope": {"mode": "all"}}, {"storage": {"renewMs": 60_000}}, {"limits": 3}, {"robots": {"enabled": 1}}):
        with pytest.raises(config.ConfigError):
            config.resolve(bad)
    other = config.resolve({"limits": {"maxDepth": 2}, "network": {"concurrency": 4}, "session": {"bearer": "s", "headers": {"X": "y"}}})
    a, b = config.fingerprints(done), config.fingerprints(other)
    assert a["exact"] != b["exact"] and a["resume"] == b["resume"]


def test_cli(tmp_path, capsys):
    good, bad = tmp_path / "c.json", tmp_path / "d.json"
    good.write_text(json.dumps({"limits": {"maxDepth": 1}}))
    bad.write_text(json.dumps({"limit": 1}))
    assert cli.main(["config", str(good)]) == 0 and cli.main(["config", str(bad)]) == 4 and cli.main(["nothing"]) == 2 and cli.main(["list"]) == 0
    assert "link_edges" in capsys.readouterr().out
    ops.request_abort(str(tmp_path))
    assert ops.abort_requested(str(tmp_path))
    ops.write_private(str(tmp_path / "p"), "x")
    assert (tmp_path / "p").stat().st_mode & 0o777 == 0o600
