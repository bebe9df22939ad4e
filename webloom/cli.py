"""Command line: list and run queries, check configurations, inspect, validate, compact and compare runs.

Exit codes: 0 done, 1 problems found, 2 wrong usage, 4 failed.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("webloom").getOrCreate()


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="webloom", description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    commands.add_parser("doctor")
    for name, fields in {"query": ["name", "tables"], "config": ["file"], "inspect": ["run"], "validate": ["run"], "abort": ["run"], "audit": ["run"], "compact": ["run", "target"], "export": ["run", "target"], "compare": ["base", "target"]}.items():
        sub = commands.add_parser(name)
        for f in fields:
            sub.add_argument(f)
    try:
        a = parser.parse_args(arguments)
    except SystemExit as e:
        return 2 if e.code else 0
    try:
        return _run(a)
    except (OSError, ValueError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 4


def _run(a: argparse.Namespace) -> int:
    from webloom import config, ops
    from webloom.plans import catalog

    show = lambda x: print(json.dumps(x, indent=1, default=str))
    if a.command == "list":
        print("\n".join(catalog.queries()))
    elif a.command == "doctor":
        show(ops.doctor())
    elif a.command == "config":
        show(config.redact(config.resolve(json.loads(Path(a.file).read_text()))))
    elif a.command == "query":
        if a.name not in catalog.queries():
            print(f"no query {a.name}", file=sys.stderr)
            return 2
        catalog.queries()[a.name](_session(), a.tables).show(50, truncate=80)
    elif a.command == "inspect":
        show(ops.inspect(_session(), a.run))
    elif a.command == "validate":
        problems = ops.validate(_session(), a.run)
        problems.show(50, truncate=False)
        return int(ops.status(problems) != "passed")
    elif a.command == "abort":
        ops.request_abort(a.run)
    elif a.command == "audit":
        found = ops.audit(a.run)
        show(found)
        return int(bool(found))
    elif a.command == "compact":
        ops.compact(_session(), a.run, a.target)
    elif a.command == "export":
        from webloom.sources.runs import read_records, write_ndjson

        show(write_ndjson(read_records(_session(), a.run), a.target))
    elif a.command == "compare":
        from webloom.operators.diff import compare, last_wins
        from webloom.sources.runs import read_records

        sides = [last_wins(read_records(_session(), r, "resource"), ["url"], ["created_at", "record_id"]) for r in (a.base, a.target)]
        changes = compare(*sides, "resource", "url", {"status": "status_code"})
        changes.orderBy("entity", "key", "kind").show(100, truncate=False)
        return int(changes.limit(1).count() > 0)
    return 0


if __name__ == "__main__":
    sys.exit(main())
