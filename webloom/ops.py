"""Tools over run folders: inspection, validation, abort marks, audit, compaction."""

from __future__ import annotations

import json
import os
import platform
import stat
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators.records import CrawlIndex
from webloom.sources.runs import metadata, read_records


def inspect(spark: SparkSession, folder: str) -> dict:
    """Rows of every kind and the files of a run."""
    counts = {r["kind"]: r["records"] for r in CrawlIndex(read_records(spark, folder)).counts_by_kind().collect()}
    files = sorted(str(p.relative_to(folder)) for p in Path(folder).rglob("*") if p.is_file())
    return {"records": counts, "files": files, "manifest": metadata(folder, "manifest")}


def validate(spark: SparkSession, folder: str) -> DataFrame:
    """Problems of a run's records: severity, kind, record_id, problem."""
    rows = read_records(spark, folder)
    broken = F.try_parse_json("json").isNull()
    problem = F.when(broken, "not JSON").when(F.col("record_id").isNull(), "no id").when((F.col("kind") == "link") & (F.col("from_url").isNull() | F.col("to_url").isNull()), "link without ends")
    found = rows.withColumn("problem", problem).where("problem is not null").select(F.lit("error").alias("severity"), "kind", "record_id", "problem")
    if metadata(folder, "manifest") is None:
        found = found.unionByName(spark.createDataFrame([("warning", None, None, "no manifest")], found.schema))
    return found


def status(problems: DataFrame) -> str:
    kinds = {r["severity"] for r in problems.select("severity").distinct().collect()}
    return "failed" if "error" in kinds else "warning" if kinds else "passed"


def request_abort(folder: str) -> None:
    Path(folder, "abort.json").write_text(json.dumps({"requestedAt": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}))


def abort_requested(folder: str) -> bool:
    return Path(folder, "abort.json").exists()


def compact(spark: SparkSession, folder: str, target: str, rows_per_file: int = 1_000_000) -> None:
    """Rewrites a run's records into another folder, in ranges of kind and URL, one row an id (see ``sources.compaction`` for a run's own folder)."""
    rows = read_records(spark, folder).dropDuplicates(["kind", "record_id"])
    rows.orderBy("kind", "url").write.option("maxRecordsPerFile", rows_per_file).partitionBy("kind").mode("overwrite").parquet(f"{target}/records")


def audit(folder: str) -> list[dict]:
    """Files of a run that are links or that others may read or write."""
    out = []
    for p in Path(folder).rglob("*"):
        mode = p.lstat().st_mode
        if stat.S_ISLNK(mode):
            out.append({"path": str(p), "problem": "symbolic link"})
        elif p.is_file() and mode & 0o022:
            out.append({"path": str(p), "problem": "writable by others"})
    return sorted(out, key=lambda x: x["path"])


def doctor() -> dict:
    import pyspark

    return {"python": sys.version.split()[0], "pyspark": pyspark.__version__, "platform": platform.system(), "java": bool(os.environ.get("JAVA_HOME")) or None}


def write_private(path: str, text: str) -> None:
    """Writes a file for its owner alone, whole or not at all."""
    temporary = f"{path}.{os.getpid()}.tmp"
    with os.fdopen(os.open(temporary, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w") as f:
        f.write(text)
    os.replace(temporary, path)
