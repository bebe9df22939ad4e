"""Run folders: typed Parquet tables per record kind, NDJSON in and out, SQLite read by ranges."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators.records import KINDS
from webloom.sources import compaction
from webloom.sources.run_source import read_sqlite

# File names of record kinds in NDJSON run folders.
FILES = {"request": "requests", "request-state": "request-states", "discovery": "discoveries", "resource": "resources", "html-page": "pages", "xml-resource": "xml", "link": "links", "skipped": "skipped", "error": "errors", "robots": "robots", "sitemap-entry": "sitemaps", "feed-entry": "feeds"}


def write_records(records: DataFrame, folder: str) -> None:
    """Index rows as Parquet, one partition a kind; re-inserted ids are dropped on read (first wins)."""
    records.write.partitionBy("kind").mode("append").parquet(f"{folder}/records")


def read_records(spark: SparkSession, folder: str, kind: str | None = None) -> DataFrame:
    """Index rows; a kind prunes to its own partition."""
    return compaction.read(spark, folder, kind)


def write_ndjson(records: DataFrame, folder: str, kinds: list[str] | None = None) -> dict[str, int]:
    """One NDJSON folder per kind that has rows; returns the counts."""
    counts = {r["kind"]: r["n"] for r in records.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    for kind in kinds or KINDS:
        if counts.get(kind):
            records.where(F.col("kind") == kind).select(F.col("json").alias("value")).write.mode("overwrite").text(f"{folder}/{FILES[kind]}.ndjson")
    return {k: counts.get(k, 0) for k in kinds or KINDS}


def read_ndjson(spark: SparkSession, folder: str, kind: str, schema: str | None = None) -> DataFrame:
    """Records of a kind with a raw line column for those that don't parse; a missing file is empty."""
    path = f"{folder}/{FILES[kind]}.ndjson"
    fields = schema or "url string, schemaId string, schemaVersion int"
    fields += ", _malformed string"
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs):
        return spark.createDataFrame([], fields)
    return spark.read.schema(fields).option("columnNameOfCorruptRecord", "_malformed").json(path)


def import_sqlite(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Index rows of a run's SQLite file, read on the executors in ranges of row numbers (see ``run_source``)."""
    return read_sqlite(spark, path, kind)


def open_run(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Records of a run folder in whichever format it has: Parquet, SQLite or NDJSON."""
    if (Path(folder) / "records").exists():
        return read_records(spark, folder, kind)
    if (Path(folder) / "crawl.sqlite").exists():
        return import_sqlite(spark, str(Path(folder, "crawl.sqlite").resolve()), kind)
    return read_ndjson(spark, folder, kind)


def metadata(folder: str, key: str) -> dict | None:
    path = Path(folder) / f"{key}.json"
    return json.loads(path.read_text()) if path.exists() else None
