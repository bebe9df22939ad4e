"""Compaction of run folders: only small files are rewritten, and readers move from one whole state to the next.

``records/`` holds Parquet files by kind.  Once a folder was compacted, ``current.json`` names a
list of the files that make up its state; without it all files do.  A compaction writes new
files beside the old ones, then a new list, then moves ``current.json`` in one step: whoever
reads meanwhile sees the state before, and one that fails leaves it as it was.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX = "kind string, record_id string, request_id string, url string, status_code int, from_url string, to_url string, created_at timestamp, json string"


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _current(spark: SparkSession, folder: str) -> str | None:
    path, fs = _hadoop(spark, f"{folder}/current.json")
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text)["files"]


def files(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a run's present state: path (below the folder), kind, bytes.  Sizes are listed, nothing is read."""
    named = _current(spark, folder)
    if named:
        return spark.read.schema("path string, kind string, bytes long").parquet(f"{folder}/{named}")
    return _listed(spark, folder, "records")


def _listed(spark: SparkSession, folder: str, part: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{folder}/{part}")
    path = F.regexp_extract("path", f"/({part}/kind=[^/]*/[^/]+)$", 1)
    return found.select(path.alias("path"), F.regexp_extract("path", "/kind=([^/]*)/", 1).alias("kind"), F.col("length").alias("bytes"))


def read(spark: SparkSession, folder: str, kind: str | None = None) -> DataFrame:
    """The records of a run's present state; a kind reads its own files only."""
    if not _current(spark, folder):
        rows = spark.read.schema(INDEX).parquet(f"{folder}/records")
        return rows if kind is None else rows.where(F.col("kind") == kind)
    live = files(spark, folder)
    rows = _of(spark, folder, live if kind is None else live.where(F.col("kind") == kind))
    return rows if kind is None else rows.where(F.col("kind") == kind)


def _of(spark: SparkSession, folder: str, listed: DataFrame) -> DataFrame:
    """The records of listed files.  Their paths pass through the driver, as those of any table do; parts of several folders are joined by name."""
    paths = [r.path for r in listed.select("path").collect()]
    out = None
    for part in sorted({p.split("/")[0] for p in paths}):
        rows = spark.read.schema(INDEX).option("basePath", f"{folder}/{part}").parquet(*(f"{folder}/{p}" for p in paths if p.startswith(f"{part}/")))
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], INDEX) if out is None else out


def compact(spark: SparkSession, folder: str, target_bytes: int = 128 << 20) -> dict:
    """Rewrites the files of less than half of ``target_bytes`` into as many as their bytes fill, sorted by kind and URL.

    A kind with one small file keeps it.  Returns how many files and bytes were rewritten and how
    many files took their place.  Rows are the same before and after; the old files stay until
    ``vacuum``.
    """
    live = files(spark, folder)
    small = live.where(F.col("bytes") < target_bytes / 2)
    packed = [r.asDict() for r in small.groupBy("kind").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes")).where("files > 1").collect()]  # a row a kind
    if not packed:
        return {"files": 0, "bytes": 0, "written": 0}
    chosen = small.where(F.col("kind").isin([p["kind"] for p in packed]))
    part, new = f"records-{uuid.uuid4().hex}", sum(math.ceil(p["bytes"] / target_bytes) for p in packed)
    rows = _of(spark, folder, chosen).repartitionByRange(new, "kind", "url", "record_id").sortWithinPartitions("kind", "url", "record_id")
    rows.write.partitionBy("kind").parquet(f"{folder}/{part}")
    listing = f"files-{uuid.uuid4().hex}"
    written = _listed(spark, folder, part)
    live.join(chosen.select("path"), "path", "left_anti").unionByName(written).write.parquet(f"{folder}/{listing}")
    _swap(spark, folder, listing)
    return {"files": sum(p["files"] for p in packed), "bytes": sum(p["bytes"] for p in packed), "written": written.count()}


def _swap(spark: SparkSession, folder: str, listing: str) -> None:
    jvm = spark.sparkContext._jvm
    beside, fs = _hadoop(spark, f"{folder}/.current-{uuid.uuid4().hex}")
    stream = fs.create(beside)
    stream.write(json.dumps({"files": listing}).encode())
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri() if beside.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(beside), fs.makeQualified(_hadoop(spark, f"{folder}/current.json")[0]), overwrite)


def vacuum(spark: SparkSession, folder: str) -> int:
    """Deletes record files and lists that the present state doesn't name; returns how many record files went."""
    named = _current(spark, folder)
    if not named:
        return 0
    kept = {r.path for r in files(spark, folder).select("path").collect()}
    root, fs = _hadoop(spark, folder)
    gone = 0
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("files-") and name != named:
            fs.delete(status.getPath(), True)
        elif name == "records" or name.startswith("records-"):
            for (path,) in _listed(spark, folder, name).select("path").collect():
                if path not in kept:
                    fs.delete(_hadoop(spark, f"{folder}/{path}")[0], False)
                    gone += 1
    return gone
