"""Spark data sources of run folders: SQLite record tables and frontier journals read by ranges, and evidence written once by digest.

Tasks open the paths themselves (through pyarrow's file systems; SQLite as a local path), so these
are folders that all executors see.  No row passes through the driver.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from webloom.shared import ship_package

COLUMNS = ["kind", "record_id", "request_id", "url", "status_code", "from_url", "to_url", "created_at", "json"]
_SQLITE = "kind string, record_id string, request_id string, url string, status_code int, from_url string, to_url string, created_at string, json string"


def _store(path: str):
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int
    size: int = 0


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.rows = options["path"].removeprefix("file://"), int(options.get("rowsperpartition", 100_000))
        self.kinds: list[str] | None = None

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        """Takes ``kind = value``; Spark applies everything else."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("kind",):
                self.kinds = [f.value]
            else:
                yield f

    def partitions(self) -> list[Range]:
        db = self._open()
        try:
            low, high = db.execute("SELECT min(rowid), max(rowid) FROM crawl_records").fetchone()
        finally:
            db.close()
        return [] if low is None else [Range(self.path, i, min(i + self.rows, high + 1)) for i in range(low, high + 1, self.rows)]

    def read(self, partition: Range | None) -> Iterator[tuple]:
        if partition is None:  # Spark's single partition of an empty table
            return
        db = self._open()
        try:
            sql, values = f"SELECT {', '.join(COLUMNS)} FROM crawl_records WHERE rowid >= ? AND rowid < ?", [partition.begin, partition.end]
            if self.kinds:
                sql, values = f"{sql} AND kind = ?", [*values, *self.kinds]
            yield from db.execute(sql, values)
        finally:
            db.close()


class SqliteRecords(DataSource):
    """``format("webloom-sqlite")``: the record table of a run, a partition for each range of row numbers."""

    @classmethod
    def name(cls) -> str:
        return "webloom-sqlite"

    def schema(self) -> str:
        return _SQLITE

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(self.options)


class _LineReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.bytes = options["path"], int(options.get("bytesperpartition", 64 << 20))

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        store, path = _store(self.path)
        info = store.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else sorted(store.get_file_info(fs.FileSelector(path)), key=lambda f: f.path) if info.type == fs.FileType.Directory else []
        files = [f for f in files if f.type == fs.FileType.File and f.size and not f.base_name.startswith(("_", "."))]
        return [Range(f.path, i, min(i + self.bytes, f.size), f.size) for f in files for i in range(0, f.size, self.bytes)]

    def read(self, partition: Range | None) -> Iterator[tuple]:
        """Lines that begin in the range, the last one read to its end beyond it."""
        if partition is None:
            return
        store, _ = _store(self.path)
        with io.BufferedReader(store.open_input_file(partition.path), 1 << 16) as f:
            at = partition.begin
            if at:
                f.seek(at - 1)
                at += len(f.readline()) - 1
            else:
                f.seek(0)
            while at < partition.end:
                raw = f.readline()
                if not raw:
                    return
                whole = raw.endswith(b"\n")
                yield partition.path, at, raw.rstrip(b"\r\n").decode("utf-8", "replace"), whole
                at += len(raw)


class JournalLines(DataSource):
    """``format("webloom-lines")``: lines of a file or of the files of a folder by byte ranges: path, at (byte), line, whole (ended by a line break)."""

    @classmethod
    def name(cls) -> str:
        return "webloom-lines"

    def schema(self) -> str:
        return "path string, at long, line string, whole boolean"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _LineReader(self.options)


@dataclass
class Written(WriterCommitMessage):
    part: str
    objects: int
    bytes: int
    stored: int


class _EvidenceWriter(DataSourceWriter):
    """Objects are named by their content, so an attempt that runs twice writes the same files.

    First phase: a task puts each object beside its place and moves it there whole, and writes
    its part of the manifest.  Second phase: the driver names the parts of the attempts that
    were committed in ``bundle.json``; parts of others are never read.
    """

    def __init__(self, options: dict):
        self.path, self.compress, self.run_id = options["path"].rstrip("/"), options.get("compress") == "true", options.get("runid", "")

    def write(self, rows: Iterator) -> Written:
        store, root = _store(self.path)
        part, lines, bytes_, stored = f"manifest/part-{uuid.uuid4().hex}.ndjson", {}, 0, 0
        for row in rows:
            content = bytes(row["content"])
            digest = hashlib.sha256(content).hexdigest()
            if digest in lines:
                continue
            name = f"evidence/sha256/{digest[:2]}/{digest}"
            place = f"{name}.gz" if self.compress else name
            data = gzip.compress(content, mtime=0) if self.compress else content
            store.create_dir(f"{root}/{name.rpartition('/')[0]}", recursive=True)
            beside = f"{root}/{name.rpartition('/')[0]}/.{uuid.uuid4().hex}"
            with store.open_output_stream(beside) as f:
                f.write(data)
            store.move(beside, f"{root}/{place}")
            lines[digest] = json.dumps({"sourcePath": name, "bundlePath": place, "sha256": digest, "byteLength": len(content), "storedByteLength": len(data), "contentEncoding": "gzip" if self.compress else "identity"})
            bytes_, stored = bytes_ + len(content), stored + len(data)
        store.create_dir(f"{root}/manifest", recursive=True)
        with store.open_output_stream(f"{root}/{part}") as f:
            f.write("".join(f"{x}\n" for x in lines.values()).encode())
        return Written(part, len(lines), bytes_, stored)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        done = [m for m in messages if m]
        bundle = {"runId": self.run_id, "compressed": self.compress, "objectCount": sum(m.objects for m in done), "totalBytes": sum(m.bytes for m in done), "storedBytes": sum(m.stored for m in done), "parts": sorted(m.part for m in done)}
        with store.open_output_stream(f"{root}/.bundle.json") as f:
            f.write(json.dumps(bundle).encode())
        store.move(f"{root}/.bundle.json", f"{root}/bundle.json")

    def abort(self, messages: list[Written | None]) -> None:
        """Objects may belong to others by now and stay; without ``bundle.json`` nothing refers to them."""


@dataclass
class Folder(InputPartition):
    path: str
    split: int
    splits: int


class _EvidenceReader(DataSourceReader):
    """A partition for each folder of two digits, or several of them by later digits; folders are listed by the tasks."""

    def __init__(self, options: dict):
        self.path, self.splits = options["path"].rstrip("/"), int(options.get("splits", 1))
        self.prefixes = options["prefixes"].split(",") if "prefixes" in options else None

    def partitions(self) -> list[Folder]:
        from pyarrow import fs

        store, root = _store(self.path)
        found = store.get_file_info(fs.FileSelector(f"{root}/evidence/sha256", allow_not_found=True))
        names = sorted(f.path for f in found if f.type == fs.FileType.Directory and (self.prefixes is None or f.base_name in self.prefixes))
        return [Folder(n, i, self.splits) for n in names for i in range(self.splits)]

    def read(self, partition: Folder | None) -> Iterator[tuple]:
        from pyarrow import fs

        if partition is None:
            return
        store, root = _store(self.path)
        for f in store.get_file_info(fs.FileSelector(partition.path)):
            if f.base_name.startswith(".") or int(hashlib.sha256(f.base_name.encode()).hexdigest()[:4], 16) % partition.splits != partition.split:
                continue
            if f.type != fs.FileType.File:
                yield f.path[len(root) + 1 :], f.base_name, None, None
                continue
            with store.open_input_file(f.path) as one:
                stored = one.read()
            content = stored
            if f.base_name.endswith(".gz"):
                try:
                    content = gzip.decompress(stored)
                except (OSError, EOFError):
                    content = None
            yield f.path[len(root) + 1 :], f.base_name.removesuffix(".gz"), len(stored), content


class EvidenceBundle(DataSource):
    """``format("webloom-evidence")``: writes rows of content (binary) as a bundle of objects, and reads the objects of one."""

    @classmethod
    def name(cls) -> str:
        return "webloom-evidence"

    def schema(self) -> str:
        return "path string, name string, stored_bytes long, content binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _EvidenceReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _EvidenceWriter(self.options)


def _registered(spark: SparkSession) -> SparkSession:
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (SqliteRecords, JournalLines, EvidenceBundle):
        spark.dataSource.register(source)
    return spark


def read_sqlite(spark: SparkSession, path: str, kind: str | None = None, rows_per_partition: int = 100_000) -> DataFrame:
    """Index rows of a run's SQLite file, read in ranges of row numbers; a kind is filtered where the rows are read."""
    rows = _registered(spark).read.format("webloom-sqlite").option("path", path).option("rowsperpartition", rows_per_partition).load()
    rows = rows if kind is None else rows.where(F.col("kind") == kind)
    return rows.withColumn("created_at", F.to_timestamp("created_at"))


def read_lines(spark: SparkSession, path: str, bytes_per_partition: int = 64 << 20) -> DataFrame:
    """path, at, line, whole of every line of a file or folder; a missing path is empty."""
    return _registered(spark).read.format("webloom-lines").option("path", path).option("bytesperpartition", bytes_per_partition).load()


def read_journal(spark: SparkSession, path: str, schema: str, bytes_per_partition: int = 64 << 20) -> DataFrame:
    """Records of a frontier journal (JSON lines) in columns of ``schema``, with path, at and malformed.

    Blank lines are skipped.  A last line that was torn while it was written (no line break, not
    a JSON object) is no record; any other line that isn't one is kept as malformed.
    """
    lines = read_lines(spark, path, bytes_per_partition).where(F.trim("line") != "")
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json("line")).startswith("OBJECT"), F.lit(False))
    rows = lines.withColumn("malformed", ~is_object).where(~F.col("malformed") | F.col("whole"))
    return rows.select("path", "at", "malformed", F.from_json(F.when(~F.col("malformed"), F.col("line")), schema).alias("r")).select("path", "at", "malformed", "r.*")


def write_bundle(bodies: DataFrame, folder: str, *, column: str = "content", compress: bool = False, run_id: str = "") -> None:
    """Writes every distinct body once, named by its digest, with a manifest; null bodies have no object."""
    _registered(bodies.sparkSession)
    content = F.col(column).cast("binary")
    rows = bodies.where(content.isNotNull()).select(content.alias("content")).withColumn("_d", F.sha2("content", 256)).dropDuplicates(["_d"]).select("content")
    rows.write.format("webloom-evidence").mode("append").option("path", folder).option("compress", str(compress).lower()).option("runid", run_id).save()


def bundle_summary(spark: SparkSession, folder: str) -> DataFrame:
    """One row: runId, compressed, objectCount, totalBytes, storedBytes, parts."""
    return spark.read.schema("runId string, compressed boolean, objectCount long, totalBytes long, storedBytes long, parts array<string>").json(f"{folder}/bundle.json")


def bundle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The objects that the committed parts of a bundle's manifest list."""
    parts = bundle_summary(spark, folder).first()
    schema = "sourcePath string, bundlePath string, sha256 string, byteLength long, storedByteLength long, contentEncoding string"
    return spark.read.schema(schema).json([f"{folder}/{p}" for p in (parts.parts if parts else [])]) if parts and parts.parts else spark.createDataFrame([], schema)


def stored_objects(spark: SparkSession, folder: str, prefixes: list[str] | None = None, splits: int = 1) -> DataFrame:
    """Objects that lie in a bundle: path (in it), name, stored_bytes, content (inflated; null if it doesn't inflate or is no file).

    ``prefixes``: the first two digits of the digests that are wanted; other folders aren't
    listed.  ``splits``: tasks for each folder.
    """
    rows = _registered(spark).read.format("webloom-evidence").option("path", folder).option("splits", splits)
    return (rows if prefixes is None else rows.option("prefixes", ",".join(prefixes))).load()


def bundle_faults(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with a bundle: path, fault (missing, unlisted, stored length, length, digest, name).  Contents aren't shuffled."""
    listed = bundle_manifest(spark, folder).select(F.col("bundlePath").alias("path"), "sha256", "byteLength", "storedByteLength", "sourcePath")
    there = stored_objects(spark, folder).select("path", "stored_bytes", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("digest"), F.lit(True).alias("there"))
    fault = (
        F.when(F.col("there").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(~F.col("stored_bytes").eqNullSafe(F.col("storedByteLength")), "stored length").when(~F.col("bytes").eqNullSafe(F.col("byteLength")), "length")
        .when(F.col("digest") != F.col("sha256"), "digest").when(F.substring_index("sourcePath", "/", -1) != F.col("sha256"), "name")
    )
    return listed.join(there, "path", "full_outer").select("path", fault.alias("fault")).where("fault is not null")


def read_evidence(spark: SparkSession, folder: str, references: DataFrame) -> DataFrame:
    """digest, content of the stored objects that ``references`` (digest) names; only their folders are listed (256 at most)."""
    wanted = references.select("digest").where(F.col("digest").rlike("^[0-9a-f]{64}$")).distinct()
    prefixes = sorted(r[0] for r in wanted.select(F.substring("digest", 1, 2)).distinct().collect())
    return stored_objects(spark, folder, prefixes).select(F.col("name").alias("digest"), "content").join(wanted, "digest", "left_semi")
