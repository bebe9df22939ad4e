"""Session-level helpers: shared scratch tables and package delivery to workers."""

from __future__ import annotations

import contextlib
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, which a cluster must name.

    Only where all tasks run in the driver's process may a temporary folder stand for it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.gettempdir()}/webloom-scratch"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


@contextlib.contextmanager
def _shuffles_end_with_query(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, None)
    with contextlib.suppress(Exception):
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with contextlib.suppress(Exception):
            if before is None:
                spark.conf.unset(_CLEANUP)
            else:
                spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as a Parquet table in the shared scratch folder and reads it back.

    The write is Spark's own commit protocol, so a lost executor only repeats its tasks.
    Shuffle files of the finished query are dropped at once.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    with _shuffles_end_with_query(spark):
        df.write.parquet(path)
    del df
    gc.collect()
    out = spark.read.schema(schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that no plan reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of ``rows`` rows for what is written meanwhile, where a row is large."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable on executors, whatever their PYTHONPATH is.

    Rows here are whole texts, so Arrow batches of Spark's default of 10,000 rows would take
    much memory off the heap; the default, and no other setting, is lowered.
    """
    if spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, "1000")
    sc = spark.sparkContext
    if getattr(sc, "_webloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="webloom-")
    target = os.path.join(folder, "webloom_package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"webloom/{p.relative_to(root)}")
    sc.addPyFile(target)
    sc._webloom_shipped = True
