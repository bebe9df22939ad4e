"""Streams give what their batch twins give."""

from pyspark.sql import functions as F

from webloom.operators.frontier import throttled as batch_throttled
from webloom.streaming import stateful as S


def run(spark, df, transform, tmp_path, parts=3, mode="update"):
    """Feeds df in ``parts`` micro-batches; returns the rows of all of them in order."""
    source, out = str(tmp_path / "in"), []
    for i in range(parts):
        df.where(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.drop("_part").schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = transform(stream).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "check")).foreachBatch(lambda b, _: out.extend(b.collect())).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return out


def test_throttle(spark, tmp_path):
    df = spark.range(120).select((F.col("id") % 5).cast("string").alias("origin"), F.col("id").alias("seq"), F.when(F.col("id") % 7 == 0, "failed").otherwise("handled").alias("kind"), (F.col("id") * 37 % 400).alias("latency_ms"), F.floor(F.col("id") / 40).cast("int").alias("_part"))
    last = {r.origin: (r.outcomes, r.delay_ms) for r in run(spark, df, S.throttled, tmp_path)}
    assert last == {r.origin: (r.outcomes, r.delay_ms) for r in batch_throttled(df.drop("_part")).collect()}


def test_throttle_vectors(spark):
    df = spark.createDataFrame([("a", 1, "handled", 1000), ("b", 1, "handled", 1000), ("b", 2, "failed", 0)], "origin string, seq long, kind string, latency_ms long")
    assert {r.origin: r.delay_ms for r in batch_throttled(df, smoothing=1.0).collect()} == {"a": 1000, "b": 2000}


def test_permits_and_leases(spark, tmp_path):
    rows = [("o", 1, "w1", "acquire", 0, 0), ("o", 2, "w2", "acquire", 1, 0), ("o", 3, "w3", "acquire", 2, 0), ("o", 4, "w1", "release", 3, 1), ("o", 5, "w3", "acquire", 4, 1), ("o", 6, "w4", "acquire", 70, 2), ("o", 7, "w2", "renew", 71, 2)]
    df = spark.createDataFrame(rows, "origin string, seq long, worker string, action string, at long, _part int")
    got = {r.seq: r.granted for r in run(spark, df, S.permits, tmp_path / "p", mode="append")}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: True, 6: True, 7: False}
    rows = [(1, 1, "enqueued", None, 0), (1, 2, "leased", 9, 0), (2, 1, "leased", 9, 0), (1, 2, "handled", None, 1), (1, 3, "handled", None, 1), (3, 1, "enqueued", None, 2)]
    df = spark.createDataFrame(rows, "request_id long, sequence long, type string, expires_at long, _part int")
    last = {r.request_id: (r.state, r.sequence, r.rejected) for r in run(spark, df, lambda s: S.leases(s, None), tmp_path / "l")}
    assert last == {1: ("terminal", 3, 1), 2: ("unknown", 0, 1), 3: ("pending", 1, 0)}


def test_robots_cache(spark, tmp_path):
    rows = [("o", 1, 0, "A", None, 0), ("o", 2, 10, "B", None, 1), ("o", 3, 200, None, "timeout", 1), ("o", 4, 201, "C", None, 2), ("x", 1, 0, None, "timeout", 0)]
    df = spark.createDataFrame(rows, "origin string, seq long, at long, text string, error string, _part int")
    got = {(r.origin, r.seq): (r.source, r.text) for r in run(spark, df, lambda s: S.robots_cache(s, 100), tmp_path, mode="append")}
    assert got == {("o", 1): ("fetched", "A"), ("o", 2): ("cached", "A"), ("o", 3): ("stale", "A"), ("o", 4): ("fetched", "C"), ("x", 1): ("unavailable", None)}
