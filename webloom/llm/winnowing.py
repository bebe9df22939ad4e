"""Benchmark decontamination by winnowed word fingerprints (operator 5), in DataFrame functions only.

Every ``window``-word passage holds ``window - gram + 1`` k-grams; both sides keep the
minimum k-gram hash of every such group, so a document and a benchmark item that share a
passage share a kept fingerprint at the same place in it.  Neighbouring windows with one minimum
are one fingerprint, which keeps the range of windows it stands for.  Document fingerprints stream
past the benchmark's, a hit is extended to the windows of its range, and only windows whose words
are equal count.  A text is worked on in blocks of words, so time and memory are linear in
its length.  The benchmark's side is broadcast below a checked size in bytes and shuffled beyond
it, by the same plan.  The texts of documents are read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.shared import written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_array(text: Column) -> Column:
    """Words of a text after A-Z are lower-cased; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), F.lit(WORD), F.lit(0))


def _fingerprinted(frame: DataFrame, words: str, gram: int, group: int) -> DataFrame:
    """Adds ``least``: for each window, the least hash of its ``group`` consecutive k-grams, and
    ``changes``: the windows (from 1) whose minimum is not that of the window before.

    Every step is a column of its own.  Inside a lambda a column is a reference, while a nested
    expression would be evaluated again for each element.
    """

    def starts(c: str, n: int) -> Column:
        return F.when(F.size(c) >= n, F.sequence(F.lit(1), F.size(c) - n + 1)).otherwise(F.array().cast("array<int>"))

    frame = frame.withColumn("_hash", F.transform(words, lambda w: F.xxhash64(w)))
    frame = frame.withColumn("_grams", F.transform(starts("_hash", gram), lambda i: F.xxhash64(*(F.element_at("_hash", i + j) for j in range(gram)))))
    frame = frame.withColumn("least", F.transform(starts("_grams", group), lambda i: F.array_min(F.slice("_grams", i, group))))
    changes = F.filter(starts("least", 1), lambda i: (i == 1) | (F.get("least", i - 1) != F.get("least", i - 2)))
    return frame.withColumn("changes", changes).drop("_hash", "_grams")


#: Words of a text that are worked on together; a longer text is several blocks.
_BLOCK = 128


def _blocks(words: str, window: int) -> Column:
    """(base, part) for every _BLOCK words: the words and those that windows which start in it go on to."""
    last = F.greatest(F.lit(0), F.floor((F.size(words) - 1) / _BLOCK).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.struct((b * _BLOCK).alias("base"), F.slice(words, b * _BLOCK + 1, _BLOCK + window - 1).alias("part")))


def _entries(short: bool) -> Column:
    """(at, upto, print) of each fingerprint of a block, for windows at to upto; with ``short`` also of each word.

    Entry 0 of the first block stands for the document, which so stays in the stream without
    hits; its print is as good as random, so that no join gathers these rows in one task.
    """
    kind = "array<struct<at:int,upto:int,print:long>>"

    def entry(at: Column, upto: Column, mark: Column) -> Column:
        return F.struct(at.alias("at"), upto.alias("upto"), mark.alias("print"))

    head = F.when(F.col("base") == 0, F.array(entry(F.lit(0), F.lit(0), F.col("k1")))).otherwise(F.array().cast(kind))
    runs = F.transform("changes", lambda at, i: entry(at, F.coalesce(F.get("changes", i + 1) - 1, F.size("least")), F.get("least", at - 1)))
    each = F.transform(F.slice("part", 1, _BLOCK), lambda w, i: entry(i + 1, i + 1, F.xxhash64(F.lit("first"), w)))
    return F.concat(head, runs, each) if short else F.concat(head, runs)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, gram: int = 7, percent: int = 5, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Finds the benchmark passages in documents.

    ``docs``: doc_id, text.  ``benchmark``: item_id, text.  More columns are ignored.  A window
    is ``window`` consecutive words of an item (an item with fewer, but not none, is one
    window).  A document word inside an occurrence of a window is hit.  Returns a row per row
    of docs: doc_id, n_words, n_hit, items (ids as strings, sorted), contaminated
    (n_hit > 0 and n_hit is at least ``percent`` of n_words).  Null texts have no words; null
    item ids count as no item but their windows hit; repeated rows each give a row; an empty
    benchmark contaminates nothing.  A very long text is one row until its entries are made,
    in time and memory linear in its words.  ``broadcast_bytes`` changes no result.
    """
    if not 1 <= gram <= window:
        raise ValueError("gram must lie between 1 and window")
    group = window - gram + 1

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), word_array(F.col("text")).alias("words")).where("size(words) > 0")
    length = F.least(F.size("words"), F.lit(window))
    windows = items.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - length + 1), lambda i: F.slice("words", i, length))).alias("passage"))
    windows = windows.groupBy("passage").agg(F.collect_set("item").alias("owners")).withColumn("size", F.size("passage"))
    windows = written(windows, "winnowing-windows")

    weight = 64 + 24 * F.col("size") + F.length(F.array_join("passage", "")) + F.aggregate("owners", F.lit(0), lambda a, x: a + F.length(x) + 24)
    total, short = windows.agg(F.coalesce(F.sum(weight), F.lit(0)), F.coalesce(F.max(F.col("size") < window), F.lit(False))).first()
    fit = F.broadcast if total <= broadcast_bytes else (lambda side: side.hint("merge"))
    prints = _fingerprinted(windows.where(F.col("size") == window), "passage", gram, group).select(F.col("least")[0].alias("print"), "size")
    if short:  # too short for the guarantee: found by their first words
        prints = prints.unionByName(windows.where(F.col("size") < window).select(F.xxhash64(F.lit("first"), F.col("passage")[0]).alias("print"), "size"))

    # Rows are named by their content, which no repeated task changes.
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), word_array(text).alias("words"))
    base = base.withColumn("n_words", F.size("words"))
    key = ["doc_id", "k1", "k2", "n_words"]
    rows = _fingerprinted(base.select(*key, F.inline(_blocks("words", window))), "part", gram, group)
    stream = rows.select(*key, "base", "part", F.inline(_entries(short)))
    skipped = F.col("at") - 1
    if total > broadcast_bytes:  # a shuffled join moves the words of a range and not the block's
        stream = stream.withColumn("part", F.slice("part", F.greatest(F.col("at"), F.lit(1)), F.col("upto") - F.col("at") + window))
        skipped = F.lit(0)
    met = stream.join(fit(prints.distinct()), "print", "left").where("size is not null or at = 0")
    # A hit is extended to every window of its range; ``nth`` counts them from 0.
    met = met.select(*key, "base", "at", "part", "size", skipped.alias("skipped"), F.explode(F.sequence(F.lit(0), F.col("upto") - F.col("at"))).alias("nth"))
    passage = F.when(F.col("at") == 0, F.array(F.col("k2").cast("string"))).otherwise(F.slice("part", F.col("skipped") + F.col("nth") + 1, F.coalesce("size", F.lit(1))))
    met = met.select(*key, F.when(F.col("at") > 0, F.col("base") + F.col("at") + F.col("nth")).otherwise(0).alias("at"), passage.alias("passage"))
    hits = met.join(fit(windows), "passage", "left").where("owners is not null or at = 0")

    spans = F.array_sort(F.filter(F.collect_set(F.struct("at", F.col("size").alias("len"))), lambda s: s["at"] > 0))
    owners = F.when(F.col("at") > 0, F.col("owners"))
    found = hits.groupBy(*key).agg(spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(owners)))).alias("items"), F.count_if(F.col("at") == 0).alias("copies"))
    start = F.struct(F.lit(1).alias("free"), F.lit(0).alias("hit"))
    covered = F.aggregate(
        "spans",
        start,
        lambda acc, s: F.struct(
            F.greatest(acc["free"], s["at"] + s["len"]).alias("free"),
            (acc["hit"] + F.greatest(F.lit(0), s["at"] + s["len"] - F.greatest(acc["free"], s["at"]))).alias("hit"),
        ),
    )["hit"].cast("long")
    out = found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), covered.alias("n_hit"), "items", "copies")
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words")))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies", "copy")


def op5_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 13) AS k, unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2), lambda i: array_to_string(w[i:i + least(len(w), 13) - 1], ' '))) AS p FROM b WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k),
hit AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON bw.k = dw.k AND array_to_string(dw.w[dw.i:dw.i + dw.k - 1], ' ') = bw.p),
pos AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items,
 sha256(coalesce(it.s, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AND 20 * coalesce(pos.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
