"""Resampling of a corpus towards a target's distribution of n-grams (operator 12).

Words of an Arrow batch become integers; a suffix array of them, ordered as deep as the longest
feature, puts equal n-grams beside each other.  Runs of neighbours whose common prefix (LCP)
has k words or more are the distinct k-grams of the batch: each is hashed once, and its bucket
goes back to all its occurrences.  Bucket counts of both corpora give a gain a bucket, and
every document gets the mean gain of its features and a Gumbel key of its id, so that the
largest sums are a weighted sample without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.shared import ship_package, written

#: 0 parts words; A-Z are lowered; digits, a-z and bytes beyond ASCII stay.
_FOLD = np.array([(c + 32 if 65 <= c <= 90 else c) if c > 127 or chr(c).isalnum() else 0 for c in range(256)], np.uint8)
#: Documents of a batch are taken in slices of about so many bytes; a longer one is alone.
_SLICE = 8 << 20
#: Scores this near are counted together first when places are added up.
_STEP = 1024


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order (as binary) and the text of each."""
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    low = _FOLD[raw]
    word = low != 0
    first = word.copy()
    first[1:] &= ~word[:-1]
    heads = ends[:-1][ends[:-1] < ends[1:]]
    first[heads] = word[heads]
    starts = np.flatnonzero(first)
    cuts = np.append(np.cumsum(word)[starts] - 1, word.sum()).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(low[word].tobytes())])
    return words, np.searchsorted(ends, starts, side="right") - 1


def suffix_array(ids: np.ndarray, owner: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes ordered by their first ``depth`` words: (order, lcp with the one before, number of words up to the text's end).

    Both numbers end at ``depth``; a prefix never leaves its text.
    """
    n = len(ids)
    columns = np.full((depth, n), -1, np.int64)
    for k in range(min(depth, n)):
        inside = owner[k:] == owner[: n - k]
        columns[k, : n - k][inside] = ids[k:][inside]
    order = np.argsort(columns[depth - 1], kind="stable")
    for k in range(depth - 2, -1, -1):
        order = order[np.argsort(columns[k][order], kind="stable")]
    lcp, same = np.zeros(n, np.int64), np.ones(max(n - 1, 0), bool)
    for column in columns:
        c = column[order]
        same &= (c[1:] == c[:-1]) & (c[1:] >= 0)
        lcp[1:] += same
    return order, lcp, (columns >= 0).sum(axis=0)


def features(texts: pa.Array, low: int, high: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of every occurrence of every run of ``low`` to ``high`` words, and the number of words of each text."""
    words, owner = words_of(texts)
    n_words = np.bincount(owner, minlength=len(texts))
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), n_words
    coded = words.dictionary_encode()
    ids, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
    order, lcp, left = suffix_array(ids, owner, high)
    texts_of, buckets_of = [], []
    for k in range(low, high + 1):
        full = left[order] >= k
        at, fresh = order[full], (lcp < k)[full]
        if not len(at):
            break
        heads = at[fresh].tolist()
        hashed = np.array([zlib.crc32(b" ".join([names[i] for i in ids[h : h + k]])) % buckets for h in heads] if k > 1 else [zlib.crc32(names[ids[h]]) % buckets for h in heads], np.int64)
        texts_of.append(owner[at])
        buckets_of.append(hashed[np.cumsum(fresh) - 1])
    return np.concatenate(texts_of or [np.zeros(0, np.int64)]), np.concatenate(buckets_of or [np.zeros(0, np.int64)]), n_words


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(batch.num_columns - 1).cast(pa.large_binary())])
    begin = 0
    while begin < batch.num_rows:
        before = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, before + _SLICE, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def bucket_counts(texts: DataFrame, low: int = 1, high: int = 1, buckets: int = 10_000) -> DataFrame:
    """bucket, n: features of all texts (column ``text``) by bucket; a task sends a row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in _slices(batch):
                total += np.bincount(features(part.column(0), low, high, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    ship_package(texts.sparkSession)
    return texts.select(F.col("text").cast("string")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _counted(texts: DataFrame, low: int, high: int, buckets: int) -> np.ndarray:
    out = np.zeros(buckets, object)
    for bucket, n in bucket_counts(texts, low, high, buckets).collect():  # a row a bucket at most
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of how much likelier the target is than the source) of each bucket, smoothed by one."""
    s, t, b = float(source.sum() + len(source)), float(target.sum() + len(target)), zip(source, target, strict=True)
    return np.array([math.floor(1000 * math.log(((y + 1) * s) / ((x + 1) * t))) for x, y in b], np.int64)


def _weigh(gain: np.ndarray, low: int, high: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                owner, bucket, n_words = features(part.column(1), low, high, len(gain))
                n = np.bincount(owner, minlength=part.num_rows)
                total = np.bincount(owner, weights=gain[bucket], minlength=part.num_rows).astype(np.int64)  # below 2^53: exact
                yield pa.record_batch([part.column(0), pa.array(n_words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(total // np.maximum(n, 1))], ["doc_id", "n_words", "n_features", "weight"])

    return run


def resample(docs: DataFrame, target: DataFrame, *, low: int = 1, high: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024) -> DataFrame:
    """Draws documents as if from the target's distribution: doc_id, n_features, weight, score, rank.

    ``docs``: doc_id, text; ``target``: text; more columns are ignored.  Features are the runs of
    ``low`` to ``high`` words, repeats counted; ``weight`` is the floored mean gain of a
    document's features (0 without); ``score`` adds a Gumbel key made from ``seed`` and doc_id.
    Of the N documents of ``min_words`` words or more, floor(percent * N / 100) with the highest
    scores are drawn and ranked from 1, ties by doc_id; others have no rank.

    Null texts have no words, null ids the key of an empty id (last of a tie); repeated rows are documents of
    their own and share a score; an empty table gives an empty result, an empty target makes
    frequent features cheap; a very long text is scored whole.  The driver gets one number a
    bucket.  Places are counted by score first, so no task sorts all rows.
    """
    if not 1 <= low <= high:
        raise ValueError("low is at least 1 and at most high")
    ship_package(docs.sparkSession)
    gain = gains(_counted(docs, low, high, buckets), _counted(target, low, high, buckets))
    weighed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_weigh(gain, low, high), "doc_id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    key = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = written(weighed.select("doc_id", "n_features", "weight", (F.col("weight") + key).alias("score"), (F.col("n_words") >= min_words).alias("able")), "resampling-scores")

    able = scored.where("able")
    wanted = able.count() * percent // 100
    counts = able.groupBy("score").agg(F.count("*").alias("n")).withColumn("step", F.floor(F.col("score") / _STEP))
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a step
    steps = counts.groupBy("step").agg(F.sum("n").alias("n")).select("step", before.alias("base"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("step").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    above = counts.withColumn("inside", inside).join(steps, "step").select("score", (F.col("base") + F.col("inside")).alias("above")).where(F.col("above") < wanted)
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.desc("able"), F.asc_nulls_last("doc_id")))
    ranked = scored.withColumn("place", place).join(above, "score", "left").withColumn("rank", F.col("above") + F.col("place"))
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("able") & (F.col("rank") <= wanted), F.col("rank")).alias("rank"))


OP12_SQL = r"""
WITH RECURSIVE b(i, k, v) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM b WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS c FROM b WHERE k = 8),
x AS (SELECT doc_id AS id, 0 AS side, row_number() OVER () AS r, text FROM documents UNION ALL SELECT item_id, 1, row_number() OVER (), text FROM benchmark),
l AS (SELECT id, side, r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM x),
w AS (SELECT id, side, r, unnest(words) AS word FROM l),
u AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), (2 * i + 1)::INTEGER, 2))::BIGINT)),
    lambda a, e: xor(a >> 8, c[(xor(a, e) & 255) + 1])), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT word FROM w), crc),
n AS (SELECT side, bucket, count(*) AS n FROM w JOIN u USING (word) GROUP BY ALL),
t AS (SELECT coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM n),
g AS (SELECT bucket, floor(1000 * ln(((coalesce(sum(n) FILTER (side = 1), 0) + 1)::DOUBLE * (any_value(t.s) + 10000)::DOUBLE) / ((coalesce(sum(n) FILTER (side = 0), 0) + 1)::DOUBLE * (any_value(t.t) + 10000)::DOUBLE)))::BIGINT AS gain FROM n, t GROUP BY bucket),
d AS (SELECT r, count(*) AS n, floor(sum(gain) / count(*))::BIGINT AS weight FROM w JOIN u USING (word) JOIN g USING (bucket) WHERE side = 0 GROUP BY r),
f AS (SELECT id, r, len(words) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM l LEFT JOIN d USING (r) WHERE side = 0),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, id NULLS LAST) AS rank, count(*) OVER () AS able FROM f WHERE n_words >= 20)
SELECT id AS doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN rank <= 10 * able // 100 THEN rank END::BIGINT AS rank FROM f LEFT JOIN o USING (r)
"""


def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
