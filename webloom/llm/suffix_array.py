"""Byte-level deduplication by depth-limited radix sorting of suffixes (operator 2).

A suffix matters only through its first ``window`` bytes, so the sort stops there: passes
of eight bytes, most significant first, split groups of equal prefixes and drop a suffix as
soon as it is alone.  Groups that outlive the last pass are exactly the windows that occur
more than once.  Suffixes reach a sort only in the company of others that share their
minimizer, see ``repeats``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.kernels import union
from webloom.llm.repeats import Unit, apply_spans, repeated_spans

_DIGIT = 8


def radix_repeats(bodies: list[bytes], shards: list[int], window: int) -> list[np.ndarray]:
    """Bytes of each body that are covered by a window which starts anywhere else in its shard.

    The shard number is the first digit, so many small shards share the passes.
    """
    data = np.frombuffer(b"".join(bodies) + bytes(window + _DIGIT), np.uint8)
    sizes = np.array([len(b) for b in bodies])
    base = np.cumsum(sizes) - sizes
    count = np.maximum(sizes - window + 1, 0)
    owner = np.repeat(np.arange(len(bodies)), count)
    places = np.repeat(base - (np.cumsum(count) - count), count) + np.arange(count.sum())
    group = np.asarray(shards, np.int64)[owner]
    for depth in range(0, window, _DIGIT):
        if not len(places):
            break
        left = min(_DIGIT, window - depth)
        digit = np.zeros(len(places), np.uint64)
        for j in range(left):
            digit = (digit << np.uint64(8)) | data[places + depth + j]
        order = np.lexsort((digit, group))
        group, digit = group[order], digit[order]
        new = np.ones(len(order), bool)
        new[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        alone = new & np.append(new[1:], True)
        group = (np.cumsum(new) - 1)[~alone]
        order = order[~alone]
        places, owner = places[order], owner[order]
    found = [np.zeros((0, 2), np.int64)] * len(bodies)
    order = np.lexsort((places, owner))
    places, owner = places[order], owner[order]
    cuts = np.searchsorted(owner, np.arange(len(bodies) + 1))
    for i in np.unique(owner):
        start = places[cuts[i] : cuts[i + 1]] - base[i]
        found[i] = union(np.column_stack((start, start + window)))
    return found


def dedup_bytes(docs: DataFrame, window: int = 200, gram: int = 64, hot: int = 8192) -> DataFrame:
    """Removes every byte covered by a ``window``-byte string that starts anywhere else too.

    ``docs``: doc_id, text; more columns are ignored.  Returns doc_id, n (bytes), n_removed,
    spans (maximal removed runs of bytes) and kept (the other bytes, binary).
    A very long text is handled whole.  Null text is empty; texts shorter than the window are kept whole; a null doc_id stays
    null; repeated rows are copies of each other and lose their windows; an empty table gives
    an empty result.
    ``hot`` bounds the classes that are sorted together; it changes no result.
    """
    if not 1 <= gram <= window:
        raise ValueError("gram must lie between 1 and window")
    unit = Unit("bytes", window, gram, hot)
    texts, spans = repeated_spans(docs, unit, radix_repeats, keep_first=False)
    return apply_spans(texts, spans, unit)


def op2_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.col("n").alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
i AS (SELECT doc_id, b, unnest(range(1, octet_length(b) - 198)) AS i FROM d WHERE octet_length(b) >= 200),
h AS (SELECT doc_id, i, md5(hex(array_slice(b, i, i + 199))) AS h FROM i),
r AS (SELECT doc_id, i FROM h QUALIFY count(*) OVER (PARTITION BY h) > 1),
s AS (SELECT doc_id, i, i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 AS gap FROM r),
t AS (SELECT doc_id, i, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM s),
u AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM t GROUP BY doc_id, island),
v AS (SELECT u.doc_id, a, z, hex(array_slice(b, coalesce(lag(z) OVER (PARTITION BY u.doc_id ORDER BY a), 1), a - 1)) AS before FROM u JOIN d ON d.doc_id = u.doc_id),
k AS (SELECT doc_id, count(*) AS n, sum(z - a) AS removed, max(z) AS z, string_agg(before, '' ORDER BY a) AS before FROM v GROUP BY doc_id)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(k.n, 0) AS BIGINT) AS n_spans,
 sha256(unhex(coalesce(before, '') || hex(array_slice(b, coalesce(k.z, 1), octet_length(b))))) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
