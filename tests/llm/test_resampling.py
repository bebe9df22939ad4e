import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from webloom.llm import resampling as R


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams(text, low, high):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(low, high + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, low, high, buckets, percent, least, seed=2024):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(bucket(g) for x in texts for g in grams(x, low, high)) for texts in ([x for _, x in docs], target))
    a, b = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda i: math.floor(1000 * math.log((t[i] + 1) * a / ((s[i] + 1) * b)))
    out = []
    for doc, text in docs:
        g = grams(text, low, high)
        weight = sum(gain(bucket(x)) for x in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = [r for r, (_, text) in zip(out, docs, strict=True) if len(words(text)) >= least]
    for i, r in enumerate(sorted(able, key=lambda r: (-r[3], r[0] is None, r[0]))[: percent * len(able) // 100], 1):
        r[4] = i
    return sorted(map(tuple, out), key=str)


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.mark.parametrize("low,high,buckets,percent", [(1, 1, 97, 10), (1, 3, 1000, 33), (2, 2, 10_000, 100)])
def test_against_brute_force(spark, low, high, buckets, percent):
    r = random.Random(high)
    vocab = [f"W{i}" for i in range(30)] + ["é", "Éa", "ß9", "\U0001f600"]
    text = lambda: r.choice([" ", "--", "\x00", "\n"]).join(r.choices(vocab, k=r.choice([0, 1, 2, 19, 20, 21, 60])))
    docs = [(i, text()) for i in range(150)]
    docs += [(200, None), (201, ""), (202, "..."), (5, docs[5][1]), (5, docs[5][1]), (None, docs[6][1]), (203, "w1 é " * 4000)]
    target = [text() for _ in range(10)] + [None, ""]
    d = spark.createDataFrame([(*x, 1, 2, "x") for x in docs], "doc_id long, text string, rank int, able int, bucket string")
    t = spark.createDataFrame([(x, 1) for x in target], "text string, doc_id int")
    assert rows(R.resample(d, t, low=low, high=high, buckets=buckets, percent=percent, min_words=20)) == brute(docs, target, low, high, buckets, percent, 20)


def test_equal_scores_of_many(spark, monkeypatch):
    """Repeated rows tie and take consecutive places; places add up over steps of scores."""
    monkeypatch.setattr(R, "_STEP", 3)
    docs = [(i // 3, "a b") for i in range(300)]
    d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("a",)], "text string")
    got = rows(R.resample(d, t, percent=50, min_words=2))
    assert sorted(x[4] for x in got if x[4]) == list(range(1, 151))
    by_id = {}
    for doc, _, _, _, rank in got:
        by_id.setdefault(doc, []).append(rank)
    assert sum(all(v) and max(v) - min(v) == 2 for v in by_id.values() if None not in v) == 50


def test_empty_tables(spark):
    d, t = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert len(rows(R.resample(d, t))) == 1
    assert rows(R.resample(d.limit(0), t)) == []


def test_suffix_array_of_every_depth():
    r = np.random.default_rng(3)
    for depth in (1, 2, 5):
        ids, owner = r.integers(0, 3, 200), np.sort(r.integers(0, 20, 200))
        order, lcp, left = R.suffix_array(ids, owner, depth)
        cut = [tuple(ids[i : i + depth][owner[i : i + depth] == owner[i]]) for i in range(200)]
        assert [cut[i] for i in order] == sorted(cut)
        assert [len(c) for c in cut] == left.tolist()
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B023, B905, E731
        assert lcp.tolist() == [0] + [common(cut[a], cut[b]) for a, b in zip(order[:-1], order[1:], strict=True)]


def test_slices_of_arrays():
    texts = pa.array(["x", None, "a b", "", "ab cd ", "é"]).slice(2)
    got, owner = R.words_of(texts)
    assert got.to_pylist() == [b"a", b"b", b"ab", b"cd", "é".encode()] and owner.tolist() == [0, 0, 2, 2, 3]
