import random

import numpy as np
import pytest

from webloom.llm.token_counts import _encoding, attribute, count_tokens

P = pytest.importorskip("public_tokenizers")
pytest.importorskip("tiktoken")


def test_attribution_against_brute_force():
    r = random.Random(1)
    for _ in range(300):
        n = r.randint(1, 40)
        ends = np.array(sorted({*r.sample(range(1, n + 1), r.randint(1, n)), n}))
        bounds = np.array(sorted({0, n, *r.sample(range(n), r.randint(0, n // 2))}))
        counts, crossing = np.zeros(len(bounds) - 1, int), np.zeros(len(bounds) - 1, int)
        for a, b in zip([0, *ends], ends):
            share = [sum(bounds[i] <= x < bounds[i + 1] for x in range(a, b)) for i in range(len(bounds) - 1)]
            owner = share.index(max(share))
            counts[owner] += 1
            crossing[owner] += sum(s > 0 for s in share) > 1
        got = attribute(ends, bounds)
        assert (got[0] == counts).all() and (got[1] == crossing).all()


def test_sections_add_up(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    texts = [None, "", "one line", "two\nlines\n\n\n\nhere\n", "é\nü 😀\n", "\n", "a" * 3000 + "\n" + "b"]
    df = spark.createDataFrame([(i, t, "T", "x") for i, t in enumerate(texts)] + [(None, "x\ny", None, "x"), (2, "one line", "T", "x")], "doc_id long, text string, title string, field string")
    encoding, _ = _encoding(path, P.PATTERN)
    alone = count_tokens(df, path, P.PATTERN, ["text"]).collect()
    for i, t in enumerate(texts):
        own = [r for r in alone if r.doc_id == i]
        times = 2 if i == 2 else 1
        assert sum(r.n_tokens for r in own) == times * len(encoding.encode_ordinary(t or ""))
        assert len(own) == times * len([x for x in (t or "").splitlines(keepends=True)])
    both = count_tokens(df, path, P.PATTERN, ["title", "text"], lines=False).collect()
    own = [r for r in both if r.doc_id == 3]
    assert [r.field for r in own] == ["title", "text"] and sum(r.n_tokens for r in own) == len(encoding.encode_ordinary("T\n\n" + texts[3]))
    assert count_tokens(df.limit(0), path, P.PATTERN, ["text"]).count() == 0


def test_characters_long_texts_and_clashing_names(spark):
    text = "é😀 word\n" * 40_000 + "end"
    df = spark.createDataFrame([(1, text, "x", "y")], "doc_id long, text string, _id string, _f0 string")
    rows = sorted(count_tokens(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, ["text"]).collect(), key=lambda r: r.section)
    encoding, _ = _encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert sum(r.n_tokens for r in rows) == len(encoding.encode_ordinary(text)) and len(rows) == 40_001
    assert all(text[r.start_char : r.end_char] == "é😀 word\n" for r in rows[:-1]) and text[rows[-1].start_char : rows[-1].end_char] == "end"
