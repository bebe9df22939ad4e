import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from webloom.llm.substring import SuffixAutomaton, dedup_words, match_reference
from webloom.llm.suffix_array import dedup_bytes, radix_repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_bytes(rows, window):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for (doc, _), t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((doc, len(t), int(gone.sum()), spans, kept))
    return out


def brute_words(rows, window):
    seen, out = set(), []
    for doc, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                gone[i : i + window] = [True] * window
            seen.add(w)
        out.append((doc, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g).encode()))
    return out


def corpus(seed, n=120, vocabulary=40):
    r = random.Random(seed)
    vocab = [f"w{'x' * (i % 5)}{i}é" for i in range(vocabulary)]
    passage = " ".join(r.choices(vocab, k=60))
    rows = []
    for i in range(n):
        kind = r.random()
        body = " ".join(r.choices(vocab, k=r.randint(0, 80)))
        if kind < 0.4:
            a, b = sorted(r.sample(range(60), 2))
            body = f"{body} {' '.join(passage.split()[a:b])}\n{' '.join(r.choices(vocab, k=9))}"
        elif kind < 0.6 and rows:
            w = (rows[r.randrange(len(rows))][1] or "").split(" ")
            w[r.randrange(len(w))] = "edit"
            body = " ".join(w)
        elif kind < 0.65:
            body = "ab " * r.randint(1, 60)
        rows.append((i * 3, body))
    rows += [(1000, None), (1001, ""), (1002, "  \n"), (None, passage), (1003, rows[5][1]), (1004, "é" * 300), (1005, " ".join([passage] * 4))]
    return rows


@pytest.mark.parametrize("hot", [256, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_against_brute_force(spark, seed, hot):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, None, "s", None) for d, t in rows], SCHEMA).withColumnRenamed("lang", "spans")
    got = sorted(((r.doc_id, r.n, r.n_removed, len(r.spans), bytes(r.kept)) for r in dedup_bytes(df, 60, 16, hot).collect()), key=str)
    assert got == sorted(brute_bytes(rows, 60), key=str)


@pytest.mark.parametrize("hot", [256, 3])
@pytest.mark.parametrize("seed", [3, 4])
def test_words_against_brute_force(spark, seed, hot):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, None, "s", None) for d, t in rows], SCHEMA).withColumnRenamed("lang", "key")
    got = sorted(((r.doc_id, r.n, r.n_removed, bytes(r.kept)) for r in dedup_words(df, 8, 3, hot).collect()), key=str)
    assert got == sorted(brute_words(rows, 8), key=str)


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert dedup_bytes(df).count() == 0
    assert dedup_words(df).count() == 0


def test_repeated_rows(spark):
    text = " ".join(f"t{i}" for i in range(80))
    df = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    assert [(r.n_removed, len(r.spans)) for r in dedup_bytes(df).collect()] == [(len(text), 1)] * 2
    assert [r.n_removed for r in dedup_words(df).collect()] == [0, 0]


def test_radix_repeats_is_exact():
    r = random.Random(5)
    bodies = [bytes(r.choices(b"ab", k=r.randint(0, 40))) for _ in range(30)]
    seen = Counter(b[i : i + 9] for b in bodies for i in range(len(b) - 8))
    for body, spans in zip(bodies, radix_repeats(bodies, [0] * len(bodies), 9)):
        want = {j for i in range(len(body) - 8) if seen[body[i : i + 9]] > 1 for j in range(i, i + 9)}
        assert {j for a, b in spans for j in range(a, b)} == want


def test_automaton_statistics():
    r = random.Random(6)
    texts = [[r.choice("abc") for _ in range(r.randint(0, 25))] for _ in range(20)]
    automaton, before = SuffixAutomaton(), []
    for t in texts:
        for i, s in enumerate(t):
            got = automaton.add(s)
            old = ["".join(x) for x in before] + ["".join(t[:i])]
            want = max((k for k in range(i + 2) if any("".join(t[i + 1 - k : i + 1]) in o for o in old[:-1]) or "".join(t[i + 1 - k : i + 1]) in "".join(t[:i])), default=0)
            assert got == want
        automaton.end_text()
        before.append(t)


def test_kept_digest(spark):
    rows = corpus(7, 20)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: hashlib.sha256(bytes(r.kept)).hexdigest() for r in dedup_bytes(df).collect()}
    assert got == {d: hashlib.sha256(k).hexdigest() for d, _, _, _, k in brute_bytes(rows, 200)}


def test_broadcast_reference_against_brute_force(spark):
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(12)]
    reference = [" ".join(r.choices(vocab, k=40)) for _ in range(6)] + [""]
    grams = {tuple(t.split()[i : i + 4]) for t in reference for i in range(len(t.split()) - 3)}
    rows = [(i, " ".join(r.choices(vocab, k=r.randint(0, 60)))) for i in range(40)] + [(50, None), (51, reference[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for row, (_, text) in zip(match_reference(df, reference, 4).orderBy("doc_id").collect(), rows, strict=True):
        w = (text or "").split()
        want = {j for i in range(len(w) - 3) if tuple(w[i : i + 4]) in grams for j in range(i, i + 4)}
        assert {j for s in row.spans for j in range(s.start, s.end)} == want
    with pytest.raises(ValueError):
        match_reference(df, reference, 4, max_words=10)


def test_very_long_texts(spark):
    r = random.Random(9)
    words = [f"x{i}" for i in range(3000)]
    passage = " ".join(r.choices(words, k=400))
    long = " ".join(r.choices(words, k=60_000)) + " " + passage + " " + " ".join(r.choices(words, k=60_000))
    df = spark.createDataFrame([(1, passage), (2, long)], "doc_id long, text string")
    assert {x.doc_id: x.n_removed for x in dedup_words(df).collect()} == {1: 0, 2: 400}
    got = {x.doc_id: x for x in dedup_bytes(df).collect()}
    assert got[1].n_removed == len(passage) and len(passage) <= got[2].n_removed <= len(passage) + 2 and len(got[2].spans) == 1


def thue_morse(n):
    """A word of letters and its complement, which every polynomial hash modulo 2^64 takes for one from 1,024 letters on."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_polynomials_confuse(spark, n):
    a, b = thue_morse(n)
    rest = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{b} {rest} end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in dedup_words(df).collect()} == {1: 0, 2: 0, 3: 20}
    rows = [(1, a), (2, b)]
    got = sorted(((r.doc_id, r.n, r.n_removed, len(r.spans), bytes(r.kept)) for r in dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted(brute_bytes(rows, 200), key=str)
