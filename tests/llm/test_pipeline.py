import os
import random

import pytest

from test_jaccard import brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "encoding"]
    counts = [docs.count()]
    # The smallest table holds no secret, so one is planted before the stage that looks for them.
    planted = spark.createDataFrame([(10**9, "token: abcdefgh12 end", "en", "s", 21)], docs.schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "secrets":
            docs = docs.unionByName(planted)
        docs = corpus_pipeline.written(stage(spark, docs, DATA), f"test-{name}")
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4] - 1 > 0
    assert [tuple(r)[:2] + (r.n_chars,) for r in docs.where("text like '%[secret]%'").collect()] == [(10**9, "[secret] end", 12)]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.count() == counts[-1] and "ids_sha256" in last.columns
    again = docs.select("doc_id").collect()
    assert len({r.doc_id for r in again}) == len(again)


def test_edge_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c d e", None, None, 9), (3, "x y z w v", "en", "s", 9), (3, "x y z w v", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = corpus_pipeline.written(stage(spark, docs, DATA), "test-edge")
    assert sorted(docs.select("doc_id").toPandas().doc_id.fillna(-1).tolist()) == [-1, 1, 2, 3]


def test_clashing_names_long_texts_and_empty_tables(spark):
    extra = ["spans", "_text", "_upper", "_kept", "kept", "_bad", "bad", "digest", "_digest", "mark", "row", "redacted", "id", "k1", "of_kept", "_new"]
    r = random.Random(3)
    prose = " ".join(r.choices([f"word{i}" for i in range(3000)], k=60_000))
    rows = [(1, "token: abcdefgh12 end " + " ".join(f"t{i}" for i in range(30)), "en", "s", 21), (2, prose, "en", "s", len(prose)), (None, None, None, None, None), (3, "x y z w v", "en", "s", 9), (3, "x y z w v", "en", "s", 9)]
    rows = [(*row, *extra) for row in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    full = spark.createDataFrame(rows, schema)
    for docs in (full, full.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DATA)
            if name == "encoding":
                assert out.count() == docs.count()
                break
            assert out.columns == docs.columns
            got = out.collect()
            assert all(tuple(x)[5:] == tuple(extra) for x in got)
            if name == "quality":
                assert {x.text for x in got} <= {x.text for x in docs.collect()}
            elif docs is full:
                assert {(x.doc_id, (x.text or "")[:8]) for x in got} == {(1, "[secret]" if name == "secrets" else "token: a"), (2, prose[:8]), (None, ""), (3, "x y z w ")}


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(2000)]
    rows = []
    for i in range(12):
        words = r.choices(vocab, k=200)
        # 196/236 of the 5-word shingles and 197/237 of the 4-word ones: between 0.8 and 0.85.
        rows += [(10 * i, " ".join(words)), (10 * i + 1, " ".join(words + r.choices(vocab, k=40))), (10 * i + 2, " ".join(words + r.choices(vocab, k=60)))]
        for j in range(3, 7):
            copy = list(words)
            for _ in range(j):
                copy[r.randrange(200)] = r.choice(vocab)
            rows.append((10 * i + j, " ".join(copy)))
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, DATA).collect())
    assert got == sorted(d for d, _, least in brute(rows, 80, 5) if d == least)
    assert not {10 * i + 1 for i in range(12)} & set(got)


def test_verdicts_by_row(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = lambda k: " ".join(f"{k}w{i}" for i in range(40))
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").where("length(text) > 200").orderBy("item_id").first().text
    texts = [(None, item), (None, words("a")), (7, item), (7, words("b")), (8, words("c"))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in texts], schema)
    got = {(r.doc_id, r.text) for r in corpus_pipeline.decontamination(spark, docs, DATA).collect()}
    assert got == {x for x in texts if x[1] != item}

    # A lone null id, a null id that copies a document, and two texts of one id, one a copy of a lesser id.
    texts = [(None, words("n")), (None, words("d")), (1, words("d")), (3, words("e")), (5, words("e")), (5, words("f"))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in texts], schema)
    got = {(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, DATA).collect()}
    assert got == {texts[0], texts[2], texts[3], texts[5]}


def test_near_duplicates_of_words_that_polynomials_confuse(spark):
    a = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{a} w x y z", "en", "s", 1), (2, f"{b} w x y z", "en", "s", 1), (3, f"{b} w x y z", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, DATA).collect()) == [1, 2]
