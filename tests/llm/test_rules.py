import os
import zlib

import numpy as np
import pytest

from webloom.llm.rules import STATISTICS, fit, keep_quality, score_documents, statistics

DATA = "/root/testdata/sf0.01"


def test_statistics_of_plain_cases():
    texts = [b"", b"AB cd!! cd!!\nAB cd!! cd!!", b"\n \n"]
    at = np.cumsum([0] + [len(t) for t in texts])
    got = [dict(zip(STATISTICS, r)) for r in statistics(np.frombuffer(b"".join(texts), np.uint8), at)]
    assert all(v == 0 for k, v in got[0].items())
    assert got[1]["marked_words"] == pytest.approx(4 / 6) and got[1]["caps_words"] == pytest.approx(2 / 6)
    assert got[1]["distinct_words"] == pytest.approx(2 / 6) and got[1]["repeated_lines"] == 0.5 and got[1]["line_words"] == 3
    assert got[2]["space"] == 1 and got[2]["log_words"] == 0


def test_fit_finds_a_conjunction():
    r = np.random.default_rng(1)
    x = r.random((3000, len(STATISTICS)))
    y = ((x[:, 2] > 0.4) & (x[:, 5] <= 0.7)).astype(float)
    model = fit(x, y)
    margin = model.bias + sum(w * np.all([(x[:, s] > t) == up for s, up, t in rule], axis=0) for rule, w in zip(model.rules, model.weights))
    assert ((margin > 0) == (y == 1)).mean() > 0.97
    assert len(model.rules) < 120


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a"), (2, ""), (3, "é" * 100_000)], "doc_id long, text string").selectExpr("*", "1 as score")
    labels = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, quality int")
    rows = score_documents(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= x.score <= 1 for x in rows)
    assert {x.score for x in score_documents(docs, labels.limit(0)).collect()} == {0.5}
    assert score_documents(docs.limit(0), labels).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    scored = score_documents(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in scored.doc_id)
    assert (scored.predicted == scored.quality).mean() >= 0.95
    kept = keep_quality(docs, labels)
    assert kept.columns == docs.columns and 0.8 * docs.count() < kept.count() < docs.count()


def test_repeated_ids_and_clashing_names(spark):
    docs = spark.createDataFrame([(i % 4, f"a b c {i}", "u") for i in range(8)], "doc_id long, text string, _upper string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 1), (2, 0)], "doc_id long, quality int")
    assert sorted(r.doc_id for r in score_documents(docs, labels).collect()) == sorted(i % 4 for i in range(8))
    kept = keep_quality(docs, labels)
    assert kept.columns == docs.columns and {r._upper for r in kept.collect()} <= {"u"}
