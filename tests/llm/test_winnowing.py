import random
import re

import pytest

from webloom.llm.winnowing import decontaminate


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=13):
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, passage in items:
            p = words(passage)
            k = min(window, len(p))
            grams = {tuple(p[i : i + k]) for i in range(len(p) - k + 1)} if k else set()
            for i in range(len(w) - k + 1 if grams else 0):
                if tuple(w[i : i + k]) in grams:
                    hit.update(range(i, i + k))
                    if item is not None:
                        found.add(str(item))
        out.append((doc, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [64 << 20, 5])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, limit):
    r = random.Random(seed)
    vocab = [f"Éa{i}" for i in range(60)] + ["Ab", "ß", "9"]
    items = [(i, ", ".join(r.choices(vocab, k=r.choice([0, 1, 5, 12, 13, 14, 30])))) for i in range(15)]
    items += [(99, None), (98, items[3][1]), (None, items[4][1]), (97, " ".join(["the"] * 20))]
    docs = []
    for i in range(60):
        body = r.choices(vocab, k=r.randint(0, 70))
        for _ in range(r.randint(0, 3)):
            p = words(r.choice(items)[1])
            a = r.randint(0, max(0, len(p) - 13))
            at = r.randint(0, len(body))
            body[at:at] = [x.upper() if x.isascii() else x for x in p[a : a + r.choice([12, 13, 20])]]
        docs.append((i, "--".join(body)))
    docs += [(100, None), (101, ""), (102, "..."), (3, docs[3][1]), (None, items[6][1]), (103, "the " * 40)]
    d = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(a, t, 1) for a, t in items], "item_id long, text string, doc_id int")
    got = sorted(((x.doc_id, x.n_words, x.n_hit, x["items"], x.contaminated) for x in decontaminate(d, b, broadcast_bytes=limit).collect()), key=str)
    assert got == brute(docs, items)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(x) for x in decontaminate(d, b).collect()] == [(1, 2, 0, [], False)]
    assert decontaminate(d.limit(0), b).count() == 0


@pytest.mark.parametrize("limit", [64 << 20, 5])
def test_long_items_only_and_many_copies(spark, limit):
    r = random.Random(9)
    vocab = [f"v{i}" for i in range(40)]
    items = [(i, " ".join(r.choices(vocab, k=r.randint(13, 40)))) for i in range(10)] + [(50, "v1 " * 30)]
    docs = [(i % 7, " ".join(r.choices(vocab, k=r.randint(0, 9))) + " " + r.choice(items)[1] + " v1" * r.randint(0, 30)) for i in range(60)]
    docs += [(1, items[0][1])] * 40 + [(2, None)] * 3
    d = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, k1 int")
    b = spark.createDataFrame([(a, t, 1) for a, t in items], "item_id long, text string, words int")
    got = sorted(((x.doc_id, x.n_words, x.n_hit, x["items"], x.contaminated) for x in decontaminate(d, b, broadcast_bytes=limit).collect()), key=str)
    assert got == brute(docs, items)


def test_long_text(spark):
    r = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(30))
    text = " ".join(r.choices([f"w{i}" for i in range(500)], k=60_000)) + " " + passage
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    b = spark.createDataFrame([(4, passage)], "item_id long, text string")
    assert [tuple(x) for x in decontaminate(d, b).collect()] == [(1, 60_030, 30, ["4"], False)]
