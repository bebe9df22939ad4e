import random
import re

import pytest

from webloom.llm.components import components
from webloom.llm.jaccard import _Join, similar_documents


def brute(rows, percent=85, k=4):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, n=150):
    r = random.Random(seed)
    vocab = [f"Wörd{i}" for i in range(300)]
    line = " ".join(r.choices(vocab, k=14))
    bases = [r.choices(vocab, k=r.randint(1, 90)) for _ in range(12)]
    rows = []
    for i in range(n):
        kind = r.random()
        if kind < 0.7:
            words = list(r.choice(bases[:3]) if kind < 0.4 else r.choice(bases))
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                words[r.randrange(len(words))] = r.choice(vocab)
        else:
            words = r.choices(vocab, k=r.randint(0, 60))
        text = " ".join(words)
        rows.append((r.randrange(10**6), text + "\n" + line if r.random() < 0.3 else text))
    return rows + [(7, None), (8, ""), (9, " \n"), (None, rows[0][1]), (5, "a b"), (6, "A  b"), (5, "a b"), (None, "only null")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, root string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in similar_documents(df).collect()), key=str)
    assert got == brute(rows)


def test_large_group_of_near_copies(spark, monkeypatch):
    """2,000 near copies with a line in common: candidates grow with the group, not with its square."""
    r = random.Random(11)
    vocab = [f"v{i}" for i in range(5000)]
    base, line = r.choices(vocab, k=60), " ".join(r.choices(vocab, k=12))
    rows = [(0, " ".join(base) + " " + line)]
    for i in range(1, 2000):
        words = list(base)
        for _ in range(r.choice([1, 1, 2, 3, 4])):
            words[r.randrange(60)] = r.choice(vocab)
        rows.append((i, " ".join(words) + " " + line))
    rows += [(5000 + i, " ".join(r.choices(vocab, k=70)) + " " + line) for i in range(300)]
    asked = []
    plain = _Join.links
    monkeypatch.setattr(_Join, "links", lambda self, pairs, alive: (asked.append(pairs.count()), plain(self, pairs, alive))[1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in similar_documents(df).collect()), key=str)
    assert got == brute(rows)
    assert sum(asked) < 5 * len(rows)


def test_very_long_texts_and_clashing_names(spark):
    r = random.Random(12)
    words = [f"w{r.randrange(10**6)}" for _ in range(80_000)]
    df = spark.createDataFrame([(3, " ".join(words), 1, 2, 3), (2, " ".join(words[:-5000]), 1, 2, 3), (1, " ".join(words[:40_000]), 1, 2, 3)], "doc_id long, text string, n long, doc long, node long")
    assert sorted((x.doc_id, x.component_id) for x in similar_documents(df).collect()) == [(1, 1), (2, 2), (3, 2)]


def test_empty_table(spark):
    assert similar_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(5, 5)]
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: find(i) for i in parent if find(i) != i}


def test_words_that_polynomials_confuse(spark):
    a = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{a} x y z"), (2, f"{b} x y z"), (3, f"{b.upper()} x y z")]
    got = sorted(tuple(r) for r in similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), percent=85, shingle=4).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute(rows) == [(1, 1, 1), (2, 1, 2), (3, 1, 2)]
