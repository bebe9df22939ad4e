import random
import re
from collections import Counter, defaultdict

import pytest

from webloom.llm.divergence import source_divergence

SCHEMA = "text string, lang string, source string, term int, salt int, n int, p0 string"


def terms(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, min_docs, top):
    docs = [(terms(t), lang or "", source or "") for t, lang, source in docs]
    out = []
    for lang in {x[1] for x in docs}:
        mine = [x for x in docs if x[1] == lang]
        df = Counter(w for ws, *_ in mine for w in set(ws))
        kept = sorted(w for w, n in df.items() if n >= min_docs)
        counts = defaultdict(Counter)
        for ws, _, source in mine:
            counts[source].update(w for w in ws if w in set(kept))
            counts[None].update(w for w in ws if w in set(kept))
        share = {s: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept} for s, c in counts.items()}
        far = lambda p, q: (p - q) ** 2 // (p + q)
        for s in counts.keys() - {None}:
            pair = [("pair", o, sum(far(share[s][w], share[o][w]) for w in kept)) for o in counts.keys() - {None, s}]
            over = [("term", w, far(share[s][w], share[None][w])) for w in kept if counts[s][w] and share[s][w] > share[None][w]]
            for rows, limit in ((pair, None), (over, top)):
                ranked = sorted(rows, key=lambda r: (-r[2], r[1].encode()))[:limit]
                out += [(lang, s, *r, i) for i, r in enumerate(ranked, 1)]
    return sorted(out)


def rows(df):
    return sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect())


def frame(spark, docs):
    return spark.createDataFrame([(*d, 1, 2, 3, "x") for d in docs], SCHEMA)


@pytest.mark.parametrize("seed,min_docs", [(1, 3), (2, 1), (3, 10)])
def test_against_brute_force(spark, seed, min_docs):
    r = random.Random(seed)
    vocab = [f"w{chr(97 + i)}" for i in range(20)] + ["Éa", "éa", "ß", "Zz", "zz", "\U0001f600x"]
    docs = []
    for _ in range(120):
        lang, source = r.choice(["en", "en", "de", None, ""]), r.choice(["a", "a", "a", "b", "c", None, "é", "￿", "\U00010000"])
        docs.append((r.choice([" ", "1", "\x00", "-\n"]).join(r.choices(vocab[: r.randint(1, 26)], k=r.randint(0, 30))), lang, source))
    docs += [(None, "en", "only null"), ("", "fr", "a"), ("123 ...", "fr", "b"), docs[0], docs[0], ("wa " * 5000, "en", "b")]
    assert rows(source_divergence(frame(spark, docs), min_docs=min_docs, top=4)) == brute(docs, min_docs, 4)


def test_groups_without_terms(spark):
    docs = [(None, "en", "a"), ("", "en", "b"), ("x", None, None)]
    assert rows(source_divergence(frame(spark, docs))) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_empty_table(spark):
    assert rows(source_divergence(frame(spark, [("x", "a", "b")]).limit(0))) == []


def test_values_beyond_64_bits_inside(spark, monkeypatch):
    """Shares of very large counts are exact."""
    from pyspark.sql import functions as F

    from webloom.llm.divergence import _share

    n = 10**15
    got = spark.createDataFrame([(n, 3 * n, 7)], "n long, total long, kinds long").select(_share("n", "total", "kinds", 10**9, 2).alias("p"), F.lit(1)).first().p
    assert got == 1 + 10**9 * (n + 2) // (3 * n + 14)
