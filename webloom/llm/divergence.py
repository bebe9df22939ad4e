"""Divergence of the sources of each language from each other and from the whole (operator 11).

Terms are tallied in the tasks that read the texts, so a source, language or term with a third
of all rows sends one row a task.  Two sources are compared through the joint histogram of
their counts: how many terms have the counts (a, b).  Only terms that both have meet in a join;
the cells with a zero follow from the histogram of each source and the number of terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.shared import discard, ship_package, written

#: What is no ASCII letter and below 128 parts terms; A-Z are lowered.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c > 127 or chr(c).isalpha() else 32 for c in range(256))
#: Entries of a task's tables before they are handed on.
_HELD = 200_000
_SALTS = 32


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs of the texts of a task; a row without a term for each group seen."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = pa.array([None, *n], pa.binary()).cast(pa.string())
            size = len(terms)
            yield pa.record_batch(
                [pa.array([lang] * size), pa.array([source] * size), terms, pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, n)], pa.int64())],
                ["lang", "source", "term", "n", "docs"],
            )
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            terms = text.encode().translate(_FOLD).split()
            n.update(terms)
            docs.update(set(terms))
        if sum(len(n) for n, _ in held.values()) > _HELD:
            yield from rows()
    yield from rows()


def _share(count: str | int, total: str, kinds: str, scale: int, smooth: int) -> Column:
    """1 + floor(scale * (count + smooth) / (total + smooth * kinds)), exact; null where there are no terms."""
    return F.expr(f"CASE WHEN {kinds} > 0 THEN 1 + ({scale} * (CAST({count} AS DECIMAL(20,0)) + {smooth})) div ({total} + {smooth} * {kinds}) END")


def _distance(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _salted(df: DataFrame) -> DataFrame:
    """Every row once a salt: the small side of a join whose large side has hot keys."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))


def _cells(scored: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, cells): lang, a, b of sources a < b; their joint histogram ca, cb, pa, pb and number m of terms, zero cells included."""
    side = lambda df, x, *more: df.select("lang", F.col("source").alias(x), F.col("p0").alias(f"p{x}0"), *more)
    mine, theirs = _salted(side(groups, "a", "kinds")), side(groups, "b").withColumn("salt", F.pmod(F.hash("b"), F.lit(_SALTS)))
    pairs = mine.join(theirs, ["lang", "salt"]).where("a < b").drop("salt")

    left = side(scored, "a", "term", F.col("n").alias("ca"), F.col("p").alias("pa"))
    right = side(scored, "b", "term", F.col("n").alias("cb"), F.col("p").alias("pb"))
    both = left.join(right, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b", "ca", "cb", "pa", "pb", "pa0", "pb0").agg(F.count("*").alias("m"))

    cell = lambda ca, cb, pa, pb, m: F.struct(*(F.expr(e).cast("long").alias(n) for e, n in zip((ca, cb, pa, pb, m), ("ca", "cb", "pa", "pb", "m"), strict=True)))
    cells = both.select("lang", "a", "b", F.inline(F.array(cell("ca", "cb", "pa", "pb", "m"), cell("ca", "0", "pa", "pb0", "-m"), cell("0", "cb", "pa0", "pb", "-m"), cell("0", "0", "pa0", "pb0", "m"))))
    single = scored.groupBy("lang", "source", "n", "p").agg(F.count("*").alias("m")).withColumn("salt", F.pmod(F.hash("n"), F.lit(_SALTS)))
    one = lambda x: _salted(pairs).join(single.select("lang", F.col("source").alias(x), "n", "p", "m", "salt"), ["lang", x, "salt"])
    cells = cells.unionByName(one("a").select("lang", "a", "b", F.inline(F.array(cell("n", "0", "p", "pb0", "m"), cell("0", "0", "pa0", "pb0", "-m")))))
    cells = cells.unionByName(one("b").select("lang", "a", "b", F.inline(F.array(cell("0", "n", "pa0", "p", "m"), cell("0", "0", "pa0", "pb0", "-m")))))
    cells = cells.unionByName(pairs.select("lang", "a", "b", F.inline(F.array(cell("0", "0", "pa0", "pb0", "kinds")))))
    return pairs, cells.groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m"), F.max("pa").alias("pa"), F.max("pb").alias("pb")).where("m <> 0")


def source_divergence(docs: DataFrame, *, min_docs: int = 10, top: int = 10, scale: int = 1_000_000_000, smooth: int = 2) -> DataFrame:
    """How the sources of each language differ: lang, source, part, item, value, rank.

    ``docs``: text, lang, source (null: ''); more columns are ignored.  The terms (runs of
    letters, A-Z lowered) in at least ``min_docs`` rows of a language count there.  A term's
    share is 1 + floor(scale * (n + smooth) / (N + smooth * V)); two shares p and q are
    floor((p - q)^2 / (p + q)) apart.  Part ``pair``: the sum over all terms for each other
    source of the language (0 without terms).  Part ``term``: the ``top`` terms of the source
    with a larger share than in its whole language.  Ranks go from 1 by value, largest first,
    then by item.  ``scale`` is at most 10^9, so that squares fit 64 bits.

    Repeated rows count each; empty texts and texts without letters still make their group
    known; an empty table gives an empty result; very long texts are tallied whole.
    """
    if not 0 < scale <= 1_000_000_000:
        raise ValueError("scale is from 1 to 10^9")
    ship_package(docs.sparkSession)
    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    tallied = read.mapInArrow(_tally, "lang string, source string, term string, n long, docs long")
    counts = tallied.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    counts = counts.select("lang", "source", "term", "n", F.sum("docs").over(term).alias("docs"), F.sum("n").over(term).alias("n_all"), (F.min("source").over(term) == F.col("source")).alias("first"))
    kept = written(counts.where((F.col("docs") >= min_docs) | F.col("term").isNull()).drop("docs"), "divergence-counts")

    named = F.col("term").isNotNull()
    lang = Window.partitionBy("lang")
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if(named & F.col("first")).alias("kinds"))
    groups = groups.select("lang", "source", "total", F.sum("kinds").over(lang).alias("kinds"), F.sum("total").over(lang).alias("total_all"))
    groups = written(groups.withColumn("p0", _share(0, "total", "kinds", scale, smooth)), "divergence-groups")
    scored = kept.where(named).withColumn("salt", F.pmod(F.hash("term"), F.lit(_SALTS))).join(_salted(groups), ["lang", "source", "salt"])
    scored = written(scored.select("lang", "source", "term", "n", _share("n", "total", "kinds", scale, smooth).alias("p"), "p0", _share("n_all", "total_all", "kinds", scale, smooth).alias("q")), "divergence-shares")
    discard(kept)

    pairs, cells = _cells(scored, groups)
    value = cells.select("lang", "a", "b", (F.col("m") * _distance("pa", "pb")).alias("value")).unionByName(pairs.select("lang", "a", "b", F.lit(0).cast("long").alias("value")))
    value = value.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    value = value.select("lang", "value", F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = value.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    over = scored.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _distance("p", "q").alias("value"))
    return pair.unionByName(over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
w AS (SELECT r, lang, source, unnest(words) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
a AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT *, sum(n) OVER t AS n_all FROM a WINDOW t AS (PARTITION BY lang, term)),
p AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER x + 2 * count(*) OVER x) AS p,
    1 + (1000000000::HUGEINT * (n_all + 2)) // (sum(n) OVER l + 2 * count(DISTINCT term) OVER l) AS q
    FROM s WINDOW x AS (PARTITION BY lang, source), l AS (PARTITION BY lang)),
pair AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(z.value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
    LEFT JOIN (SELECT u.lang, u.source, v.source AS item, sum(((u.p - v.p) * (u.p - v.p)) // (u.p + v.p)) AS value FROM p u JOIN p v ON u.lang = v.lang AND u.term = v.term GROUP BY ALL) z
    ON z.lang = x.lang AND z.source = x.source AND z.item = y.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pair UNION ALL FROM term))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))
