"""Set-similarity join on word shingles with several global token orders (operator 9).

Two sets with Jaccard similarity of at least t share a token among the first
``p = n - ceil(t n) + 1`` tokens of each, under *any* order of all tokens.

1. **Lone tokens.**  A set that links with another has at most ``n - ceil(t n)`` tokens that no
   other set has.  Those are counted on a fixed share of the token space (every token with a
   hash below a bound, of all documents), which already rules out most sets; no partner of a
   set that is left is ever ruled out.
2. **First order.**  Among the sets that are left, tokens are ordered by document frequency,
   counted over all of them.  A token at place i of a set leaves ``n - i + 1`` tokens for an
   intersection that starts there, which bounds the size of a partner: the entry's *reach*.
   Every link is found at the first token that its two sets have in common, where each size is
   within the other's reach; entries whose reach allows no partner are not in the lists at all.
3. **Stars.**  Within a token's list every set is compared with one centre, the entry with the
   earliest place (what copies were made from has no lone tokens, each edit adds some), so
   groups of thousands of near copies are joined in linear work.
4. **The rest.**  Lists that still hold several components compare the entries outside the
   list's largest component with the list, keyed by token *and size*, so that a row is made only
   for sizes within reach.  Nothing is compared inside one component, and no list is cut.
5. **Other orders.**  Candidates must also share enough of their prefixes under hash orders of
   all tokens; what passes every order is verified on the whole sets.

Documents with equal sets are one class from the start.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.llm import kernels as K
from webloom.llm.components import components
from webloom.shared import discard, ship_package, written

#: Null ids take this value inside the plan, so they are never the least of a component.
_NO_ID = (1 << 63) - 1
_U = np.uint64
#: Pairs of one set that are verified in one place; beyond it they are spread.
_SPREAD = 256


def _sets(data: np.ndarray, at: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row in ascending order, and row offsets in them."""
    data = K.fold_ascii(data)
    starts, ends, rows_at = K.words(data, at, K.SPACED)
    prefix = K.Prefix(K.word_symbols(data, starts, ends))
    lengths = np.diff(rows_at)
    count = np.where(lengths >= shingle, lengths - shingle + 1, np.minimum(lengths, 1))
    rows = np.repeat(np.arange(len(count)), count)
    begin = np.repeat(rows_at[:-1] - (np.cumsum(count) - count), count) + np.arange(len(rows))
    hashes = prefix.spans(begin, begin + np.minimum(lengths, shingle)[rows])
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[new], np.searchsorted(rows[new], np.arange(len(at)))


def _marks(hashes: np.ndarray, rows_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set."""
    one = K.Prefix(hashes).spans(rows_at[:-1], rows_at[1:])
    two = K.Prefix(K.mix(hashes)).spans(rows_at[:-1], rows_at[1:])
    return one.view(np.int64), two.view(np.int64)


def _describe(shingle: int, keep: list[str]) -> Callable:
    """Per document: set size and two hashes of its set, and the columns ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r0, r1, data, at in K.chunks(batch.column("text")):
                hashes, rows_at = _sets(data, at, shingle)
                one, two = _marks(hashes, rows_at)
                yield pa.record_batch([batch.column("doc")[r0:r1], pa.array(np.diff(rows_at)), pa.array(one), pa.array(two), *(batch.column(c)[r0:r1] for c in keep)], ["doc", "n", "s1", "s2", *keep])

    return run


def _tokens(shingle: int, below: int | None = None) -> Callable:
    """(token, node) of every set; with ``below`` only tokens whose scrambled hash is less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column("node").to_numpy(zero_copy_only=False)
            for r0, _, data, at in K.chunks(batch.column("text")):
                hashes, rows_at = _sets(data, at, shingle)
                owner = np.repeat(nodes[r0 : r0 + len(rows_at) - 1], np.diff(rows_at))
                if below is not None:
                    inside = K.mix(hashes) < _U(below)
                    hashes, owner = hashes[inside], owner[inside]
                for i in range(0, len(hashes), 1 << 16):
                    part = slice(i, i + (1 << 16))
                    yield pa.record_batch([pa.array(hashes[part].view(np.int64)), pa.array(owner[part])], ["token", "node"])

    return run


def _lists(values: np.ndarray, take: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(take))).astype(np.int32)), pa.array(values.view(kind)))


def _in_full(shingle: int, percent: int, orders: int) -> Callable:
    """Each node's whole set, and its prefix and last place under every further order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r0, r1, data, at in K.chunks(batch.column("text"), K.CHUNK // 4):
                hashes, rows_at = _sets(data, at, shingle)
                n = np.diff(rows_at)
                take = n - (percent * n + 99) // 100 + 1
                rows = np.repeat(np.arange(len(n)), n)
                out = {"node": batch.column("node")[r0:r1], "items": _lists(hashes, n, np.int64), "p": pa.array(take)}
                for i in range(orders - 1):
                    ranks = K.mix(hashes + _U(2 + i)) >> _U(1)
                    ranks = ranks[np.lexsort((ranks, rows))]
                    ranks = ranks[np.repeat(rows_at[:-1] - (np.cumsum(take) - take), take) + np.arange(take.sum())]
                    out |= {f"o{i}": _lists(ranks, take, np.int64), f"last{i}": pa.array(ranks[np.cumsum(take) - 1].view(np.int64))}
                yield pa.record_batch(list(out.values()), list(out))

    return run


class _Join:
    def __init__(self, texts: DataFrame, percent: int, shingle: int, orders: int):
        self.texts, self.percent, self.shingle, self.orders = texts, percent, shingle, orders

    def classes(self) -> DataFrame:
        """node, s1, s2, n, doc, copies, text: one row for all documents with one set.

        Partial aggregation leaves one text of a class in each task; numbers are given once,
        in the table that is written here.
        """
        rows = self.texts.mapInArrow(_describe(self.shingle, ["text"]), "doc long, n long, s1 long, s2 long, text string")
        rows = rows.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc").alias("doc"), F.count("*").alias("copies"), F.first("text").alias("text"))
        return written(rows.withColumn("node", F.monotonically_increasing_id()), "jaccard-classes")

    def alive(self, classes: DataFrame) -> DataFrame:
        """node, n, copies, text of the classes that their lone tokens don't rule out."""
        share = min(100, 2 * (100 - self.percent))  # of the token space, in percent
        below = None if share == 100 else (share << 64) // 100
        seen = classes.select("node", "text").mapInArrow(_tokens(self.shingle, below), "token long, node long")
        lone = seen.groupBy("token").agg(F.count("*").alias("m"), F.min("node").alias("node")).where("m = 1")
        lone = written(lone.groupBy("node").agg(F.count("*").alias("lone")), "jaccard-lone")
        rows = classes.select("node", "n", "copies", "text").join(lone.hint("merge"), "node", "left")
        rows = rows.where(F.expr(f"100 * (n - coalesce(lone, 0)) >= {self.percent} * n")).drop("lone")
        rows = written(rows, "jaccard-alive")
        discard(lone)
        return rows

    def entries(self, alive: DataFrame) -> DataFrame:
        """token, node, n, copies, place, reach: the lists of the first order, without tokens that only one class has."""
        tokens = written(alive.select("node", "text").mapInArrow(_tokens(self.shingle), "token long, node long"), "jaccard-tokens")
        often = written(tokens.groupBy("token").agg(F.count("*").alias("often")).where("often > 1"), "jaccard-often")
        shared = tokens.join(often.hint("merge"), "token").join(alive.select("node", "n", "copies").hint("merge"), "node")
        own = Window.partitionBy("node")
        place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("often", "token"))
        t = self.percent
        shared = shared.withColumn("place", place).withColumn("reach", F.expr(f"least((100 * n) div {t}, ({100 + t} * (n - place + 1)) div {t} - n)"))
        out = written(shared.where(f"100 * reach >= {t} * n").select("token", "node", "n", "copies", "place", "reach"), "jaccard-entries")
        discard(tokens, often)
        return out

    def stars(self, entries: DataFrame) -> DataFrame:
        """Pairs (x, y), x the larger node, of every entry and its list's centre."""
        rank = F.struct((-F.col("place") / F.col("n")).alias("early"), "copies", (-F.col("node")).alias("least"), "n", "reach")
        centre = entries.groupBy("token").agg(F.max(rank).alias("c"), F.count("*").alias("size")).where("size > 1")
        centre = written(centre.select("token", (-F.col("c.least")).alias("node2"), F.col("c.n").alias("n2"), F.col("c.reach").alias("reach2")), "jaccard-centres")
        met = entries.join(centre.hint("merge"), "token").where("node <> node2 and n2 <= reach and n <= reach2")
        pairs = written(met.select(F.greatest("node", "node2").alias("x"), F.least("node", "node2").alias("y")).distinct(), "jaccard-stars")
        discard(centre)
        return pairs

    def rest(self, entries: DataFrame, roots: DataFrame, done: DataFrame) -> DataFrame:
        """Pairs across the components that one list still holds, apart from the pairs ``done``."""
        placed = entries.join(roots.withColumnRenamed("root", "top").hint("merge"), "node", "left").withColumn("top", F.coalesce("top", "node"))
        split = placed.groupBy("token").agg(F.min("top").alias("low"), F.max("top").alias("high")).where("low < high").select("token")
        apart = written(placed.join(split.hint("merge"), "token").select("token", "node", "n", "reach", "top"), "jaccard-apart")
        main = apart.groupBy("token", "top").agg(F.count("*").alias("size")).groupBy("token").agg(F.max_by("top", F.struct("size", "top")).alias("main"))
        main = written(main, "jaccard-main")
        sizes = written(apart.groupBy("token", F.col("n").alias("size")).agg(F.max("reach").alias("furthest")), "jaccard-sizes")
        others = apart.join(main.hint("merge"), "token").where("top <> main").drop("main")
        within = F.expr(f"100 * size >= {self.percent} * n and size <= reach and n <= furthest")
        others = written(others.join(sizes.hint("merge"), "token").where(within).drop("furthest"), "jaccard-others")
        twin = apart.select("token", F.col("n").alias("size"), F.col("node").alias("node2"), F.col("reach").alias("reach2"), F.col("top").alias("top2"))
        met = others.join(twin.hint("merge"), ["token", "size"]).where("n <= reach2 and top <> top2")
        pairs = met.select(F.greatest("node", "node2").alias("x"), F.least("node", "node2").alias("y")).distinct()
        pairs = written(pairs.join(done.hint("merge"), ["x", "y"], "left_anti"), "jaccard-rest")
        discard(apart, main, sizes, others)
        return pairs

    def links(self, pairs: DataFrame, alive: DataFrame) -> DataFrame:
        """The pairs that link, as (u, v): filtered under every further order, then verified on whole sets.

        A set with very many pairs, a centre, is handed out several times and its pairs are
        spread over these, so no task holds them all.
        """
        nodes = pairs.select(F.col("x").alias("node")).union(pairs.select("y")).distinct()
        fields = ", ".join(["node long", "items array<long>", "p long", *(f"o{i} array<long>, last{i} long" for i in range(self.orders - 1))])
        texts = alive.select("node", "text").join(nodes.hint("merge"), "node", "left_semi")
        sets = written(texts.mapInArrow(_in_full(self.shingle, self.percent, self.orders), fields), "jaccard-sets")
        both = pairs
        tables = []
        for side in "xy":
            parts = written(pairs.groupBy(side).agg(F.ceil(F.count("*") / _SPREAD).cast("int").alias("parts")), "jaccard-parts")
            other = "y" if side == "x" else "x"
            both = both.join(parts.hint("merge"), side).withColumn("salt", F.pmod(F.hash(other), "parts")).drop("parts")
            named = sets.select(F.col("node").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in sets.columns if c != "node"))
            named = named.join(parts.hint("merge"), side).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
            both = both.join(named.hint("merge"), [side, "salt"]).drop("salt")
            tables.append(parts)
        t = self.percent
        for i in range(self.orders - 1):
            room = f"if(x_last{i} <= y_last{i}, size(x_items) - x_p, size(y_items) - y_p)"
            both = both.where(f"{100 + t} * (size(array_intersect(x_o{i}, y_o{i})) + {room}) >= {t} * (size(x_items) + size(y_items))")
        common = F.size(F.array_intersect("x_items", "y_items"))
        either = F.size("x_items") + F.size("y_items") - common
        found = written(both.where(100 * common >= t * either).select(F.col("x").alias("u"), F.col("y").alias("v")), "jaccard-links")
        discard(sets, *tables)
        return found


def similar_documents(docs: DataFrame, percent: int = 85, shingle: int = 4, orders: int = 3, mark: Column | None = None) -> DataFrame:
    """Links documents whose sets of ``shingle``-word shingles have Jaccard similarity of ``percent``/100 or more.

    ``docs``: doc_id, text; more columns are ignored.  Words lie between ASCII white space,
    A-Z lower-cased; a text of fewer words is one shingle.  Returns one row per row of docs:
    doc_id, n_shingles, component_id (the least doc_id reachable by links, itself included).
    Null texts and texts without words have empty sets and link with nothing.  Repeated rows
    each give a row.  A null doc_id is never the least; it is returned as null, and so is the
    component of rows that link with null ids only.  An empty table gives an empty result.
    Very long texts are taken whole, one at a time in a task.  Ties in the order of tokens are
    broken by their hashes, which changes no result.  ``mark``, an expression over docs, is
    returned as one more column of each row.
    """
    ship_package(docs.sparkSession)
    keep = [] if mark is None else ["mark"]
    columns = [F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")]
    texts = docs.select(*columns)
    join = _Join(texts, percent, shingle, orders)
    classes = join.classes()
    alive = join.alive(classes)
    entries = join.entries(alive)
    stars = join.stars(entries)
    first = join.links(stars, alive)
    roots = components(first)
    rest = join.rest(entries, roots, stars)
    more = join.links(rest, alive)
    tops = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))

    placed = classes.join(tops.hint("merge"), "node", "left").select("s1", "s2", "n", "doc", F.coalesce("root", "node").alias("top"))
    least = placed.groupBy("top").agg(F.min("doc").alias("component"))
    named = written(placed.join(least.hint("merge"), "top").select("s1", "s2", "n", "component"), "jaccard-named")
    described = texts if mark is None else docs.select(*columns, mark.alias("mark"))
    kept = "".join(f", {c} {described.schema[c].dataType.simpleString()}" for c in keep)
    members = written(described.mapInArrow(_describe(shingle, keep), f"doc long, n long, s1 long, s2 long{kept}"), "jaccard-members")
    discard(classes, alive, entries, stars, first, roots, rest, more, tops)
    full = members.join(named.hint("merge"), ["s1", "s2", "n"], "left")
    missing = F.lit(_NO_ID)
    return full.select(
        F.nullif("doc", missing).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.nullif(F.coalesce("component", "doc"), missing).alias("component_id"),
        *keep,
    )


def op9_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 85 * (a.n + b.n - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS t FROM w UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.t)
SELECT w.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.t) AS component_id FROM w JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY 1
"""
