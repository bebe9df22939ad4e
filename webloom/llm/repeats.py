"""Exact search for token windows that occur more than once in a corpus.

Shared by the byte-level and the word-level substring deduplication.  All windows of
``window`` tokens are compared, but only as many are moved as may have a partner:

1. Every window is represented by its minimizer (``kernels.window_runs``); windows that
   share one minimizer occurrence form a *run*.  Equal windows have equal minimizers, so a
   run whose minimizer occurs once in the corpus is dropped after an 8-byte count.
2. The runs that are left are cut from the texts and classed by their whole content.
   Runs inside a copied passage are equal as wholes and end here, pre-aggregated to one
   row a class whatever the number of copies.
3. Only classes that share a minimizer and differ (the rims of copied passages) are
   compared token by token, one shard a minimizer, in the kernel that the caller names
   (radix passes or a suffix automaton).  A shard of more than ``hot`` classes is dealt out
   once more, by a longer digit: its windows are taken by where the minimizer lies in them, a
   range of places at a time, and the tokens that all windows of a range hold around the
   minimizer make the new shard.  The pieces of classes in a new shard are classed again, by
   content, and judged in the same way, with ranges that narrow to one place, where the digit is
   the whole window.  So no shard grows with the corpus and every one ends in the same kernel.
4. Verdicts go back to all occurrences with a join that AQE may split, and one join by
   document applies them.

Hashes are 64 bits for the minimizer and 64 more for the content; a false merge needs two
different contents to agree in both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import kernels as K
from webloom.shared import discard, ship_package, written

#: Null ids take this value inside the plan, so they sort first.
_NO_ID = -(1 << 63)


@dataclass(frozen=True)
class Unit:
    """How texts become tokens and how long a repeated window is."""

    kind: str  # "bytes" or "words"
    window: int
    gram: int
    hot: int  # classes in a shard beyond which it is dealt out by a longer digit

    def tokens(self, data: np.ndarray, at: np.ndarray):
        """Token symbols, row offsets in them, and the byte spans of tokens."""
        if self.kind == "bytes":
            return K.byte_symbols(data), at, None, None
        starts, ends, rows = K.words(data, at, K.SPACED)
        return K.word_symbols(data, starts, ends), rows, starts, ends


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.asarray(column.offsets).astype(np.int64)
    return offsets - offsets[0], column.flatten()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _fingerprint(unit: Unit) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc").to_numpy(zero_copy_only=False)
            for r0, _, data, at in K.chunks(batch.column("text")):
                symbols, rows_at, _, _ = unit.tokens(data, at)
                rows, _, _, keys = K.window_runs(symbols, rows_at, unit.window, unit.gram)
                if len(rows):
                    first = np.searchsorted(rows, rows)
                    no = (np.arange(len(rows)) - first).astype(np.int32)
                    yield pa.record_batch([_signed(keys), pa.array(ids[r0 + rows]), pa.array(no)], ["key", "doc", "run"])

    return run


def _cut(unit: Unit) -> Callable:
    """Runs named by their numbers, with content hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc").to_numpy(zero_copy_only=False)
            marks = batch.column("mark").to_numpy(zero_copy_only=False)
            list_at, numbers = _lists(batch.column("runs"))
            numbers = numbers.to_numpy(zero_copy_only=False)
            for r0, r1, data, at in K.chunks(batch.column("text")):
                symbols, rows_at, _, _ = unit.tokens(data, at)
                rows, starts, sizes, keys = K.window_runs(symbols, rows_at, unit.window, unit.gram)
                if not len(rows):
                    continue
                row_head = np.searchsorted(rows, np.arange(r1 - r0 + 1))
                owner = np.repeat(np.arange(r1 - r0), np.diff(list_at[r0 : r1 + 1]))
                wanted = numbers[list_at[r0] : list_at[r1]]
                fits = wanted < np.diff(row_head)[owner]  # always, unless an id is repeated
                pick = row_head[owner[fits]] + wanted[fits]
                begin = rows_at[rows[pick]] + starts[pick]
                content = K.Prefix(symbols).spans(begin, begin + sizes[pick] + unit.window - 1)
                at_row = r0 + rows[pick]
                yield pa.record_batch(
                    [_signed(keys[pick]), _signed(content), pa.array(ids[at_row]), pa.array(marks[at_row]), pa.array(starts[pick].astype(np.int32)), pa.array(sizes[pick].astype(np.int32))],
                    ["key", "content", "doc", "mark", "start", "size"],
                )

    return run


def _slices(unit: Unit) -> Callable:
    """The token strings of chosen runs (bytes as they are; words joined by one space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            list_at, runs = _lists(batch.column("runs"))
            start = runs.field("start").to_numpy(zero_copy_only=False)
            size = runs.field("size").to_numpy(zero_copy_only=False)
            doc, marks = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("doc", "mark"))
            owner = np.repeat(np.arange(len(doc)), np.diff(list_at))
            out: list[bytes] = []
            for r0, r1, data, at in K.chunks(batch.column("text")):
                raw = data.tobytes()
                _, rows_at, w0, w1 = unit.tokens(data, at) if unit.kind == "words" else (None, at, None, None)
                for i in range(list_at[r0], list_at[r1]):
                    a = rows_at[owner[i] - r0] + start[i]
                    b = a + size[i] + unit.window - 1
                    out.append(raw[a:b] if w0 is None else b" ".join(raw[w0[j] : w1[j]] for j in range(a, b)))
            for i in range(0, len(out), 4096):
                part = slice(i, i + 4096)
                yield pa.record_batch(
                    [*(runs.field(n)[part] for n in ("key", "content", "weight")), pa.array(doc[owner[part]]), pa.array(marks[owner[part]]), pa.array(start[part]), pa.array(out[part], pa.binary())],
                    ["key", "content", "weight", "doc", "mark", "start", "body"],
                )

    return run


def _redealt(unit: Unit, width: int) -> Callable:
    """Pieces of slices whose windows have their minimizer within ``width`` places, with the tokens around it as key."""
    places = unit.window - unit.gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outer = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "content", "doc", "mark", "start", "weight")]
            for r0, r1, data, at in K.chunks(batch.column("body"), K.CHUNK // 8):
                symbols, rows_at, _, _ = unit.tokens(data, at)
                prefix = K.Prefix(symbols)
                grams = prefix.grams(unit.gram) & K._HIGH
                row, first, size, key_a, key_b, low = [], [], [], [], [], []
                for r in range(r1 - r0):
                    begin, count = rows_at[r], rows_at[r + 1] - rows_at[r] - unit.window + 1
                    m = int(grams[begin : begin + places].argmin())  # windows 0 .. count - 1 have it at m, m - 1, ...
                    for lo in range((m - count + 1) // width * width, m + 1, width):
                        hi = min(lo + width, places)
                        a, b = max(0, m - hi + 1), min(count, m - lo + 1)
                        row.append(r)
                        first.append(a)
                        size.append(b - a)
                        low.append(lo)
                        key_a.append(begin + m - lo)
                        key_b.append(begin + m - hi + 1 + unit.window)
                if not row:
                    continue
                row, first, size = np.array(row), np.array(first), np.array(size)
                key, content, doc, mark, start, weight = (x[r0 + row] for x in outer)
                near = K.mix(prefix.spans(np.array(key_a), np.array(key_b)) ^ K.mix(np.array(low).astype(np.uint64)) ^ key.view(np.uint64))
                own = rows_at[row] + first
                inner = prefix.spans(own, own + size + unit.window - 1)
                yield pa.record_batch(
                    [_signed(near), _signed(inner), pa.array(doc), pa.array(mark), pa.array((start + first).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(weight), pa.array(key), pa.array(content), pa.array(first.astype(np.int32))],
                    ["key", "content", "doc", "mark", "start", "size", "weight", "outer_key", "outer_content", "first"],
                )

    return run


#: Shards are handed to a kernel in groups of about this many bytes.
_SHARD_BYTES = 2_000_000


def by_shard(kernel: Callable, window: int) -> Callable:
    """Feeds whole shards (rows of one key, in order of document and start) to ``kernel``.

    ``kernel(bodies, shards, window)`` gets the bodies of some whole shards with their shard
    numbers, ascending, and gives for each body the [start, end) tokens that repeated windows
    of its shard cover.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, shard, size = None, -1, 0
        keys, contents, shards, bodies = [], [], [], []

        def judged() -> pa.RecordBatch | None:
            out = [(k, c, int(a), int(b)) for k, c, spans in zip(keys, contents, kernel(bodies, shards, window), strict=True) for a, b in spans]
            return _verdicts(out) if out else None

        for batch in batches:
            for key, content, body in zip(*(batch.column(n).to_pylist() for n in ("key", "content", "body")), strict=True):
                if key != last:
                    if size > _SHARD_BYTES:
                        if (found := judged()) is not None:
                            yield found
                        keys, contents, shards, bodies, size = [], [], [], [], 0
                    last, shard = key, shard + 1
                keys.append(key)
                contents.append(content)
                shards.append(shard)
                bodies.append(body)
                size += len(body)
        if bodies and (found := judged()) is not None:
            yield found

    return run


def _verdicts(out: list) -> pa.RecordBatch:
    key, content, a, b = zip(*out, strict=True)
    return pa.record_batch([pa.array(key, pa.int64()), pa.array(content, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["key", "content", "a", "b"])


_BODIES = "key long, content long, weight long, doc long, mark long, start int, body binary"
_PIECES = "key long, content long, doc long, mark long, start int, size int"


class _Judge:
    """Which tokens of pieces (key, content, doc, mark, start, size, weight) repeated windows cover."""

    def __init__(self, texts: DataFrame, unit: Unit, kernel: Callable, keep_first: bool):
        self.texts, self.unit, self.kernel, self.keep_first = texts, unit, kernel, keep_first

    def _bodies(self, classes: DataFrame) -> DataFrame:
        by_doc = classes.groupBy("doc", "mark").agg(F.collect_list(F.struct("key", "content", "weight", "start", "size")).alias("runs"))
        return self.texts.join(by_doc, ["doc", "mark"]).select("doc", "mark", "text", "runs").mapInArrow(_slices(self.unit), _BODIES)

    def judged(self, pieces: DataFrame, width: int) -> DataFrame:
        """key, content, n, head (doc, start of the first occurrence) and parts (spans in it) of classes with repeats.

        ``width`` is the range of places for shards that are too large; 0: no shard of several classes is left.
        """
        unit = self.unit
        classes = pieces.groupBy("key", "content").agg(F.min(F.struct("doc", "start", "mark", "size")).alias("first"), F.sum("weight").alias("n"))
        classes = written(classes, "repeats-classes")
        crowd = classes.groupBy("key").agg(F.count("*").alias("crowd")).where("crowd > 1")
        rims = written(classes.join(crowd.hint("merge"), "key").select("key", "content", "crowd", F.col("n").alias("weight"), "first.*"), "repeats-rims")

        shards = self._bodies(rims.where(F.col("crowd") <= unit.hot)).repartition("key").sortWithinPartitions("key", "doc", "start")
        verdicts = shards.select("key", "content", "body").mapInArrow(by_shard(self.kernel, unit.window), "key long, content long, a int, b int")
        hot = rims.where(F.col("crowd") > unit.hot)
        if width and hot.limit(1).count():
            inner = written(self._bodies(hot).mapInArrow(_redealt(unit, width), f"{_PIECES}, weight long, outer_key long, outer_content long, first int"), "repeats-redealt")
            found = inner.join(self.judged(inner, max(1, width // 4) if width > 1 else 0).hint("merge"), ["key", "content"])
            spans = F.explode(self.parts()).alias("p")
            found = found.select("outer_key", "outer_content", "first", spans).select(F.col("outer_key").alias("key"), F.col("outer_content").alias("content"), (F.col("first") + F.col("p.a")).alias("a"), (F.col("first") + F.col("p.b")).alias("b"))
            verdicts = verdicts.unionByName(found)

        judged = classes.join(verdicts.groupBy("key", "content").agg(F.collect_list(F.struct("a", "b")).alias("spans")), ["key", "content"], "left")
        judged = judged.where("n > 1 or spans is not null").select("key", "content", "n", "spans", F.struct("first.doc", "first.start").alias("head"))
        out = written(judged, "repeats-judged")
        discard(classes, rims)
        return out

    def parts(self):
        """Spans of a piece, joined with what was judged of its class, in its own tokens."""
        whole = F.array(F.struct(F.lit(0).alias("a"), (F.col("size") + self.unit.window - 1).alias("b")))
        if self.keep_first:
            return F.when(F.struct("doc", "start") != F.col("head"), whole).otherwise(F.col("spans"))
        return F.when(F.col("n") > 1, whole).otherwise(F.col("spans"))


def repeated_spans(docs: DataFrame, unit: Unit, kernel: Callable, *, keep_first: bool) -> tuple[DataFrame, DataFrame]:
    """Returns (texts, spans): ``texts(doc, mark, text)`` and ``spans(doc, mark, spans)``.

    ``docs`` has ``doc_id`` and ``text``.  ``spans`` lists, for documents that have any, the
    token spans covered by windows that also occur elsewhere; with ``keep_first``, by windows
    that also occur earlier (in order of document id, then start).  Rows that repeat both id
    and text are one document under both rules' order, and copies of each other otherwise.
    """
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))

    runs = written(texts.select("doc", "text").mapInArrow(_fingerprint(unit), "key long, doc long, run int"), "repeats-runs")
    # Written sides make joins that AQE can split: both children are plain shuffles.
    shared = written(runs.groupBy("key").count().where("count > 1").select("key"), "repeats-shared")
    wanted = runs.join(shared.hint("merge"), "key").groupBy("doc").agg(F.collect_list("run").alias("runs"))
    pieces = written(texts.join(wanted, "doc").select("doc", "mark", "text", "runs").mapInArrow(_cut(unit), _PIECES), "repeats-pieces")
    discard(runs, shared)

    judge = _Judge(texts, unit, kernel, keep_first)
    judged = judge.judged(pieces.withColumn("weight", F.lit(1).cast("long")), max(1, (unit.window - unit.gram + 1) // 4))
    found = (
        pieces.join(judged.hint("merge"), ["key", "content"])
        .select("doc", "mark", F.transform(judge.parts(), lambda p: F.struct((F.col("start") + p["a"]).alias("a"), (F.col("start") + p["b"]).alias("b"))).alias("parts"))
        .where("parts is not null")
        .groupBy("doc", "mark")
        .agg(F.flatten(F.collect_list("parts")).alias("spans"))
    )
    return texts, found


def apply_spans(texts: DataFrame, spans: DataFrame, unit: Unit) -> DataFrame:
    """One row per document: doc_id, n tokens, n_removed, spans (merged), kept (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            column = batch.column("spans").fill_null([]) if batch.column("spans").null_count else batch.column("spans")
            list_at, flat = _lists(column)
            pairs = np.column_stack((flat.field("a").to_numpy(zero_copy_only=False), flat.field("b").to_numpy(zero_copy_only=False))).astype(np.int64).reshape(-1, 2)
            for r0, r1, data, at in K.chunks(batch.column("text")):
                raw = data.tobytes()
                _, rows_at, w0, w1 = unit.tokens(data, at) if unit.kind == "words" else (None, at, None, None)
                total, removed, kept, merged = [], [], [], []
                for r in range(r0, r1):
                    cover = K.union(pairs[list_at[r] : list_at[r + 1]])
                    lo, n = int(rows_at[r - r0]), int(rows_at[r - r0 + 1] - rows_at[r - r0])
                    edges = [0, *cover.ravel().tolist(), n]
                    total.append(n)
                    removed.append(int((cover[:, 1] - cover[:, 0]).sum()))
                    merged.append([{"start": int(a), "end": int(b)} for a, b in cover])
                    stays = zip(edges[::2], edges[1::2], strict=True)
                    if w0 is None:
                        kept.append(b"".join(raw[lo + a : lo + b] for a, b in stays))
                    else:
                        kept.append(b" ".join(raw[w0[j] : w1[j]] for a, b in stays for j in range(lo + a, lo + b)))
                yield pa.record_batch(
                    [ids[r0:r1], pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(merged, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())],
                    ["doc_id", "n", "n_removed", "spans", "kept"],
                )

    joined = texts.join(spans, ["doc", "mark"], "left").select(F.expr(f"nullif(doc, {_NO_ID})").alias("doc_id"), "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n long, n_removed long, spans array<struct<start:int,end:int>>, kept binary")
