"""Word-level substring deduplication with suffix automata of reference shards (operator 6).

The reference of a corpus is the corpus itself, cut into shards that hold what shares a
minimizer.  A shard's automaton is built in the task that streams the shard's pieces, in
order of document and position: each word first yields the length of the longest suffix that
the automaton has already seen (the matching statistic) and then joins it.  Positions whose
statistic reaches the window length end a repeated window.

Sending every shard's automaton to all documents would cost the square of the corpus, so
shards and pieces are brought together by their minimizer.  ``match_reference`` keeps the
broadcast form for a reference of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.kernels import union
from webloom.llm.repeats import Unit, apply_spans, repeated_spans
from webloom.shared import ship_package


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class SuffixAutomaton:
    """Online suffix automaton over hashable symbols; ``None`` separates texts."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.last = 0

    def add(self, symbol) -> int:
        """Appends a symbol; returns the length of the longest suffix that occurred before."""
        nxt, link, length = self.next, self.link, self.length
        state, here = self.last, len(nxt)
        if symbol in nxt[state]:
            target = nxt[state][symbol]
            self.last = target if length[target] == length[state] + 1 else self._clone(state, symbol, target)
            return length[self.last]
        nxt.append({})
        link.append(0)
        length.append(length[state] + 1)
        while state != -1 and symbol not in nxt[state]:
            nxt[state][symbol] = here
            state = link[state]
        if state != -1:
            target = nxt[state][symbol]
            link[here] = target if length[target] == length[state] + 1 else self._clone(state, symbol, target)
        self.last = here
        return length[link[here]]

    def _clone(self, state: int, symbol, target: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[target]))
        link.append(link[target])
        length.append(length[state] + 1)
        link[target] = copy
        while state != -1 and nxt[state].get(symbol) == target:
            nxt[state][symbol] = copy
            state = link[state]
        return copy

    def end_text(self) -> None:
        """The next symbol begins another text; matches never cross."""
        self.last = 0

    def statistics(self, symbols) -> list[int]:
        """Longest match that ends at each symbol, without adding anything."""
        state, size, out = 0, 0, []
        for s in symbols:
            while state and s not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if s in self.next[state]:
                state = self.next[state][s]
                size += 1
            else:
                size = 0
            out.append(size)
        return out


def _cover(statistics: list[int], window: int) -> np.ndarray:
    ends = np.flatnonzero(np.asarray(statistics) >= window) + 1
    return union(np.column_stack((ends - window, ends)))


def automaton_repeats(bodies: list[bytes], shards: list[int], window: int) -> list[np.ndarray]:
    """Words of each body covered by a window that an earlier place in its shard holds too."""
    found, shard, automaton = [], None, SuffixAutomaton()
    for body, number in zip(bodies, shards, strict=True):
        if number != shard:
            shard, automaton = number, SuffixAutomaton()
        found.append(_cover([automaton.add(w) for w in body.split(b" ")], window))
        automaton.end_text()
    return found


def dedup_words(docs: DataFrame, window: int = 20, gram: int = 8, hot: int = 1024) -> DataFrame:
    """Removes every word covered by a ``window``-word sequence that also starts earlier.

    ``docs``: doc_id, text; more columns are ignored.  Words lie between ASCII white space.
    Earlier is a smaller doc_id (null first) or an earlier start.  Returns doc_id, n (words),
    n_removed, spans (maximal removed runs of words), kept (binary: the other words joined by
    one space).  A very long text is handled whole.  Null text has no words; texts shorter than the window are kept; rows that
    repeat id and text are the same document, none earlier than the other; an empty table
    gives an empty result.
    ``hot`` bounds the classes, and so the automaton, of one shard; it changes no result.
    """
    if not 1 <= gram <= window:
        raise ValueError("gram must lie between 1 and window")
    unit = Unit("words", window, gram, hot)
    texts, spans = repeated_spans(docs, unit, automaton_repeats, keep_first=True)
    return apply_spans(texts, spans, unit)


def match_reference(docs: DataFrame, reference: list[str], window: int = 20, max_words: int = 200_000) -> DataFrame:
    """Spans of ``docs`` that repeat ``window`` words of a small reference, by broadcast automata.

    The reference's size is checked against ``max_words`` (its automaton takes about half a
    kilobyte a word).  Returns a row per row of docs: doc_id, spans of words.  Null texts have
    none; an empty reference matches nothing.
    """
    words = [_WORD.findall((t or "").encode()) for t in reference]
    if sum(map(len, words)) > max_words:
        raise ValueError("the reference exceeds max_words; add it to the corpus and use dedup_words")
    spark = docs.sparkSession
    ship_package(spark)
    automaton = SuffixAutomaton()
    for text in words:
        for w in text:
            automaton.add(w)
        automaton.end_text()
    shared = spark.sparkContext.broadcast((automaton.next, automaton.link, automaton.length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = SuffixAutomaton()
        own.next, own.link, own.length = shared.value
        for batch in batches:
            spans = [[{"start": int(a), "end": int(b)} for a, b in _cover(own.statistics(_WORD.findall((t or "").encode())), window)] for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, spans array<struct<start:int,end:int>>")


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.col("n").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, unnest(list_transform(range(1, len(w) - 18), lambda i: md5(array_to_string(w[i:i + 19], ' ')))) AS h FROM w WHERE len(w) >= 20),
d AS (SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
c AS (SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT doc_id, unnest(range(i, i + 20)) AS j FROM d) GROUP BY 1),
k AS (SELECT w.doc_id, len(w.w) AS n, coalesce(len(gone), 0) AS r, list_filter(w.w, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)) AS kept FROM w LEFT JOIN c USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
