"""Token counts by section from one encoding of the whole document (operator 10).

A document is its fields joined by a separator.  It is encoded once, as a whole; tokens and
sections (fields, or the lines of fields) are both runs of byte intervals over it, so the
interval join is a merge of two sorted lists.  A token that crosses a boundary belongs to the
section that holds most of its bytes, and to the earliest of these on a tie.  A separator
belongs to the section before it, so every token belongs to exactly one section and the counts
of a document add up to the length of its encoding.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.shared import ship_package


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def attribute(ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens (their end offsets, the first starts at 0) and sections (start offsets and the end): counts, and how many cross.

    A crossing token counts where the majority rule puts it, for both numbers.
    """
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    n = len(bounds) - 1
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, ends, side="left") - 1
    owner = first.copy()
    crossing = np.flatnonzero(last > first)
    for t in crossing:
        edges = np.clip(bounds[first[t] : last[t] + 2], starts[t], ends[t])
        owner[t] = first[t] + int(np.argmax(np.diff(edges)))
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def _count(path: str, pattern: str, fields: list[str], separator: str, lines: bool) -> Callable:
    glue = separator.encode()

    def bounds_of(values: list[str | None]) -> tuple[bytes, list[int], list[int], list[int]]:
        parts, bounds, names, numbers, at = [], [], [], [], 0
        for k, v in enumerate(values):
            raw = (v or "").encode()
            end = at + len(raw) + (len(glue) if k + 1 < len(values) else 0)
            heads = [at]
            if lines and raw:
                cuts = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
                heads += [at + int(c) for c in cuts if c < len(raw)]
            if end > at:
                bounds += heads
                names += [k] * len(heads)
                numbers += range(len(heads))
            parts.append(raw)
            at = end
        return glue.join(parts), [*bounds, at], names, numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sizes = _encoding(path, pattern)
        for batch in batches:
            out: list[tuple] = []
            n_out = 0
            for doc, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw, bounds, names, numbers = bounds_of(values)
                if not names:
                    continue
                tokens = np.asarray(encoding.encode_to_numpy(raw.decode(), disallowed_special=()), np.int64)
                bounds = np.asarray(bounds)
                counts, crossing = attribute(np.cumsum(sizes[tokens]), bounds)
                # Characters before each bound: bytes that don't continue one.
                chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))[bounds]
                out.append((np.full(len(names), -1 if doc is None else doc), np.full(len(names), doc is None), np.asarray(names), np.asarray(numbers), bounds[:-1], bounds[1:], chars[:-1], chars[1:], counts, crossing))
                n_out += len(names)
                if n_out > 20_000:
                    yield _rows(out, fields)
                    out, n_out = [], 0
            if out:
                yield _rows(out, fields)

    return run


def _rows(out: list[tuple], fields: list[str]) -> pa.RecordBatch:
    doc, null, name, number, start, end, first, last, count, crossing = (np.concatenate(c) for c in zip(*out, strict=True))
    names = pa.array(fields).take(pa.array(name))
    return pa.record_batch(
        [pa.array(doc, mask=null), names, pa.array(number.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(end.astype(np.int64)), pa.array(first.astype(np.int64)), pa.array(last.astype(np.int64)), pa.array(count.astype(np.int64)), pa.array(crossing.astype(np.int64))],
        ["doc_id", "field", "section", "start_byte", "end_byte", "start_char", "end_char", "n_tokens", "n_crossing"],
    )


def count_tokens(docs: DataFrame, path: str, pattern: str, fields: list[str], *, id_column: str = "doc_id", separator: str = "\n\n", lines: bool = True) -> DataFrame:
    """Tokens of each section of each document, from one encoding of the whole document.

    ``path``: a rank file; ``pattern``: how texts are split before merges.  Returns doc_id,
    field, section (line number in the field from 0; 0 alone without ``lines``), start_byte,
    end_byte, start_char, end_char (in the joined document), n_tokens, n_crossing (of these,
    tokens that cross a boundary).  A crossing token goes to the section with most of its bytes,
    the first of several.  A very long document is encoded whole.  Null fields are empty; a document without any text has no sections and so no
    rows; repeated rows each give their rows; an empty table gives an empty result.
    """
    ship_package(docs.sparkSession)
    frame = docs.select(F.col(id_column).cast("long").alias("_id"), *(F.col(f).cast("string").alias(f"_f{i}") for i, f in enumerate(fields)))
    return frame.mapInArrow(_count(path, pattern, fields, separator, lines), "doc_id long, field string, section int, start_byte long, end_byte long, start_char long, end_char long, n_tokens long, n_crossing long")


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ["text"])
