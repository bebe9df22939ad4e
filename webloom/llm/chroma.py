"""Chroma audio fingerprints and their alignment (operator 1).

Sound is cut into overlapping frames; each frame's spectrum is folded into twelve pitch
classes.  Sixteen rectangular filters, summed over an integral image of (frame, pitch class),
give two bits each: one 32-bit integer a frame.  Two recordings that share material share
integers at one constant offset, so a histogram of offsets aligns them and the bit errors under
the best offset decide.

Noise turns the bits first whose filter value lies next to a threshold.  A query therefore looks
up, besides each integer, all integers that differ from it in some of its ``DOUBT`` least certain
bits; so two integers meet in spite of bit errors, as long as these fall on bits in doubt.
A short overlap may have no such place, so these are compared one by one.

The tables have no audio column; the query reads the UTF-8 bytes of ``documents.text`` as
unsigned 8-bit samples.  ``fingerprints`` takes any binary or string column that way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import kernels as K
from webloom.shared import batches_of, discard, ship_package, written

SPAN = 8  # frames under one fingerprint integer
DOUBT = 7  # bits of an integer that a lookup may turn
BLOCK = 1 << 16  # integers of queries under one table of neighbours
MEETINGS = 1 << 20  # pairs of integers that are held at once
SHORT = 12  # integers of an overlap up to which every alignment is compared, met or not
_LEVELS = np.array([-0.1, 0.0, 0.1])  # thresholds of a filter's two bits (Gray code)


@dataclass(frozen=True)
class Audio:
    rate: int = 8000
    frame: int = 256
    hop: int = 64
    low: float = 60.0
    high: float = 3600.0


def pitch_classes(audio: Audio) -> np.ndarray:
    """Weights of spectrum bins (rows) in the twelve pitch classes."""
    f = np.arange(audio.frame // 2 + 1) * audio.rate / audio.frame
    out = np.zeros((len(f), 12))
    heard = np.flatnonzero((f >= audio.low) & (f <= audio.high))
    out[heard, np.round(12 * np.log2(f[heard] / 440)).astype(int) % 12] = 1
    return out


def _filters() -> list[tuple[int, int, int, int]]:
    """(shape, first class, classes, frames) by rule: every shape at spread places and sizes."""
    return [(i % 4, (5 * i) % 9, 4 if i % 3 else 2, (SPAN, SPAN // 2, SPAN)[i % 3]) for i in range(16)]


def chroma(samples: np.ndarray, audio: Audio) -> np.ndarray:
    """Twelve energies a frame, each frame scaled to unit length."""
    n = (len(samples) - audio.frame) // audio.hop + 1
    if n <= 0:
        return np.zeros((0, 12))
    weights, window = pitch_classes(audio), np.hanning(audio.frame).astype(np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples, audio.frame)[:: audio.hop][:n]
    out = np.empty((n, 12))
    for a in range(0, n, 4096):
        part = np.fft.rfft((frames[a : a + 4096] - frames[a : a + 4096].mean(1, keepdims=True)) * window)
        out[a : a + 4096] = (part.real**2 + part.imag**2) @ weights
    size = np.sqrt((out**2).sum(1, keepdims=True))
    return np.divide(out, size, out=np.zeros_like(out), where=size > 1e-9)


def fingerprint(features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed 32-bit integers, one for every SPAN consecutive frames, and the mask of each one's bits in doubt."""
    n = len(features) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    image = np.zeros((len(features) + 1, 13))
    image[1:, 1:] = features.cumsum(0).cumsum(1)
    at = np.arange(n)

    def box(x0: int, x1: int, y0: int, y1: int) -> np.ndarray:
        return image[at + x1, y1] - image[at + x0, y1] - image[at + x1, y0] + image[at + x0, y0]

    out = np.zeros(n, np.uint32)
    margin, bit = np.empty((n, 16), np.float32), np.empty((n, 16), np.uint32)
    for f, (shape, y, h, w) in enumerate(_filters()):
        if shape == 0:  # earlier against later
            a, b = box(0, w // 2, y, min(y + h, 12)), box(w // 2, w, y, min(y + h, 12))
        elif shape == 1:  # lower against higher classes
            a, b = box(0, w, y, y + h // 2), box(0, w, y + h // 2, min(y + h, 12))
        elif shape == 2:  # middle against its sides in time
            q = w // 4
            a, b = box(q, w - q, y, min(y + h, 12)), box(0, q, y, min(y + h, 12)) + box(w - q, w, y, min(y + h, 12))
        else:  # one diagonal against the other
            m, top = y + h // 2, min(y + h, 12)
            a, b = box(0, w // 2, y, m) + box(w // 2, w, m, top), box(0, w // 2, m, top) + box(w // 2, w, y, m)
        value = np.log((1 + a) / (1 + b))
        level = (value > _LEVELS[0]).astype(np.uint32) + (value > _LEVELS[1]) + (value > _LEVELS[2])
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1))).astype(np.uint32)
        size = np.abs(value)
        margin[:, f] = np.minimum(size, np.abs(size - _LEVELS[2]))
        # Crossing zero turns the filter's high bit, crossing an outer threshold its low bit.
        bit[:, f] = np.where(size < _LEVELS[2] / 2, np.uint32(2), np.uint32(1)) << np.uint32(2 * (15 - f))
    least = np.argpartition(margin, DOUBT, 1)[:, :DOUBT]
    return out, np.bitwise_or.reduce(np.take_along_axis(bit, least, 1), 1)


def _print(audio: Audio) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r0, r1, data, at in K.chunks(batch.column("sound")):
                both = [fingerprint(chroma(data[a:b].astype(np.float32) / 128 - 1, audio)) for a, b in zip(at[:-1], at[1:], strict=True)]
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(p) for p, _ in both]))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).view(np.int32))) for x in zip(*both, strict=True)]
                yield pa.record_batch([batch.column("doc")[r0:r1], *lists], ["doc", "print", "doubt"])

    return run


def fingerprints(recordings: DataFrame, id_column: str = "doc_id", sound_column: str = "text", audio: Audio = Audio()) -> DataFrame:
    """doc, print, doubt: the fingerprint of every recording and the masks of bits in doubt.

    Both are empty for null and for sound shorter than SPAN frames.  A very long recording is
    read whole, its spectra 4,096 frames at a time.
    """
    ship_package(recordings.sparkSession)
    sound = F.coalesce(F.col(sound_column).cast("binary"), F.lit(b""))
    frame = recordings.select(F.col(id_column).cast("long").alias("doc"), sound.alias("sound"))
    return frame.mapInArrow(_print(audio), "doc long, print array<int>, doubt array<int>")


def neighbours(value: np.ndarray, doubt: np.ndarray) -> np.ndarray:
    """A row for each integer: itself with every subset of its DOUBT bits in doubt turned."""
    out, rest = value[:, None], doubt.copy()
    for _ in range(DOUBT):
        lowest = rest & (~rest + np.uint32(1))
        rest ^= lowest
        out = np.concatenate((out, out ^ lowest[:, None]), 1)
    return out


@lru_cache(maxsize=1)
def _table(value: bytes, doubt: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All neighbours of some integers, ascending, and the place of the integer that each belongs to."""
    near = neighbours(np.frombuffer(value, np.uint32), np.frombuffer(doubt, np.uint32)).astype(np.uint64)
    near <<= np.uint64(32)
    near |= np.arange(len(near), dtype=np.uint64)[:, None]
    near = near.ravel()
    near.sort()
    return (near >> np.uint64(32)).astype(np.uint32), near.astype(np.uint32)


def _packed(most: int, columns: tuple[str, ...]) -> Callable:
    """Whole recordings in rows of ``most`` integers or a recording more: ids, sizes and the named columns, end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, parts, held = [], [], [[] for _ in columns], 0

        def row() -> pa.RecordBatch:
            whole = [np.array(ids, np.int64), np.array(sizes, np.int64), *(np.concatenate(p) for p in parts)]
            return pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in whole], ["ids", "sizes", *columns])

        for batch in batches:
            for doc, *lists in zip(batch.column("class").to_numpy(), *(batch.column(c) for c in columns), strict=True):
                ids.append(doc)
                sizes.append(len(lists[0]))
                for p, x in zip(parts, lists, strict=True):
                    p.append(x.values.to_numpy())
                held += sizes[-1]
                if held >= most:
                    yield row()
                    ids, sizes, parts, held = [], [], [[] for _ in columns], 0
        if ids:
            yield row()

    return run


class _Pack:
    """Recordings end to end, as ``_packed`` has them."""

    def __init__(self, ids: bytes, sizes: bytes, value: bytes):
        self.ids, self.size, self.value = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64), np.frombuffer(value, np.uint32)
        self.end = self.size.cumsum()
        self.at = self.end - self.size
        self.owner = np.repeat(np.arange(len(self.ids)), self.size)


def _upto(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items that reach ``most`` together, one item at least; ``ends`` are the sums of their sizes."""
    i = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def _alike(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a_at`` and ``b_at`` of all pairs of windows of ``n`` integers with ``most`` wrong bits at most."""

    def words(value: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at), n + n % 2), np.uint32)
        out[:, :n] = value[at[:, None] + np.arange(n)]
        return np.ascontiguousarray(out.view(np.uint64).T)

    x, found = words(a, a_at), [np.zeros((2, 0), np.int64)]
    first = min(len(x), 3 if n < 10 else 4)  # words that rule out nearly all pairs
    for j in range(0, len(b_at), 4096):
        y = words(b, b_at[j : j + 4096])
        for i in range(0, len(a_at), 64):
            wrong = np.bitwise_count(x[0, i : i + 64, None] ^ y[0])
            for k in range(1, first):
                wrong += np.bitwise_count(x[k, i : i + 64, None] ^ y[k])  # 256 would be 0, which the whole count corrects
            if len(near := np.flatnonzero(wrong <= most)):
                p, q = np.divmod(near, y.shape[1])
                good = np.bitwise_count(x[:, i + p] ^ y[:, q]).sum(0, dtype=np.int64) <= most
                found.append(np.stack((i + p[good], j + q[good])))
    return tuple(np.concatenate(found, 1))


def _short(asked: _Pack, others: _Pack, i: int, j: int, least: int, most_wrong: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, recording, offset) of all matches with recordings i .. j - 1 whose overlap has SHORT integers at most."""
    for n in range(least, SHORT + 1):
        q, c = np.flatnonzero(asked.size >= n), i + np.flatnonzero(others.size[i:j] >= n)
        q_all = np.flatnonzero(np.arange(len(asked.value)) + n <= asked.end[asked.owner])
        c_all = np.arange(others.at[i], others.end[j - 1])
        c_all = c_all[c_all + n <= others.end[others.owner[c_all]]]
        # An overlap ends with both recordings' ends, or is the whole of one of them.
        for a_at, b_at in ((asked.end[q] - n, others.at[c]), (asked.at[q], others.end[c] - n), (asked.at[asked.size == n], c_all), (q_all, others.at[c[others.size[c] == n]])):
            p, r = _alike(asked.value, a_at, others.value, b_at, n, int(most_wrong * n)) if len(a_at) and len(b_at) else (q[:0], c[:0])
            p, r = a_at[p], b_at[r]
            q_of, c_of = asked.owner[p], others.owner[r]
            yield q_of, c_of, (r - others.at[c_of]) - (p - asked.at[q_of])


def _met(asked: _Pack, doubt: np.ndarray, others: _Pack, least: int, most_wrong: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All (query, recording, offset) at which an integer of the recording is a neighbour of one of the query, and short matches, once each."""
    b, order = others.value, np.argsort(others.value)
    found = []
    for p in range(0, len(asked.value), BLOCK):
        value, place = _table(asked.value[p : p + BLOCK].tobytes(), doubt[p : p + BLOCK].tobytes())
        low, count = np.empty(len(b), np.int64), np.empty(len(b), np.int64)
        low[order] = np.searchsorted(value, b[order], "left")
        count[order] = np.searchsorted(value, b[order], "right") - low[order]
        found.append((p, place, low, count))
    span = int(asked.size.max() + others.size.max())

    def key(q: np.ndarray, c: np.ndarray, offset: np.ndarray) -> np.ndarray:
        return (q * len(others.ids) + c) * span + offset + asked.size.max()

    total = np.sum([x[3] for x in found], 0).cumsum()
    for i, j in _upto(total[others.end - 1], MEETINGS):
        keys = [key(*x) for x in _short(asked, others, i, j, least, most_wrong)]
        for p, place, low, count in found:
            begin, own = others.at[i], count[others.at[i] : others.end[j - 1]]
            for s, e in _upto(own.cumsum(), MEETINGS):
                n = own[s:e]
                at = np.repeat(np.arange(begin + s, begin + e), n)
                q_at = p + place[np.repeat(low[begin + s : begin + e] - (n.cumsum() - n), n) + np.arange(n.sum())].astype(np.int64)
                q, c = asked.owner[q_at], others.owner[at]
                offset = (at - others.at[c]) - (q_at - asked.at[q])
                keys.append(np.unique(key(q, c, offset)))
        pair, offset = np.divmod(np.unique(np.concatenate(keys)), span)
        yield pair // len(others.ids), pair % len(others.ids), offset - asked.size.max()


def search(asked: _Pack, doubt: np.ndarray, others: _Pack, least: int, most_wrong: float) -> Iterator[tuple[np.ndarray, ...]]:
    """query, recording (places), votes, offset, overlap, bit_errors: the best alignment of each pair that matches."""
    for q, c, offset in _met(asked, doubt, others, max(1, least), most_wrong):
        overlap = np.minimum(asked.size[q], others.size[c] - offset) - np.maximum(0, -offset)
        fits = np.flatnonzero((overlap >= max(1, least)) & (asked.ids[q] != others.ids[c]))
        q, c, offset, overlap = (x[fits] for x in (q, c, offset, overlap))
        a_at, b_at = asked.at[q] + np.maximum(0, -offset), others.at[c] + np.maximum(0, offset)

        def compared(some: np.ndarray, judge: Callable) -> np.ndarray:
            """The sum of ``judge(differing bits, place in the queries)`` over each overlap."""
            out = np.empty(len(some), np.int64)
            for i, j in _upto(overlap[some].cumsum(), MEETINGS):
                n = overlap[some[i:j]]
                heads = n.cumsum() - n
                step = np.arange(n.sum()) - np.repeat(heads, n)
                at = np.repeat(a_at[some[i:j]], n) + step
                out[i:j] = np.add.reduceat(judge(asked.value[at] ^ others.value[np.repeat(b_at[some[i:j]], n) + step], at), heads, dtype=np.int64)
            return out

        wrong = compared(np.arange(len(q)), lambda x, at: np.bitwise_count(x))
        good = np.flatnonzero(wrong <= most_wrong * overlap)
        votes = compared(good, lambda x, at: (x & ~doubt[at]) == 0)
        q, c, offset, overlap, wrong = (x[good] for x in (q, c, offset, overlap, wrong))
        order = np.lexsort((offset, -np.abs(offset), votes, c, q))
        q, c = q[order], c[order]
        last = np.ones(len(order), bool)
        last[:-1] = (q[1:] != q[:-1]) | (c[1:] != c[:-1])
        order = order[last]
        if len(order):
            yield q[last], c[last], votes[order], offset[order], overlap[order], wrong[order]


def _searched(least: int, error_rate: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q_sizes, value, doubt, c_ids, c_sizes, other in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                asked, others = _Pack(q_ids, q_sizes, value), _Pack(c_ids, c_sizes, other)
                for q, c, _, *found in search(asked, np.frombuffer(doubt, np.uint32), others, least, error_rate * 32):
                    columns = [pa.array(asked.ids[q]), pa.array(others.ids[c]), *(pa.array(x.astype(np.int32)) for x in (asked.size[q], *found))]
                    yield pa.record_batch(columns, ["query", "class", "n_frames", "offset", "overlap", "bit_errors"])

    return run


def align(prints: DataFrame, every: int = 50, least_overlap: int = 8, error_rate: float = 0.2) -> DataFrame:
    """Searches all recordings for material of the queries (ids divisible by ``every``).

    ``prints``: doc, print, doubt (see ``fingerprints``).  Recordings with equal prints are one
    class.  A class with a query looks up every integer of it and the neighbours that its bits in
    doubt allow.  The offsets at which a class meets it are counted, and the bit errors are taken
    under each of them; of those that match, the one that most integers agree on is returned (ties:
    the offset nearest to zero, then the larger).  So a match is found if at one place of its
    overlap the two integers differ in bits in doubt only; a short one, of SHORT common frames or
    fewer, is found in any case, as all such alignments are compared.  Returns a row per recording (doc_id,
    class_id, n_frames, and nulls), and for each match of a query class a row of its first
    recording with match_class, offset, overlap and bit_errors; a match has at least
    ``least_overlap`` common frames and at most ``error_rate`` wrong bits.  Copies of a match are
    the members of its class.  Recordings without integers match nothing; null ids are returned
    but never queries; repeated rows are copies; an empty table gives none.

    The queries are dealt into blocks and the classes into packs of bounded size, and each block
    meets each pack once, in one task, where a sorted table of the block's neighbours finds the
    offsets and both prints are at hand to judge them.  Only matches leave it.
    """
    spark = prints.sparkSession
    ship_package(spark)
    mark = F.when(F.size("print") > 0, F.sha2(F.array_join("print", ",").cast("binary"), 256))
    prints = written(prints.withColumn("mark", mark), "chroma-prints")
    # An overlap has ``least_overlap`` integers at least, so shorter prints meet nothing: each is its own class.
    known = prints.where("mark is not null")
    classes = known.groupBy("mark").agg(F.min("doc").alias("class"), F.first("print").alias("print"), F.min("doubt").alias("doubt"), F.max(F.coalesce(F.col("doc") % every == 0, F.lit(False))).alias("asked"))
    classes = written(classes.where("class is not null"), "chroma-classes")
    long = classes.where(F.size("print") >= least_overlap)
    asked = long.where("asked").select("class", "print", "doubt")
    integers = asked.agg(F.sum(F.size("print"))).first()[0] or 0
    blocks = asked.repartition(1 + 2 * integers // BLOCK).mapInArrow(_packed(BLOCK, ("print", "doubt")), "ids binary, sizes binary, print binary, doubt binary")
    packs = long.select("class", "print").mapInArrow(_packed(4 * BLOCK, ("print",)), "ids binary, sizes binary, print binary")
    blocks, packs = written(blocks, "chroma-blocks"), written(packs, "chroma-packs")
    # The rows of one block follow each other, so its table is made once in a task, or kept from the last.
    met = blocks.hint("shuffle_replicate_nl").crossJoin(packs.toDF("other_ids", "other_sizes", "other_print"))
    found = met.mapInArrow(_searched(least_overlap, error_rate), "query long, class long, n_frames int, offset int, overlap int, bit_errors int")
    with batches_of(spark, 8):
        matches = written(found, "chroma-matches")
    discard(blocks, packs)
    none = F.lit(None)
    members = prints.select("doc", "mark", F.size("print").alias("n_frames")).join(classes.select("mark", "class").hint("merge"), "mark", "left")
    rows = members.select(F.col("doc").alias("doc_id"), F.coalesce("class", "doc").alias("class_id"), "n_frames", none.cast("long").alias("match_class"), none.cast("int").alias("offset"), none.cast("int").alias("overlap"), none.cast("int").alias("bit_errors"))
    return rows.unionByName(matches.select(F.col("query").alias("doc_id"), F.col("query").alias("class_id"), "n_frames", F.col("class").alias("match_class"), "offset", "overlap", "bit_errors"))


def op1_chroma_fingerprints(spark, sf_dir: str) -> DataFrame:
    return align(fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")))
