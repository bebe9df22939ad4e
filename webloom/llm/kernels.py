"""Vectorised text kernels shared by the operators of this subpackage.

Everything here is plain numpy over Arrow buffers: no Spark import, so the kernels
are unit-testable and run unchanged inside ``mapInArrow``.  A record batch is worked
on in chunks of about ``CHUNK`` bytes (a longer document is a chunk of its own), so
memory follows the longest document and never the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19

_U = np.uint64
_ODD = 0x9E3779B97F4A7C15 | 1
_INV = pow(_ODD, -1, 1 << 64)
_HIGH = _U(0xFFFFFFFF00000000)
_LOW = _U(0x00000000FFFFFFFF)
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers so that every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(31))
        x = x * _U(0xD6E8FEB86659FD93)
        x ^= x >> _U(29)
        x *= _U(0xA3B195354A39B70D)
        return x ^ (x >> _U(32))


def _byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=_U) * _U(0xC2B2AE3D27D4EB4F))


_BYTE_CODES = _byte_codes()


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the longest length seen."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1024)
        with np.errstate(over="ignore"):
            have = np.empty(size, _U)
            have[0] = 1
            done = 1
            while done < size:
                step = min(done, size - done)
                have[done : done + step] = have[:step] * _U(pow(base, done, 1 << 64))
                done += step
        _POWERS[base] = have
    return have[:n]


class Prefix:
    """Prefix sums of a sequence of 64-bit symbols; hashes any span in constant time."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(n + 1, _U)
            np.cumsum(symbols * _powers(_ODD, n), out=self.sums[1:])
        self.back = _powers(_INV, n + 1)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[ends] - self.sums[starts]) * self.back[starts])

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all spans of k symbols, in order of their starts."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, _U)
        with np.errstate(over="ignore"):
            return mix((self.sums[k:] - self.sums[:n]) * self.back[:n])


def byte_symbols(data: np.ndarray) -> np.ndarray:
    return _BYTE_CODES[data]


#: Words this long are named by a cryptographic hash: from 1,024 letters on, pairs exist that any polynomial modulo 2^64 takes for one.
LONG_WORD = 256


def word_symbols(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit symbol for each word."""
    out = Prefix(byte_symbols(data)).spans(starts, ends)
    for i in np.flatnonzero(ends - starts >= LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, end row, bytes, row offsets in these bytes), never splitting a row."""
    data, at = buffers(column)
    row, n = 0, len(column)
    while row < n:
        end = int(np.searchsorted(at, at[row] + size, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def words(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes with ``inside[byte]``, never across rows: starts, ends, and row offsets in them."""
    n = len(data)
    here = inside[data]
    left = np.zeros(n + 1, bool)
    left[1:] = here
    left[at] = False
    right = np.zeros(n + 1, bool)
    right[:n] = here
    right[at] = False
    starts = np.flatnonzero(here & ~left[:n])
    ends = np.flatnonzero(here & ~right[1:]) + 1
    return starts, ends, np.searchsorted(starts, at)


def fold_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def byte_class(*spans: tuple[int, int]) -> np.ndarray:
    """A table that is true for the bytes of the given inclusive spans."""
    table = np.zeros(256, bool)
    for low, high in spans:
        table[low : high + 1] = True
    return table


#: Words between ASCII white space.
SPACED = byte_class((0, 8), (14, 31), (33, 255))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    low, span = values, 1
    while span * 2 <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    return np.minimum(low[:n], low[width - span : width - span + n])


def window_runs(symbols: np.ndarray, at: np.ndarray, window: int, k: int):
    """Groups the windows of each row by their minimizer.

    A window is ``window`` consecutive symbols of one row; its minimizer is the
    leftmost of its k-grams with the least hash, so equal windows have equal
    minimizers at equal places.  Windows that share one occurrence of a minimizer are
    consecutive: a run.  Returns row, first window (in the row), number of windows and
    the minimizer's hash, for all runs in order.
    """
    none = np.zeros(0, np.int64)
    if len(symbols) < window:
        return none, none, none, np.zeros(0, _U)
    grams = Prefix(symbols).grams(k)
    ranked = (grams & _HIGH) | np.arange(len(grams), dtype=_U)
    place = (sliding_min(ranked, window - k + 1) & _LOW).astype(np.int64)
    lengths = np.diff(at)
    count = np.maximum(lengths - window + 1, 0)  # windows of each row
    rows = np.repeat(np.arange(len(count)), count)
    if not len(rows):
        return none, none, none, np.zeros(0, _U)
    first = np.repeat(at[:-1] - np.concatenate(([0], np.cumsum(count)[:-1])), count)
    starts = first + np.arange(len(rows))
    place = place[starts]
    new = np.ones(len(rows), bool)
    new[1:] = (place[1:] != place[:-1]) | (rows[1:] != rows[:-1])
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, len(rows)))
    return rows[heads], starts[heads] - at[rows[heads]], sizes, grams[place[heads]]


def union(spans: np.ndarray) -> np.ndarray:
    """Merges overlapping or touching [start, end) rows, sorted by start."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] > reach[:-1]
    heads = np.flatnonzero(new)
    return np.column_stack((spans[heads, 0], reach[np.append(heads[1:], len(spans)) - 1]))
