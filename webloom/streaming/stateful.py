"""Keyed-state operators on streams: deduplication, throttling, leases, permits, event rings.

Each has a batch twin in ``operators.frontier``; the tests feed both the same rows.  The
reference knows no event time: leases run on processing time, so the lease operator takes the
clock of its rows (``at``) and a timer closes what no row touches again.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from webloom.operators.frontier import FOLLOWS, TERMINAL
from webloom.shared import ship_package


def first_sightings(stream: DataFrame, time_column: str = "at", horizon: str = "7 days") -> DataFrame:
    """The first row of each URL within the horizon; state is dropped behind the watermark."""
    return stream.withWatermark(time_column, horizon).dropDuplicatesWithinWatermark(["url"])


def throttled(stream: DataFrame, *, start: float = 100, low: float = 0, high: float = 30_000, smoothing: float = 0.3, concurrency: int = 1) -> DataFrame:
    """Adaptive delay of each origin after every micro-batch of outcomes (origin, seq, kind, latency_ms)."""
    ship_package(stream.sparkSession)

    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        delay, seen = state.get if state.exists else (float(start), 0)
        rows = pd.concat(list(frames)).sort_values("seq")
        for kind, latency in zip(rows["kind"], rows["latency_ms"], strict=True):
            target = min(max(latency / concurrency, low), high)
            if kind == "handled":
                delay = float(int(min(max(delay * (1 - smoothing) + target * smoothing, low), high) + 0.5))
            else:
                delay = max(delay, target, min(high, delay * 2))
            seen += 1
        state.update((delay, seen))
        yield pd.DataFrame({"origin": [key[0]], "outcomes": [seen], "delay_ms": [int(delay)]})

    return stream.groupBy("origin").applyInPandasWithState(run, "origin string, outcomes long, delay_ms long", "delay double, seen long", "update", GroupStateTimeout.NoTimeout)


def leases(stream: DataFrame, timeout_ms: int | None = 60_000) -> DataFrame:
    """State of each request after journal rows (request_id, sequence, type, at, expires_at).

    Rows that may not follow the state, or come with an old sequence, are rejected as stale.
    A leased request that no row touches for ``timeout_ms`` goes back to pending by a timer;
    with timers the query runs batches without data too, so it never becomes idle.
    """
    ship_package(stream.sparkSession)

    timeout = GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout

    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, sequence, rejected, expires = state.get if state.exists else ("", 0, 0, 0)
        if state.hasTimedOut:
            last, expires = "released", 0
        else:
            for r in pd.concat(list(frames)).sort_values("sequence").itertuples(index=False):
                if r.sequence <= sequence or r.type not in FOLLOWS.get(last or None, []):
                    rejected += 1
                    continue
                last, sequence = r.type, int(r.sequence)
                expires = int(r.expires_at) if r.expires_at == r.expires_at and r.expires_at is not None else 0
        kind = "terminal" if last in TERMINAL else "in_progress" if last in ("leased", "renewed") else "pending" if last else "unknown"
        state.update((last, sequence, rejected, expires))
        if kind == "in_progress" and timeout_ms is not None:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame({"request_id": [key[0]], "state": [kind], "sequence": [sequence], "rejected": [rejected]})

    return stream.groupBy("request_id").applyInPandasWithState(run, "request_id long, state string, sequence long, rejected long", "last string, sequence long, rejected long, expires long", "update", timeout)


def permits(stream: DataFrame, limit: int = 2, ttl: int = 60) -> DataFrame:
    """Grants at most ``limit`` permits per origin to rows (origin, seq, worker, action, at in seconds).

    ``acquire`` and ``renew`` set an expiry ``ttl`` seconds ahead, ``release`` gives one back;
    expired permits are free again.
    """
    ship_package(stream.sparkSession)

    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        workers, ends = (list(x) for x in state.get) if state.exists else ([], [])
        held = dict(zip(workers, ends, strict=True))
        out = []
        for r in pd.concat(list(frames)).sort_values("seq").itertuples(index=False):
            held = {w: e for w, e in held.items() if e > r.at}
            if r.action == "release":
                granted = held.pop(r.worker, None) is not None
            else:
                granted = r.worker in held or (r.action == "acquire" and len(held) < limit)
                if granted:
                    held[r.worker] = int(r.at) + ttl
            out.append((key[0], r.seq, r.worker, r.action, granted))
        state.update((list(held), list(held.values())))
        yield pd.DataFrame(out, columns=["origin", "seq", "worker", "action", "granted"])

    return stream.groupBy("origin").applyInPandasWithState(run, "origin string, seq long, worker string, action string, granted boolean", "workers array<string>, ends array<long>", "append", GroupStateTimeout.NoTimeout)


def robots_cache(stream: DataFrame, ttl: int = 86_400) -> DataFrame:
    """The policy in force after each row (origin, seq, at, text, error): a failed refresh keeps the stale one."""
    ship_package(stream.sparkSession)

    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, fetched = state.get if state.exists else (None, 0)
        out = []
        for r in pd.concat(list(frames)).sort_values("seq").itertuples(index=False):
            fresh = text is not None and r.at - fetched < ttl
            if fresh:
                source = "cached"
            elif isinstance(r.error, str):
                source = "stale" if text is not None else "unavailable"
            else:
                text, fetched, source = r.text, int(r.at), "fetched"
            out.append((key[0], r.seq, source, text))
        state.update((text, fetched))
        yield pd.DataFrame(out, columns=["origin", "seq", "source", "text"])

    return stream.groupBy("origin").applyInPandasWithState(run, "origin string, seq long, source string, text string", "text string, fetched long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, time_column: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per window and type with a watermark (additive: the reference has no event time)."""
    return stream.withWatermark(time_column, late).groupBy(F.window(time_column, width).alias("w"), "event_type").agg(F.count("*").alias("events")).select(F.col("w.start").alias("hour"), "event_type", "events")
