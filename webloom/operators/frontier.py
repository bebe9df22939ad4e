"""Frontier order, leases, journals and throttling, as batch operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Priorities of enqueue sources.
PRIORITIES = {"seed": 100, "robots-sitemap": 90, "sitemap-index": 80, "sitemap": 70, "html-link": 60, "javascript-static": 50, "css-static": 45, "feed": 40, "redirect": 30, "manual": 20, "hook": 10}
TERMINAL = ["handled", "failed", "skipped", "cancelled"]


def priority(source: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for name, value in PRIORITIES.items():
        out = out.when(source == name, value)
    return out.otherwise(0)


def order(strategy: str = "priority", seq: str = "seq") -> list[Column]:
    """Lease order: priority (then depth, then insertion), bfs (insertion) or dfs (latest first)."""
    if strategy == "bfs":
        return [F.col(seq)]
    if strategy == "dfs":
        return [F.desc(seq)]
    return [F.desc("priority"), F.col("depth"), F.col(seq)]


def ready(requests: DataFrame, strategy: str = "priority", limit: int = 128) -> DataFrame:
    """The best pending request of each origin, best origins first, at most ``limit``."""
    best = F.row_number().over(Window.partitionBy("origin").orderBy(*order(strategy)))
    return requests.where("state = 'pending'").withColumn("_n", best).where("_n = 1").drop("_n").orderBy(*order(strategy)).limit(limit)


def first_sightings(inputs: DataFrame) -> DataFrame:
    """Adds status: enqueued for the first row of each URL, already_seen for the others, invalid_url for null."""
    nth = F.row_number().over(Window.partitionBy("url").orderBy("seq"))
    return inputs.withColumn("status", F.when(F.col("url").isNull(), "invalid_url").when(nth == 1, "enqueued").otherwise("already_seen"))


def state_counts(requests: DataFrame) -> DataFrame:
    """One row: pending, in_progress, outstanding, deferred lease expiries and terminal requests."""
    state = F.col("state")
    return requests.agg(
        F.count_if(state == "pending").alias("pending"), F.count_if(state == "in_progress").alias("in_progress"), F.count_if(state.isin("pending", "in_progress")).alias("outstanding"),
        F.count_if(state.isin(*TERMINAL)).alias("terminal"), F.min(F.when(state == "in_progress", F.col("expires_at"))).alias("next_expiry"),
    )


def recover(journal: DataFrame, now: int) -> DataFrame:
    """Last state of each request of a journal (request_id, sequence, type, expires_at).

    Terminal records end a request; a lease that has run out goes back to pending and counts as
    recovered; a live one is deferred.
    """
    last = journal.groupBy("request_id").agg(F.max_by(F.struct("type", "expires_at"), "sequence").alias("last"), F.count("*").alias("records"))
    kind, expires = F.col("last.type"), F.col("last.expires_at")
    leased = kind.isin("leased", "renewed")
    state = F.when(leased & (expires <= now), "pending").when(leased, "deferred").when(kind.isin("enqueued", "released"), "pending").otherwise("terminal")
    return last.select("request_id", "records", state.alias("state"), (leased & (expires <= now)).alias("recovered"))


def record_text(*columns: str) -> Column:
    """The text a journal record's checksum covers."""
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))


def chained(journal: DataFrame, columns: tuple[str, ...] = ("request_id", "sequence", "type", "at")) -> DataFrame:
    """Adds checksum (of the record) and previous (the checksum of the record before it in its journal)."""
    sums = journal.withColumn("checksum", F.sha2(record_text(*columns).cast("binary"), 256))
    return sums.withColumn("previous", F.lag("checksum").over(Window.partitionBy("request_id").orderBy("sequence")))


def chain_faults(records: DataFrame, columns: tuple[str, ...] = ("request_id", "sequence", "type", "at")) -> DataFrame:
    """Records whose sequence, link to the record before, or checksum is wrong: adds fault."""
    w = Window.partitionBy("request_id").orderBy("sequence")
    before = F.lag("sequence").over(w)
    link = F.lag("checksum").over(w)
    fault = (
        F.when(F.col("sequence") != F.coalesce(before + 1, F.lit(1)), "sequence")
        .when(~F.col("previous").eqNullSafe(link), "previous")
        .when(F.col("checksum") != F.sha2(record_text(*columns).cast("binary"), 256), "checksum")
    )
    return records.withColumn("fault", fault).where("fault is not null")


#: Record types that may follow each type (None: the first record).
FOLLOWS = {None: ["enqueued"], "enqueued": ["leased", "skipped", "cancelled"], "leased": ["renewed", "released", *TERMINAL], "renewed": ["renewed", "released", *TERMINAL], "released": ["leased", "skipped", "cancelled"]}


def transition_faults(journal: DataFrame) -> DataFrame:
    """Records whose type may not follow the one before it."""
    before = F.lag("type").over(Window.partitionBy("request_id").orderBy("sequence"))
    valid = F.lit(False)
    for last, following in FOLLOWS.items():
        valid = valid | (before.eqNullSafe(F.lit(last)) & F.col("type").isin(*following))
    return journal.withColumn("before", before).withColumn("valid", valid).where("not valid").drop("valid")


def throttled(outcomes: DataFrame, *, start: int = 100, low: int = 0, high: int = 30_000, smoothing: float = 0.3, concurrency: int = 1) -> DataFrame:
    """Adaptive delay of each origin after its outcomes (origin, seq, kind, latency_ms), in order of seq.

    Success moves the delay towards the latency; failure doubles it within bounds.
    """
    steps = F.array_sort(F.collect_list(F.struct("seq", F.col("kind").alias("kind"), F.col("latency_ms").cast("double").alias("latency"))))
    clamp = lambda x: F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))

    def step(delay: Column, s: Column) -> Column:
        target = clamp(s["latency"] / concurrency)
        up = F.greatest(delay, target, F.least(F.lit(float(high)), delay * 2))
        eased = F.floor(clamp(delay * (1 - smoothing) + target * smoothing) + 0.5).cast("double")
        return F.when(s["kind"] == "handled", eased).otherwise(up)

    return outcomes.groupBy("origin").agg(steps.alias("steps")).select("origin", F.size("steps").cast("long").alias("outcomes"), F.aggregate("steps", F.lit(float(start)), step).cast("long").alias("delay_ms"))


def next_allowed(now: Column, delay: Column, *, minimum: int = 0, per_minute: int | None = None) -> Column:
    gap = F.lit(60_000 / per_minute if per_minute else 0.0)
    return now + F.greatest(F.lit(float(minimum)), gap, delay)


def origin_stats(outcomes: DataFrame) -> DataFrame:
    failed = F.col("kind") != "handled"
    return outcomes.groupBy("origin").agg(F.count("*").alias("requests"), F.count_if(failed).alias("failures"), F.floor(F.sum("latency_ms") / F.count("*")).cast("long").alias("mean_latency_ms"), F.max("latency_ms").alias("max_latency_ms"))


def retry_delay(status: Column, retry_after: Column, attempt: Column, now: Column, backoff: int = 1000) -> Column:
    """Milliseconds until the next attempt: Retry-After seconds or date, else backoff doubled per attempt."""
    seconds = retry_after.try_cast("double") * 1000
    date = F.greatest(F.lit(0), (F.unix_timestamp(F.try_to_timestamp(retry_after, F.lit("EEE, dd MMM yyyy HH:mm:ss 'GMT'"))) - now) * 1000).cast("double")
    return F.when(status.isin(429, 500, 502, 503, 504), F.coalesce(seconds, F.when(F.length(retry_after) > 28, date), F.lit(backoff) * F.pow(F.lit(2.0), attempt)).cast("long"))


def dropped_events(events: DataFrame, capacity: int, subscriber: str = "user_id") -> DataFrame:
    """A ring of ``capacity`` newest events per subscriber: kept, dropped, and the oldest kept event."""
    nth = F.row_number().over(Window.partitionBy(subscriber).orderBy(F.desc("ts"), F.desc("event_id")))
    kept = F.col("_n") <= capacity
    return events.withColumn("_n", nth).groupBy(subscriber).agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped"), F.min(F.when(kept, F.col("event_id"))).alias("least_kept_event"))


def peak(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """Most intervals open at once.  Ends free their place before starts of the same instant.

    Steps are summed per instant first, then day by day, so only one row a day is scanned in order.
    """
    steps = intervals.select(F.col(start).alias("at"), F.lit(1).alias("d")).unionAll(intervals.select(F.col(end).alias("at"), F.lit(-1).alias("d")))
    steps = steps.groupBy("at").agg(F.sum(F.when(F.col("d") < 0, F.col("d")).otherwise(0)).alias("down"), F.sum(F.when(F.col("d") > 0, F.col("d")).otherwise(0)).alias("up"))
    steps = steps.withColumn("day", F.to_date("at"))
    run = F.sum(F.col("down") + F.col("up")).over(Window.partitionBy("day").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    days = steps.withColumn("run", run).groupBy("day").agg(F.max("run").alias("top"), F.sum(F.col("down") + F.col("up")).alias("net"))
    # One row a day: a bounded, ordered scan.
    before = F.coalesce(F.sum("net").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return days.withColumn("peak", F.col("top") + before).agg(F.max("peak").alias("peak"))
