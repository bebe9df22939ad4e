"""Scope, robots and admission decisions."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.functions import robots_kernel
from webloom.functions import urls as U
from webloom.shared import discard, ship_package, written


@dataclass(frozen=True)
class Scope:
    mode: str = "origin"  # origin, host, domain or custom
    max_url_length: int = 2048
    max_segments: int = 20
    max_query_params: int = 20
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    allowed_hosts: tuple[str, ...] = ()
    denied_hosts: tuple[str, ...] = ()
    max_per_directory: int = 10_000
    max_per_pattern: int = 10_000
    seeds: tuple[str, ...] = field(default=())


def in_mode(url: Column, seed: Column, mode: str) -> Column:
    """Whether a URL belongs to its seed's origin, host or domain (equal or a subdomain)."""
    if mode == "custom":
        return F.lit(True)
    if mode == "origin":
        return U.origin(url) == U.origin(seed)
    host, own = U.host(url), U.host(seed)
    return host == own if mode == "host" else (host == own) | F.endswith(host, F.concat(F.lit("."), own))


def scope_reason(url: Column, depth: Column, seed: Column, scope: Scope) -> Column:
    """The first rule that a normalised URL breaks, or null."""
    host = U.host(url)
    out = F.when(url.isNull(), "url").when(~url.rlike("^https?://"), "protocol")
    out = out.when(F.length(url) > scope.max_url_length, "url-length").when(U.path_segments(url) > scope.max_segments, "path-segments").when(U.query_param_count(url) > scope.max_query_params, "query-params")
    if scope.denied_hosts:
        out = out.when(host.isin(*scope.denied_hosts), "denied-host")
    if scope.allowed_hosts:
        out = out.when(~host.isin(*scope.allowed_hosts), "allowed-host")
    for pattern in scope.exclude:
        out = out.when(url.rlike(U.glob_regex(pattern)), "exclude")
    if scope.include:
        out = out.when(~url.rlike("|".join(U.glob_regex(p) for p in scope.include)), "include")
    return out.when(~F.coalesce(in_mode(url, seed, scope.mode), F.lit(False)), "scope").when(depth < 0, "depth")


def resolve_seeds(urls: DataFrame, seeds: DataFrame) -> DataFrame:
    """Adds seed_url: the seed equal to the URL, else the first seed of its origin, else null.

    ``seeds``: ordinal, seed_url.  Two equi-joins on pre-aggregated seeds, no theta join.
    """
    exact = seeds.groupBy(F.col("seed_url").alias("url")).agg(F.min("ordinal").alias("_o")).select("url", F.col("url").alias("_exact"))
    first = seeds.groupBy(U.origin(F.col("seed_url")).alias("_origin")).agg(F.min_by("seed_url", "ordinal").alias("_first"))
    joined = urls.join(exact, "url", "left").withColumn("_origin", U.origin(F.col("url"))).join(first, "_origin", "left")
    return joined.withColumn("seed_url", F.coalesce("_exact", "_first")).drop("_exact", "_first", "_origin")


def public_address(address: Column) -> Column:
    """Whether a resolved address is publicly routable; null for a text that is none."""

    @F.pandas_udf("boolean")
    def run(values: pd.Series) -> pd.Series:
        def one(v: str | None) -> bool | None:
            try:
                return ipaddress.ip_address(v or "").is_global
            except ValueError:
                return None

        return values.map(one).astype(object)

    return run(address)


def robots_rules(robots: DataFrame, token: str) -> DataFrame:
    """What robots files say to a product token: origin, failed, missing, patterns, allows, crawl_delay.

    ``robots``: origin, status, text, error; one row per origin.  Each text is parsed once here.
    A network error or 5xx disallows everything (failed); 4xx or no text allows it (missing).
    """
    ship_package(robots.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for origin, failed, missing, text in frame.itertuples(index=False, name=None):
                policy = robots_kernel.parse("" if failed or missing else text)
                rules = robots_kernel.rules_for(policy, token)
                out.append((origin, failed, missing, [p for _, p in rules], [a for a, _ in rules], robots_kernel.crawl_delay(policy, token)))
            yield pd.DataFrame(out, columns=["origin", "failed", "missing", "patterns", "allows", "crawl_delay"])

    failed = F.col("error").isNotNull() | F.coalesce(F.col("status") >= 500, F.lit(False))
    missing = F.coalesce(F.col("status").between(400, 499), F.lit(False)) | F.col("text").isNull()
    rows = robots.select("origin", failed.alias("failed"), missing.alias("missing"), "text")
    return rows.mapInPandas(run, "origin string, failed boolean, missing boolean, patterns array<string>, allows array<boolean>, crawl_delay double")


def robots_decisions(urls: DataFrame, robots: DataFrame, token: str = "robot") -> DataFrame:
    """Adds allowed and crawl_delay to URLs, by the rules of their origins (see ``robots_rules``); no row allows.

    Only the rules that bind the token meet the URLs, never the texts.
    """
    rules = written(robots_rules(robots, token), "robots-rules")
    rules = rules.select(F.col("origin").alias("_origin"), *(F.col(c).alias(f"_{c}") for c in rules.columns[1:]))
    joined = urls.withColumn("_origin", U.origin(F.col("url"))).join(rules, "_origin", "left")

    @F.pandas_udf("boolean")
    def run(url: pd.Series, patterns: pd.Series, allows: pd.Series) -> pd.Series:
        def one(u: str | None, p: list | None, a: list | None) -> bool:
            rest = u.split("://", 1)[1] if u and "://" in u else ""
            return robots_kernel.decide([] if p is None else list(zip(a, p, strict=True)), "/" + rest.partition("/")[2])

        return pd.Series([one(*r) for r in zip(url, patterns, allows, strict=True)], dtype=object)

    ruled = F.coalesce(F.size("_patterns") > 0, F.lit(False))
    joined = joined.withColumn("_asked", run("url", "_patterns", "_allows"))
    allowed = F.when(F.col("_failed"), False).when(F.col("_missing") | ~ruled, True).otherwise(F.col("_asked"))
    return joined.select(*urls.columns, allowed.alias("allowed"), F.when(~F.col("_failed") & ~F.col("_missing"), F.col("_crawl_delay")).alias("crawl_delay"))


#: Sources of requests for sitemap files.
SITEMAP_FILES = ("robots-sitemap", "sitemap-index")
#: Beyond every sequence number.
_OPEN = (1 << 63) - 1


def _ranked_until(members: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """``end``: the ``seq`` of the cap-th member of each key; later rows find the cap reached.

    Members are counted first, and only keys that have as many are ranked; ranking stops at the
    cap in every task before the shuffle, so one key with very many rows sends ``cap`` of them
    at most.  Keys below their cap have no row.
    """
    if cap <= 1:  # the first member; without room at all every row comes too late
        return members.groupBy(*keys).agg((F.min("seq") if cap == 1 else F.min(F.lit(-1))).alias("end"))
    full = members.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= cap).select(*keys)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))
    ranked = members.join(full, keys, "left_semi").withColumn("_n", nth).where(F.col("_n") <= cap)
    return ranked.where(F.col("_n") == cap).select(*keys, F.col("seq").alias("end"))


def _ends(members: DataFrame, keys: list[str], caps: dict[str, int]) -> DataFrame:
    """``_ranked_until`` of every kind of key by its own cap; ``members``: kind, key, seq."""
    out = None
    for kind, cap in caps.items():
        part = _ranked_until(members.where(F.col("kind") == kind), keys, cap)
        out = part if out is None else out.unionByName(part)
    return out


def _cut(members: DataFrame, cap: int) -> int:
    """The ``seq`` of the cap-th member of all, or beyond every one where they are fewer."""
    if cap <= 0:
        return -1
    found = members.select("seq").orderBy("seq").limit(cap).agg(F.count("*"), F.max("seq")).first()
    return found[1] if found[0] == cap else _OPEN


def _settled(events: DataFrame, caps: dict[str, int]) -> DataFrame:
    """seq of the rows that are enqueued when each is decided in order of seq.

    ``events``: part, seq, sure, keys (array of kind and key; no key occurs in two parts).  Rows
    stream through the task of their part, which holds one counter a key and no rows; a sure row
    is counted without being asked.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[tuple[str, str], int] = {}
        for frame in frames:
            taken = []
            for seq, sure, keys in frame.itertuples(index=False, name=None):
                mine = [(k["kind"], k["key"]) for k in keys]
                if sure or all(counts.get(k, 0) < caps[k[0]] for k in mine):
                    for k in mine:
                        counts[k] = counts.get(k, 0) + 1
                    if not sure:
                        taken.append(seq)
            yield pd.DataFrame({"seq": taken}, dtype="int64")

    return events.repartition("part").sortWithinPartitions("seq", "sure").select("seq", "sure", "keys").mapInPandas(run, "seq long")


def _members(firsts: DataFrame, known: DataFrame | None, caps: dict[str, int], room: int) -> tuple[DataFrame, list[DataFrame]]:
    """The rows of ``firsts`` that are enqueued if the run has no cap, as far as ``room`` of them, and the tables they read.

    ``firsts``: seq, seed_url, keys (array of kind and key); ``known``: key arrays of what was
    enqueued before.  Three steps: rows whose keys all stay within their caps need no decision.
    Of the others, those are sure that find room even if every earlier row is enqueued, and
    those are out that find a cap reached by sure rows alone.  What is left waits for other rows
    and is decided in order, a part at a time (see ``_settled``).
    """
    flat = firsts.select("seq", "seed_url", F.inline("keys"))
    if known is not None:
        flat = flat.unionByName(known.select(F.lit(-1).cast("long").alias("seq"), F.lit(None).cast("string").alias("seed_url"), F.inline("keys")))
    cap = F.create_map(*(F.lit(x) for kv in caps.items() for x in kv))[F.col("kind")]
    tight = flat.groupBy("kind", "key").agg(F.count("*").alias("n")).where(F.col("n") > cap).select("kind", "key")
    bound = written(flat.join(tight, ["kind", "key"], "left_semi"), "admission-bound")
    if bound.isEmpty():
        discard(bound)
        return firsts.select("seq"), []
    key = ["kind", "key"]
    late = lambda ends: bound.where("seq >= 0").join(ends, key).where("seq > end").select("seq").distinct()
    unsure = written(late(_ends(bound, key, caps)), "admission-unsure")
    sure = bound.join(unsure, "seq", "left_anti")
    out = late(_ends(sure, key, caps))
    stop = _cut(firsts.join(unsure, "seq", "left_anti"), room)
    open_ = written(unsure.where(F.col("seq") <= stop).join(out, "seq", "left_anti"), "admission-open")
    within = firsts.where(F.col("seq") <= stop)
    if open_.isEmpty():
        discard(open_)
        return within.join(unsure, "seq", "left_anti").select("seq"), [bound, unsure]
    waiting = bound.join(open_, "seq", "left_semi")
    live = waiting.select("kind", "key").distinct()
    rows = waiting.select("*", F.lit(False).alias("sure")).unionByName(sure.where(F.col("seq") <= stop).join(live, key, "left_semi").withColumn("sure", F.lit(True)))
    # Keys belong to one seed but for URLs and the sitemap files: seeds that share such a key make one part.
    shared = waiting.groupBy(*key).agg(F.min("seed_url").alias("a"), F.max("seed_url").alias("b")).where("a <> b").select(*key)
    joined = waiting.join(shared, key, "left_semi").select(F.col("seed_url").alias("seed")).distinct()
    keyed = rows.join(waiting.select(*key, "seed_url").groupBy(*key).agg(F.min("seed_url").alias("seed")), key).join(joined.withColumn("shared", F.lit(True)), "seed", "left")
    part = F.when(F.coalesce("shared", F.lit(False)), F.lit("*")).otherwise(F.concat(F.lit("-"), "seed"))
    # Rows that were enqueued before have no number of their own: each is counted once a key.
    old = keyed.where("seq < 0").select(part.alias("part"), "seq", "sure", F.array(F.struct(*key)).alias("keys"))
    events = keyed.where("seq >= 0").groupBy("seq", "sure").agg(F.min(part).alias("part"), F.collect_list(F.struct(*key)).alias("keys")).select("part", "seq", "sure", "keys").unionByName(old)
    taken = written(_settled(events, caps), "admission-settled")
    rejected = unsure.join(taken, "seq", "left_anti")
    return within.join(rejected, "seq", "left_anti").select("seq"), [bound, unsure, open_, taken]


def admit(
    candidates: DataFrame, scope: Scope, *, known: DataFrame | None = None, max_depth: int = 5, run_cap: int = 1000, seed_cap: int | None = None, seed_max_depth: int | None = None, sitemap_cap: int | None = None, queue_cap: int | None = None
) -> DataFrame:
    """Decisions for candidates (seq, url, depth, seed_url), as if taken one by one in order of seq; adds status.

    The first rule that applies decides: no seed (rejected_scope), no valid URL (invalid_url), a
    URL that was enqueued before (already_seen; a rejected sighting leaves no trace), sitemap-file
    cap (trap_guard; needs a column ``source``), run cap (queue_limit), scope and the seed's depth
    (rejected_scope), seed cap (queue_limit), directory and pattern caps (trap_guard), depth
    (max_depth), queue size (queue_limit), else enqueued.  Every cap counts enqueued rows only,
    ``known`` (url, seed_url) among them.  ``seq`` is unique and not negative.

    Whether a row is enqueued depends on earlier rows through these counts, but only where caps
    bind: of the sightings of a URL by a seed only the first can be enqueued, keys with no more
    rows than their cap bind nobody, and nearly all other rows are settled by two bounds on the
    counts.  The number of tables written is fixed, however long the chains are in which rows
    wait for each other (deciding such a chain in parallel is not possible in general; it
    streams through one task a seed with a counter a key).
    """
    url, seed = F.col("url"), F.col("seed_url")
    place = F.concat_ws("\x00", "seed_url", U.origin(url), U.directory(url))
    shape = F.concat_ws("\x00", "seed_url", U.origin(url), U.path_pattern(url), U.query_pattern(url))
    reason = F.coalesce(scope_reason(url, F.col("depth"), seed, scope), F.when(F.col("depth") > seed_max_depth, "seed-depth") if seed_max_depth is not None else F.lit(None))
    sitemap = F.coalesce(F.col("source").isin(*SITEMAP_FILES), F.lit(False)) if sitemap_cap is not None else F.lit(False)
    rows = written(candidates.select("*", reason.alias("_reason"), place.alias("place"), shape.alias("shape"), sitemap.alias("_sitemap")), "admission-rows")

    caps = {"url": 1, "seed_url": seed_cap, "place": scope.max_per_directory, "shape": scope.max_per_pattern, "file": sitemap_cap}
    caps = {k: c for k, c in caps.items() if c is not None}
    kinds = [k for k in caps if k != "file"]
    pairs = [F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in kinds]
    keys = F.array(*pairs)
    if "file" in caps:
        keys = F.when(F.col("_sitemap"), F.array(*pairs, F.struct(F.lit("file").alias("kind"), F.lit("file").alias("key")))).otherwise(keys)
    able = rows.where(seed.isNotNull() & url.isNotNull() & F.col("_reason").isNull() & (F.col("depth") <= max_depth))
    firsts = able.groupBy("url", "seed_url", "place", "shape", "_sitemap").agg(F.min("seq").alias("seq"))
    firsts = written(firsts.select("seq", *kinds, *(() if "seed_url" in kinds else ("seed_url",)), "_sitemap", keys.alias("keys")), "admission-firsts")
    before, n_before = None, 0
    if known is not None:
        before = written(known.select("url", "seed_url", place.alias("place"), shape.alias("shape"), F.lit(False).alias("_sitemap")), "admission-known")
        n_before = before.count()
    whole = run_cap if queue_cap is None else min(run_cap, queue_cap)
    member_seqs, tables = _members(firsts, None if before is None else before.select(keys.alias("keys")), caps, whole - n_before)
    end = _cut(member_seqs, whole - n_before)
    members = written(firsts.join(member_seqs, "seq", "left_semi").where(F.col("seq") <= end).select("seq", *kinds, "_sitemap"), "admission-members")
    discard(firsts, *tables)
    run = end if run_cap == whole else _OPEN
    files = _cut(members.where("_sitemap"), sitemap_cap) if sitemap_cap is not None else _OPEN

    counted = members.select("seq", *kinds)
    if before is not None:
        counted = counted.unionByName(before.select(F.lit(-1).cast("long").alias("seq"), *kinds))
    status = F.when(seed.isNull(), "rejected_scope").when(url.isNull(), "invalid_url")
    for k in kinds:
        rows = rows.join(_ranked_until(counted.select(k, "seq"), [k], caps[k]).withColumnRenamed("end", f"_{k}"), k, "left")
    over = lambda k: F.col("seq") > (F.coalesce(F.col(f"_{k}"), F.lit(_OPEN)) if caps[k] > 0 else -1)
    status = status.when(over("url"), "already_seen").when(F.col("_sitemap") & (F.col("seq") > files), "trap_guard").when(F.col("seq") > run, "queue_limit").when(F.col("_reason").isNotNull(), "rejected_scope")
    if seed_cap is not None:
        status = status.when(over("seed_url"), "queue_limit")
    status = status.when(over("place") | over("shape"), "trap_guard").when(F.col("depth") > max_depth, "max_depth")
    if queue_cap is not None:
        status = status.when(F.col("seq") > end, "queue_limit")
    return rows.withColumn("status", status.otherwise("enqueued")).select(*candidates.columns, "status")
