"""Policies over requests and redirect targets: scope by seed, network safety, robots; redirect chains."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.operators.scope import Scope, scope_reason
from webloom.shared import written

# Names and texts of the rules in ``scope_reason``.
RULES = {
    "url": ("url", "Invalid URL"),
    "protocol": ("protocol", "Unsupported protocol"),
    "url-length": ("maxUrlLength", "URL length exceeds maximum"),
    "path-segments": ("maxPathSegments", "Path segment count exceeds maximum"),
    "query-params": ("maxQueryParams", "Query parameter count exceeds maximum"),
    "denied-host": ("deniedHosts", "Host is explicitly denied"),
    "allowed-host": ("allowedHosts", "Host is not explicitly allowed"),
    "exclude": ("exclude", "URL matched exclude pattern"),
    "include": ("include", "URL did not match include pattern"),
    "scope": ("scope", "URL is outside {mode} scope"),
    "depth": ("depth", "Negative depth"),
    "seed-depth": ("seed.maxDepth", "Seed depth limit exceeded"),
}
REDIRECTS = [301, 302, 303, 307, 308]


def scope_decisions(rows: DataFrame, default: Scope, by_seed: dict[str, Scope] | None = None, seed_depth: dict[str, int] | None = None) -> DataFrame:
    """Adds scope_rule, scope_policy and scope_detail (null where allowed) to rows of url, depth and seed_url.

    The seed's own depth limit comes first, then the rules of its own scope, else of the default.
    Scopes are configuration: the distinct ones become branches of one expression.
    """
    url, depth, seed = F.col("url"), F.col("depth"), F.col("seed_url")
    groups: dict[Scope, list[str]] = {}
    for s, scope in (by_seed or {}).items():
        groups.setdefault(scope, []).append(s)
    chosen, mode = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for scope, seeds in groups.items():
        chosen, mode = chosen.when(seed.isin(*seeds), scope_reason(url, depth, seed, scope)), mode.when(seed.isin(*seeds), scope.mode)
    rule = chosen.otherwise(scope_reason(url, depth, seed, default))
    for s, limit in (seed_depth or {}).items():
        rule = F.when((seed == s) & (depth > limit), "seed-depth").otherwise(rule)
    names = F.create_map(*(F.lit(x) for k, (policy, _) in RULES.items() for x in (k, policy)))
    texts = F.create_map(*(F.lit(x) for k, (_, text) in RULES.items() for x in (k, text)))
    rows = rows.withColumn("scope_rule", rule)
    detail = F.replace(texts[F.col("scope_rule")], F.lit("{mode}"), mode.otherwise(default.mode))
    detail = F.when(F.col("scope_rule") == "protocol", F.concat(detail, F.lit(" "), F.regexp_extract(url, "^([^:]*:)", 1))).otherwise(detail)
    return rows.withColumn("scope_policy", names[F.col("scope_rule")]).withColumn("scope_detail", detail)


def request_decisions(rows: DataFrame) -> DataFrame:
    """Adds decision, policy and detail to rows after ``scope_decisions`` with safe and robots_allowed.

    Scope, then network safety, then robots: the first that refuses names the reason.
    """
    first = (
        F.when(F.col("scope_rule").isNotNull(), F.struct(F.lit("SCOPE_REJECTED").alias("decision"), F.coalesce("scope_policy", F.lit("scope")).alias("policy"), F.col("scope_detail").alias("detail")))
        .when(~F.coalesce("safe", F.lit(False)), F.struct(F.lit("NETWORK_SAFETY_REJECTED").alias("decision"), F.lit("networkSafety").alias("policy"), F.lit("address is not public").alias("detail")))
        .when(~F.coalesce("robots_allowed", F.lit(False)), F.struct(F.lit("ROBOTS_DISALLOWED").alias("decision"), F.lit("robots").alias("policy"), F.lit("disallowed by robots rules").alias("detail")))
        .otherwise(F.struct(F.lit("allow").alias("decision"), F.lit(None).cast("string").alias("policy"), F.lit(None).cast("string").alias("detail")))
    )
    return rows.withColumn("_first", first).select(*rows.columns, "_first.*")


def redirect_decision(scope_rule: Column, safe: Column, robots_allowed: Column | None = None) -> Column:
    """Struct of allowed, scope_allowed, network_safety_allowed and robots_allowed of a redirect target.

    Robots are asked only for targets that scope and safety allow, and not at all (None) for
    redirects of robots files themselves.
    """
    inside = scope_rule.isNull()
    both = inside & F.coalesce(safe, F.lit(False))
    asked = F.lit(None).cast("boolean") if robots_allowed is None else F.when(both, robots_allowed)
    allowed = both if robots_allowed is None else both & F.coalesce(robots_allowed, F.lit(False))
    return F.struct(allowed.alias("allowed"), inside.alias("scope_allowed"), safe.alias("network_safety_allowed"), asked.alias("robots_allowed"))


def follow_redirects(starts: DataFrame, responses: DataFrame, *, max_hops: int = 10, target_allowed: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Follows recorded redirects hop by hop, all requests at once.

    ``starts``: request_id, url.  ``responses``: url, status, location (resolved, without
    fragment).  Each hop is one equi-join, at most ``max_hops + 1`` of them; a request carries
    the URLs it has visited, no more than that many.  Returns (hops, outcomes): hops of
    request_id, hop_index, from_url, to_url, status, valid_target, allowed; outcomes of
    request_id, final_url, status, hops, error (null, REDIRECT_LOOP, REDIRECT_TARGET_REJECTED
    or TOO_MANY_REDIRECTS).  A URL without a response ends there with a null status.
    """
    known = responses.groupBy("url").agg(F.min(F.struct("status", "location")).alias("r")).select("url", "r.status", "r.location")
    now = starts.select("request_id", "url", F.array("url").alias("visited"), F.lit(0).alias("hop_index"))
    hops, ends = [], []
    for hop in range(max_hops + 1):
        got = now.join(known, "url", "left")
        moves = F.col("status").isin(*REDIRECTS) & F.col("location").isNotNull()
        loop = F.array_contains("visited", F.col("location"))
        allowed = F.lit(True) if target_allowed is None else F.coalesce(target_allowed(F.col("location")), F.lit(False))
        got = got.withColumn("_moves", F.coalesce(moves, F.lit(False))).withColumn("_loop", loop).withColumn("_allowed", F.when(~F.col("_loop"), allowed))
        got = written(got, "redirect-hop")
        ends.append(got.where("not _moves").select("request_id", F.col("url").alias("final_url"), "status", F.col("hop_index").alias("hops"), F.lit(None).cast("string").alias("error")))
        moved = got.where("_moves")
        if hop == max_hops:
            ends.append(moved.select("request_id", F.col("url").alias("final_url"), "status", F.col("hop_index").alias("hops"), F.lit("TOO_MANY_REDIRECTS").alias("error")))
            break
        hops.append(moved.select("request_id", "hop_index", F.col("url").alias("from_url"), F.col("location").alias("to_url"), "status", (~F.col("_loop")).alias("valid_target"), F.col("_allowed").alias("allowed")))
        error = F.when(F.col("_loop"), "REDIRECT_LOOP").when(~F.col("_allowed"), "REDIRECT_TARGET_REJECTED")
        ends.append(moved.where(error.isNotNull()).select("request_id", F.col("location").alias("final_url"), "status", (F.col("hop_index") + 1).alias("hops"), error.alias("error")))
        now = moved.where(error.isNull()).select("request_id", F.col("location").alias("url"), F.concat("visited", F.array("location")).alias("visited"), (F.col("hop_index") + 1).alias("hop_index"))
        if now.isEmpty():
            break
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    return union(hops) if hops else starts.sparkSession.createDataFrame([], "request_id long, hop_index int, from_url string, to_url string, status int, valid_target boolean, allowed boolean"), union(ends)
