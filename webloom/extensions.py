"""Extension points of a crawl: middlewares that decide over rows, hooks on the driver, failure modes.

A middleware is a function from a DataFrame to a decision column (see ``decide``); Spark evaluates
it with the stage it extends.  Hooks are called on the driver between stages, with lazy tables,
so what a hook reads is its own choice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hooks, failure modes and decisions.
HOOKS = ["onRunStart", "onRunFinish", "onEvent", "onRequestEnqueued", "onRequestSkipped", "beforeRequest", "afterResponse", "onHtmlParsed", "onXmlParsed", "onLinksExtracted", "onRequestFailed", "onFatalError"]
FAILURE_MODES = ["record", "fail-request", "fail-run"]
REQUEST_DECISIONS = ["continue", "delay", "skip", "fail", "abort"]
RESOURCE_DECISIONS = ["continue", "skip-processing", "fail", "abort"]
_DECISION = "struct<kind:string,reason:string,delay_ms:long>"

Middleware = Callable[[DataFrame], Column]


class ExtensionFailure(RuntimeError):
    """A failed extension that its failure mode doesn't let pass."""


class RunAborted(RuntimeError):
    """A hook or middleware ended the run."""


def decide(kind: str | Column, reason: str | Column | None = None, delay_ms: int | Column | None = None) -> Column:
    """A middleware's decision; null counts as continue."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(kind).alias("kind"), lit(reason).cast("string").alias("reason"), lit(delay_ms).cast("long").alias("delay_ms")).cast(_DECISION)


@dataclass
class Extensions:
    before_request: list[Middleware] = field(default_factory=list)
    after_resource: list[Middleware] = field(default_factory=list)
    hooks: dict[str, Callable] = field(default_factory=dict)
    failure_mode: str = "record"
    event_buffer: int = 1024
    errors: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.failure_mode not in FAILURE_MODES:
            raise ValueError(f"failure_mode must be one of {FAILURE_MODES}")
        if unknown := set(self.hooks) - set(HOOKS):
            raise ValueError(f"unknown hooks {sorted(unknown)}")
        if not isinstance(self.event_buffer, int) or self.event_buffer <= 0:
            raise TypeError("event_buffer must be a positive integer")

    def _guarded(self, name: str, scope: str, action: Callable, fallback):
        try:
            return action()
        except RunAborted:
            raise
        except Exception as e:
            mode = "fail-run" if scope == "run" and self.failure_mode == "fail-request" else self.failure_mode
            self.errors.append({"code": "EXTENSION_ERROR", "name": name, "message": str(e), "fatal": mode == "fail-run"})
            if mode != "record":
                raise ExtensionFailure(name) from e
            return fallback

    def call(self, hook: str, *args, scope: str = "run") -> None:
        """Calls a hook, if it is set, under the failure mode."""
        if hook not in HOOKS:
            raise ValueError(f"unknown hook {hook}")
        if hook in self.hooks:
            self._guarded(hook, scope, lambda: self.hooks[hook](*args), None)

    def apply(self, rows: DataFrame, point: str) -> DataFrame:
        """Adds decision (the first that isn't continue or delay), reason and delay_ms (the sum of delays).

        ``point`` is before_request or after_resource.  Each middleware sees the rows without
        the others' decisions; a negative delay is an error of the row, kind fail.
        """
        known = REQUEST_DECISIONS if point == "before_request" else RESOURCE_DECISIONS
        columns = []
        for i, middleware in enumerate(getattr(self, point)):
            made = self._guarded(f"{point} middleware #{i + 1}", "request", lambda m=middleware: m(rows), None)
            if made is not None:
                columns.append(made.cast(_DECISION))
        rows = rows.withColumn("_made", F.array(*columns).cast(f"array<{_DECISION}>"))
        made = F.filter("_made", lambda d: d["kind"].isNotNull())
        bad = lambda d: ~d["kind"].isin(*known) | ((d["kind"] == "delay") & (F.coalesce(d["delay_ms"], F.lit(-1)) < 0))
        ends = F.filter(made, lambda d: bad(d) | ~d["kind"].isin("continue", "delay"))
        first = F.get(ends, 0)
        wait = F.aggregate(F.filter(made, lambda d: d["kind"] == "delay"), F.lit(0).cast("long"), lambda a, d: a + F.greatest(F.lit(0), F.coalesce(d["delay_ms"], F.lit(0))))
        kind = F.when(first.isNull(), "continue").when(bad(first), "fail").otherwise(first["kind"])
        reason = F.when(bad(first), F.concat(F.lit("invalid decision "), first["kind"])).otherwise(first["reason"])
        return rows.withColumn("decision", kind).withColumn("reason", reason).withColumn("delay_ms", wait).drop("_made")

    def outcome(self, decided: DataFrame) -> DataFrame:
        """The rows that go on; raises RunAborted if any row's decision is abort."""
        stop = decided.where("decision = 'abort'").limit(1).collect()
        if stop:
            raise RunAborted(stop[0]["reason"])
        return decided.where("decision = 'continue'")
