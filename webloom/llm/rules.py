"""Quality classifier: a sparse ensemble of rules over text statistics (operator 8).

Statistics of whole texts are computed by one vectorised kernel.  Shallow trees are boosted on
a bounded sample of labelled rows; every path from a root becomes a conjunctive rule; logistic
regression with an L1 penalty gives most rules no weight; the rest compile into one Spark
column expression, which scores the corpus without leaving the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm import kernels as K
from webloom.llm.names import free_name
from webloom.shared import ship_package

_ENDS = K.byte_class((10, 10))
_CLASSES = {
    "upper": K.byte_class((65, 90)),
    "lower": K.byte_class((97, 122)),
    "digit": K.byte_class((48, 57)),
    "space": K.byte_class((9, 13), (32, 32)),
    "stop": K.byte_class((44, 44), (46, 46)),
    "symbol": K.byte_class((33, 43), (45, 45), (47, 47), (58, 64), (91, 96), (123, 126)),
    "high": K.byte_class((128, 255)),
}
STATISTICS = ["log_words", "word_length", *_CLASSES, "marked_words", "caps_words", "distinct_words", "common_word", "line_words", "repeated_lines", "bare_words"]


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of STATISTICS a text; all are finite, and 0 where a text has nothing to count."""
    n = len(at) - 1
    size = np.maximum(np.diff(at), 1)
    share = []
    for table in _CLASSES.values():
        total = np.concatenate(([0], np.cumsum(table[data], dtype=np.int64)))
        share.append((total[at[1:]] - total[at[:-1]]) / size)
    starts, ends, rows_at = K.words(data, at, K.SPACED)
    count = np.diff(rows_at)
    rows = np.repeat(np.arange(n), count)
    some = np.maximum(count, 1)
    per_row = lambda x: np.bincount(rows, weights=x, minlength=n) / some
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    first = data[starts] if len(starts) else last
    second = data[np.minimum(starts + 1, len(data) - 1)] if len(starts) else last
    caps = _CLASSES["upper"][first] & _CLASSES["upper"][second] & (ends - starts > 1)
    bare = (ends - starts == 1) & _CLASSES["symbol"][first]

    hashes = K.Prefix(K.byte_symbols(data)).spans(starts, ends)
    distinct, common = _repetition(hashes, rows, n)
    line_starts, line_ends, lines_at = K.words(data, at, ~_ENDS)
    lines = np.repeat(np.arange(n), np.diff(lines_at))
    unlike, _ = _repetition(K.Prefix(K.byte_symbols(data)).spans(line_starts, line_ends), lines, n)
    n_lines = np.maximum(np.diff(lines_at), 1)
    return np.column_stack((
        np.log1p(count), per_row((ends - starts).astype(float)), *share, per_row(_CLASSES["symbol"][last].astype(float)), per_row(caps.astype(float)),
        distinct / some, common / some, count / n_lines, np.where(np.diff(lines_at) > 0, 1 - unlike / n_lines, 0), per_row(bare.astype(float)),
    ))


def _repetition(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, and the count of its most common one."""
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    heads = np.flatnonzero(new)
    most = np.zeros(n)
    np.maximum.at(most, r[heads], np.diff(np.append(heads, len(h))))
    return np.bincount(r[heads], minlength=n).astype(float), most


def _measure(text: int, kept: int, names: list[str]) -> Callable:
    """Statistics of column number ``text``; the first ``kept`` columns pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r0, r1, data, at in K.chunks(batch.column(text)):
                values = statistics(data, at)
                yield pa.record_batch([*(c[r0:r1] for c in batch.columns[:kept]), *(pa.array(v) for v in values.T)], [*batch.schema.names[:kept], *names])

    return run


def statistic_names(taken: list[str]) -> list[str]:
    """Column names of the statistics: with underscores before them until none is taken."""
    prefix = "_"
    while any(free_name(taken, prefix + s) != prefix + s for s in STATISTICS):
        prefix += "_"
    return [prefix + s for s in STATISTICS]


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and the statistics of each text, in columns named by ``statistic_names(keep)``."""
    ship_package(docs.sparkSession)
    columns = keep if "text" in keep else [*keep, "text"]
    frame, names = docs.select(*(F.col(f"`{c}`") for c in columns)), statistic_names(keep)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[: len(keep)]] + [f"`{n}` double" for n in names]
    return frame.mapInArrow(_measure(columns.index("text"), len(keep), names), ", ".join(fields))


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id's text is divisible by 5 (null ids: held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


Condition = tuple[int, bool, float]  # statistic, above, threshold


@dataclass
class RuleModel:
    rules: list[tuple[Condition, ...]]
    weights: list[float]
    bias: float

    def margin(self, names: list[str]) -> Column:
        total = F.lit(float(self.bias))
        for rule, w in zip(self.rules, self.weights, strict=True):
            total = total + F.when(_condition(rule, names), float(w)).otherwise(0.0)
        return total

    def score(self, names: list[str]) -> Column:
        """Probability of label 1, over the statistics' columns of ``measured``."""
        return 1 / (1 + F.exp(-self.margin(names)))

    def explain(self) -> list[str]:
        return [f"{w:+.3f}  " + " and ".join(f"{STATISTICS[s]} {'>' if up else '<='} {t:.4g}" for s, up, t in rule) for rule, w in zip(self.rules, self.weights, strict=True)]


def _condition(rule: tuple[Condition, ...], names: list[str]) -> Column:
    out = F.lit(True)
    for s, up, t in rule:
        c = F.col(names[s])
        out = out & ((c > t) if up else (c <= t))
    return out


def _holds(x: np.ndarray, rule: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for s, up, t in rule:
        out &= (x[:, s] > t) if up else (x[:, s] <= t)
    return out


def _grow(x: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, weight: np.ndarray, depth: int, rule: tuple[Condition, ...], rows: np.ndarray, out: list) -> None:
    """Second-order boosting splits; notes every path below the root and the value of each leaf."""
    value = gradient[rows].sum() / (weight[rows].sum() + 1.0)
    best = (1e-6, None)
    if depth:
        for s, thresholds in enumerate(cuts):
            if not len(thresholds):
                continue
            place = np.searchsorted(thresholds, x[rows, s], side="left")
            g = np.bincount(place, gradient[rows], len(thresholds) + 1).cumsum()
            h = np.bincount(place, weight[rows], len(thresholds) + 1).cumsum()
            k = np.bincount(place, minlength=len(thresholds) + 1).cumsum()
            gain = g[:-1] ** 2 / (h[:-1] + 1) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + 1) - g[-1] ** 2 / (h[-1] + 1)
            gain[(k[:-1] < 5) | (k[-1] - k[:-1] < 5)] = 0
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], (s, float(thresholds[i])))
    if best[1] is None:
        out.append((rule, value, rows))
        return
    s, t = best[1]
    up = x[rows, s] > t
    for side, chosen in ((False, rows[~up]), (True, rows[up])):
        _grow(x, cuts, gradient, weight, depth - 1, (*rule, (s, side, t)), chosen, out)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 2e-3, steps: int = 400) -> RuleModel:
    """Boosted trees to rules to lasso weights.  One class only: its smoothed share is the score."""
    prior = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(prior / (1 - prior)))
    if not len(y) or y.min() == y.max():
        return RuleModel([], [], base)
    cuts = [np.unique(np.quantile(x[:, s], np.linspace(0, 1, 66)[1:-1])) for s in range(x.shape[1])]
    margin, paths = np.full(len(y), base), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        leaves: list = []
        _grow(x, cuts, y - p, p * (1 - p), depth, (), np.arange(len(y)), leaves)
        for rule, value, rows in leaves:
            margin[rows] += 0.3 * value
            for n in range(1, len(rule) + 1):
                paths[tuple(sorted(set(rule[:n])))] = None
    rules = list(paths)
    if not rules:  # too few rows to split
        return RuleModel([], [], base)
    z = np.column_stack([_holds(x, r) for r in rules]).astype(np.float64)
    mean, spread = z.mean(0), z.std(0)
    rules, z = [r for r, s in zip(rules, spread, strict=True) if s > 1e-3], z[:, spread > 1e-3]
    mean, spread = z.mean(0), z.std(0)
    z = (z - mean) / spread
    step = 4 / max(np.linalg.norm(z, 2) ** 2 / len(y), 1e-9)
    w = v = np.zeros(z.shape[1])
    bias, momentum = base, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(z @ v + bias)))
        moved = v - step * (z.T @ (p - y) / len(y))
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        bias -= (p - y).mean()
        after = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        v, w, momentum = new + (momentum - 1) / after * (new - w), new, after
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    real = w[kept] / spread[kept]
    return RuleModel([rules[i] for i in kept], [float(r) for r in real], float(bias - (real * mean[kept]).sum()))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 20_000) -> RuleModel:
    """Fits on at most about ``sample`` labelled documents that aren't held out, chosen by a hash of the id.

    ``docs``: doc_id, text.  ``labels``: doc_id and the label; null labels are skipped, of several
    the largest counts, as the least statistics do where an id repeats.  The ids are chosen first
    (those whose hash falls below a share that leads to 95 % of the bound; so few that they are
    broadcast), and only their texts are measured.  Only the sample goes to the driver.
    """
    known = labels.where(~held_out(F.col("doc_id")) & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("double")).alias("label"))
    n = known.count()
    if n > sample:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(0.95 * sample / n * (1 << 40)))
    chosen = docs.select("doc_id", "text").join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")
    names = statistic_names(["doc_id", "label"])
    stats = measured(chosen, ["doc_id"]).groupBy("doc_id").agg(F.min(F.struct(*names)).alias("s"))
    got = known.join(stats, "doc_id").select("doc_id", "label", "s.*").toPandas().sort_values("doc_id").to_numpy(dtype=np.float64).reshape(-1, len(STATISTICS) + 2)
    return fit(got[:, 2:], got[:, 1])


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, sample: int = 20_000) -> DataFrame:
    """Scores every whole text; returns a row per row of docs: doc_id, held_out, score, predicted.

    ``docs``: doc_id, text; ``labels``: doc_id and the label; more columns are ignored.  Null
    and empty texts have the statistics of no words and get a score too; null ids are held
    out; repeated rows each give a row; without usable labels every score is 0.5; an empty
    table gives an empty result.  Very long texts are measured whole.
    """
    model, names = train(docs, labels, label, sample), statistic_names(["doc_id"])
    stats = measured(docs, ["doc_id"])
    return stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score(names).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 20_000) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with their columns, whatever those are named."""
    model, names = train(docs, labels, sample=sample), statistic_names(docs.columns)
    return measured(docs, docs.columns).where(model.score(names) >= threshold).select(*(F.col(f"`{c}`") for c in docs.columns))


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
