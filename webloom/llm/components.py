"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.shared import discard, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges(u, v), u != v: joins each vertex's larger (or other) neighbours to its least neighbour.

    The least neighbour is a pre-aggregated minimum, and the join that hands it out can be
    split, so a hub with very many edges costs no single task.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least.hint("merge"), "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) to (node, root): the least node of the component, for every node with an edge that isn't the root.

    Loops over u = v and repeated edges do no harm; the rounds grow with the logarithm of the
    component size, and each is written, so lineage stays short.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    before = last = None
    while True:
        now = written(_star(_star(now, large=True), large=False), "components")
        if last is not None:
            discard(last)
        last = now
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            roots._scratch = now._scratch  # so that ``discard`` knows the table
            return roots
        before = state
