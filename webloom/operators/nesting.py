"""Nested facts of pages: microdata items with their properties, and the outline.

Elements come as intervals that are nested or apart.  The enclosing scope of an element needs no
pairs of elements: a running sum of opened and closed scopes gives every element its depth, and
the scope it lies in is the last one before it that opened at that depth.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.functions import urls as U
from webloom.functions.element_kernel import SECTIONS, Element, nested_elements
from webloom.shared import ship_package

_FIELDS = "start int, end int, tag string, level int, itemscope boolean, itemtype string, itemid string, itemprop array<string>, value string, text string"


def nested(pages: DataFrame) -> DataFrame:
    """Items, properties, headings and sections of pages (page_id, url, html) as intervals, in one pass over each page."""
    ship_package(pages.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(page, *e) for page, url, html in frame.itertuples(index=False, name=None) for e in nested_elements(html or "", url or "")]
            out = pd.DataFrame(rows, columns=["page_id", *Element._fields])
            out["level"] = out["level"].astype("Int32")
            yield out

    return pages.select("page_id", U.without_fragment(F.col("url")).alias("url"), "html").mapInPandas(run, f"page_id long, {_FIELDS}")


def enclosed(elements: DataFrame, scope: Column, name: str, carry: dict[str, str] | None = None) -> DataFrame:
    """Adds ``name``: the start of the innermost element with ``scope`` true that holds the element, null if none does.

    ``elements``: page_id, start, end; more columns are kept.  ``carry``: columns to add, each
    with the column of the holding element that it takes.  The elements are read once, and one
    shuffle by page serves both windows.
    """
    kept, carry = elements.columns, carry or {}
    rows = elements.withColumn("_scope", F.coalesce(scope, F.lit(False)))
    event = lambda at, step: F.struct(F.col(at).alias("_at"), F.lit(step).alias("_step"))
    events = rows.select(*kept, "_scope", F.inline(F.when(F.col("_scope"), F.array(event("start", 1), event("end", -1))).otherwise(F.array(event("start", 0)))))
    # A page's events in order; what closes at a place does so before anything opens there.
    order = Window.partitionBy("page_id").orderBy("_at", "_step")
    depth = F.coalesce(F.sum("_step").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    opened = events.withColumn("_depth", depth).where("_step >= 0")
    # A scope that opens at depth k - 1 holds elements of depth k.
    levels = F.when(F.col("_scope"), F.array(F.col("_depth"), F.col("_depth") + 1)).otherwise(F.array("_depth"))
    both = opened.select(*kept, "_scope", "_at", "_depth", F.explode(levels).alias("_level")).withColumn("_opens", F.col("_level") > F.col("_depth"))
    last = F.last(F.when(F.col("_opens"), F.struct(F.col("start").alias(name), *(F.col(c).alias(n) for n, c in carry.items()))), ignorenulls=True)
    inside = last.over(Window.partitionBy("page_id", "_level").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    return both.withColumn("_in", F.when(F.col("_level") > 0, inside)).where("not _opens").select(*kept, *(F.col("_in")[c].alias(c) for c in (name, *carry)))


def microdata(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, properties) of pages.

    ``elements``: see ``nested``.  Items: page_id, item (its start), itemtype, itemid, parent
    (the item it lies in, null at the top).  Properties: page_id, item (null for a property
    outside of all items), parent_type, name, value (null for an item), value_item, one row for
    each name of an element, in order of ``position``.  ``itemref`` isn't followed.
    """
    rows = elements.where(F.col("itemscope") | (F.size("itemprop") > 0))
    rows = enclosed(rows, F.col("itemscope"), "parent", {"parent_type": "itemtype"})
    items = rows.where("itemscope").select("page_id", F.col("start").alias("item"), "itemtype", "itemid", "parent")
    named = rows.select("page_id", "parent", "parent_type", "start", "value", "itemscope", F.explode("itemprop").alias("name"))
    return items, named.select("page_id", F.col("parent").alias("item"), "parent_type", "name", "value", F.when(F.col("itemscope"), F.col("start")).alias("value_item"), F.col("start").alias("position"))


def outline(elements: DataFrame) -> DataFrame:
    """Sections and headings of pages as a tree: page_id, node, tag, text, parent (null at the top).

    A heading belongs to the last heading before it of a lower level in the same sectioning
    element (article, aside, nav, section), and else to that element; a sectioning element
    belongs to the one around it.
    """
    section = F.col("tag").isin(*SECTIONS)
    rows = enclosed(elements.where(section | F.col("level").isNotNull()), section, "section")
    before = Window.partitionBy("page_id", "section").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    above = [F.when(F.col("level") > k, F.last(F.when(F.col("level") == k, F.col("start")), ignorenulls=True).over(before)) for k in range(1, 6)]
    parent = F.coalesce(F.greatest(*above), F.col("section"))
    return rows.select("page_id", F.col("start").alias("node"), "tag", "text", parent.alias("parent"))
