"""Comparison of two runs, and replay of extraction from stored evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webloom.functions import urls as U


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; rows with a null in their key are left out."""
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(o) for o in order)))
    return rows.withColumn("_n", nth).where("_n = 1").drop("_n")


def compare(base: DataFrame, target: DataFrame, entity: str, key: str, fields: dict[str, Column | str]) -> DataFrame:
    """Changes of one entity: appeared, disappeared, and one ``<name>-changed`` for every field that differs.

    Both sides hold one row per key.  Only the key and the compared fields are shuffled.
    """
    pick = lambda rows, side: rows.select(F.col(key).alias("key"), F.struct(*((F.col(v) if isinstance(v, str) else v).alias(n) for n, v in fields.items())).alias(side))
    both = pick(base, "b").join(pick(target, "t"), "key", "full_outer")
    changed = [F.when(~F.col(f"b.{n}").eqNullSafe(F.col(f"t.{n}")), F.lit(f"{n}-changed")) for n in fields]
    kinds = F.when(F.col("b").isNull(), F.array(F.lit("appeared"))).when(F.col("t").isNull(), F.array(F.lit("disappeared"))).otherwise(F.array_compact(F.array(*changed)))
    return both.select(F.lit(entity).alias("entity"), "key", F.explode(kinds).alias("kind"))


def membership(base: DataFrame, target: DataFrame, entity: str, keys: list[str]) -> DataFrame:
    """Keys on one side only: added or removed."""
    key = F.concat_ws("\x00", *keys)
    b, t = (x.where(" and ".join(f"{k} is not null" for k in keys)).select(key.alias("key")).distinct() for x in (base, target))
    added = t.join(b, "key", "left_anti").select(F.lit(entity).alias("entity"), "key", F.lit("added").alias("kind"))
    return added.unionByName(b.join(t, "key", "left_anti").select(F.lit(entity).alias("entity"), "key", F.lit("removed").alias("kind")))


def summary(changes: DataFrame) -> DataFrame:
    kind = F.col("kind")
    outer = ["appeared", "disappeared", "added", "removed"]
    return changes.groupBy("entity").agg(
        F.count("*").alias("changes"), F.count_if(kind == "appeared").alias("appeared"), F.count_if(kind == "disappeared").alias("disappeared"), F.count_if(kind == "added").alias("added"),
        F.count_if(kind == "removed").alias("removed"), F.count_if(~kind.isin(*outer)).alias("modified"),
    )


# Compared fields of each entity, by the name of the change.
RESOURCE = {"status": "status", "redirect": "final_url", "content-type": "content_type", "body": "body_hash"}
PAGE = {"title": "title", "canonical": "canonical", "meta-description": "meta_description", "headings": "headings", "text": "visible_text"}


def compare_runs(base: dict[str, DataFrame], target: dict[str, DataFrame]) -> DataFrame:
    """All changes between two runs: id, entity, kind, key.

    Each run names some of resource (url, RESOURCE's columns), html-page (url, PAGE's columns),
    link (from_url, to_url, kind), sitemap (sitemap_url, url, kind) and robots (origin and any
    columns that count), with one row per key (see ``last_wins``).  Long facts are compared by
    hash, so no text is shuffled.
    """
    parts = []
    if "resource" in base:
        parts.append(compare(base["resource"], target["resource"], "resource", "url", RESOURCE))
    if "html-page" in base:
        parts.append(compare(base["html-page"], target["html-page"], "html-page", "url", {k: stable_hash(c) for k, c in PAGE.items()}))
    for entity, keys in (("link", ["from_url", "to_url", "kind"]), ("sitemap", ["sitemap_url", "url", "kind"])):
        if entity in base:
            parts.append(membership(base[entity], target[entity], entity, keys).withColumn("kind", F.concat_ws("-", "entity", "kind")))
    if "robots" in base:
        fields = [c for c in base["robots"].columns if c != "origin"]
        parts.append(compare(base["robots"], target["robots"], "robots", "origin", {"robots": stable_hash(*fields)}))
    changes = parts[0]
    for p in parts[1:]:
        changes = changes.unionByName(p)
    return changes.select(U.make_id("change", F.concat_ws(":", "entity", "kind", "key")).alias("id"), "entity", "kind", "key")


def report_summary(changes: DataFrame) -> DataFrame:
    """One row: appeared, disappeared, modified, links_added, links_removed, sitemap_added, sitemap_removed."""
    kind = F.col("kind")
    names = {"appeared": "appeared", "disappeared": "disappeared", "links_added": "link-added", "links_removed": "link-removed", "sitemap_added": "sitemap-added", "sitemap_removed": "sitemap-removed"}
    return changes.agg(*(F.count_if(kind == v).alias(k) for k, v in names.items()), F.count_if(~kind.isin(*names.values())).alias("modified"))


def collated(changes: DataFrame) -> list[Column]:
    """The order of a report: entity, key and kind as readers sort them, by the root collation of Unicode (case and accents last)."""
    return [F.collate(F.col(c), "UNICODE") for c in ("entity", "key", "kind")]


def first_changes(changes: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` changes of each entity in the report's order: adds place (from 1).

    Ranking is limited in every task before the shuffle, so an entity with very many changes
    sends few of them.
    """
    place = F.row_number().over(Window.partitionBy("entity").orderBy(*collated(changes)[1:], "id"))
    return changes.withColumn("place", place).where(F.col("place") <= limit)


def write_report(changes: DataFrame, folder: str) -> None:
    """Writes the changes as JSON lines in the report's order (a range-partitioned sort), and the summary beside them."""
    changes.orderBy(*collated(changes)).write.mode("overwrite").json(f"{folder}/changes")
    report_summary(changes).coalesce(1).write.mode("overwrite").json(f"{folder}/summary")


def replay_counts(items: DataFrame) -> DataFrame:
    """One row: matched, changed, missing_evidence, failed."""
    status = F.col("status")
    return items.agg(*(F.count_if(status == s).alias(s.replace("-", "_")) for s in ("matched", "changed", "missing-evidence", "failed")))


def stable_hash(*columns: Column | str) -> Column:
    """Hash of values as JSON with nulls kept, so equal content hashes alike."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary"), 256)


def replay(saved: DataFrame, again: DataFrame, key: str, volatile: list[str] = ()) -> DataFrame:
    """Status of each saved record against its re-extraction: matched, changed, missing-evidence or failed.

    ``again`` holds the re-extracted rows for which evidence was found, with ``failed`` set
    where extraction didn't succeed; volatile columns (ids of the run, times) don't count.
    """
    fields = [c for c in saved.columns if c != key and c not in volatile]
    a = saved.select(F.col(key).alias("key"), stable_hash(*fields).alias("a"))
    b = again.select(F.col(key).alias("key"), F.coalesce(F.col("failed"), F.lit(False)).alias("failed"), stable_hash(*fields).alias("b"))
    joined = a.join(b, "key", "left")
    status = F.when(F.col("b").isNull(), "missing-evidence").when(F.col("failed"), "failed").when(F.col("a") == F.col("b"), "matched").otherwise("changed")
    return joined.select("key", status.alias("status"))
