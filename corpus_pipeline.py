"""Training-corpus pipeline: filter, deduplicate, decontaminate, redact and encode documents.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; a stage's rows are written as
Parquet and read again as the next one's ``docs``.  All but the last keep the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.bpe import encode_documents, vocabulary
from webloom.llm.jaccard import similar_documents
from webloom.llm.names import free_name
from webloom.llm.rules import keep_quality
from webloom.llm.secrets import redacted, scan_secrets
from webloom.llm.winnowing import decontaminate
from webloom.shared import discard, written


def _digest() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: rows that the quality rules reject go.

    Null and empty texts have a score too; repeated rows share one; empty tables and tables
    with more columns, whatever their names, pass through; very long texts count whole.
    """
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9, on 5-word shingles at 0.8: the document with the least id of each component stays.

    Rows that repeat an id and its text are one document.  Null ids stay if nothing with an id
    is linked with them.  Null and empty texts link with nothing and stay.
    """
    groups = similar_documents(docs, percent=80, shingle=5, mark=_digest())
    kept_id, digest = free_name(docs.columns, "kept"), free_name(docs.columns, "digest")
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(kept_id), F.col("mark").alias("of_kept")).distinct()
    mine = docs.select(F.struct(*_columns(docs)).alias("row"), F.col("doc_id").alias("id"), _digest().alias(digest))
    left = mine.join(kept.hint("merge"), F.col("id").eqNullSafe(F.col(kept_id)) & (F.col(digest) == F.col("of_kept")), "left_semi")
    return left.dropDuplicates(["id", digest]).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: contaminated documents go.  The verdict is on a text, whatever ids it has.

    Null and empty texts hold nothing and stay; repeated rows share a verdict.
    """
    found = decontaminate(docs.select(_digest().alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    name = free_name(docs.columns, "bad")
    bad = found.where("contaminated").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad.hint("merge"), _digest() == F.col(name), "left_anti").select(*_columns(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: secrets are replaced by a mark in the text; every document stays.

    n_chars follows a changed text.  Null texts stay null.
    """
    spans = free_name(docs.columns, "spans")
    found = scan_secrets(docs, keep=docs.columns, spans_as=spans)
    # A column of its own: its length must not evaluate the replacement a second time.
    text = free_name(found.columns, "redacted")
    found = found.withColumn(text, redacted(F.col("text"), F.col(spans)))
    new = {"text": F.col(text), "n_chars": F.when(F.size(spans) > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))}
    return found.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: token ids of every document, with digests of ids and decoded text.

    A row per row of docs; null texts are empty; columns beyond those of documents are left out.
    """
    out = encode_documents(docs, vocabulary(), keep=["lang", "source"])
    tokens = (F.octet_length("ids") / 4).cast("long")
    return out.select("doc_id", "lang", "source", tokens.alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("encoding", encoding),
]

#: A fitted classifier and a BPE vocabulary are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
