"""Files to grounded, normalized, embedded facts in the lake: the ingest plan and the upload handler."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.normalize import normalized
from ledgerloom.functions.text import embedding_text
from ledgerloom.functions.vectors import hashed_embedding
from ledgerloom.operators import chunk, compare, evidence, model_stage, tables, validate
from ledgerloom.sources import lake, pages
from ledgerloom.sources.storage import materialize

PROMPT = """Extract the financial facts of these pages as a JSON object {{"facts": [...]}} with the fields page_no, entity,
metric, value, unit, period, scope, geography, reporting_basis, is_reported_value, quote, confidence. Quote verbatim.

"""
EMBEDDED = ("entity", "metric", "value", "unit", "period", "scope", "quote")


@dataclass(frozen=True)
class Ingested:
    """What one run produced: registrations, pages, accepted facts, facts without evidence, invalid facts."""

    documents: DataFrame
    pages: DataFrame
    facts: DataFrame
    ungrounded: DataFrame
    rejected: DataFrame


def ingest(
    spark: SparkSession,
    paths: str | list[str],
    providers: Sequence[model_stage.Provider],
    documents: DataFrame,
    run_id: int,
    root: str | None = None,
    splitter: pages.Splitter = pages.plain_text,
    pattern: str = pages.UPLOADS,
    cache: DataFrame | None = None,
    embedding: Callable[[Column], Column] = hashed_embedding,
) -> Ingested:
    """Register, split, chunk, extract, ground, validate, normalize and embed; write the layers under ``root``.

    Files whose bytes equal a complete document's (``documents``) are skipped before they are split.
    ``embedding`` makes a vector column of a text column; the offline hash is the default.
    """
    files = pages.files(spark, paths, pattern)
    uploads = files.select("document_id", "content_hash", F.lit(run_id).alias("uploaded_at"))
    registered = materialize(tables.register(uploads, documents), "registered")
    fresh = registered.where("status = 'new'").select("document_id", "content_hash", "document_version")
    split = pages.split_pages(files.join(fresh.select("document_id", "content_hash"), ["document_id", "content_hash"], "left_semi"), splitter)
    texts = materialize(split.join(fresh.select("document_id", "document_version"), "document_id"), "pages")
    chunks, _ = validate.chunks(chunk.document_chunks(texts.select("document_id", "page_no", "text")))
    asked = chunks.join(fresh.select("document_id", "document_version"), "document_id").withColumn("prompt", F.concat(F.lit(PROMPT), "text"))
    replies = materialize(model_stage.answered(asked, providers, cache), "replies")
    raw = materialize(model_stage.raw_facts(replies), "raw")
    identified = tables.surrogate_ids(raw, F.struct("document_id", "document_version", "chunk_id", "page_no", "entity", "metric", "value", "quote"), run_id << 32)
    grounded = evidence.verified(identified.withColumnRenamed("id", "fact_id"), texts.select("document_id", "document_version", "page_no", "text"))
    grounded = materialize(grounded.withColumnRenamed("fact_id", "id"), "grounded")
    valid, rejected = validate.facts(grounded.where("evidence_status <> 'unverifiable'"))
    formed = normalized(valid).withColumn("embedding", embedding(embedding_text(*[F.col(c) for c in EMBEDDED])))
    facts = validate.embeddings(formed).withColumns({"run_id": F.lit(run_id).cast("long"), "is_active": F.lit(True), "created_at": F.current_timestamp()})
    facts = materialize(facts, "facts")
    if root is not None:
        lake.write_bronze(texts.drop("num_pages"), fresh, root)
        lake.write_silver(facts, root)
        lake.write_gold(facts, root)
    return Ingested(registered, texts, facts, grounded.where("evidence_status = 'unverifiable'"), rejected)


def relate(new: DataFrame, facts: DataFrame, existing: DataFrame, model: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Relations of the new facts to all facts, new ones included; relations of older versions are inactive."""
    return compare.compare_new_facts(new, facts, existing, model)


def run_report(done: Ingested) -> DataFrame:
    """One row of counters: documents new and skipped, pages, facts, facts without evidence, invalid facts."""
    count = F.count(F.lit(1))
    return (
        done.documents.agg(F.count_if(F.col("status") == "new").alias("new_documents"), F.count_if(F.col("status") == "skipped").alias("skipped_documents"))
        .join(done.pages.agg(count.alias("pages")))
        .join(done.facts.agg(count.alias("facts")))
        .join(done.ungrounded.agg(count.alias("ungrounded")))
        .join(done.rejected.agg(count.alias("rejected")))
    )
