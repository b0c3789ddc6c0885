"""Bronze, silver and gold layers as partitioned Parquet; compaction; JSON lines; object stores by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SILVER = ("id", "run_id", "document_id", "document_version", "page_no", "entity", "metric", "value", "unit", "period", "scope", "geography", "reporting_basis", "quote", "confidence", "numeric_confidence", "evidence_status", "norm_entity", "norm_metric", "norm_value", "norm_unit", "norm_period", "norm_scope")
GOLD_SCHEMA = """fact_id long, document_id string, document_version int, entity string, metric string, value double,
    unit string, period string, scope string, reporting_basis string, evidence_status string, quote string, run_id long"""


def run_stamp(at: Column | None = None) -> Column:
    return F.date_format(F.current_timestamp() if at is None else at, "yyyyMMdd'T'HHmmss'Z'")


def write_layer(df: DataFrame, path: str, *partitions: str) -> None:
    """Append, replacing only the partitions that ``df`` holds, so that a repeated run is idempotent."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def write_bronze(pages: DataFrame, meta: DataFrame, root: str) -> None:
    """Page texts by document and version, and one row of metadata each."""
    write_layer(pages, f"{root}/bronze/pages", "document_id", "document_version")
    write_layer(meta.withColumn("written_at", run_stamp()), f"{root}/bronze/meta", "document_id", "document_version")


def write_silver(facts: DataFrame, root: str) -> None:
    write_layer(facts.select(*[c for c in SILVER if c in facts.columns]), f"{root}/silver", "document_id", "document_version", "run_id")


def gold(facts: DataFrame) -> DataFrame:
    """Facts that are not unverifiable, normalized fields first."""
    kept = facts.where("coalesce(evidence_status, '') <> 'unverifiable'")
    first = {c: F.coalesce(f"norm_{c}", c) for c in ("entity", "metric", "unit", "period", "scope")}
    return kept.select(F.col("id").alias("fact_id"), "document_id", "document_version", *[e.alias(c) for c, e in first.items()], F.col("norm_value").alias("value"), "reporting_basis", "evidence_status", "quote", "run_id")


def write_gold(facts: DataFrame, root: str) -> None:
    """One snapshot partition per run, so two runs in one second don't overwrite each other."""
    write_layer(gold(facts), f"{root}/gold/facts", "run_id")


def compact_gold(spark: SparkSession, root: str, n_files: int | None = None) -> DataFrame:
    """All snapshots read with an explicit schema and rewritten as ``n_files`` files, or as many as their size asks for; rows are not deduplicated."""
    rows = spark.read.schema(GOLD_SCHEMA).parquet(f"{root}/gold/facts")
    (rows.repartition(n_files) if n_files else rows.hint("rebalance")).write.mode("overwrite").parquet(f"{root}/gold/compacted")
    return spark.read.parquet(f"{root}/gold/compacted")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_document_json(df: DataFrame, path: str, key: str = "document_id") -> None:
    """One file of JSON lines for each document, in a folder of its name; a document's rows in the order of their JSON text."""
    rows = df.select(F.col(key), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    rows.repartition(key).sortWithinPartitions(key, "value").write.mode("overwrite").partitionBy(key).text(path)


def nested_as_json(df: DataFrame) -> DataFrame:
    """Struct, array and map columns as JSON text, for readers that need flat columns."""
    nested = {f.name: F.to_json(f.name) for f in df.schema if f.dataType.typeName() in ("struct", "array", "map")}
    return df.withColumns(nested) if nested else df


def cached(prompts: DataFrame, cache: DataFrame) -> DataFrame:
    """``prompts`` (key) with the latest cached value, null on a miss."""
    return prompts.join(cache.groupBy("key").agg(F.max_by("value", "created_at").alias("value")), "key", "left")
