"""Versioned tables as append-only data: registration, latest state, lookups and enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.normalize import canonical_metric, clean_entity
from ledgerloom.operators.compare import pair_key


def active(df: DataFrame) -> DataFrame:
    """Rows that are active; null counts as active."""
    return df.where("coalesce(is_active, true)")


def facts_of(facts: DataFrame, document_id: str | None = None, exclude: bool = False, active_only: bool = True) -> DataFrame:
    """Facts of one document, or of all others, without the vector column."""
    found = active(facts) if active_only else facts
    if document_id is not None:
        found = found.where(F.col("document_id") != document_id if exclude else F.col("document_id") == document_id)
    return found.drop("embedding")


def fact(facts: DataFrame, fact_id: int) -> DataFrame:
    """One fact, active or not, without the vector column."""
    return facts.where(F.col("id") == fact_id).drop("embedding")


def register(uploads: DataFrame, documents: DataFrame) -> DataFrame:
    """``uploads`` (document_id, content_hash, uploaded_at) with status 'skipped' or 'new' and document_version.

    Bytes equal to a complete document's (``documents``: document_id, document_version, content_hash, status), or
    to an earlier upload's of this batch, are skipped; others continue the versions of their document.
    """
    complete = documents.where("status = 'complete'").select("content_hash").distinct().withColumn("_known", F.lit(True))
    earlier = Window.partitionBy("content_hash").orderBy("uploaded_at", "document_id")
    marked = uploads.join(complete, "content_hash", "left").withColumn("_nth", F.row_number().over(earlier))
    marked = marked.withColumn("status", F.when(F.col("_known") | (F.col("_nth") > 1), "skipped").otherwise("new"))
    last = documents.groupBy("document_id").agg(F.max("document_version").alias("_last"))
    in_order = Window.partitionBy("document_id", "status").orderBy("uploaded_at", "content_hash")
    numbered = marked.join(last, "document_id", "left").withColumn("_n", F.row_number().over(in_order))
    version = F.when(F.col("status") == "new", F.coalesce("_last", F.lit(0)) + F.col("_n")).cast("int")
    return numbered.select(*uploads.columns, "status", version.alias("document_version"))


def with_activity(rows: DataFrame) -> DataFrame:
    """is_active: whether the row is of its document's latest version (older versions are soft-deleted)."""
    latest = F.max("document_version").over(Window.partitionBy("document_id"))
    return rows.withColumn("is_active", F.col("document_version") == latest)


def active_relations(relations: DataFrame, facts: DataFrame) -> DataFrame:
    """Relations both of whose facts are active."""
    ids = active(facts).select("id")
    both = relations.join(ids.withColumnRenamed("id", "fact_a_id"), "fact_a_id", "left_semi")
    return both.join(ids.withColumnRenamed("id", "fact_b_id"), "fact_b_id", "left_semi").select(*relations.columns)


def latest(events: DataFrame, key: str, at: str, *values: str) -> DataFrame:
    """One row per key with the values of its last event; later values win ties by their own order."""
    last = F.max(F.struct(F.col(at), *values)).alias("_last")
    return events.groupBy(key).agg(last).select(key, F.col(f"_last.{at}").alias(at), *[F.col(f"_last.{v}").alias(v) for v in values])


def upserted(old: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Old and new rows, the latest for each key."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, at, "_side") and not both.schema[c].dataType.simpleString().startswith("map")]
    order = Window.partitionBy(*keys).orderBy(F.col(at).desc(), F.col("_side").desc(), *rest)  # total, so that a re-run chooses alike
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_side")


def merged_relations(old: DataFrame, new: DataFrame) -> DataFrame:
    """One relation per unordered pair, the latest by created_at, then the larger id."""
    both = old.unionByName(new, allowMissingColumns=True).withColumn("_pair", pair_key(F.col("fact_a_id"), F.col("fact_b_id")))
    order = Window.partitionBy("_pair").orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc())
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_pair")


def page_map(pages: DataFrame, document_id: str, version: int | None = None) -> DataFrame:
    """Pages of a version; without one each page's text in its latest version."""
    own = pages.where(F.col("document_id") == document_id)
    if version is not None:
        return own.where(F.col("document_version") == version).select("page_no", "text")
    return own.groupBy("page_no").agg(F.max_by("text", "document_version").alias("text"))


def fact_relations(relations: DataFrame, facts: DataFrame, fact_id: int | None = None) -> DataFrame:
    """Active relations seen from each of their facts (or one), with the other fact, which may be missing."""
    seen = active(relations).select("*", F.explode(F.array("fact_a_id", "fact_b_id")).alias("fact_id")).distinct()
    if fact_id is not None:
        seen = seen.where(F.col("fact_id") == fact_id)
    other = F.when(F.col("fact_id") == F.col("fact_a_id"), F.col("fact_b_id")).otherwise(F.col("fact_a_id"))
    details = facts.drop("embedding").select(F.col("id").alias("other_id"), F.struct(*[c for c in facts.columns if c != "embedding"]).alias("other"))
    return seen.withColumn("other_id", other).join(details, "other_id", "left")


def relation_report(relations: DataFrame, facts: DataFrame, first: int = 5) -> DataFrame:
    """Per relation type the number of relations and the first few with both facts; a missing fact drops the row."""
    a = facts.select(F.col("id").alias("fact_a_id"), F.struct("document_id", "entity", "metric", "value").alias("a"))
    b = facts.select(F.col("id").alias("fact_b_id"), F.struct("document_id", "entity", "metric", "value").alias("b"))
    by_type = Window.partitionBy("relation_type")
    counted = relations.withColumn("n", F.count(F.lit(1)).over(by_type)).withColumn("nth", F.row_number().over(by_type.orderBy("fact_a_id", "fact_b_id")))
    return counted.where(F.col("nth") <= first).join(a, "fact_a_id").join(b, "fact_b_id")


def relation_cube(relations: DataFrame, facts: DataFrame) -> DataFrame:
    """Relations by type, reason and the first fact's document, with all subtotals in one pass.

    ``level`` is the grouping id: of its bits 4, 2 and 1 each stands for a column that is totalled.  Columns that are
    totalled are null, as are missing values, which ``level`` tells apart.
    """
    of = facts.select(F.col("id").alias("fact_a_id"), "document_id")
    named = relations.join(of, "fact_a_id", "left")
    return named.cube("relation_type", "reason", "document_id").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"))


def matrix(facts: DataFrame, keys: list[str], column: str, values: list[str], measure: str) -> DataFrame:
    """One row per ``keys`` with the largest ``measure`` for each of ``values`` in ``column``, as a column of its name."""
    return facts.groupBy(*keys).pivot(column, values).agg(F.max(measure))


def reconciled(left: DataFrame, right: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """Rows of both tables side by side by ``keys``: left_id, right_id, ``side`` (both, left, right) and how far ``measure`` is apart.

    Null keys match nothing, so that such rows stand alone.
    """
    a = left.select(*keys, F.col("id").alias("left_id"), F.col(measure).alias("_a"))
    b = right.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("id").alias("right_id"), F.col(measure).alias("_b"))
    both = a.join(b, [F.col(k) == F.col(f"_{k}") for k in keys], "full")
    side = F.when(F.col("left_id").isNull(), "right").when(F.col("right_id").isNull(), "left").otherwise("both")
    return both.select(*[F.coalesce(k, f"_{k}").alias(k) for k in keys], "left_id", "right_id", side.alias("side"), (F.col("_b") - F.col("_a")).alias("apart"))


HISTORY = ("id", "document_id", "page_no", "entity", "metric", "value", "unit", "period", "scope", "geography", "reporting_basis", "quote", "norm_entity", "norm_metric", "norm_value", "norm_unit", "norm_period", "norm_scope")


def metric_history(facts: DataFrame, entity: str | None = None, metric: str | None = None) -> DataFrame:
    """Active facts of an entity and a metric (either optional), by period text and document."""
    found = active(facts)
    if entity:
        own = clean_entity(F.coalesce(F.nullif(F.col("norm_entity"), F.lit("")), F.col("entity")))
        found = found.where(own == clean_entity(F.lit(entity)))
    if metric:
        found = found.where(F.coalesce("norm_metric", canonical_metric(F.col("metric"))) == canonical_metric(F.lit(metric)))
    return found.select(*[c for c in HISTORY if c in facts.columns]).orderBy(F.coalesce("norm_period", F.lit("")), F.coalesce("document_id", F.lit("")), "id")


def documents_list(documents: DataFrame) -> DataFrame:
    return documents.orderBy(F.col("updated_at").desc_nulls_last(), "id")


def run_metrics(facts: DataFrame, relations: DataFrame, runs: DataFrame) -> DataFrame:
    """One row of totals: facts, relations and runs by outcome."""
    return (
        facts.agg(F.count(F.lit(1)).alias("facts"), F.count_if(F.coalesce("is_active", F.lit(True))).alias("active_facts"))
        .join(relations.agg(F.count(F.lit(1)).alias("relations")))
        .join(runs.agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "failed").alias("failed_runs"), F.coalesce(F.sum("facts_extracted"), F.lit(0)).alias("facts_extracted")))
    )


def surrogate_ids(df: DataFrame, key: Column, start: int = 0) -> DataFrame:
    """``id``: the rank of each row by a stable business key, after ``start``.

    Ranks are counted per range of keys and added up over ranges, so no task holds all rows.
    """
    from ledgerloom.sources.storage import materialize

    ranged = materialize(df.withColumn("_key", key).repartitionByRange(F.col("_key")).withColumn("_part", F.spark_partition_id()), "ids")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_key"))
    return ranged.withColumn("_n", inside).join(F.broadcast(before), "_part").select(*df.columns, (F.col("_n") + F.col("_before") + start).cast("long").alias("id"))
