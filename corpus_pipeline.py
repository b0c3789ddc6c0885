"""Corpus preparation: quality, line deduplication, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on what the stage before it kept.  All but the
last return the columns of ``documents``; the last returns the packed pieces.

Defined cases, the same for every stage: a null text counts as the empty text and stays null; an
empty text is kept by all stages, unless the quality stage rejects it, and packs as one piece; a
null doc_id is kept; rows that repeat doc_id and text share a decision; rows with equal ids and
different texts are decided apart; very long texts are read whole; an empty table gives an empty
result; other columns are kept, whatever their names, but for the last stage, which ignores them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm import jaccard, line_dedup, packing, quality, queries, secret_scan
from ledgerloom.llm.runtime import materialize, unused, where_computed


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted quality is 1; rows that share a doc_id share its decision only by text."""
    scores = quality.scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep_hash=True)
    bad = scores.where("predicted = 0").select(F.col("doc_id").alias("b_id"), "text_hash").distinct()
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.join(bad, docs.doc_id.eqNullSafe(bad.b_id) & (own == bad.text_hash), "left_anti")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated chunks of lines; a document that has nothing left goes."""
    left = line_dedup.deduplicated(docs)
    left = left.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return where_computed(left, "text IS NULL OR n_chars > 0")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component, with the smallest doc_id (a null one last); all documents without words."""
    groups = jaccard.component_ids(docs, keep_keys=True).where("n_shingles > 0")
    # rows equal in doc_id and text are one here
    rows = groups.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("times"), F.first("component_key").alias("component_key"))
    order = Window.partitionBy("component_key").orderBy(F.col("doc_id").asc_nulls_last(), "text_hash")
    rows = materialize(rows.withColumn("nth", F.row_number().over(order)).where("nth > 1 OR times > 1"), "copies")
    own = F.xxhash64(F.coalesce("text", F.lit("")))

    def of(marked: DataFrame, how: str) -> DataFrame:
        marked = marked.select(F.col("doc_id").alias("g_id"), F.col("text_hash").alias("g_hash"))
        return docs.join(marked, docs.doc_id.eqNullSafe(marked.g_id) & (own == marked.g_hash), how)

    if not rows.where("nth = 1").limit(1).count():
        return of(rows, "left_anti")
    again, row, nth = of(rows.where("nth = 1"), "left_semi"), unused(docs, "_row"), unused(docs, "_nth")
    # equal rows of one doc_id and text are alike in the result; others go by what can be compared of them
    rest = [F.to_json(F.struct(F.col(f"`{c}`"))) for c in docs.columns if c not in ("doc_id", "text")]
    first = Window.partitionBy("doc_id", F.xxhash64(F.coalesce("text", F.lit("")))).orderBy(*(rest or [F.lit(0)]))
    one = again.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), F.row_number().over(first).alias(nth)).where(F.col(nth) == 1)
    return of(rows, "left_anti").unionByName(one.select(*[F.col(f"{row}.`{c}`").alias(c) for c in docs.columns]))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every found span replaced by a mark."""
    found = secret_scan.redacted(docs)
    return found.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in the packed sequences."""
    return packing.pack_documents(docs, queries.BPE, queries.BPE_RANKS)


STAGES = [
    ("quality", good_quality),
    ("line_dedup", without_repeated_lines),
    ("near_duplicates", without_near_duplicates),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: The stages are not expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
