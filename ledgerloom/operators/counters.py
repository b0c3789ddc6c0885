"""Counters of a run, gathered while its tables are written or by one aggregation each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ledgerloom.functions.text import is_candidate_page

MODEL_COUNTERS = ("answers", "cached", "quota", "failed", "prompt_chars", "answer_chars")


def page_counts(pages: DataFrame) -> DataFrame:
    """Per document (document_id): pages, candidates and dropped pages."""
    candidate = F.coalesce(is_candidate_page(F.col("text")), F.lit(False))
    counted = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(candidate).alias("candidates"))
    return counted.withColumn("dropped", F.col("pages") - F.col("candidates"))


def decision_counts(judged: DataFrame) -> DataFrame:
    """One row: pairs that the table of rules decided, and those left to the model."""
    return judged.agg(F.count_if(F.col("relation_type").isNotNull()).alias("by_table"), F.count_if(F.col("relation_type").isNull()).alias("by_model"))


def index_size(facts: DataFrame) -> DataFrame:
    """One row: facts that a vector search can find."""
    return facts.agg(F.count_if(F.size("embedding") > 0).alias("size"))


def observed(replies: DataFrame, name: str = "model") -> tuple[DataFrame, Observation]:
    """``replies`` of the model stage, and its counters once the frame has been written: ``observation.get``."""
    observation = Observation(name)
    status = F.col("status")
    counts = [
        F.count_if(status == "ok").alias("answers"),
        F.count_if(status == "cached").alias("cached"),
        F.count_if(status == "quota").alias("quota"),
        F.count_if(status == "failed").alias("failed"),
        F.coalesce(F.sum(F.length("prompt")), F.lit(0)).alias("prompt_chars"),
        F.coalesce(F.sum(F.length("answer")), F.lit(0)).alias("answer_chars"),
    ]
    return replies.observe(observation, *counts), observation


def added(*runs: dict[str, int]) -> dict[str, int]:
    """Totals over runs, with the number of calls that reached a provider."""
    total = {c: sum(run.get(c, 0) for run in runs) for c in MODEL_COUNTERS}
    return total | {"calls": total["answers"] + total["quota"] + total["failed"]}
