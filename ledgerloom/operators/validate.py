"""Row gates: valid rows go on, rejects go to a quarantine with their reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import coerce, vectors
from ledgerloom.functions.text import stripped
from ledgerloom.schemas import REASONS, RELATION_TYPES


def _problems(rules: dict[str, Column]) -> Column:
    """Names of the rules that do not hold (null counts as not holding)."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()]))


def split(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with ``problems``)."""
    judged = df.withColumn("problems", _problems(rules))
    return judged.where(F.size("problems") == 0).drop("problems"), judged.where(F.size("problems") > 0)


def facts(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Coerced facts that have a page and an entity, metric, value and quote; and the rejects."""
    coerced = raw.withColumns(
        {
            "confidence": coerce.confidence(F.col("confidence")),
            "reporting_basis": coerce.reporting_basis(F.col("reporting_basis")),
            "numeric_confidence": coerce.numeric_confidence(F.col("numeric_confidence")),
        }
    )
    rules = {"page_no": F.col("page_no") >= 1} | {c: F.length(c) >= 1 for c in ("entity", "metric", "value", "quote")}
    return split(coerced, rules)


def normalized_facts(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    rules = {"norm_value": F.col("norm_value").isNotNull(), "norm_unit": F.col("norm_unit").isNotNull()}
    return split(df, rules | {c: F.length(c) >= 1 for c in ("norm_entity", "norm_metric")})


def embeddings(df: DataFrame, dimension: int = vectors.DIMENSION) -> DataFrame:
    """``embedding`` nulled where unusable, with its status and error."""
    usable = vectors.is_usable(F.col("embedding"), dimension)
    return df.withColumns(
        {
            "embedding_status": F.when(usable, "success").otherwise("failed"),
            "embedding_error": F.when(~usable, "empty, zero, non-finite or wrongly sized vector"),
            "embedding": F.when(usable, F.col("embedding")),
        }
    )


def relations(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    coerced = df.withColumns(
        {
            "relation_type": coerce.relation_type(F.col("relation_type")),
            "reason": coerce.reason(F.col("reason")),
            "confidence": coerce.relation_confidence(F.col("confidence")),
        }
    )
    rules = {c: F.col(c).isNotNull() for c in ("fact_a_id", "fact_b_id")}
    return split(coerced, rules | {"relation_type": F.col("relation_type").isin(*RELATION_TYPES), "reason": F.col("reason").isin(*REASONS)})


def chunks(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    rules = {c: F.col(c).isNotNull() for c in ("document_id", "chunk_id")}
    rules |= {"start_page": F.col("start_page") >= 1, "end_page": F.col("end_page") >= F.col("start_page"), "text": F.length(stripped(F.col("text"))) > 0}
    return split(df, rules)
