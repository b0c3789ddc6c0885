"""What a viewer shows of facts, relations and documents, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the viewer.
TIMELINE_ROWS, CITATIONS = 12, 5
LARGE_PAGES = 7


def percent(confidence: Column) -> Column:
    """Whole percent, halves up; null stays null."""
    return F.floor(confidence * 100 + 0.5).cast("long")


def number_text(value: Column) -> Column:
    """A number without an exponent or zeros at its end."""
    return F.regexp_replace(value.cast("decimal(38,6)").cast("string"), r"\.?0+$", "")


def normalized_line(metric: Column, value: Column, unit: Column, period: Column) -> Column:
    """``metric = value unit (period)``; '' without a value, zero and empty parts left out."""
    parts = F.concat_ws(" ", F.when(value != 0, number_text(value)), F.nullif(unit, F.lit("")))
    line = F.concat(F.coalesce(metric, F.lit("")), F.lit(" = "), parts, F.coalesce(F.concat(F.lit(" ("), F.nullif(period, F.lit("")), F.lit(")")), F.lit("")))
    return F.when(value.isNull(), "").otherwise(line)


def shown_quote(evidence: Column, quote: Column) -> Column:
    """The relation's evidence unless it is blank, else the fact's quote."""
    return F.when(F.trim(F.coalesce(evidence, F.lit(""))) != "", evidence).otherwise(quote)


def shown_basis(basis: Column, is_reported: Column) -> Column:
    return F.coalesce(F.nullif(basis, F.lit("")), F.when(is_reported == F.lit(False), "estimate").otherwise("actual"))


def reason_text(reason: Column) -> Column:
    """Words instead of underscores; no reason and ``none`` are null."""
    return F.replace(F.nullif(F.nullif(reason, F.lit("none")), F.lit("")), F.lit("_"), F.lit(" "))


def is_large(num_pages: Column) -> Column:
    """By all pages, unlike the chunk filter, which counts those with text."""
    return F.coalesce(num_pages > LARGE_PAGES, F.lit(False))


def timeline(history: DataFrame, rows: int = TIMELINE_ROWS) -> DataFrame:
    """The first rows of a metric's history with normalized fields before raw ones."""
    value = F.coalesce(number_text(F.col("norm_value")), F.col("value"))
    return history.limit(rows).select("id", "document_id", F.coalesce("norm_period", "period").alias("period"), value.alias("value"), F.coalesce("norm_unit", "unit").alias("unit"), "scope")


def cited(citations: Column) -> Column:
    return F.slice(citations, 1, CITATIONS)
