"""Coercions of extracted fields into their enumerations and ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import stripped
from ledgerloom.schemas import REASONS


def confidence(level: Column) -> Column:
    """low, medium or high; anything else is medium."""
    found = F.lower(stripped(level))
    return F.when(found.isin("low", "medium", "high"), found).otherwise("medium")


def level_score(level: Column) -> Column:
    return F.when(level == "high", 0.9).when(level == "low", 0.35).otherwise(0.6)


#: Synonyms of the reporting bases.
BASES = {
    "actual": ("actual", "reported", "true"),
    "estimate": ("estimate", "estimated", "e", "consensus"),
    "forecast": ("forecast", "projected", "guidance", "outlook"),
    "target": ("target", "tp"),
}


def reporting_basis(basis: Column) -> Column:
    """One of four bases by its synonyms; an unknown word passes in lower case; null and blank are actual."""
    found = F.lower(stripped(basis))
    out = F.when(found.isNull() | (found == ""), "actual")
    for name, words in BASES.items():
        out = out.when(found.isin(*words), name)
    return out.otherwise(found)


def share(score: Column, default: float) -> Column:
    """A score in 0..1 from text or number: 5 < x <= 100 counts as a percentage, bad values are ``default``."""
    x = stripped(score.cast("string")).try_cast("double")
    scaled = F.when((x > 5.0) & (x <= 100.0), x / 100.0).otherwise(x)
    return F.when(x.isNull() | F.isnan(x), F.lit(default)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)))


def numeric_confidence(score: Column) -> Column:
    return share(score, 0.6)


def relation_confidence(score: Column) -> Column:
    return share(score, 0.5)


def _first_match(text: Column, rules: list[tuple[Column, str]], otherwise: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for condition, name in rules:
        out = out.when(condition, name)
    return out.otherwise(otherwise)


def relation_type(name: Column) -> Column:
    # fixed rules: words and their order
    s = F.lower(stripped(F.coalesce(name, F.lit(""))))
    words = (("review", "needs_review"), ("corroborat", "corroborates"), ("contradict", "contradicts"), ("reconcil", "reconcilable"))
    return _first_match(s, [(s.contains(w), n) for w, n in words], F.lit("unrelated"))


def reason(name: Column) -> Column:
    """The first rule that fits, in this fixed order; else the name itself if it is a reason, else none."""
    s = F.translate(F.lower(stripped(F.coalesce(name, F.lit("")))), "- ", "__")
    rules = [
        (s.contains("actual") & s.contains("estimat"), "actual_vs_estimate"),
        (s.contains("basis"), "different_reporting_basis"),
        (s.contains("period"), "different_reporting_period"),
        (s.contains("scope"), "different_scope"),
        (s.contains("def"), "different_definition"),
        (s.contains("geo"), "different_geography"),
        (s.contains("unit"), "different_unit"),
        (s.contains("curr"), "different_currency"),
        (s.contains("update") | s.contains("restate"), "updated_information"),
        (s.contains("estimat") | s.contains("method"), "different_estimation_method"),
    ]
    return _first_match(s, rules, F.when(s.isin(*REASONS), s).otherwise("none"))
