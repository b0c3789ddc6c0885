"""How two facts relate: one ordered decision table, and the driver that applies it to candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import coerce
from ledgerloom.functions.normalize import canonical_unit, clean_entity
from ledgerloom.operators import retrieve
from ledgerloom.sources.storage import materialize

#: Tolerances and unit families.
SAME = 0.01
RESTATED = 0.15
UNIT_SYNONYMS = (("inr", "rs"), ("usd", "$"), ("percent", "pct", "%"))
UNSTATED_SCOPES = ("", "unspecified", "none", "null")
UNSTATED_GEOGRAPHIES = ("", "unspecified", "none", "null", "n/a")

def _either(a: Column, b: Column) -> Column:
    """The first that is neither null nor ''."""
    return F.coalesce(F.nullif(a, F.lit("")), b, F.lit(""))


def _stated(normal: Column, raw: Column, unstated: tuple[str, ...]) -> Column:
    value = F.lower(F.trim(_either(normal, raw)))
    return F.when(value.isin(*unstated), F.lit("")).otherwise(value)


def side(df: DataFrame, prefix: str) -> Column:
    """What the table reads of a fact, as one struct named by the prefix; a missing field is null."""
    kinds = {"is_reported_value": "boolean", "norm_value": "double"}

    def field(name: str) -> Column:
        return (F.col(name) if name in df.columns else F.lit(None)).cast(kinds.get(name, "string"))

    basis = F.lower(F.trim(F.coalesce(field("reporting_basis"), F.lit(""))))
    implied = F.when(field("is_reported_value") == F.lit(False), "estimate").otherwise("actual")
    return F.struct(
        clean_entity(_either(field("norm_entity"), field("entity"))).alias("entity"),
        F.coalesce(field("norm_metric"), F.lit("")).alias("metric"),
        _either(field("norm_unit"), canonical_unit(field("unit"))).alias("unit"),
        field("norm_value").alias("value"),
        F.coalesce(field("norm_period"), F.lit("")).alias("period"),
        _stated(field("norm_scope"), field("scope"), UNSTATED_SCOPES).alias("scope"),
        _stated(field("norm_geography"), field("geography"), UNSTATED_GEOGRAPHIES).alias("geography"),
        F.when(basis == "", implied).when(basis == "reported", "actual").otherwise(basis).alias("basis"),
        field("quote").alias("quote"),
    ).alias(prefix)


def classify(a: Column, b: Column) -> Column:
    """struct(rule, relation_type, confidence, reason) for two ``side`` structs; a null type is left to a model.

    Rules are tried in order.  The two sides are the new fact and the candidate; the table isn't symmetric.
    """
    ea, eb = a["entity"], b["entity"]
    ma, mb = a["metric"], b["metric"]
    ua, ub = a["unit"], b["unit"]
    va, vb = a["value"], b["value"]
    pa, pb = a["period"], b["period"]
    sa, sb = a["scope"], b["scope"]
    ga, gb = a["geography"], b["geography"]
    same_entity, same_metric = (ea != "") & (ea == eb), (ma != "") & (ma == mb)
    complete = (ma != "") & (ua != "") & va.isNotNull() & vb.isNotNull() & (ea != "") & (eb != "")
    la, lb = (F.lower(F.when(u == "", "unitless").otherwise(u)) for u in (ua, ub))
    same_unit = (la == lb) | (la == "unitless") | (lb == "unitless")
    for family in UNIT_SYNONYMS:
        same_unit = same_unit | la.isin(*family) & lb.isin(*family)
    rupees_a, rupees_b = (u.startswith("inr") | (u == "rs") for u in (ua, ub))
    dollars_a, dollars_b = (u.startswith("usd") | (u == "$") for u in (ua, ub))
    apart = F.abs(va - vb) / F.greatest(F.abs(va), F.abs(vb))
    same_period = pa == pb

    def verdict(rule: str, kind: str | None, confidence: float | None, reason: str = "none") -> Column:
        return F.struct(F.lit(rule).alias("rule"), F.lit(kind).cast("string").alias("relation_type"), F.lit(confidence).cast("double").alias("confidence"), F.lit(reason if kind else None).cast("string").alias("reason"))

    return (
        F.when((ea != "") & (eb != "") & (ea != eb), verdict("C1", "unrelated", 0.9))
        .when((ma != "") & (mb != "") & (ma != mb), verdict("C2", "unrelated", 0.85))
        .when(~complete & same_entity & same_metric, verdict("C3", "needs_review", 0.4))
        .when(~complete, verdict("C3", None, None))
        .when(~same_entity | ~same_metric, verdict("C4", None, None))
        .when(a["basis"] != b["basis"], verdict("C5", "reconcilable", 0.88, "actual_vs_estimate"))
        .when((ga != "") & (gb != "") & (ga != gb), verdict("C6", "reconcilable", 0.9, "different_geography"))
        .when((sa != "") & (sb != "") & (sa != sb), verdict("C7", "reconcilable", 0.9, "different_scope"))
        .when(~same_unit & (rupees_a & dollars_b | dollars_a & rupees_b), verdict("C8", "reconcilable", 0.9, "different_currency"))
        .when(~same_unit, verdict("C8", "reconcilable", 0.9, "different_unit"))
        .when((va == 0) & (vb == 0), verdict("C10", None, None))
        .when((pa != "") & (pb != "") & ~same_period, verdict("C11", "reconcilable", 0.9, "different_reporting_period"))
        .when(apart <= SAME, verdict("C12", "corroborates", 0.95))
        .when(same_period & (apart < RESTATED), verdict("C13", "reconcilable", 0.75, "updated_information"))
        .otherwise(verdict("C14", None, None))
    )


def classified(pairs: DataFrame, facts: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """``pairs`` (fact_id, cand_id, ...) with the structs a and b and the verdict's columns."""
    new = facts if new is None else new
    left = new.select(F.col("id").alias("fact_id"), side(new, "a"))
    right = facts.select(F.col("id").alias("cand_id"), side(facts, "b"))
    joined = pairs.join(left, "fact_id").join(right, "cand_id")
    return joined.withColumn("_v", classify(F.col("a"), F.col("b"))).select("*", "_v.*").drop("_v")


def pair_key(a: Column, b: Column) -> Column:
    return F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))


def compare_new_facts(new: DataFrame, facts: DataFrame, existing: DataFrame, model: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Relations of new facts: fact_a_id, fact_b_id, relation_type, confidence, reason, evidence, source.

    Unverifiable facts take no part; pairs that ``existing`` (fact_a_id, fact_b_id, is_active) relates in either
    direction are skipped; of a pair found from both sides the first stands.  Pairs that the table leaves open
    go to ``model`` (pairs with a and b in, the verdict's columns out); without one they need review.
    Unrelated pairs are dropped.
    """
    sound = "coalesce(evidence_status, 'pending') <> 'unverifiable'"
    new, facts = new.where(sound), facts.where(sound)
    found = retrieve.candidates(new, facts)
    known = existing.where("coalesce(is_active, true)").select(pair_key(F.col("fact_a_id"), F.col("fact_b_id")).alias("_pair")).distinct()
    fresh = found.withColumn("_pair", pair_key(F.col("fact_id"), F.col("cand_id"))).join(known, "_pair", "left_anti")
    first = Window.partitionBy("_pair").orderBy("fact_id", "rank")
    fresh = fresh.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("fact_id", "cand_id", "rank")
    fresh = materialize(fresh, "pairs")  # read for the settled and for the open pairs
    judged = classified(fresh, facts, new)
    settled = judged.where("relation_type IS NOT NULL").withColumn("source", F.lit("table"))
    open_pairs = judged.where("relation_type IS NULL")
    if model is None:
        answered = open_pairs.withColumns({"relation_type": F.lit("needs_review"), "confidence": F.lit(0.3), "reason": F.lit("none"), "source": F.lit("none")})
    else:
        said = model(open_pairs)
        source = F.col("source") if "source" in said.columns else F.lit("model")
        answered = said.withColumns({"relation_type": coerce.relation_type(F.col("relation_type")), "confidence": coerce.relation_confidence(F.col("confidence")), "reason": coerce.reason(F.col("reason")), "source": source})
    columns = [
        F.col("fact_id").alias("fact_a_id"),
        F.col("cand_id").alias("fact_b_id"),
        "relation_type",
        "confidence",
        "reason",
    ]

    def evidence(df: DataFrame) -> list[Column]:
        """The model's own evidence where it gives some."""
        return [F.coalesce(F.col(f"fact_{x}_evidence") if f"fact_{x}_evidence" in df.columns else F.lit(None), F.col(f"{x}.quote"), F.lit("")).alias(f"fact_{x}_evidence") for x in "ab"]

    return settled.select(*columns, *evidence(settled), "source").unionByName(answered.select(*columns, *evidence(answered), "source")).where("relation_type <> 'unrelated'")
