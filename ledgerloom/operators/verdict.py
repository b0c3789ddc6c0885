"""The model's verdict on pairs that the decision table leaves open: prompt, answer, safeguards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import coerce
from ledgerloom.functions.text import blank_to_null, without_fences
from ledgerloom.operators import compare, model_stage
from ledgerloom.schemas import REASONS, RELATION_TYPES, VERDICT

#: Confidence of a pair that no model has judged.
UNJUDGED = 0.3
#: What a prompt says of each fact: a label and the field.
SAID = (("entity", "entity"), ("metric", "metric"), ("value", "value"), ("unit", "unit"), ("period", "period"), ("scope", "scope"), ("geography", "geography"), ("basis", "reporting_basis"), ("quote", "quote"))
HEAD = f"""Two facts come from two documents. Decide how they relate.

relation_type is one of: {", ".join(RELATION_TYPES)}.
- corroborates: all dimensions agree and the values do, but for rounding or units
- contradicts: all dimensions agree and the values can't both be right; another period, scope, unit, currency, geography or basis is never a contradiction
- reconcilable: a difference that one reason explains
- unrelated: about different things
- needs_review: can't be told
reason is one of: {", ".join(REASONS)}; "none" unless reconcilable.
"""
TAIL = 'Answer with one JSON object: {"relation_type": "", "confidence": 0.0, "reason": "", "explanation": "", "fact_a_evidence": "", "fact_b_evidence": ""}'


def described(name: str, fact: Column) -> Column:
    """One fact in the prompt, a line a field; a missing field is ``unspecified``, a missing unit is empty."""
    lines = [F.concat(F.lit(f"Fact {name}, from "), F.coalesce(fact["document_id"], F.lit("")), F.lit(", page "), F.coalesce(fact["page_no"].cast("string"), F.lit("")))]
    for label, field in SAID:
        missing = "" if field in ("unit", "quote") else "actual" if field == "reporting_basis" else "unspecified"
        lines.append(F.concat(F.lit(f"{label}: "), F.coalesce(F.nullif(fact[field].cast("string"), F.lit("")), F.lit(missing))))
    return F.concat_ws("\n", *lines)


def prompt(a: Column, b: Column) -> Column:
    return F.concat_ws("\n\n", F.lit(HEAD.rstrip()), described("A", a), described("B", b), F.lit(TAIL))


def _raw(facts: DataFrame, key: str, name: str) -> DataFrame:
    """(``key``, ``name``): each fact's own fields, as its document has them."""
    fields = ["document_id", "page_no", *[f for _, f in SAID]]
    return facts.select(F.col("id").alias(key), F.struct(*[(F.col(f) if f in facts.columns else F.lit(None)).cast("string").alias(f) for f in fields]).alias(name))


def verdicts(pairs: DataFrame, new: DataFrame, facts: DataFrame, providers: Sequence[model_stage.Provider], cache: DataFrame | None = None) -> DataFrame:
    """``pairs`` (fact_id, cand_id, a, b, ...) with relation_type, confidence, reason, explanation, fact_a_evidence, fact_b_evidence, source.

    A pair that no provider answers needs review, with the status as its explanation and source 'none'; an answer that isn't
    a JSON object drops its pair.  A contradiction that the decision table reconciles becomes the table's verdict.
    """
    named = pairs.join(_raw(new, "fact_id", "_raw_a"), "fact_id").join(_raw(facts, "cand_id", "_raw_b"), "cand_id")
    replies = model_stage.answered(named.withColumn("prompt", prompt(F.col("_raw_a"), F.col("_raw_b"))), providers, cache)
    down = ~F.col("status").isin("ok", "cached")
    text = without_fences(F.col("answer"))
    judged = replies.withColumn("_said", F.from_json(text, VERDICT)).where(down | text.startswith("{") & F.col("_said").isNotNull())
    judged = judged.withColumn("_table", compare.classify(F.col("a"), F.col("b")))
    kind = coerce.relation_type(F.col("_said.relation_type"))
    guarded = (kind == "contradicts") & F.coalesce(F.col("_table.relation_type") == "reconcilable", F.lit(False))

    def of(name: str, model: Column) -> Column:
        return F.when(guarded, F.col(f"_table.{name}")).otherwise(model)

    columns = {
        "relation_type": F.when(down, "needs_review").otherwise(of("relation_type", kind)),
        "confidence": F.when(down, UNJUDGED).otherwise(of("confidence", coerce.relation_confidence(F.col("_said.confidence")))),
        "reason": F.when(down, "none").otherwise(of("reason", coerce.reason(F.col("_said.reason")))),
        "explanation": F.when(down, F.concat(F.lit("no model answered: "), F.col("status"))).otherwise(F.coalesce("_said.explanation", F.lit(""))),
        "fact_a_evidence": F.coalesce(blank_to_null(F.col("_said.fact_a_evidence")), F.col("_raw_a.quote"), F.lit("")),
        "fact_b_evidence": F.coalesce(blank_to_null(F.col("_said.fact_b_evidence")), F.col("_raw_b.quote"), F.lit("")),
        "source": F.when(down, "none").when(guarded, "table").otherwise("model"),
    }
    kept = [c for c in pairs.columns if c not in columns]
    return judged.select(*kept, *[v.alias(k) for k, v in columns.items()])
