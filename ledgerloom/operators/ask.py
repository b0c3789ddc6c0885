"""Questions over facts: filters read from the question, retrieval, cited facts, number grounding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ledgerloom.functions.normalize import canonical_metric
from ledgerloom.functions.text import NUMBER_IN_ANSWER, numbers, tokens
from ledgerloom.functions.vectors import hashed_embedding
from ledgerloom.operators import model_stage, retrieve
from ledgerloom.sources.storage import materialize

#: Words of a question that hint at a metric.
METRIC_HINTS = ("revenue", "profit", "ebitda", "gdp", "inflation", "eps", "margin", "aum", "npa")
QUESTION_K = 8
PROMPT = """You answer a question from grounded facts only. Every number in the answer must stand in a fact.
Cite facts as [fact_id]. If the facts don't suffice, say so.

Question: {question}

Facts:
{facts}

Answer with a JSON object: {{"answer": "...", "cited_fact_ids": [1, 2]}}"""

#: The fields of a cited fact.
CITED = ("id", "document_id", "page_no", "entity", "metric", "value", "unit", "period", "scope", "geography", "reporting_basis", "quote", "evidence_status")


def narrowed(facts: DataFrame, question: str) -> DataFrame:
    """Sound active facts; of the entities that the question names, if any; of its metrics, if that leaves some."""
    asked = F.lit(question.lower())
    pool = retrieve.keyed(facts.where("coalesce(is_active, true) AND coalesce(evidence_status, '') <> 'unverifiable'"))
    named = (F.col("_entity") != "") & asked.contains(F.col("_entity"))
    flags = pool.agg(F.coalesce(F.bool_or(named), F.lit(False)).alias("_any_named"))  # one row
    pool = pool.join(F.broadcast(flags)).where(named | ~F.col("_any_named")).drop("_any_named")
    hints = [h for h in METRIC_HINTS if h in question.lower()]
    if not hints:
        return pool
    names = [canonical_metric(F.lit(h)) for h in hints]
    hinted = F.lit(False)
    for name in names:
        hinted = hinted | (F.coalesce("norm_metric", F.lit("")) == name) | F.lower(F.coalesce("metric", F.lit(""))).contains(name)
    found = pool.agg(F.coalesce(F.bool_or(hinted), F.lit(False)).alias("_any_hinted"))
    return pool.join(F.broadcast(found)).where(hinted | ~F.col("_any_hinted")).drop("_any_hinted")


def facts_for(facts: DataFrame, question: str, k: int = QUESTION_K) -> DataFrame:
    """The facts retrieved for a question with score and rank; without any hit the first k of the pool."""
    spark = facts.sparkSession
    pool = narrowed(facts, question)
    query = spark.range(1).select(F.lit(-1).cast("long").alias("id"), *[F.lit("").alias(f"_{c}") for c in retrieve.BONUS], tokens(F.lit(f"{question} {question}")).alias("_tokens"), hashed_embedding(F.lit(question)).alias("embedding"))
    pairs = pool.select(F.lit(-1).cast("long").alias("fact_id"), F.col("id").alias("cand_id"), F.lit(0).alias("tier"))
    vector = retrieve.vector_hits(pairs, query, pool)
    lexical = retrieve.bm25_corpus(query.select(F.col("id").alias("fact_id"), "_tokens"), pool.select(F.col("id").alias("cand_id"), "_tokens"), retrieve.LEXICAL_K)
    best = retrieve.fused(vector, lexical, query, pool, k)
    bare = pairs.join(best.select("fact_id").distinct(), "fact_id", "left_anti").orderBy("cand_id").limit(k)
    bare = bare.select("fact_id", "cand_id", F.lit(None).cast("double").alias("score"), F.row_number().over(Window.partitionBy("fact_id").orderBy("cand_id")).alias("rank"))
    chosen = best.unionByName(bare).select(F.col("cand_id").alias("id"), "score", "rank")
    return facts.join(chosen, "id")


def unsupported(answer: Column, allowed: Column) -> Column:
    """Numbers of the answer, in order, that are not allowed with or without a percent sign; bare years are."""
    found = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(NUMBER_IN_ANSWER), F.lit(0))

    def bad(n: Column) -> Column:
        bare = F.replace(n, F.lit(","), F.lit(""))
        known = F.array_contains(allowed, bare) | F.array_contains(allowed, F.regexp_replace(bare, "%+$", ""))
        return ~bare.rlike("^(19|20)[0-9]{2}$") & ~known

    return F.filter(found, bad)


def grounded(answer: Column, allowed: Column) -> Column:
    """struct(answer with unsupported numbers marked, unsupported numbers), by a fold over gaps and matches."""
    text = F.coalesce(answer, F.lit(""))
    parts = F.arrays_zip(F.split(text, NUMBER_IN_ANSWER, -1).alias("gap"), F.regexp_extract_all(text, F.lit(NUMBER_IN_ANSWER), F.lit(0)).alias("number"))
    wrong = unsupported(answer, allowed)

    def step(made: Column, part: Column) -> Column:
        number = part.getField("number")
        marked = F.when(number.isNull(), "").when(F.array_contains(wrong, number), F.concat(F.lit("[UNSUPPORTED:"), number, F.lit("]"))).otherwise(number)
        return F.concat(made, part.getField("gap"), marked)

    return F.struct(F.aggregate(parts, F.lit(""), step).alias("answer"), wrong.alias("unsupported"))


def allowed_numbers(facts: DataFrame) -> DataFrame:
    """One row: the distinct numbers in the facts' values, normalized values and quotes."""
    each = F.array_union(F.array_union(numbers(F.col("value")), numbers(F.col("norm_value").cast("string"))), numbers(F.col("quote")))
    return facts.select(F.explode(each).alias("n")).agg(F.array_sort(F.collect_set("n")).alias("allowed"))


def answer_question(facts: DataFrame, question: str, model: Callable[[str], object] | None = None, k: int = QUESTION_K) -> DataFrame:
    """One row: answer, unsupported, cited (array of facts).

    At most k facts reach the driver for the prompt.  Without a model, or where it is down, the answer lists the first five
    as they are.  Ids that a model cites are kept where they exist, and all facts are cited where none does; numbers of its
    answer that no cited fact has are marked.  An answer that is no object is taken as its text.
    """
    if not question or not question.strip():
        raise ValueError("a question must not be blank")
    spark = facts.sparkSession
    best = materialize(facts_for(facts, question, k), "best")  # at most k rows, read for the prompt, the citations and the numbers
    rows = [r.asDict() for r in best.orderBy("rank").collect()]

    def line(row: dict, *fields: str) -> str:
        said = {f: "" if row.get(f) is None else str(row[f]) for f in fields}
        return f"[{row['id']}] {said.pop('entity')} | {said.pop('metric')} | {said.pop('value')} {said.pop('unit')} | {said.pop('period')}" + "".join(f" | {f}: {v}" for f, v in said.items())

    short = ("entity", "metric", "value", "unit", "period")
    said, cited = None, []
    if model is not None and rows:
        try:
            reply = model(PROMPT.format(question=question, facts="\n".join(line(r, *short, "scope", "reporting_basis", "page_no", "quote") for r in rows)))
        except (model_stage.TransientError, model_stage.QuotaError):
            reply = None
        if isinstance(reply, dict):
            said, cited = str(reply.get("answer") or ""), {int(i) for i in reply.get("cited_fact_ids") or [] if str(i).isdigit()}
        elif reply is not None:
            said = str(reply)
    by_model = said is not None
    if not by_model:
        said = "No model is available. Retrieved facts:\n" + "\n".join(line(r, *short) for r in rows[:5]) if rows else "No facts found."
    known = [r["id"] for r in rows if r["id"] in cited] or [r["id"] for r in rows]
    kept = best.where(F.col("id").isin(known)) if known else best.limit(0)
    columns = [c for c in CITED if c in facts.columns]
    citations = kept.agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("cited"))
    row = spark.createDataFrame([(said,)], StructType([StructField("said", StringType())])).join(allowed_numbers(kept)).join(citations)
    none = F.array().cast(ArrayType(StringType()))
    checked = grounded(F.col("said"), F.coalesce("allowed", none)) if by_model else F.struct(F.col("said").alias("answer"), none.alias("unsupported"))
    return row.withColumn("_g", checked).select("_g.*", "cited")
