"""Grounding: does a fact's quote stand on its page, on another one, or nowhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import match_form, stripped
from ledgerloom.sources.storage import materialize

#: Fixed values of the window search.
SHORTEST_WINDOW = 20
COVERAGE = 0.7


def quote_windows(quote: Column, coverage: float = COVERAGE) -> Column:
    """The parts of a matchable quote any of which suffices: windows of the covered length at a quarter's stride."""
    n = F.length(quote)
    size = F.greatest(F.lit(SHORTEST_WINDOW), F.floor(n * coverage).cast("int"))
    stride = F.greatest(F.lit(1), F.floor(size / 4).cast("int"))
    starts = F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)), stride)
    return F.when(n >= SHORTEST_WINDOW, F.transform(starts, lambda i: F.substring(quote, i + 1, size))).otherwise(F.array(quote))


def stands_on(quote: Column, page: Column, coverage: float = COVERAGE) -> Column:
    """Whether the quote or one of its windows occurs in the page; both in match form; blank never does."""
    found = page.contains(quote) | F.exists(quote_windows(quote, coverage), lambda w: page.contains(w))
    return F.when((quote == "") | (page == ""), F.lit(False)).otherwise(F.coalesce(found, F.lit(False)))


def containing(needles: DataFrame, texts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, text_id, needle_id, needle): which texts (text_id, text) hold which needles (needle_id, needle) of equal ``keys``, all in match form.

    They meet on the needle's rarest inner word among the texts, which stands in a text that holds the needle between spaces as
    well; so a needle with an inner word that no text has is in none of them.  Only needles of fewer than three words meet
    every text of their keys.
    """
    keys = keys or []
    inner = F.expr("array_distinct(filter(slice(split(needle, ' '), 2, greatest(size(split(needle, ' ')) - 2, 0)), w -> w <> ''))")
    asked = needles.select(*keys, "needle_id", "needle", inner.alias("_inner"))
    each = asked.select(*keys, "needle_id", "needle", F.explode("_inner").alias("_word"), F.size("_inner").alias("_n"))
    words = texts.select(*keys, "text_id", F.explode(F.array_distinct(F.split("text", " "))).alias("_word"))
    words = materialize(words.join(each.select("_word").distinct(), "_word", "left_semi"), "words")
    frequency = words.groupBy("_word").agg(F.count(F.lit(1)).alias("_df"))
    rarest = F.min(F.struct("_df", (-F.length("_word")).alias("_size"), "_word")).alias("_best")
    anchored = each.join(frequency, "_word").groupBy(*keys, "needle_id", "needle", "_n").agg(F.count(F.lit(1)).alias("_known"), rarest)
    anchored = anchored.where("_known = _n").select(*keys, "needle_id", "needle", F.col("_best._word").alias("_word"))
    near = words.join(anchored, [*keys, "_word"]).select(*keys, "text_id", "needle_id", "needle")
    found = near.join(texts, [*keys, "text_id"]).where("contains(text, needle)")
    short = asked.where("size(_inner) = 0 AND needle <> ''").select(*keys, "needle_id", "needle")
    holds = F.expr("contains(text, needle)")
    rest = texts.join(short, keys).where(holds) if keys else texts.join(short, holds)
    columns = [*keys, "text_id", "needle_id", "needle"]
    return found.select(*columns).unionByName(rest.select(*columns))


def verified(facts: DataFrame, pages: DataFrame, composed: bool = True, coverage: float = COVERAGE) -> DataFrame:
    """``facts`` with evidence_status, evidence_error, the found page_no and n_hits.

    Facts have fact_id, document_id, document_version, page_no, quote and optionally chunk_pages (array<int>);
    pages have document_id, document_version, page_no, text.  A quote on its claimed page is verified.
    Otherwise the chunk's pages are searched, then the document's: a single hit, else a single exact hit, else
    the first page is taken, and a page other than the claimed one is flagged.  Facts whose quote stands on
    their claimed page don't take part in the search and have one hit; for the others their windows meet the pages of
    their document by ``containing``.  ``coverage`` is the share of a quote that has to stand on a page.
    """
    claims = facts if "chunk_pages" in facts.columns else facts.withColumn("chunk_pages", F.lit(None).cast("array<int>"))
    claims = claims.withColumn("_quote", match_form(stripped(F.coalesce("quote", F.lit(""))), composed))
    texts = pages.select("document_id", "document_version", F.col("page_no").alias("_page"), match_form(F.col("text"), composed).alias("_text"))
    within = F.col("chunk_pages").isNull() | (F.size("chunk_pages") == 0) | F.array_contains("chunk_pages", F.col("_page"))
    keys = ["document_id", "document_version"]
    asked = claims.select("fact_id", *keys, "page_no", "chunk_pages", "_quote").where("_quote <> ''")
    right = asked.join(texts.withColumnRenamed("_page", "page_no"), [*keys, "page_no"]).withColumn("_page", F.col("page_no"))
    right = right.where(within & stands_on(F.col("_quote"), F.col("_text"), coverage)).select("fact_id").distinct().withColumn("_right", F.lit(True))
    right = materialize(right, "right")
    lost = materialize(asked.join(right, "fact_id", "left_anti"), "lost")
    parts = lost.select(*keys, F.col("fact_id").alias("needle_id"), F.explode(F.array_union(F.array("_quote"), quote_windows(F.col("_quote"), coverage))).alias("needle"))
    held = texts.where("_text <> ''").select(*keys, F.col("_page").alias("text_id"), F.col("_text").alias("text"))
    met = containing(parts.distinct(), held, keys).groupBy("needle_id", "text_id").agg(F.collect_set("needle").alias("_needles"))
    hits = met.join(lost, F.col("needle_id") == F.col("fact_id")).withColumn("_page", F.col("text_id"))
    hits = hits.select("fact_id", "_page", within.alias("_near"), F.array_contains("_needles", F.col("_quote")).alias("_exact"))

    def summary(near: Column, name: str) -> list[Column]:
        exact = near & F.col("_exact")
        return [
            F.count_if(near).alias(f"{name}_hits"),
            F.count_if(exact).alias(f"{name}_exact"),
            F.min(F.when(exact, F.col("_page"))).alias(f"{name}_exact_page"),
            F.min(F.when(near, F.col("_page"))).alias(f"{name}_page"),
        ]

    found = hits.groupBy("fact_id").agg(*summary(F.col("_near"), "near"), *summary(F.lit(True), "all"))
    judged = claims.join(found, "fact_id", "left").join(right, "fact_id", "left")

    def chosen(name: str) -> Column:
        several = (F.col(f"{name}_hits") > 1) & (F.col(f"{name}_exact") == 1)
        return F.when(several, F.col(f"{name}_exact_page")).when(F.col(f"{name}_hits") > 0, F.col(f"{name}_page"))

    page = F.when(F.col("_right"), F.col("page_no")).otherwise(F.coalesce(chosen("near"), chosen("all")))
    claimed = F.coalesce(F.col("page_no").cast("string"), F.lit("None"))
    nowhere = F.concat(F.lit("no page holds the quote (page "), claimed, F.lit(" was claimed)"))
    moved = F.concat(F.lit("page "), claimed, F.lit(" was claimed, the quote is on page "), page.cast("string"), F.lit("; corrected"))
    blank = stripped(F.coalesce("quote", F.lit(""))) == ""
    same = F.coalesce(page == F.col("page_no"), F.lit(False))
    return judged.select(
        *[c for c in facts.columns if c != "page_no"],
        F.when(blank | page.isNull(), "unverifiable").when(same, "verified").otherwise("flagged").alias("evidence_status"),
        F.when(blank, "blank quote").when(page.isNull(), nowhere).when(~same, moved).alias("evidence_error"),
        F.coalesce(page, F.col("page_no")).cast("int").alias("page_no"),
        F.when(F.col("_right"), 1).otherwise(F.coalesce("all_hits", F.lit(0))).cast("long").alias("n_hits"),
    )
