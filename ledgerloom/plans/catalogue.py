"""Named queries over the star-schema tables and the SQL each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import coerce, normalize, text, vectors
from ledgerloom.operators import ask, chunk, compare, counters, embed, evidence, retrieve, tables, viewer
from ledgerloom.plans import oracle, reports, temporal
from ledgerloom.plans.inputs import document_pages, facts, table
from ledgerloom.sources import lake, pages
from ledgerloom.sources.storage import materialize
from ledgerloom.streaming import jobs, windows


def _pairs(all_facts: DataFrame) -> DataFrame:
    """Same-entity pairs of facts from different documents, in document order."""
    own = F.coalesce("norm_entity", normalize.clean_entity(F.col("entity")))
    left = all_facts.select(F.col("id").alias("fact_id"), own.alias("e"))
    right = all_facts.select(F.col("id").alias("cand_id"), own.alias("e"))
    return left.join(right, "e").where("fact_id % 10 < cand_id % 10").drop("e")


def relation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = facts(spark, sf_dir)
    return compare.classified(_pairs(found), found).select(F.col("fact_id").alias("fact_a_id"), F.col("cand_id").alias("fact_b_id"), "rule", "relation_type", "confidence", "reason")


def relation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation_pairs(spark, sf_dir).groupBy("relation_type", "reason").agg(F.count(F.lit(1)).alias("n_pairs"))


def relation_top5_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relation_pairs(spark, sf_dir).where("relation_type IS NOT NULL")
    return tables.relation_report(found, facts(spark, sf_dir)).select("relation_type", F.col("n").alias("n_pairs"), "nth", "fact_a_id", "fact_b_id", F.col("a.document_id").alias("document_a"), F.col("b.document_id").alias("document_b"))


def fact_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relation_pairs(spark, sf_dir).where("relation_type = 'corroborates' OR rule = 'C13'").withColumn("is_active", F.lit(True))
    seen = tables.fact_relations(found, facts(spark, sf_dir))
    return seen.select("fact_id", "other_id", "relation_type", F.col("other.document_id").alias("other_document"), F.col("other.norm_period").alias("other_period"))


def metric_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.metric_history(facts(spark, sf_dir), "Nation_7 Ltd.", "net sales")
    return found.select("id", "document_id", "norm_entity", "norm_metric", "norm_period", "norm_value")


def gold_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lake.gold(facts(spark, sf_dir)).select("fact_id", "document_id", "entity", "metric", "unit", "period", "scope", "value")


def pair_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unordered pair once, whichever side found it; pairs within 1 % are taken as known."""
    found = relation_pairs(spark, sf_dir)
    turned = found.select(F.col("fact_b_id").alias("fact_a_id"), F.col("fact_a_id").alias("fact_b_id"), "rule")
    both = found.select("fact_a_id", "fact_b_id", "rule").unionByName(turned)
    key = compare.pair_key(F.col("fact_a_id"), F.col("fact_b_id"))
    known = found.where("rule = 'C12'").select(key.alias("pair")).distinct()
    fresh = both.withColumn("pair", key).join(known, "pair", "left_anti")
    first = Window.partitionBy("pair").orderBy("fact_a_id")
    return fresh.withColumn("n", F.row_number().over(first)).where("n = 1").select("fact_a_id", "fact_b_id", "rule")


def _embedded(found: DataFrame) -> DataFrame:
    return found.withColumn("embedding", vectors.hashed_embedding(text.embedding_text(*[F.col(c) for c in ("entity", "metric", "value", "unit", "period", "scope", "quote")])))


def compare_new_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _embedded(facts(spark, sf_dir))
    new = found.where("document_id = 'review'")
    none = spark.createDataFrame([], "fact_a_id long, fact_b_id long, is_active boolean")
    return compare.compare_new_facts(new, found, none).select("fact_a_id", "fact_b_id", "relation_type", "confidence", "reason", "source")


def retrieve_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of every fact of every document among all facts."""
    embedded = _embedded(facts(spark, sf_dir))
    return retrieve.candidates(embedded, embedded).select("fact_id", "cand_id", F.round("score", 6).alias("score"), "rank")


def question_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ask.facts_for(_embedded(facts(spark, sf_dir)), "What was the revenue of nation_7 in FY1996?").select("id", "document_id", "norm_period", "rank")


def answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer that lists what was retrieved, with the numbers that no fact supports marked."""
    found = ask.answer_question(_embedded(facts(spark, sf_dir)), "What was the revenue of nation_7 in FY1996?")
    return found.select("answer", F.array_join("unsupported", ",").alias("unsupported"), F.size("cited").alias("n_cited"))


def normalize_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(oracle.ENTITY_INPUT).alias("entity"))
    return names.select("s_suppkey", normalize.clean_entity(F.col("entity")).alias("norm_entity"))


def normalize_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = list(normalize.METRIC_ALIASES)
    named = F.element_at(F.array(*[F.lit(k) for k in keys]), (F.col("p_partkey") % len(keys) + 1).cast("int"))
    metric = F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise(F.concat(F.lit(" "), F.upper(named)))
    return table(spark, sf_dir, "part").select("p_partkey", normalize.canonical_metric(metric).alias("norm_metric"))


def normalize_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = list(normalize.UNIT_ALIASES)
    named = F.element_at(F.array(*[F.lit(k) for k in keys]), (F.col("p_partkey") % len(keys) + 1).cast("int"))
    unit = F.when(F.col("p_partkey") % 5 == 0, F.lit(None)).when(F.col("p_partkey") % 5 == 1, F.col("p_type")).otherwise(named)
    return table(spark, sf_dir, "part").select("p_partkey", normalize.canonical_unit(unit).alias("norm_unit"), normalize.currency_of(unit).alias("norm_currency"))


def normalize_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(oracle.PERIOD_INPUT).alias("period"))
    return rows.select("o_orderkey", normalize.canonical_period(F.col("period")).alias("norm_period"))


def normalize_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(oracle.VALUE_INPUT).alias("value"))
    return rows.select("o_orderkey", normalize.numeric_value(F.col("value")).alias("norm_value"))


def normalize_geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = list(normalize.GEOGRAPHY_ALIASES)
    named = F.element_at(F.array(*[F.lit(k) for k in keys]), (F.col("c_custkey") % len(keys) + 1).cast("int"))
    place = F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise(named)
    return table(spark, sf_dir, "customer").select("c_custkey", normalize.canonical_geography(place).alias("norm_geography"))


def coerced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "value", F.expr(oracle.LABEL_INPUT).alias("label"))
    return rows.select(
        "event_id",
        coerce.confidence(F.col("label")).alias("confidence"),
        coerce.reporting_basis(F.col("label")).alias("basis"),
        F.round(coerce.numeric_confidence(F.col("value")), 6).alias("numeric_confidence"),
        coerce.relation_type(F.col("label")).alias("relation_type"),
        coerce.reason(F.col("label")).alias("reason"),
    )


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" \t"), F.regexp_replace("text", " ", "  "), F.lit("\r\n\r\n\r\n\r\n x\t y \r"))
    clean = text.clean_page_text(raw)
    return table(spark, sf_dir, "documents").select("doc_id", F.length(clean).cast("long").alias("n_clean"), F.md5(clean.cast("binary")).alias("clean_md5"))


def candidate_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(text.is_candidate_page(F.col("text"))).select("doc_id")


def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunk.chunks(document_pages(spark, sf_dir).withColumn("n_pages", F.lit(1).cast("long")), separator="\n")
    return made.select("document_id", "chunk_id", "start_page", "end_page", F.length("text").cast("long").alias("n_chars"))


def candidate_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunk.chunks(chunk.candidate_pages(document_pages(spark, sf_dir).drop("doc_id")), separator="\n")
    return made.select("document_id", "chunk_id", "start_page", "end_page", F.array_join(F.transform("page_map", lambda p: p.cast("string")), ",").alias("page_map"), "n_pages")


def split_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = table(spark, sf_dir, "documents").where(F.length("text") > chunk.CHUNK_LIMIT)
    parts = long.select("doc_id", F.posexplode(chunk.packed_paragraphs(F.col("text"), separator="\n")).alias("part", "t"))
    return parts.select("doc_id", F.col("part").cast("long").alias("part"), F.length("t").cast("long").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("part_md5"))


def chunk_top25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors stand for chunks, labels for documents, the six vectors with the smallest ids for queries."""
    rows = table(spark, sf_dir, "embeddings")
    queries = rows.orderBy("vec_id").limit(6).agg(F.collect_list("embedding").alias("queries"))  # one row of six vectors
    scored = rows.join(F.broadcast(queries)).withColumn("best", F.array_max(F.transform("queries", lambda q: F.round(vectors.cosine(F.col("embedding"), q), 6))))
    chunks = scored.select(F.col("label").cast("string").alias("document_id"), "vec_id", F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("chunk_id"), "best", F.lit(100).alias("n_pages"))
    return chunk.top_chunks(chunks, F.col("best")).select("document_id", "vec_id", "best")


def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.tokens(F.col("text"))).alias("token"))
    counts = words.groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("tf"))
    return counts.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"), F.max("tf").alias("max_tf"))


def _benchmark(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("fact_id"), text.tokens(F.col("text")).alias("_tokens"))
    # dealt by document while they are whole texts: words, counts and scores of a document then stay in one task
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("cand_id"), "text").repartition("cand_id")
    return items, docs.select("cand_id", text.tokens(F.col("text")).alias("_tokens"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = retrieve.bm25_corpus(*_benchmark(spark, sf_dir), k=5)
    return best.select(F.col("fact_id").alias("item_id"), F.col("cand_id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return retrieve.nearest(rows, rows, 5).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion of the BM25 ranking with a ranking by length, over the benchmark's items."""
    lexical = materialize(retrieve.bm25_corpus(*_benchmark(spark, sf_dir), k=20).select("fact_id", "cand_id", "rank"), "lexical")
    shortest = Window.partitionBy("fact_id").orderBy("n_chars", "cand_id")
    sizes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("cand_id"), "n_chars")
    other = lexical.join(sizes, "cand_id").withColumn("rank", F.row_number().over(shortest)).where("rank <= 10").select("fact_id", "cand_id", "rank")
    none = [F.lit("").alias(f"_{c}") for c in retrieve.BONUS]
    left, right = lexical.select(F.col("fact_id").alias("id")).distinct().select("id", *none), lexical.select(F.col("cand_id").alias("id")).distinct().select("id", *none)
    return retrieve.fused(other, lexical, left, right).select(F.col("fact_id").alias("item_id"), F.col("cand_id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed slot counts of every benchmark item, where not zero."""
    slots = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(vectors.hashed_counts(F.col("text"))).alias("slot", "v"))
    return slots.where("v <> 0").select("item_id", F.col("slot").cast("long").alias("slot"), F.col("v").cast("long").alias("v"))


def hash_embedding_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed slot counts of the whole text of every document, where not zero."""
    return embed.slot_rows(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


def _claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every benchmark item claims page item_id % 50 + 1 of every twentieth source by name."""
    items = table(spark, sf_dir, "benchmark")
    claims = items.select(F.col("item_id").alias("fact_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("document_id"), F.lit(1).alias("document_version"), (F.col("item_id") % 50 + 1).cast("int").alias("page_no"), F.col("text").alias("quote"))
    return claims, document_pages(spark, sf_dir).drop("doc_id")


def evidence_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evidence.verified(*_claims(spark, sf_dir))
    return found.select("fact_id", "document_id", "evidence_status", F.col("page_no").cast("long").alias("page_no"), "n_hits")


def quote_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose matchable text holds a whole benchmark item."""
    items = table(spark, sf_dir, "benchmark").select("item_id", text.match_form(F.col("text")).alias("q"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), text.match_form(F.col("text")).alias("text"))
    found = evidence.containing(items.select(F.col("item_id").alias("needle_id"), F.col("q").alias("needle")), docs)
    return found.select(F.col("needle_id").alias("item_id"), F.col("text_id").alias("doc_id"))


def quote_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose matchable text holds a benchmark item or one of its windows, and whether all of it."""
    items = table(spark, sf_dir, "benchmark").select("item_id", text.match_form(text.stripped(F.coalesce("text", F.lit("")))).alias("q")).where("q <> ''")
    parts = items.select(F.col("item_id").alias("needle_id"), F.explode(F.array_union(F.array("q"), evidence.quote_windows(F.col("q")))).alias("needle"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), text.match_form(F.col("text")).alias("text"))
    found = evidence.containing(parts, docs).join(items.select(F.col("item_id").alias("needle_id"), "q"), "needle_id")
    return found.groupBy(F.col("needle_id").alias("item_id"), F.col("text_id").alias("doc_id")).agg(F.bool_or(F.col("needle") == F.col("q")).alias("exact"))


def dedupe_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    uploads = table(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), F.sha2("text", 256).alias("content_hash"), F.col("doc_id").alias("uploaded_at"))
    none = spark.createDataFrame([], "document_id string, document_version int, content_hash string, status string")
    return tables.register(uploads, none).select(F.col("uploaded_at").alias("doc_id"), "document_id", "status", F.col("document_version").cast("long").alias("document_version"))


def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("document_id"), F.row_number().over(order).alias("document_version"))
    return tables.with_activity(rows).select("event_id", "document_id", F.col("document_version").cast("long").alias("document_version"), "is_active")


def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.latest(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "event_type").select("user_id", "event_id", "event_type")


def extract_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", text.numbers(F.col("text")).alias("n")).where(F.size("n") > 0)
    return found.select("doc_id", F.array_join("n", " ").alias("numbers"))


def unsupported_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of each document that its predecessor by id doesn't have."""
    docs = table(spark, sf_dir, "documents")
    before = docs.select((F.col("doc_id") + 1).alias("doc_id"), text.numbers(F.col("text")).alias("allowed"))
    joined = docs.join(before, "doc_id").select("doc_id", ask.unsupported(F.col("text"), F.col("allowed")).alias("n")).where(F.size("n") > 0)
    return joined.select("doc_id", F.array_join("n", " ").alias("unsupported"))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k int"))
    return parsed.groupBy("event_type").agg(F.count("p.k").alias("n"), F.sum(F.col("p.k").cast("long")).alias("total"), F.max(F.col("p.k").cast("long")).alias("most"))


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = pages.html_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(clean).cast("long").alias("n_chars"), F.size(F.split(clean, "\n")).cast("long").alias("n_lines"))


def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = jobs.deduplicated(jobs.events_stream(spark, sf_dir), ["event_id"])
    return jobs.run_to_table(stream.select("event_id", "user_id", "event_type"), "stream-dedupe")


def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by day and type in append mode; the last days are closed at the end of the input."""
    names = [c.split()[0] for c in temporal.EVENTS.split(", ")]
    split = windows.Accepted(spark, temporal.EVENTS, "1 day")
    split.take(jobs.events_stream(spark, sf_dir).select(*names))
    measures = {"n": F.count(F.lit(1)), "total": F.sum("value")}
    counted = windows.run_to_end(lambda: windows.sliding(split.stream(), ["event_type"], measures, "1 day", "1 day"), split, "1 day", [{}], "daily")
    return counted.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


def viewer_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line and the basis that a viewer shows of every fact; the value is zero for every eleventh nation."""
    value = F.when(F.floor(F.col("id") / 100000) % 11 == 3, 0.0).otherwise(F.col("norm_value"))
    line = viewer.normalized_line(F.col("norm_metric"), value, F.col("norm_unit"), F.col("norm_period"))
    basis = viewer.shown_basis(F.nullif(F.col("reporting_basis"), F.lit("estimate")), F.col("reporting_basis") != "estimate")
    return facts(spark, sf_dir).select("id", line.alias("line"), basis.alias("basis"))


def viewer_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viewer.timeline(tables.metric_history(facts(spark, sf_dir), "Nation_7 Ltd.", "net sales"))


def viewer_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent, reason and shown quotes of every decided pair; evidence is blank for every second first fact."""
    found = relation_pairs(spark, sf_dir).where("relation_type IS NOT NULL")
    quotes = facts(spark, sf_dir).select(F.col("id").alias("fact_a_id"), "quote")
    evidence_of = F.when(F.floor(F.col("fact_a_id") / 10) % 2 == 0, "  ").otherwise(F.concat(F.lit("seen: "), F.col("quote")))
    return found.join(quotes, "fact_a_id").select("fact_a_id", "fact_b_id", viewer.percent(F.col("confidence")).alias("pct"), viewer.reason_text(F.col("reason")).alias("reason"), viewer.shown_quote(evidence_of, F.col("quote")).alias("shown"))


def confidence_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", viewer.percent(F.round(F.when(F.col("event_id") % 7 > 0, coerce.numeric_confidence(F.col("value"))), 4)).alias("pct"))


def document_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stand for documents, their lines for pages."""
    sizes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("num_pages"))
    return sizes.select("l_orderkey", viewer.is_large(F.col("num_pages") + 1).alias("is_large"))


def fact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact by its id, though inactive."""
    found = facts(spark, sf_dir).withColumn("is_active", F.lit(False))
    return tables.fact(found, 719961).select("id", "document_id", "norm_period", "is_active")


def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.decision_counts(relation_pairs(spark, sf_dir))


def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.page_counts(table(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), "text"))


def index_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.index_size(table(spark, sf_dir, "embeddings"))


def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled, ids = table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "documents").select("doc_id")
    parts = {"both": ids.intersect(labelled), "unlabelled": ids.exceptAll(labelled), "either": ids.union(labelled).distinct()}
    out = None
    for name, part in parts.items():
        row = part.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("total"))
        out = row if out is None else out.unionByName(row)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        relation_summary, relation_pairs, relation_top5_per_type, fact_relations, metric_history, gold_projection, pair_dedupe, compare_new_facts,
        retrieve_candidates, question_facts, answer, normalize_entity, normalize_metric, normalize_unit, normalize_period, normalize_value,
        normalize_geography, coerced, clean_text, candidate_docs, chunk_pages, candidate_chunks, split_long, chunk_top25, token_stats, bm25_topk,
        vector_topk, hybrid_rrf, hash_embedding, hash_embedding_documents, evidence_status, quote_exact, quote_window, dedupe_content_hash, latest_version, latest_status, extract_numbers,
        unsupported_numbers, json_props, html_pages, stream_dedupe, stream_daily_counts, set_ops, viewer_facts, viewer_timeline, viewer_relations, confidence_percent, document_badges,
        fact_lookup, decision_counts, page_counts, index_size,
    )
}
QUERIES |= temporal.QUERIES | reports.queries(QUERIES)
ORACLE_SQL = oracle.ORACLE_SQL | temporal.ORACLE_SQL | reports.ORACLE_SQL
