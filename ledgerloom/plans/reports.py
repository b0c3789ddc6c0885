"""Index search, pruned ranking, report cubes, clusters, sketches, model verdicts and SQL text, and their SQL."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import sql
from ledgerloom.functions import normalize, text, vectors
from ledgerloom.operators import clusters, compare, model_stage, retrieve, sketches, tables, vector_index, verdict
from ledgerloom.plans import oracle
from ledgerloom.plans.inputs import FACTS_SQL, facts, table
from ledgerloom.sources import tabular
from ledgerloom.sources.storage import materialize, new_path

Query = Callable[[SparkSession, str], DataFrame]


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all vectors to every vector whose id is divisible by 100, through the index."""
    rows = _embeddings(spark, sf_dir)
    found = vector_index.search(rows.where("vec_id % 100 = 0"), vector_index.build(rows), 5)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def index_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 20 neighbours with a similarity of at least 0.3, which some vectors of the table have and most have not."""
    rows = _embeddings(spark, sf_dir)
    found = vector_index.search(rows.where("vec_id % 100 = 0"), vector_index.build(rows), 20, 0.3)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def bm25_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents of every benchmark item, by bounds on terms."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("fact_id"), text.tokens(F.col("text")).alias("_tokens"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("cand_id"), text.tokens(F.col("text")).alias("_tokens"))
    best = retrieve.bm25_pruned(items, docs, 5)
    return best.select(F.col("fact_id").alias("item_id"), F.col("cand_id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


def _corroborated(spark: SparkSession, sf_dir: str, known: dict[str, Query]) -> DataFrame:
    pairs = known["relation_pairs"](spark, sf_dir).where("relation_type = 'corroborates'")
    return pairs.select(F.col("fact_a_id").alias("a"), F.col("fact_b_id").alias("b"))


def sketch_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct tokens of each source from its documents' stored sketches, merged in two steps; whether they are within the stated error."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.explode(text.tokens(F.col("text"))).alias("token"))
    stored = materialize(sketches.token_sketches(docs, ["source", "doc_id"]), "sketches")
    halves = stored.withColumn("run", F.col("doc_id") % 2).groupBy("source", "run").agg(F.hll_union_agg("tokens").alias("tokens"))  # two runs
    found = sketches.distinct_tokens(halves, ["source"])
    exact = docs.groupBy("source").agg(F.count_distinct("token").alias("n"))
    close = F.abs(F.col("n_tokens") - F.col("n")) <= F.greatest(F.col("n") * sketches.ERROR, F.lit(1))
    return found.join(exact, "source").select("source", F.col("n").alias("n_exact"), close.alias("close"))


RANKS = [0.1, 0.5, 0.9]


def sketch_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of the events' values by type from daily sketches; whether their rank is within the stated error."""
    rows = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), "value")
    stored = materialize(sketches.value_sketches(rows, ["event_type", "day"]), "sketches")
    found = sketches.quantiles(stored, ["event_type"], RANKS)
    ranked = rows.where("value IS NOT NULL").join(found.select("event_type", "rank", F.col("value").alias("q")), "event_type").groupBy("event_type", "rank")
    shares = ranked.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("value") < F.col("q"), 1.0).otherwise(0.0)).alias("under"), F.avg(F.when(F.col("value") <= F.col("q"), 1.0).otherwise(0.0)).alias("upto"))
    close = (F.col("under") <= F.col("rank") + sketches.RANK_ERROR) & (F.col("upto") >= F.col("rank") - sketches.RANK_ERROR)
    return shares.select("event_type", "rank", "n", close.alias("close"))


def judge(prompt: str) -> str:
    """A stand-in for a model, which sees nothing but the prompt: the larger first value contradicts, a smaller one is unrelated; it is down for values that aren't numbers."""
    found = re.findall(r"^value: (.*)$", prompt, re.MULTILINE)
    try:
        first, second = map(float, found)
    except ValueError:
        raise model_stage.QuotaError from None
    kind = "Contradicts" if first > second else "no relation"
    return "```json\n" + json.dumps({"relation_type": kind, "confidence": "0.7", "reason": "none", "explanation": "by value"}) + "\n```"


def compare_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of the review's facts, with the pairs that the table leaves open asked of a provider."""
    found = facts(spark, sf_dir)
    found = materialize(found.withColumn("embedding", vectors.hashed_embedding(text.embedding_text(*[F.col(c) for c in ("entity", "metric", "value", "unit", "period", "scope", "quote")]))), "embedded")
    new = found.where("document_id = 'review'")
    none = spark.createDataFrame([], "fact_a_id long, fact_b_id long, is_active boolean")
    done = compare.compare_new_facts(new, found, none, lambda pairs: verdict.verdicts(pairs, new, found, [judge]))
    return done.select("fact_a_id", "fact_b_id", "relation_type", "confidence", "reason", "source")


def sql_unsupported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``unsupported_numbers`` as SQL text, through the registered functions."""
    sql.register(spark, sf_dir)
    return spark.sql("""
        WITH said AS (SELECT d.doc_id, n.position, n.number, bare_number(n.number) AS bare FROM documents d, LATERAL numbers(d.text) n),
        allowed AS (SELECT doc_id + 1 AS doc_id, numbers_of(text) AS own FROM documents)
        SELECT doc_id, joined(position, number) AS unsupported FROM said JOIN allowed USING (doc_id)
        WHERE NOT is_year(bare) AND NOT array_contains(own, bare) AND NOT array_contains(own, regexp_replace(bare, '%+$', ''))
        GROUP BY doc_id""")


def document_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity's value by period, a column for each document."""
    found = facts(spark, sf_dir).where("norm_value IS NOT NULL")
    return tables.matrix(found, ["norm_entity", "norm_period"], "document_id", ["orders", "lines", "review"], "norm_value")


def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders' facts beside the review's, in cents, with those that stand alone."""
    own = F.coalesce("norm_entity", normalize.clean_entity(F.col("entity")))
    found = materialize(facts(spark, sf_dir).withColumns({"cents": F.round(F.col("norm_value") * 100).cast("long"), "norm_entity": own}), "cents")
    left, right = (found.where(F.col("document_id") == name) for name in ("orders", "review"))
    return tables.reconciled(left, right, ["norm_entity", "norm_metric", "norm_period"], "cents")


ORDER_COLUMNS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"


def _imported(spark: SparkSession, sf_dir: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """Orders written as files of a kind and read back; every 50th price of the CSV is no number, every 70th priority has a quote, a comma and a line end."""
    names = [c.split()[0] for c in ORDER_COLUMNS.split(", ")]
    rows = table(spark, sf_dir, "orders").select(*names)
    path = new_path(spark, f"orders-{kind}")
    if kind == "csv":
        odd = F.when(F.col("o_orderkey") % 70 == 0, F.concat(F.lit('"a", b\n'), "o_orderpriority")).otherwise(F.col("o_orderpriority"))
        rows = rows.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 50 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))).withColumn("o_orderpriority", odd)
    tabular.write(rows, path, kind)
    return tabular.read(spark, path, ORDER_COLUMNS, kind)


def csv_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read from CSV by priority, and the number of rejected lines."""
    rows, rejected = _imported(spark, sf_dir, "csv")
    counted = rows.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    lost = rejected.agg(F.lit("rejected").alias("o_orderpriority"), F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("total"))
    return counted.unionByName(lost)


def orc_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read from ORC files, as they were."""
    return _imported(spark, sf_dir, "orc")[0]


def queries(known: dict[str, Query]) -> dict[str, Query]:
    """This module's queries; some read what ``known`` ones give."""

    def relation_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Decided relations by type, reason and document, with all subtotals."""
        found = tables.relation_cube(known["relation_pairs"](spark, sf_dir).where("relation_type IS NOT NULL"), facts(spark, sf_dir))
        return found.select("relation_type", "reason", "document_id", F.col("level").cast("long").alias("level"), "n", F.round("confidence", 6).alias("confidence"))

    def fact_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The cluster of every fact by corroborations."""
        return clusters.clusters(_corroborated(spark, sf_dir, known), facts(spark, sf_dir).select("id"))

    own = (index_search, index_hits, bm25_pruned, sketch_tokens, sketch_quantiles, compare_by_model, sql_unsupported, relation_cube, fact_clusters, document_matrix, reconciliation, csv_import, orc_import)
    return {f.__name__: f for f in own}


_COMPARED = oracle.ORACLE_SQL["compare_new_facts"]
ORACLE_SQL = {
    "index_search": f"SELECT * FROM ({oracle.ORACLE_SQL['vector_topk']}) WHERE query_id % 100 = 0",
    "index_hits": """WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s WHERE score >= 0.3)
        SELECT query_id, vec_id, round(least(1.0::DOUBLE, score), 6) AS score, CAST(r AS INT) AS rank FROM r WHERE r <= 20""",
    "bm25_pruned": oracle.ORACLE_SQL["bm25_topk"],
    "sketch_tokens": "SELECT source, count(DISTINCT token) AS n_exact, true AS close FROM (SELECT source, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents) GROUP BY source",
    "sketch_quantiles": f"SELECT event_type, rank, count(value) AS n, true AS close FROM events, (SELECT unnest([{', '.join(f'{r}::DOUBLE' for r in RANKS)}]) AS rank) GROUP BY ALL",
    "relation_cube": f"""{oracle.CLASSIFIED} SELECT relation_type, reason, doc AS document_id, CAST(GROUPING(relation_type, reason, doc) AS BIGINT) AS level, count(*) AS n, round(avg(confidence), 6) AS confidence
        FROM judged JOIN facts ON id = fact_a_id WHERE relation_type IS NOT NULL GROUP BY CUBE (relation_type, reason, doc)""",
    "fact_clusters": f"""{oracle.CLASSIFIED.replace("WITH ", "WITH RECURSIVE ", 1)},
        links AS (SELECT fact_a_id AS a, fact_b_id AS b FROM judged WHERE relation_type = 'corroborates' UNION SELECT fact_b_id, fact_a_id FROM judged WHERE relation_type = 'corroborates'),
        reach AS (SELECT id, id AS other FROM facts UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other)
        SELECT id, min(other) AS cluster_id FROM reach GROUP BY id""",
    "compare_by_model": _COMPARED.replace(
        "SELECT r.fact_id AS fact_a_id, cand_id AS fact_b_id, coalesce(relation_type, 'needs_review') AS relation_type, coalesce(confidence, 0.3::DOUBLE) AS confidence, coalesce(reason, 'none') AS reason,\n        CASE WHEN relation_type IS NULL THEN 'none' ELSE 'table' END AS source",
        "SELECT r.fact_id AS fact_a_id, cand_id AS fact_b_id, coalesce(relation_type, CASE WHEN a.val = 'n/a' OR b.val = 'n/a' THEN 'needs_review' ELSE 'contradicts' END) AS relation_type,\n        coalesce(confidence, CASE WHEN a.val = 'n/a' OR b.val = 'n/a' THEN 0.3::DOUBLE ELSE 0.7::DOUBLE END) AS confidence, coalesce(reason, 'none') AS reason,\n        CASE WHEN relation_type IS NOT NULL THEN 'table' WHEN a.val = 'n/a' OR b.val = 'n/a' THEN 'none' ELSE 'model' END AS source",
    )
    + " JOIN texts a ON a.id = r.fact_id JOIN texts b ON b.id = cand_id WHERE relation_type IS NOT NULL OR a.val = 'n/a' OR b.val = 'n/a' OR CAST(a.val AS DOUBLE) > CAST(b.val AS DOUBLE)",
    "document_matrix": f"""WITH {FACTS_SQL} SELECT entity AS norm_entity, period AS norm_period, max(value) FILTER (doc = 'orders') AS orders, max(value) FILTER (doc = 'lines') AS lines, max(value) FILTER (doc = 'review') AS review
        FROM facts WHERE value IS NOT NULL GROUP BY ALL""",
    "reconciliation": f"""WITH {FACTS_SQL}, c AS (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM facts), o AS (SELECT * FROM c WHERE doc = 'orders'), r AS (SELECT * FROM c WHERE doc = 'review')
        SELECT coalesce(o.entity, r.entity) AS norm_entity, coalesce(o.metric, r.metric) AS norm_metric, coalesce(o.period, r.period) AS norm_period, o.id AS left_id, r.id AS right_id,
            CASE WHEN o.id IS NULL THEN 'right' WHEN r.id IS NULL THEN 'left' ELSE 'both' END AS side, r.cents - o.cents AS apart
        FROM o FULL JOIN r ON o.entity = r.entity AND o.metric = r.metric AND o.period = r.period""",
    "csv_import": """WITH o AS (SELECT *, CASE WHEN o_orderkey % 70 = 0 THEN '"a", b' || chr(10) || o_orderpriority ELSE o_orderpriority END AS p FROM orders)
        SELECT p AS o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM o WHERE o_orderkey % 50 <> 0 GROUP BY p UNION ALL SELECT 'rejected', count(*), NULL FROM o WHERE o_orderkey % 50 = 0""",
    "orc_import": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders",
    "sql_unsupported": oracle.ORACLE_SQL["unsupported_numbers"],
}
