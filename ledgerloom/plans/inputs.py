"""Operator inputs built from the star-schema tables."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.normalize import normalized
from ledgerloom.sources.storage import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue facts of nations by year in three documents: orders, their line items, and a review with variants."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    buyers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"), F.year("o_orderdate").alias("year"))
    placed = orders.join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    # decimals all through, so that sums and half cents don't depend on the order of addition
    paid = F.expr("cast(l_extendedprice AS decimal(12,2)) * (1 - cast(l_discount AS decimal(4,2))) * (1 + cast(l_tax AS decimal(4,2)))").cast("decimal(24,6)")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), paid.alias("paid"))
    sums = {
        "orders": placed.groupBy("n_nationkey", "year").agg(F.sum("o_totalprice").alias("v")),
        "lines": placed.join(lines, "o_orderkey").groupBy("n_nationkey", "year").agg(F.sum("paid").alias("v")),
    }
    money = F.col("v").cast("decimal(18,2)")
    kind = F.col("n_nationkey") % 7
    common = [F.lit(1).alias("document_version"), F.lit(1).alias("page_no"), F.col("n_name").alias("entity")]

    def document(name: str, digit: int, df: DataFrame, metric: str, value, unit, period, scope, geography, basis) -> DataFrame:
        return df.join(nations, "n_nationkey").select(
            (F.col("n_nationkey").cast("long") * 100000 + F.col("year") * 10 + digit).alias("id"),
            F.lit(name).alias("document_id"),
            *common,
            F.lit(metric).alias("metric"),
            value.cast("string").alias("value"),
            unit.alias("unit"),
            period.alias("period"),
            scope.alias("scope"),
            geography.alias("geography"),
            basis.alias("reporting_basis"),
            F.concat(F.col("n_name"), F.lit(f" {metric} in "), F.col("year").cast("string")).alias("quote"),
        )

    text = F.col("year").cast("string")
    plain = (F.lit("USD"), F.lit("consolidated"), F.lit("India"), F.lit("actual"))
    first = document("orders", 1, sums["orders"], "Revenue from operations", money, plain[0], F.concat(F.lit("FY"), text), *plain[1:])
    second = document("lines", 2, sums["lines"], "Net sales", money, plain[0], F.concat(F.lit("FY '"), text), *plain[1:])
    third = document(
        "review",
        3,
        sums["orders"],
        "Total revenue",
        F.when(kind == 6, "n/a").otherwise((money * F.lit(Decimal("1.05"))).cast("decimal(18,2)").cast("string")),
        F.when(kind == 2, "INR crore").when(kind == 5, "%").otherwise("USD"),
        F.concat(F.lit("fy "), text),
        F.when(kind == 1, "standalone").otherwise("consolidated"),
        F.when(kind == 3, "global").otherwise("India"),
        F.when(kind == 4, "estimate").otherwise("actual"),
    )
    # written once: several operators read the facts, and the sums below them are the costly part
    return materialize(normalized(first.unionByName(second).unionByName(third)), "facts").withColumns({"is_active": F.lit(True), "evidence_status": F.lit("verified"), "run_id": F.lit(1).cast("long")})


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, document_version, page_no, text: documents of a source as its pages, by doc_id."""
    docs = table(spark, sf_dir, "documents")
    number = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return docs.select(F.col("source").alias("document_id"), F.lit(1).alias("document_version"), number.alias("page_no"), "text", "doc_id")


#: The same facts in SQL: id, entity, metric, value, unit, period, scope, geography, basis (normalized).
FACTS_SQL = """
placed AS (
    SELECT o_orderkey, c_nationkey AS nk, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(o_totalprice AS DECIMAL(18, 2)) AS o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey
),
a AS (SELECT nk, y, sum(o_totalprice) AS v FROM placed GROUP BY ALL),
b AS (
    SELECT nk, y, sum(CAST(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2))) * (1 + CAST(l_tax AS DECIMAL(4, 2))) AS DECIMAL(24, 6))) AS v FROM placed JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL
),
raw AS (
    SELECT nk * 100000 + y * 10 + 1 AS id, 'orders' AS doc, nk, y, CAST(v AS DECIMAL(18, 2)) AS v, 0 AS k FROM a
    UNION ALL SELECT nk * 100000 + y * 10 + 2, 'lines', nk, y, CAST(v AS DECIMAL(18, 2)), 0 FROM b
    UNION ALL SELECT nk * 100000 + y * 10 + 3, 'review', nk, y, CASE WHEN nk % 7 <> 6 THEN CAST(CAST(v AS DECIMAL(18, 2)) * CAST(1.05 AS DECIMAL(3, 2)) AS DECIMAL(18, 2)) END, nk % 7 FROM a
),
facts AS (
    SELECT CAST(id AS BIGINT) AS id, doc, lower(n_name) AS entity, CASE WHEN v IS NOT NULL THEN 'revenue' END AS metric, CAST(v AS DOUBLE) AS value,
        CASE WHEN v IS NULL THEN NULL WHEN k = 2 THEN 'inr_crore' WHEN k = 5 THEN 'percent' ELSE 'usd' END AS unit,
        CASE WHEN v IS NOT NULL THEN 'FY' || y END AS period, CASE WHEN k = 1 THEN 'standalone' ELSE 'consolidated' END AS scope,
        CASE WHEN k = 3 THEN 'global' ELSE 'india' END AS geography, CASE WHEN k = 4 THEN 'estimate' ELSE 'actual' END AS basis
    FROM raw JOIN nation ON nk = n_nationkey
)
"""
