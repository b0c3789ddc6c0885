"""From pages to chunks: candidate filter, merging of short pages, splitting of long ones, top chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.text import is_candidate_page
from ledgerloom.functions.vectors import bound, cosine, counts_of, hashed_counts

#: Limits and the generic queries that rank the chunks of a large document.
CHUNK_LIMIT = 5000
MERGE_LIMIT = 3500
LARGE_PAGES = 7
MOST_CHUNKS = 25
EMBEDDED_PREFIX = 2000
QUERIES = (
    "revenue, profit, and earnings figures",
    "financial results and key performance metrics",
    "growth rates, margins, and ratios",
    "balance sheet, assets, liabilities, and debt",
    "macroeconomic indicators such as GDP, inflation, and rates",
    "reporting period, fiscal year, and quarterly figures",
)


def candidate_pages(pages: DataFrame) -> DataFrame:
    """Non-empty pages (document_id, page_no, text) that may hold facts; all pages of a document without any.

    Adds n_pages, the number of non-empty pages of the document.
    """
    document = Window.partitionBy("document_id")
    judged = pages.where(F.length("text") > 0).withColumn("_candidate", is_candidate_page(F.col("text")))
    judged = judged.withColumn("n_pages", F.count(F.lit(1)).over(document)).withColumn("_any", F.max("_candidate").over(document))
    return judged.where("_candidate OR NOT _any").drop("_candidate", "_any")


def packed_paragraphs(text: Column, limit: int = CHUNK_LIMIT, separator: str = "\n\n") -> Column:
    """A text over the limit as an array of texts, filled greedily with whole paragraphs.

    A paragraph costs its length and two; one alone may be over the limit.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("cost"))

    def step(state: Column, paragraph: Column) -> Column:
        full = state["open"].isNotNull() & (state["cost"] + F.length(paragraph) > limit)
        cost = F.length(paragraph) + 2
        return (
            F.when(full, F.struct(F.concat(state["done"], F.array(state["open"])).alias("done"), paragraph.alias("open"), cost.alias("cost")))
            .when(state["open"].isNull(), F.struct(state["done"].alias("done"), paragraph.alias("open"), (state["cost"] + cost).alias("cost")))
            .otherwise(F.struct(state["done"].alias("done"), F.concat(state["open"], F.lit(separator), paragraph).alias("open"), (state["cost"] + cost).alias("cost")))
        )

    packed = F.aggregate(F.split(text, separator), start, step, lambda s: F.concat(s["done"], F.array(s["open"])))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(packed)


def chunks(pages: DataFrame, separator: str = "\n\n") -> DataFrame:
    """document_id, chunk_id, start_page, end_page, page_map, text, n_pages from candidate pages.

    At most two pages merge, so in each run of mergeable neighbours the odd-numbered gaps are merges.
    """
    order = Window.partitionBy("document_id").orderBy("page_no")
    size = F.length("text")
    follows = (
        (F.lag("page_no").over(order) == F.col("page_no") - 1)
        & (F.lag(size).over(order) <= CHUNK_LIMIT)
        & (size <= CHUNK_LIMIT)
        & (F.lag(size).over(order) + size <= MERGE_LIMIT)
    )
    marked = pages.withColumn("_follows", F.coalesce(follows, F.lit(False)))
    marked = marked.withColumn("_run", F.sum(F.when(~F.col("_follows"), 1).otherwise(0)).over(order))
    in_run = Window.partitionBy("document_id", "_run").orderBy("page_no")
    marked = marked.withColumn("_group", F.floor((F.row_number().over(in_run) - 1) / 2))
    page = F.concat(F.lit("[page "), F.col("page_no").cast("string"), F.lit("]\n"))
    parts = marked.select(
        "document_id",
        "n_pages",
        "page_no",
        "_run",
        "_group",
        F.posexplode(F.transform(packed_paragraphs(F.col("text"), separator=separator), lambda t: F.concat(page, t))).alias("_part", "_text"),
    )
    grouped = parts.groupBy("document_id", "n_pages", "_run", "_group", F.when(F.col("_part") > 0, F.col("_part")).otherwise(0).alias("_part")).agg(
        F.min("page_no").cast("int").alias("start_page"),
        F.max("page_no").cast("int").alias("end_page"),
        F.array_sort(F.collect_list(F.struct("page_no", "_text"))).alias("_pages"),
    )
    ordinal = F.row_number().over(Window.partitionBy("document_id").orderBy("start_page", "_part")) - 1
    return grouped.select(
        "document_id",
        F.concat("document_id", F.lit("_c"), F.format_string("%03d", ordinal)).alias("chunk_id"),
        "start_page",
        "end_page",
        F.transform("_pages", lambda p: p["page_no"].cast("int")).alias("page_map"),
        F.array_join(F.transform("_pages", lambda p: p["_text"]), "\n\n").alias("text"),
        "n_pages",
    )


def top_chunks(df: DataFrame, score: Column, most: int = MOST_CHUNKS) -> DataFrame:
    """All chunks of small documents and of documents with few; the best ``most`` of others."""
    best = Window.partitionBy("document_id").orderBy(F.col("_score").desc(), "chunk_id")
    ranked = df.withColumn("_score", score).withColumn("_rank", F.row_number().over(best))
    return ranked.where((F.col("n_pages") <= LARGE_PAGES) | (F.col("_rank") <= most)).drop("_score", "_rank")


def query_score(text: Column) -> Column:
    """The best similarity of a chunk's beginning to the generic queries, by hashed counts."""
    queries = [F.lit(counts_of(q)) for q in QUERIES]
    return bound(hashed_counts(F.substring(text, 1, EMBEDDED_PREFIX)), lambda own: F.greatest(*[cosine(own, q) for q in queries]))


def document_chunks(pages: DataFrame, separator: str = "\n\n") -> DataFrame:
    """Pages to the chunks that go to extraction."""
    return top_chunks(chunks(candidate_pages(pages), separator), query_score(F.col("text")))


def in_order(chunks: DataFrame) -> DataFrame:
    """Chunks as their documents have them: by page, then by their number, which may have more digits than its text is padded to."""
    number = F.regexp_extract("chunk_id", "_c([0-9]+)$", 1).cast("long")
    return chunks.orderBy("document_id", "start_page", number)
