"""Page sources: files of any Hadoop store as bytes, split into numbered cleaned pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.text import clean_page_text

UPLOADS = "*.[pP][dD][fF]"
#: A splitter gets a file's bytes and returns the text of each page; it runs in executors.
Splitter = Callable[[bytes], list[str]]


def files(spark: SparkSession, paths: str | list[str], pattern: str = UPLOADS) -> DataFrame:
    """document_id (the file's stem), filename, content_hash (SHA-256 hex), content of every matching file."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(paths)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return found.select("path", F.regexp_replace(name, r"\.[^.]*$", "").alias("document_id"), name.alias("filename"), F.sha2("content", 256).alias("content_hash"), "content")


def listing(spark: SparkSession, folder: str, patterns: list[str]) -> DataFrame:
    """(nth, path, filename): a folder's files, by pattern and then by name, each once with its first pattern; contents are not read."""
    found = None
    for rank, pattern in enumerate(patterns):
        names = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(F.lit(rank).alias("rank"), "path")
        found = names if found is None else found.unionByName(names)
    first = found.groupBy("path").agg(F.min("rank").alias("rank")).withColumn("filename", F.regexp_extract("path", r"([^/]+)$", 1))
    order = Window.orderBy("rank", "filename", "path")  # names alone, of one folder
    return first.withColumn("nth", F.row_number().over(order)).select("nth", "path", "filename").orderBy("nth")


def plain_text(content: bytes) -> list[str]:
    """Pages of a text file, at form feeds."""
    return content.decode("utf-8", "replace").split("\f")


def split_pages(df: DataFrame, splitter: Splitter = plain_text) -> DataFrame:
    """document_id, page_no from 1, text (cleaned), num_pages; pages that are empty after cleaning are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("document_id").to_pylist(), batch.column("content")):
                pages = splitter(content.as_py())
                n = len(pages)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(range(1, n + 1), pa.int32()), pa.array(pages, pa.string()), pa.array([n] * n, pa.int32())], ["document_id", "page_no", "raw", "num_pages"])

    raw = df.select("document_id", "content").mapInArrow(run, "document_id string, page_no int, raw string, num_pages int")
    return raw.select("document_id", "page_no", clean_page_text(F.col("raw")).alias("text"), "num_pages").where("text <> ''")


def html_text(html: Column) -> Column:
    """The text of a page: scripts, styles and comments dropped, block ends as line ends, entities decoded."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|title|section|article|ul|ol|table|nav|header|footer)\s*>", "\n")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return clean_page_text(text)


def collapsed_pages(pages: DataFrame) -> DataFrame:
    """The prototype's form of a page: all white space collapsed."""
    return pages.withColumn("text", F.trim(F.regexp_replace("text", r"(?U)\s+", " ")))
