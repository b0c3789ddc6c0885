"""Tables from CSV, ORC or Parquet files under one explicit schema; rows that don't fit it are kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.storage import materialize

FORMATS = ("csv", "orc", "parquet")
BROKEN = "_broken"
NULL = "\\N"  # a null in CSV, besides a field without anything; quotes alone are the empty text


def read(spark: SparkSession, path: str, schema: str, kind: str = "csv", **options: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): the rows of ``schema``, and of CSV the lines that don't fit it, as ``line``.

    A CSV file has a header; quotes may hold separators, line ends and doubled quotes.  Too few or many fields, or a value that isn't
    of its column's kind, reject a line.  ORC and Parquet carry their own kinds: a column that they lack is null.
    """
    if kind not in FORMATS:
        raise ValueError(f"{kind} is none of {', '.join(FORMATS)}")
    if kind != "csv":
        return spark.read.format(kind).schema(schema).load(path), spark.createDataFrame([], "line string")
    reader = spark.read.schema(f"{schema}, {BROKEN} string").option("header", "true").option("multiLine", "true").option("escape", '"').option("nullValue", NULL).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN)
    # written once: a scan that reads no other column doesn't parse, so it would find nothing broken
    found = materialize(reader.options(**options).csv(path), "tabular")
    return found.where(F.col(BROKEN).isNull()).drop(BROKEN), found.where(F.col(BROKEN).isNotNull()).select(F.col(BROKEN).alias("line"))


def write(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Replace ``path``; a CSV file gets a header and quotes that ``read`` undoes, and an empty text stays one."""
    writer = df.write.mode("overwrite").format(kind)
    if kind == "csv":
        writer = writer.option("header", "true").option("escape", '"').option("emptyValue", '""').option("nullValue", NULL).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    writer.save(path)
