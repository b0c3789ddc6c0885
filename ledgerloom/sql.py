"""The SQL surface: tables as views, and this library's functions under names that SQL text can use.

``register`` adds to a session

- scalar functions: ``bare_number``, ``is_year``, ``numbers_of``, ``match_form``, ``page_text``, ``bm25_weight``;
- the table function ``numbers(text)``: (position, number) of each number in a text, in order, through Arrow;
- the aggregate ``joined(position, text)``: the texts of a group in the order of their positions, joined by spaces.

Scalar functions are SQL themselves, so the optimizer sees through them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import NUMBER_IN_ANSWER
from ledgerloom.operators.retrieve import B, K1

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


_NUMBERS = f"regexp_extract_all(coalesce(t, ''), {_quoted(NUMBER_IN_ANSWER)}, 0)"
FUNCTIONS = {
    "bare_number(n STRING) RETURNS STRING": "replace(n, ',', '')",
    "is_year(n STRING) RETURNS BOOLEAN": "n RLIKE '^(19|20)[0-9]{2}$'",
    "numbers_of(t STRING) RETURNS ARRAY<STRING>": f"array_sort(array_distinct(transform({_NUMBERS}, n -> replace(n, ',', ''))))",
    "match_form(t STRING) RETURNS STRING": r'''lower(trim(regexp_replace(translate(coalesce(t, ''), ' –—‘’“”', " --\'\'\"\""), '(?U)\\s+', ' ')))''',
    "page_text(t STRING) RETURNS STRING": r"trim(BOTH ' \n' FROM regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(coalesce(t, ''), '\r\n?', '\n'), ' ', ' '), '[ \t]+', ' '), ' ?\n ?', '\n'), '\n{3,}', '\n\n'))",
    "bm25_weight(tf DOUBLE, df DOUBLE, dl DOUBLE, n DOUBLE, avgdl DOUBLE) RETURNS DOUBLE": f"ln(1 + (n - df + 0.5D) / (df + 0.5D)) * tf * {K1 + 1}D / (tf + {K1}D * ({1 - B}D + {B}D * dl / avgdl))",
}


class Numbers:
    """The table function's rows."""

    def __init__(self) -> None:
        self.pattern = re.compile(NUMBER_IN_ANSWER)

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        for position, found in enumerate(self.pattern.finditer(text or "")):
            yield position, found.group()


def joined(position: pd.Series, text: pd.Series) -> str:
    return " ".join(text[position.sort_values(kind="stable").index].astype(str))


def register(spark: SparkSession, folder: str | None = None) -> None:
    """The functions, and the tables of ``folder`` as views."""
    for name in TABLES if folder else ():
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("numbers", F.udtf(Numbers, returnType="position int, number string", useArrow=True))
    spark.udf.register("joined", F.pandas_udf(joined, "string"))
