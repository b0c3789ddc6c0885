"""Mergeable sketches: distinct counts and quantiles kept per run and document, and merged when asked.

A stored row holds a HyperLogLog sketch of a document's tokens and a quantile sketch of its values.  Any group of rows
merges to the sketch of all their input, so a new run adds rows and nothing is counted again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: With 2^14 registers the standard error of a distinct count is about 0.65 %, so ``ERROR`` is above four of them.
LOG_REGISTERS, ERROR = 14, 0.03
#: A quantile sketch of this size is off by about 0.8 % of the rows in rank; ``RANK_ERROR`` is above twice that.
QUANTILE_SIZE, RANK_ERROR = 350, 0.02


def token_sketches(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ``tokens``, the sketch of the distinct values of ``token``."""
    return words.groupBy(*keys).agg(F.hll_sketch_agg("token", LOG_REGISTERS).alias("tokens"))


def distinct_tokens(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ``n_tokens``, of all sketches of a key together."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("tokens")).alias("n_tokens"))


def value_sketches(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys and ``quantiles``, the sketch of the numbers in ``value``; nulls don't count."""
    return values.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(QUANTILE_SIZE)).alias("quantiles"))


def quantiles(sketches: DataFrame, keys: list[str], ranks: list[float]) -> DataFrame:
    """keys, ``rank`` and ``value``: the quantiles of all sketches of a key together."""
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("quantiles").alias("q"))
    pairs = F.array(*[F.struct(F.lit(r).alias("rank"), F.kll_sketch_get_quantile_double("q", F.lit(r)).alias("value")) for r in ranks])
    return merged.select(*keys, F.inline(pairs))
