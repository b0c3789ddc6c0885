"""Filters of bounded size that keep rows which can't match out of a shuffle.

The Bloom filter over long ids has ``PER_ID`` bits for each id, and at most ``MOST_BITS`` (32 MiB), which bounds what is sent to
the driver and to each executor.  Where more ids would need more there is no filter: rows that can't
match then cost time and change no result, since a join always follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.runtime import arrow_map, materialize

PER_ID = 12
PER_BIT = 16  # bits for each key of the filter with one hash
MOST_BITS = 1 << 28
HASHES = 4
PARTS = 8


def _bits(ids: np.ndarray, n_bits: int) -> list[np.ndarray]:
    x = ids.astype(np.int64).view(np.uint64)
    out = []
    for k in range(HASHES):
        y = (x + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
        y = (y ^ (y >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out.append(((y ^ (y >> np.uint64(32))) % np.uint64(n_bits)).astype(np.int64))
    return out


def bloom_filter(df: DataFrame, column: str) -> Broadcast | None:
    """The filter over a column of longs; partial filters reach the driver one at a time.  None where it would be too large."""
    ids = df.select(column).where(F.col(column).isNotNull())
    n_bits = 1 << max(16, (PER_ID * ids.count()).bit_length())
    if n_bits > MOST_BITS:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(n_bits, bool)
        for batch in batches:
            for at in _bits(batch.column(0).to_numpy(zero_copy_only=False), n_bits):
                flags[at] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(flags).tobytes()], pa.binary())], ["bits"])

    made = np.zeros(n_bits // 8, np.uint8)
    for part in arrow_map(ids.repartition(PARTS), run, "bits binary").toLocalIterator():
        made |= np.frombuffer(part.bits, np.uint8)
    return df.sparkSession.sparkContext.broadcast(made)


def perhaps_in(shared: Broadcast | None, column: str) -> Column:
    """False where the value is certainly not in the filter."""
    if shared is None:
        return F.lit(True)

    @F.pandas_udf("boolean")
    def perhaps(ids: pd.Series) -> pd.Series:
        values = ids.fillna(0).to_numpy(np.int64)
        found = np.ones(len(values), bool)
        for at in _bits(values, len(shared.value) * 8):
            found &= (shared.value[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
        return pd.Series(found)

    return perhaps(column)


def native_split(rows: DataFrame, wanted: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` that may have a match in ``wanted`` by the columns ``on``, and those that certainly have none.

    A bitmap of the keys' hashes, made and read by built-in functions: ``PER_BIT`` bits a key, joined
    by broadcast (at most MOST_BITS, 32 MiB).  Where that is too few all rows may match.
    """
    n_bits = 1 << max(15, (PER_BIT * wanted.count()).bit_length())
    if n_bits > MOST_BITS:
        return rows, rows.limit(0)
    place = F.pmod(F.xxhash64(*on), F.lit(n_bits)) + 1
    bits = wanted.select(F.bitmap_bucket_number(place).alias("_bucket"), F.bitmap_bit_position(place).alias("_bit"))
    bits = materialize(bits.groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits")), "bits")
    marked = rows.withColumn("_bucket", F.bitmap_bucket_number(place)).withColumn("_bit", F.bitmap_bit_position(place)).join(F.broadcast(bits), "_bucket", "left")
    byte = "conv(hex(substring(_bits, cast(_bit div 8 + 1 AS int), 1)), 16, 10)"
    maybe = f"coalesce((cast({byte} AS int) & cast(shiftleft(1, cast(_bit % 8 AS int)) AS int)) <> 0, false)"
    marked = marked.withColumn("_maybe", F.expr(maybe)).drop("_bucket", "_bit", "_bits")
    return marked.where("_maybe").drop("_maybe"), marked.where("NOT _maybe").drop("_maybe")
