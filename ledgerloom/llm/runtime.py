"""Shared plumbing: the cluster's shared folder, materialized tables, Arrow maps."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.sources.storage import materialize, new_path, shared_folder

__all__ = ["arrow_map", "discard", "documents", "id_and_text", "importable", "materialize", "new_path", "numbered", "shared_folder", "slices", "unused", "where_computed"]

_ROOT = str(Path(__file__).resolve().parents[2])


def discard(df: DataFrame) -> None:
    """Remove the files of a materialized table that no result reads any more."""
    spark = df.sparkSession
    folder = shared_folder(spark) + "/ledgerloom/"
    jvm = spark.sparkContext._jvm
    for name in {os.path.dirname(f) for f in df.inputFiles()}:
        if "/ledgerloom/" in name and folder.split(":", 1)[-1].lstrip("/") in name:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def where_computed(df: DataFrame, condition: str) -> DataFrame:
    """``df.where`` on columns that are costly to compute: the optimizer doesn't repeat them in a pushed-down filter.

    A filter isn't pushed below a projection with a non-deterministic column; its value doesn't matter here.
    """
    fence = unused(df, "_fence")
    return df.withColumn(fence, F.monotonically_increasing_id()).where(f"({condition}) AND {fence} >= 0").drop(fence)


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with the number from 1 of each row in its group, in ``order``; a large group is spread over tasks.

    Rows are dealt out by ranges of (keys, order), numbered within a range, and the counts of the ranges before are added.
    """
    dealt = df.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys], *order).withColumn("_range", F.spark_partition_id())
    dealt = materialize(dealt, "ranges")  # ranges are drawn from a sample, so they are drawn once
    counts = dealt.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = dealt.withColumn("_in", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)))
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    joined = inside.join(counts, [F.col("_range") == F.col("_r"), *same])
    return joined.select(*df.columns, (F.col("_before") + F.col("_in")).cast("long").alias(name))


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])


#: Bytes of an Arrow batch for Python; one row may be longer.
MOST_BATCH = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let Spark cut batches for Python by bytes, unless the session has a bound of its own.

    By rows alone (10,000) a batch of texts has tens of MB, which the executor holds several times
    over while it is written and a worker while it is read, and neither gives all of it back.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(MOST_BATCH))


#: By module what a worker keeps between tasks, as functions that drop it.
caches: dict[str, Callable[[], None]] = {}


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` whose workers give memory back at the end of each task; they are used again and again.

    What other operators' tasks have left in a worker (tables of words, tokenizers) is dropped first.
    """
    importable(df.sparkSession)
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others = [drop for name, drop in caches.items() if name != fn.__module__]
        for drop in others:
            drop()
        if others:
            release_memory()
        yield from fn(batches)
        release_memory()

    return df.mapInArrow(run, schema)


def release_memory() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``most_bytes`` at most (a longer value stands alone)."""
    for batch in batches:
        start, held = 0, 0
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        if sizes.sum() <= most_bytes:
            if batch.num_rows:
                yield batch
            continue
        for i, size in enumerate(sizes):
            if held and held + size > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone; a null text is the empty text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
