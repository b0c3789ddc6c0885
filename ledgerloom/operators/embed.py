"""Embeddings with a status: what a model made of each text, or why there is no vector."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import stripped, tokens
from ledgerloom.functions.vectors import DIMENSION

#: A model gets texts and returns a vector for each; it runs in executors, so it must be picklable.
Model = Callable[[Sequence[str]], Sequence[Sequence[float]]]
AT_ONCE = 256  # texts in one call
RESULT = "struct<vector:array<double>,error:string>"


def fault(vector: Sequence[float] | None, dimension: int) -> str | None:
    """Why a vector can't be used, or None."""
    if vector is None:
        return "no vector"
    if len(vector) != dimension:
        return f"wrong dimension: {len(vector)} instead of {dimension}"
    if not all(x is not None and math.isfinite(x) for x in vector):
        return "a value is not finite"
    return None if any(vector) else "all values are zero"


def vectors_of(texts: Sequence[str], model: Model, dimension: int) -> list[tuple[list[float] | None, str | None]]:
    """(vector, error) of each text; where a call fails, each of its texts is tried alone, so that one doesn't spoil the others."""
    try:
        found = [list(map(float, v)) if v is not None else None for v in model(texts)]
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
    except Exception as error:  # noqa: BLE001  whatever the model raises is the text's status
        if len(texts) == 1:
            return [(None, f"{type(error).__name__}: {error}"[:300])]
        return [made for text in texts for made in vectors_of([text], model, dimension)]
    faults = [fault(v, dimension) for v in found]
    return [(None if why else v, why) for v, why in zip(found, faults)]


def embedded(df: DataFrame, text: Column, model: Model, name: str, dimension: int = DIMENSION) -> DataFrame:
    """``df`` with embedding, embedding_status (success or failed), embedding_model and embedding_error.

    Each distinct text is embedded once.  A blank text fails without a call; a null one is blank.  Columns of these names are replaced.
    """
    added = ("embedding", "embedding_status", "embedding_model", "embedding_error")
    rows = df.drop(*added).withColumn("_said", F.coalesce(text, F.lit("")))
    rows = rows.withColumn("_key", F.when(stripped(F.col("_said")) != "", F.sha2("_said", 256)))
    asked = rows.where("_key IS NOT NULL").select("_key", "_said").dropDuplicates(["_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column("_key").to_pylist(), batch.column("_said").to_pylist()
            for at in range(0, len(texts), AT_ONCE):
                made = vectors_of(texts[at : at + AT_ONCE], model, dimension)
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + AT_ONCE], pa.string()), pa.array([v for v, _ in made], pa.list_(pa.float64())), pa.array([e for _, e in made], pa.string())], ["_key", "embedding", "embedding_error"])

    found = asked.mapInArrow(run, "_key string, embedding array<double>, embedding_error string")
    joined = rows.join(found, "_key", "left").withColumn("embedding_error", F.when(F.col("_key").isNull(), "blank text").otherwise(F.col("embedding_error")))
    status = F.when(F.col("embedding").isNotNull(), "success").otherwise("failed")
    return joined.select(*[c for c in df.columns if c not in added], "embedding", status.alias("embedding_status"), F.when(F.col("embedding").isNotNull(), name).alias("embedding_model"), "embedding_error")


MOST_AT_ONCE = 1 << 20  # tokens that are counted at once
MOST_KNOWN = 200_000  # tokens whose slot a task remembers


def slot_rows(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, slot, v): the slots of ``hashed_counts`` that aren't zero, for long texts.

    Tokens are made in the JVM; a task hashes each distinct one it meets once and counts whole batches as arrays.
    """

    def counted(keys: pa.Array, row: np.ndarray, words: pa.Array, known: dict[str, int]) -> pa.RecordBatch:
        met = words.dictionary_encode()
        if len(known) > MOST_KNOWN:
            known.clear()
        slots = [known[w] if w in known else known.setdefault(w, int(hashlib.sha256(w.encode()).hexdigest(), 16) % (2 * DIMENSION)) for w in met.dictionary.to_pylist()]
        slot = np.array(slots, np.int64)[met.indices.to_numpy()]
        place, at = np.unique(row * DIMENSION + slot % DIMENSION, return_inverse=True)
        total = np.bincount(at, np.where(slot < DIMENSION, 1, -1), len(place)).astype(np.int64)
        place, total = place[total != 0], total[total != 0]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(place // DIMENSION)), pa.array(place % DIMENSION), pa.array(total)], [key, "slot", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            keys, lists = batch.column(0), batch.column(1)
            ends = np.cumsum(lists.value_lengths().to_numpy())
            start = 0
            while start < len(ends):  # at least one row, so that a text is counted whole
                end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + MOST_AT_ONCE, "right")))
                part = lists.slice(start, end - start)
                if len(words := part.flatten()):
                    yield counted(keys.slice(start, end - start), np.repeat(np.arange(end - start), part.value_lengths().to_numpy()), words, known)
                start = end

    return df.select(key, tokens(text).alias("_tokens")).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, slot long, v long")
