"""The model as an operator: distinct prompts, a cache, providers in order, retries with back-off."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import coerce
from ledgerloom.functions.text import stripped, without_fences
from ledgerloom.schemas import RAW_FACT

ATTEMPTS, FIRST_WAIT, LONGEST_WAIT = 4, 1.0, 20.0
LIST_KEYS = ("facts", "items", "data", "results")


class TransientError(Exception):
    """Worth another attempt."""


class QuotaError(Exception):
    """This provider will not answer any more; the next one is asked."""


class Provider(Protocol):
    """Runs in executors, so it must be picklable; it gets a prompt and returns JSON text."""

    def __call__(self, prompt: str) -> str: ...


def lazily(make: Callable[[], Provider]) -> Provider:
    """A provider that is made at its first use, once in each Python worker: only ``make`` is sent there."""
    made: list[Provider] = []

    def provider(prompt: str) -> str:
        if not made:
            made.append(make())
        return made[0](prompt)

    return provider


def ask(prompt: str, providers: Sequence[Provider], wait: Callable[[float], None] = time.sleep) -> tuple[str | None, str]:
    """(answer, status): the first provider that answers within its attempts; status ok, quota or failed.

    Any other error of a provider counts as its failure, so that one prompt doesn't end the job.
    """
    status = "failed"
    for provider in providers:
        for attempt in range(ATTEMPTS):
            try:
                return provider(prompt), "ok"
            except QuotaError:
                status = "quota"
                break
            except TransientError:
                status = "failed"
                if attempt + 1 < ATTEMPTS:
                    wait(min(LONGEST_WAIT, FIRST_WAIT * 2**attempt) * random.uniform(0.5, 1.5))
            except Exception:  # noqa: BLE001
                status = "failed"
                break
    return None, status


def answered(prompts: DataFrame, providers: Sequence[Provider], cache: DataFrame | None = None) -> DataFrame:
    """``prompts`` with its prompt column's key, answer and status; each distinct prompt is asked once.

    ``cache`` (key, value, created_at) answers first, by its latest value.
    """
    keyed = prompts.withColumn("key", F.sha2("prompt", 256))
    asked = keyed.select("key", "prompt").dropDuplicates(["key"])
    kept = None
    if cache is not None:
        kept = cache.groupBy("key").agg(F.max_by("value", "created_at").alias("answer"))
        asked = asked.join(kept, "key", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            replies = [ask(p, providers) for p in batch.column("prompt").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([r[0] for r in replies], pa.string()), pa.array([r[1] for r in replies], pa.string())], ["key", "answer", "status"])

    replies = asked.mapInArrow(run, "key string, answer string, status string")
    if kept is not None:
        replies = replies.unionByName(kept.withColumn("status", F.lit("cached")))
    return keyed.join(replies, "key", "left")


def new_cache_rows(replies: DataFrame) -> DataFrame:
    return replies.where("status = 'ok'").select("key", F.col("answer").alias("value"), F.current_timestamp().alias("created_at")).dropDuplicates(["key"])


def listed(answer: Column) -> Column:
    """The facts in an answer: a list, or the first list under one of the usual keys."""
    text, kind = without_fences(answer), f"array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in RAW_FACT.split(','))}>>"
    keyed = [F.from_json(F.get_json_object(text, f"$.{k}"), kind) for k in LIST_KEYS]
    return F.when(text.startswith("["), F.from_json(text, kind)).otherwise(F.coalesce(*keyed, F.from_json(F.lit("[]"), kind)))


def raw_facts(replies: DataFrame) -> DataFrame:
    """Facts from the answers on chunks (document_id, document_version, chunk_id, start_page, page_map, answer).

    A page that isn't a whole number becomes the chunk's first page.
    """
    each = replies.select("document_id", "document_version", "chunk_id", "start_page", F.col("page_map").alias("chunk_pages"), F.explode_outer(listed(F.col("answer"))).alias("f")).where("f IS NOT NULL")
    page = F.when(stripped(F.col("f.page_no")).rlike("^[0-9]+$"), stripped(F.col("f.page_no")).try_cast("int"))
    text = {c: stripped(F.col(f"f.{c}")) for c in ("entity", "metric", "value", "quote")}
    level = coerce.confidence(F.col("f.confidence"))
    return each.select(
        "document_id",
        "document_version",
        "chunk_id",
        "chunk_pages",
        F.coalesce(page, F.col("start_page")).alias("page_no"),
        *[c.alias(n) for n, c in text.items()],
        *[F.col(f"f.{c}").alias(c) for c in ("unit", "period", "scope", "geography", "is_reported_value")],
        F.coalesce(coerce.reporting_basis(F.col("f.reporting_basis")), F.when(F.col("f.is_reported_value") == F.lit(False), "estimate")).alias("reporting_basis"),
        level.alias("confidence"),
        coerce.level_score(level).alias("numeric_confidence"),
    )
