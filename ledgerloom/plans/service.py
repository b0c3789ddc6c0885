"""The upload job from file to relations: state kept as append-only tables, one partition a run.

``process`` is the body of a job: register, ingest, relate, record.  A run that is repeated under the
same number overwrites its own partitions, and bytes that a complete document has are skipped, so a
job may be delivered more than once, in one micro-batch or in several.
"""

from __future__ import annotations

import itertools
import logging
import traceback
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import model_stage, tables
from ledgerloom.plans import ingest
from ledgerloom.sources import lake
from ledgerloom.sources.storage import exists
from ledgerloom.streaming.jobs import job_states

DOCUMENTS = "document_id string, content_hash string, status string, document_version int, run_id long"
RELATIONS = "fact_a_id long, fact_b_id long, relation_type string, confidence double, reason string, fact_a_evidence string, fact_b_evidence string, source string, is_active boolean, run_id long"
PARTS = 1 << 20
EVENTS = "job_id string, at timestamp, status string, error string, run_id long"


def state(spark: SparkSession, root: str, name: str, schema: str | None = None) -> DataFrame | None:
    """A state table; where there is none yet, an empty one of ``schema`` or None.

    Columns that only some runs have written, and those of ``schema`` that none has, are null where they are missing, so
    that a newer version's columns come without rewriting what older ones stored.
    """
    path = f"{root}/state/{name}"
    try:
        found = spark.read.option("mergeSchema", "true").parquet(path) if exists(spark, path) else None
    except AnalysisException as error:
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        found = None  # there is a folder, and no rows yet
    if found is not None:
        wanted = spark.createDataFrame([], schema).schema if schema else []
        have = {f.name: f.dataType for f in found.schema}
        return found.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted], *[c for c in found.columns if c not in {f.name for f in wanted}])
    return spark.createDataFrame([], schema) if schema else None


def record(df: DataFrame, root: str, name: str, run_id: int) -> None:
    lake.write_layer(df.withColumn("run_id", F.lit(run_id).cast("long")), f"{root}/state/{name}", "run_id")


def facts(spark: SparkSession, root: str, before: int | None = None) -> DataFrame | None:
    """All facts, active where they are of their document's latest version; of earlier runs only with ``before``."""
    found = state(spark, root, "facts")
    if found is not None and before is not None:
        found = found.where(F.col("run_id") != before)
    return None if found is None else tables.with_activity(found.drop("is_active"))


def states(spark: SparkSession, root: str) -> DataFrame:
    """The latest state of every job."""
    return job_states(state(spark, root, "events", EVENTS))


def _event(spark: SparkSession, root: str, run_id: int, number: int, ids: DataFrame, status: str, error: str = "") -> None:
    rows = ids.select(F.col("document_id").alias("job_id"), F.current_timestamp().alias("at"), F.lit(status).alias("status"), F.lit(error).alias("error"))
    record(rows, root, "events", run_id * 10 + number)


def process(
    spark: SparkSession,
    paths: str | list[str],
    providers: Sequence[model_stage.Provider],
    root: str,
    run_id: int,
    model: Callable[[DataFrame], DataFrame] | None = None,
    again: bool = False,
    **options,
) -> ingest.Ingested:
    """Ingest the files, relate their facts to all others and record documents, facts, relations and job states.

    ``again`` takes bytes that were complete once more, as the next version of their document.  A failure is
    recorded as the jobs' state and raised.
    """
    known = state(spark, root, "documents", DOCUMENTS).where(F.col("run_id") != run_id)
    if again:
        known = known.withColumn("status", F.lit("superseded"))
    names = ingest.pages.files(spark, paths, options.get("pattern", ingest.pages.UPLOADS)).select("document_id")
    _event(spark, root, run_id, 0, names, "running")
    try:
        done = ingest.ingest(spark, paths, providers, known, run_id, root, **options)
        fresh = done.documents.where("status = 'new'").select("document_id", "content_hash", F.lit("complete").alias("status"), "document_version")
        earlier = facts(spark, root, before=run_id)
        new = done.facts
        everything = new if earlier is None else tables.with_activity(earlier.unionByName(new, allowMissingColumns=True).drop("is_active"))
        existing = state(spark, root, "relations", RELATIONS).where(F.col("run_id") != run_id)
        if new.limit(1).count():
            found = ingest.relate(new, everything, existing, model).withColumn("is_active", F.lit(True))
            record(found, root, "relations", run_id)
            record(new.drop("run_id"), root, "facts", run_id)
        record(fresh, root, "documents", run_id)
    except Exception:
        _event(spark, root, run_id, 1, names, "failed", traceback.format_exc()[-500:])
        raise
    _event(spark, root, run_id, 2, names, "complete")
    return done


def handler(spark: SparkSession, providers: Sequence[model_stage.Provider], root: str, **options) -> Callable[[DataFrame, int], None]:
    """For ``jobs.start``: each micro-batch is a run; only its paths reach the driver, which the source's batch size bounds.

    Where a run fails its files are worked on in halves, down to single ones, so that only those that fail by themselves are
    left with that state; the stream goes on.  The parts of run n are runs n * PARTS + 1 and on.
    """

    def each(batch: DataFrame, number: int) -> None:
        paths = sorted({r.path for r in batch.select("path").where("path IS NOT NULL").collect()})
        parts = itertools.count((number + 1) * PARTS + 1)

        def work(some: list[str], run_id: int) -> None:
            try:
                process(spark, some, providers, root, run_id, **options)
            except Exception as error:  # noqa: BLE001  recorded as the jobs' state by ``process``
                logging.getLogger(__name__).warning("run %s of %s files failed: %s", run_id, len(some), error)
                if len(some) > 1:
                    half = len(some) // 2
                    work(some[:half], next(parts))
                    work(some[half:], next(parts))

        if paths:
            work(paths, number + 1)

    return each


def reprocess(spark: SparkSession, folder: str, providers: Sequence[model_stage.Provider], root: str, **options) -> ingest.Ingested:
    """All files of a folder once more, as next versions; their older facts become inactive."""
    last = state(spark, root, "documents", DOCUMENTS).agg(F.max("run_id")).first()[0] or 0
    return process(spark, folder, providers, root, last + 1, again=True, **options)


def submit(uploads: DataFrame, send: Callable[[DataFrame], None], inline: Callable[[DataFrame, int], None], run_id: int) -> str:
    """Send the jobs to the broker; where that fails they are worked on here.  Returns ``queued`` or ``inline``."""
    try:
        send(uploads)
        return "queued"
    except Exception:  # noqa: BLE001  whatever the broker's client raises
        inline(uploads, run_id)
        return "inline"


def evaluation(spark: SparkSession, root: str, first: int = 5) -> DataFrame:
    """The report on relations by type with examples."""
    found = facts(spark, root)
    relations = state(spark, root, "relations", RELATIONS).where("is_active")
    return tables.relation_report(tables.active_relations(relations, found), found, first)
