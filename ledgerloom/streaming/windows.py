"""Event-time windows, sessions and joins of streams, with late rows kept in a table of their own.

``Accepted`` splits a stream once: a row is late where it is older than the newest row of all earlier
micro-batches less the allowed delay, or has no instant.  Each micro-batch is one folder that a repeated
batch overwrites, and the newest instant so far is kept beside it, so that a restart goes on with the
same bound.  What later operators read of the accepted rows is never late for them, as long as they read whole micro-batches (a run
after ``take`` does): their own watermark, over the same rows with the same delay, is then never ahead of that bound.

Windows, sessions and outer joins emit in append mode when the watermark passes them.  ``run_to_end``
runs a stream over what is there, then adds rows far enough in the future to close what is open, and runs
it once more; these rows close nothing of their own, so they are in no result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.storage import exists, new_path


class Accepted:
    """Rows of a stream under ``root``, split into those in time and late ones."""

    def __init__(self, spark: SparkSession, schema: str, delay: str, root: str | None = None, at: str = "ts"):
        self.spark, self.schema, self.delay, self.at = spark, schema, delay, at
        self.root = root or new_path(spark, "accepted")

    def take(self, stream: DataFrame) -> None:
        """Split all that the stream has now; called again, it goes on after the last micro-batch."""
        query = stream.writeStream.foreachBatch(self._split).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()

    def _split(self, batch: DataFrame, number: int) -> None:
        late = self._is_late(F.col(self.at), number)
        batch.withColumn("is_late", F.coalesce(late, F.lit(True))).write.mode("overwrite").partitionBy("is_late").parquet(f"{self.root}/rows/batch={number:09d}")
        written = batch.sparkSession.read.schema(f"{self.schema}, is_late boolean").parquet(f"{self.root}/rows/batch={number:09d}")
        written.agg(F.max(self.at).alias("newest")).write.mode("overwrite").parquet(f"{self.root}/marks/batch={number:09d}")

    def _is_late(self, at: Column, number: int) -> Column:
        if not exists(self.spark, f"{self.root}/marks"):
            return at.isNull()
        marks = self.spark.read.schema("newest timestamp, batch int").parquet(f"{self.root}/marks")
        newest = marks.where(F.col("batch") < number).agg(F.max("newest")).first()[0]
        return at.isNull() if newest is None else at < F.lit(newest) - F.expr(f"INTERVAL {self.delay}")

    def rows(self, late: bool = False) -> DataFrame:
        schema = f"{self.schema}, batch int, is_late boolean"
        found = self.spark.read.schema(schema).parquet(f"{self.root}/rows") if exists(self.spark, f"{self.root}/rows") else self.spark.createDataFrame([], schema)
        return found.where(F.col("is_late") == late).drop("is_late", "batch")

    def stream(self) -> DataFrame:
        """The rows in time as a stream with the watermark; each run reads all micro-batches that are new to it."""
        return self.spark.readStream.schema(self.schema).parquet(f"{self.root}/rows/batch=*/is_late=false").withWatermark(self.at, self.delay)

    def close(self, span: str, rows: list[dict]) -> None:
        """Add ``rows`` so long after the newest one that the watermark passes all windows of ``span``.

        Their keys must pass the stream's filters, those that Spark infers from a join's keys too, so they aren't null there.
        """
        newest = self.rows().agg(F.max(self.at)).first()[0]
        if newest is None:
            return
        end = F.lit(newest) + F.expr(f"INTERVAL {self.delay}") + F.expr(f"INTERVAL {span}") + F.expr("INTERVAL 2 seconds")
        empty = self.spark.createDataFrame([], self.schema)
        fill = [F.lit(r.get(f.name)).cast(f.dataType).alias(f.name) if f.name != self.at else end.alias(f.name) for r in rows for f in empty.schema]
        width = len(empty.columns)
        for i in range(len(rows)):
            made = self.spark.range(1).select(*fill[i * width : (i + 1) * width])
            made.write.mode("overwrite").parquet(f"{self.root}/rows/batch={999_999_000 + i}/is_late=false")


def sessions(events: DataFrame, keys: list[str], measures: dict[str, Column], gap: str = "30 minutes", at: str = "ts") -> DataFrame:
    """keys, session_start, session_end and ``measures`` of each run of events less than ``gap`` apart; the end is the last event's instant plus the gap."""
    grouped = events.groupBy(*keys, F.session_window(at, gap).alias("span")).agg(*[m.alias(n) for n, m in measures.items()])
    return grouped.select(*keys, F.col("span.start").alias("session_start"), F.col("span.end").alias("session_end"), *measures)


def sliding(events: DataFrame, keys: list[str], measures: dict[str, Column], length: str = "6 hours", step: str = "2 hours", at: str = "ts") -> DataFrame:
    """keys, window_start and ``measures`` of overlapping windows, one every ``step``."""
    grouped = events.groupBy(*keys, F.window(at, length, step).alias("span")).agg(*[m.alias(n) for n, m in measures.items()])
    return grouped.select(*keys, F.col("span.start").alias("window_start"), *measures)


def followed(first: DataFrame, then: DataFrame, key: str, within: str = "1 hour", at: str = "ts") -> DataFrame:
    """Rows of ``first`` with each row of ``then`` of their key at the same instant or up to ``within`` after it, as then_*; nulls where there is none.

    Both sides are streams with watermarks; the bound on instants lets either side's state go.
    """
    right = then.select(*[F.col(c).alias(f"then_{c}") for c in then.columns])
    near = f"then_{key} = {key} AND then_{at} >= {at} AND then_{at} <= {at} + INTERVAL {within}"
    return first.join(right, F.expr(near), "leftOuter").drop(f"then_{key}")


def advance(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream in append mode over what is new since its last run, and append to the table at ``path``."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def run_to_end(build: Callable[[], DataFrame], accepted: Accepted, span: str, closing: list[dict], label: str) -> DataFrame:
    """The whole result of the stream that ``build`` makes of accepted rows."""
    spark = accepted.spark
    path, checkpoint = new_path(spark, label), new_path(spark, f"{label}-checkpoint")
    if accepted.rows().limit(1).count() == 0:
        return spark.createDataFrame([], build().schema)
    advance(build(), path, checkpoint)
    accepted.close(span, closing)
    advance(build(), path, checkpoint)
    return spark.read.schema(build().schema).parquet(path)
