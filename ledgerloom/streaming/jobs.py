"""Upload jobs as a stream: parsing, idempotent processing, state machine, event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators import tables
from ledgerloom.sources.storage import new_path

JOB = "document_id string, filename string, content_hash string, path string, uploaded_at timestamp"
#: Order of the states; of events at one instant the furthest state wins.
STATES = ("queued", "running", "failed", "complete")


def kafka_source(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """The topic's JSON messages; needs Spark's Kafka connector on the class path."""
    stream = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()
    return parsed(stream.select(F.col("value").cast("string").alias("value")))


def kafka_sink(jobs: DataFrame, servers: str, topic: str) -> None:
    """Messages to the topic, in batch."""
    jobs.select(F.to_json(F.struct(*jobs.columns)).alias("value")).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def file_source(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines dropped into a folder."""
    return parsed(spark.readStream.text(folder))


def parsed(messages: DataFrame) -> DataFrame:
    """Job rows from JSON in ``value``; a message that isn't a job has null fields and its text in ``raw``."""
    job = F.from_json("value", JOB).alias("job")
    return messages.select(job, F.col("value").alias("raw")).select("job.*", "raw")


def start(jobs: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Run ``handler`` on each micro-batch of distinct uploads; the checkpoint makes delivery at least once."""

    def each(batch: DataFrame, number: int) -> None:
        handler(batch.where("content_hash IS NOT NULL").dropDuplicates(["document_id", "content_hash"]), number)

    writer = jobs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def job_states(events: DataFrame) -> DataFrame:
    """The latest state of every job (job_id, at, status); equal instants go by the order of states."""
    order = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("status"))
    return tables.latest(events.withColumn("_order", order), "job_id", "at", "_order", "status").drop("_order")


def events_stream(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """A Parquet file or folder of events as a stream, with ``ts`` as an instant."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    reader = spark.readStream.schema(schema)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        stream = reader.parquet(f"{folder}/{name}")  # the filter below would match none of its files
    else:
        stream = reader.option("pathGlobFilter", name).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, keys: list[str], late: str = "30 days") -> DataFrame:
    """First event per key, at whatever instant its repeats come within the watermark; older state is dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def run_to_table(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream in append mode over what is there now and return the table it wrote."""
    spark = stream.sparkSession
    path, checkpoint = new_path(spark, label), new_path(spark, f"{label}-checkpoint")
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
