"""The folder that all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only in local mode, where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else None
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/ledgerloom/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    A lost executor then costs a re-read, not a recomputation, and later reads see one set of rows.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _store(spark: SparkSession, uri: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, uri: str) -> bool:
    path, store = _store(spark, uri)
    return store.exists(path)


def ensure_folder(spark: SparkSession, uri: str) -> bool:
    """Make the folder or the bucket's prefix, if the store allows it."""
    try:
        path, store = _store(spark, uri)
        return bool(store.mkdirs(path))
    except Exception:  # noqa: BLE001  a store that can't be reached is not an error here
        return False


def put(spark: SparkSession, local: str, folder: str, name: str) -> str | None:
    """Copy a file of the driver into a folder of any Hadoop store; its URI, or None where that fails."""
    try:
        target, store = _store(spark, f"{folder.rstrip('/')}/{name}")
        source = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{local}")
        store.copyFromLocalFile(False, True, source, target)
        return f"{folder.rstrip('/')}/{name}"
    except Exception:  # noqa: BLE001  best effort
        return None
