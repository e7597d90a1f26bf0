"""Sheets are tables; lineage of iterative jobs is cut by tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_kept: dict[str, str] = {}


def sheet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir, removed when the application ends.

    In local mode, where no folder need be named, a temporary one is set; on a cluster that is an error, since a folder of one
    machine would not be seen by the others.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-loomsheet-", dir="/tmp")
        spark.conf.set(CHECKPOINT_DIR, folder)
    own = f"{folder.rstrip('/')}/loomsheet-{context.applicationId}"
    if _kept.get(context.applicationId) != own:
        place = context._jvm.org.apache.hadoop.fs.Path(own)
        files = place.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(place)
        files.deleteOnExit(place)
        _kept[context.applicationId] = own
    return own


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet under the shared folder and read back: its lineage ends there and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
