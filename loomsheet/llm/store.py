"""Lineage cuts in the shared folder, and Arrow maps over texts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from loomsheet.sources.tables import CHECKPOINT_DIR, shared_dir, stored

__all__ = ["CHECKPOINT_DIR", "map_texts", "shared_dir", "stored"]

#: Rows of a batch that a Python worker gets: texts are some KB each, and some are very long.
BATCH_ROWS = 1_000
_BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"


def map_texts(df: DataFrame, task: Callable, schema) -> DataFrame:
    """df.mapInArrow for texts: batches of at most BATCH_ROWS rows (unless the session asks for fewer), and memory that a task
    no longer uses given back to the system, since workers are kept for later tasks."""
    spark = df.sparkSession
    if int(spark.conf.get(_BATCHES)) > BATCH_ROWS:
        spark.conf.set(_BATCHES, str(BATCH_ROWS))

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return df.mapInArrow(lean, schema)
