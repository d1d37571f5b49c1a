"""Cutting lineage with tables in the folder that driver and executors share, and batches into parts."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.

    Where that is unset, as in tests on one machine, a temporary folder takes its place.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a batch that a Python worker makes objects of at once.
SLICE_ROWS = 64


def slices(batch: pa.RecordBatch | pa.Array) -> Iterator[pa.RecordBatch | pa.Array]:
    """``batch`` in parts of ``SLICE_ROWS``, so that a worker's objects do not follow the batch; an empty one has one part."""
    for at in range(0, max(len(batch), 1), SLICE_ROWS):
        yield batch.slice(at, SLICE_ROWS)
