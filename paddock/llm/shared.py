"""Helpers of the operators in this folder: written intermediate tables, Arrow columns as numpy arrays."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors reach; in the warehouse where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/llm-{spark.sparkContext.applicationId}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """Write ``rows`` to the shared folder and read them back, so that a lost executor or a second use costs no new run."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    release_shuffles(spark)
    return spark.read.schema(rows.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Let executors drop the shuffle files of jobs that are done: the driver's cleaner sees them when it collects garbage."""
    spark.sparkContext._jvm.System.gc()


def dropped(rows: DataFrame) -> None:
    """Delete the files of a ``written`` table that is needed no more."""
    spark = rows.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in rows.inputFiles()}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def slices(column: pa.Array) -> Iterable[memoryview]:
    """The values of a binary or string column without nulls, none of them copied."""
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    view = memoryview(data) if data is not None else memoryview(b"")
    return (view[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))


def release_memory() -> None:
    """Give freed memory back to the system: a Python worker lives on for other tasks, and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)
