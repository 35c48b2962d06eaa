"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where the session names none, as in tests, a local master gets a folder that goes with the
    process; a cluster raises, as a folder of our own would be on one machine only.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="gaugeworks-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def crc_mod(column: str, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``; null ids count as held out nowhere (null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(m)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on sends Arrow batches of ``BATCH_ROWS`` rows and ``BATCH_BYTES`` bytes at most.

    Rows with whole texts are long: larger batches would take hundreds of MB outside the heap of each
    executor.  Smaller settings of the session stay.
    """
    spark = df.sparkSession
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
    return df


def lean(work: Callable) -> Callable:
    """``work`` on a task's batches, after which the process gives unused memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        release()

    return run


def release() -> None:
    """Give memory that Arrow and the C library hold but do not use back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_REMEMBERED: dict[Any, Any] = {}


def remembered(key: Any, make: Callable[[], Any]) -> Any:
    """What a worker process keeps from task to task under ``key``.

    Only one such memory is held: another key drops it, so stages that follow each other in the
    same workers do not add up.
    """
    if key not in _REMEMBERED:
        _REMEMBERED.clear()
        _REMEMBERED[key] = make()
    return _REMEMBERED[key]
