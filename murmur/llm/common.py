"""Helpers shared by the training-data operators: word pattern, shared scratch tables."""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.session import scratch_path

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def packed(docs: DataFrame) -> Column:
    """All columns as one struct ``doc``, so that no name of theirs can clash with a working column."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` out of the struct ``doc``."""
    return rows.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet under the cluster's shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor only re-reads files.  The file listing
    and schema are taken from the written table, so no inference job runs.
    """
    spark: SparkSession = df.sparkSession
    path = scratch_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Fewer rows in each Arrow batch while a job over texts runs: a batch is held by the JVM and the Python worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def release(spark: SparkSession) -> None:
    """Let the driver collect its garbage now, so that executors drop the shuffle files of steps that are done.

    The first collection frees the plans of those steps, the second the shuffles they held.
    The heap shrinks to what is left, and the driver's Python returns its free memory as well.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)
    give_back()


#: What this Python worker keeps from one task to the next, by name.
_kept: dict[str, Any] = {}


def kept(name: str, make: Callable[[], Any]) -> Any:
    """What the worker keeps under ``name`` until a step runs in it that does not keep it; made if it is not there."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def give_back() -> None:
    """Free memory of Arrow and of the C library goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc has it
    if trim is not None:
        trim(0)


def tidied(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], batches: Iterator[pa.RecordBatch],
           keep: str | None = None) -> Iterator[pa.RecordBatch]:
    """What ``step`` makes of a task's batches; what earlier steps kept goes before, free memory after, for the worker stays while others run."""
    for name in set(_kept) - {keep}:
        del _kept[name]
    yield from step(batches)
    give_back()
