"""Partition layout helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame


#: Input per task below which a frame is spread over all cores.
SMALL_TASK_BYTES = 16 << 20


def spread(df: DataFrame, key: str, min_partitions: int | None = None) -> DataFrame:
    """Hash-spread ``df`` on ``key`` when it is too small to keep the cluster's cores busy as it is split.

    Used right before an operator that multiplies rows (tokens → n-grams):
    a small input (one file, one split) would otherwise put all that work in
    one task.  The size is Catalyst's estimate from file sizes, so no job runs
    while the plan is built; large inputs and joined frames stay as they are.
    """
    if df.isStreaming:
        return df
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    if plan.nodeName().startswith("Repartition") and plan.numPartitions() >= want:
        return df                                       # spread already
    size = int(str(plan.stats().sizeInBytes()))
    return df.repartition(want, key) if size < want * SMALL_TASK_BYTES else df
