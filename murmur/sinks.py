"""Table sinks: summary tables partitioned for pruning, replaced one partition at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.session import delete_path, path_exists, scratch_path


def write_rollup(df: DataFrame, path: str, date_col: str = "date", by=("language",), touched: DataFrame | None = None) -> None:
    """Write a daily rollup partitioned by (language, month).

    ``df`` holds whole days.  The stored days of a touched month that ``df``
    does not have are merged in before the month's partition is replaced
    (dynamic overwrite), so rewriting a day (T22) leaves all other days as
    they are.  The merged months are staged in the shared checkpoint folder.
    ``touched`` names the days (language, date) that were computed anew: those
    that have no rows any more lose their stored ones.
    """
    spark, keys = df.sparkSession, [*by, "month"]
    month = F.date_format(F.col(date_col), "yyyy-MM")
    out = df.withColumn("month", month)
    if path_exists(spark, path):
        days = df.select(*by, date_col)
        days = (days if touched is None else days.unionByName(touched.select(*by, date_col))).distinct()
        months = days.select(*by, month.alias("month")).distinct()
        old = spark.read.schema(out.schema).parquet(path)
        kept = old.join(months, keys, "left_semi").join(days, [*by, date_col], "left_anti")
        staged = scratch_path(spark, "rollup")
        out.unionByName(kept).write.parquet(staged)
        out = spark.read.schema(out.schema).parquet(staged)
        if touched is not None:                          # a month without any row left is not overwritten, so its folder goes
            bare = months.join(out.select(*keys).distinct(), keys, "left_anti").collect()
            for r in bare:
                delete_path(spark, "/".join([path, *[f"{k}={r[k]}" for k in keys]]))
    (out.repartition(*keys).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys).parquet(path))


def read_rollup(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("month")


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int, sort: bool = True) -> None:
    """Save ``df`` as a catalog table bucketed (and sorted) on ``key``.

    Two tables bucketed on the join key with the same bucket count join
    without a shuffle (comments ⋈ predictions on the comment id, comments ⋈
    lemmatized comments), which is what keeps the pending-work and keyword
    joins cheap when both sides are large.
    """
    w = df.write.mode("overwrite").bucketBy(buckets, key)
    if sort:
        w = w.sortBy(key)
    w.saveAsTable(table)
