"""Derived drop files: TSV lines that Spark writes from the given tables.

The test data has no raw drop folders, so ingestion queries first write
header-less TSV drops derived from ``documents`` / ``orders`` into a fresh
folder under the shared checkpoint folder, in a known file and line order,
and then ingest them.  Text fields lose tabs and line breaks (the drop
format has no quoting).
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.session import delete_path, scratch_path


def tsv_line(cols: list[Column]) -> Column:
    clean = [F.coalesce(F.regexp_replace(c.cast("string"), r"[\t\r\n]", " "), F.lit("")) for c in cols]
    return F.concat_ws("\t", *clean)


#: Least number of files of a drop, and input bytes of a plain and of a gzip file, which one task has to read whole.
MIN_FILES, FILE_BYTES, GZIP_FILE_BYTES = 4, 256 << 20, 8 << 20


def files_of(df: DataFrame, gzip: bool = False) -> int:
    """Files for the rows of ``df``, by Catalyst's estimate from file sizes."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(MIN_FILES, -(-size // (GZIP_FILE_BYTES if gzip else FILE_BYTES)))


@contextmanager
def parts_kept(spark: SparkSession):
    """A union of single partitions has as many partitions as it has parts, whereas Spark 4.1 makes one of them by itself."""
    name = "spark.sql.unionOutputPartitioning"
    old = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, old)


def in_files(df: DataFrame, order_col: str, cols: list[Column], n_files: int) -> tuple[DataFrame, str]:
    """Lines in exactly ``n_files`` partitions of increasing keys, and the folder they are read from.

    A file is written by one task, so what this task reads grows with the
    input.  Instead of shuffled rows it reads the lines of its range from
    Parquet, compressed by zstd: fewer bytes, and they are no shuffle files.
    """
    spark = df.sparkSession
    bounds = df.approxQuantile(order_col, [k / n_files for k in range(1, n_files)], 0.001)
    key = F.col(order_col)
    number = sum([F.coalesce((key > x).cast("int"), F.lit(0)) for x in bounds], F.lit(0))      # a null key comes first
    path = scratch_path(spark, "drop-lines")
    lines = df.select(key.alias("key"), tsv_line(cols).alias("value"), number.alias("file"))
    lines.write.option("compression", "zstd").partitionBy("file").parquet(path)
    stored = spark.read.schema(lines.schema).parquet(path)
    each = [stored.where(F.col("file") == k).coalesce(1).sortWithinPartitions("key").select("value") for k in range(n_files)]
    return reduce(DataFrame.union, each), path


def write_drop(df: DataFrame, folder: str, cols: list[Column], order_col: str, n_files: int | None = None,
               gzip: bool = False) -> str:
    """Range-partition by ``order_col`` so part-00000, part-00001, … hold increasing
    keys, sort inside each file, and write one line per row.  Without ``n_files``
    the files of a large drop are as many as keep each small."""
    path = None
    if n_files:
        out, path = in_files(df, order_col, cols, n_files)
    else:
        out = (df.repartitionByRange(files_of(df, gzip), order_col).sortWithinPartitions(order_col)
               .select(tsv_line(cols).alias("value")))
    w = out.write.mode("overwrite")
    if gzip:
        w = w.option("compression", "gzip")
    if path:
        with parts_kept(df.sparkSession):
            w.text(folder)
        delete_path(df.sparkSession, path)
    else:
        w.text(folder)
    return folder


def write_named(df: DataFrame, folder: str, base: str, cols: list[Column], n_files: int = 2, gzip: bool = False) -> str:
    """Append files whose names begin with ``base`` (Spark adds task number and extension) to a drop folder."""
    w = df.select(tsv_line(cols).alias("value")).repartition(n_files).write.mode("append").option("mapreduce.output.basename", base)
    if gzip:
        w = w.option("compression", "gzip")
    w.text(folder)
    return folder
