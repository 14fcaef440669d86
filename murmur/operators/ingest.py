"""Loading parsed drops into the tables.

Ids follow (file name, line) order, computed without a window over rows: lines
are counted per (file, split), a prefix sum runs over that small table, and each
row adds its position inside its split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions.text import detect_language
from murmur.operators.joins import broadcast_checked
from murmur.params import Params
from murmur.session import scratch_path

BLOCK = ["file_path", "block_start"]


def assign_ids(rows: DataFrame, base: int | DataFrame = 0, out: str = "id") -> DataFrame:
    """Ids above ``base`` in (file, line) order, without moving a row.

    ``base`` is the current max id (a number or a frame whose first column
    holds the existing ids).  How files are split depends on settings and on
    the cores at hand, so the parsed rows are written once, with the place that
    this one reading gave them, and read back from there: whatever changes
    later, rows and offsets are of the same reading.  ``row_pos`` counts the
    lines a reading task has met, so inside a file split a row's number is its
    ``row_pos`` less the split's first; splits get a prefix offset from a table
    with one row per split (the window without a key runs over that table).  A
    line that the reader skips leaves a gap, ids are unique and in order all the same.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, "parsed")
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    blocks = rows.groupBy(*BLOCK).agg(F.min("row_pos").alias("_first"), F.max("row_pos").alias("_last"))
    w = Window.orderBy(*BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_off", F.coalesce(F.sum(F.col("_last") - F.col("_first") + 1).over(w), F.lit(0)))
    if isinstance(base, DataFrame):
        b = base.agg(F.coalesce(F.max(base.columns[0]), F.lit(0)).cast("long")).scalar()
    else:
        b = F.lit(base).cast("long")
    # one row per file split, counted before it is broadcast, so that no text is shuffled for its id
    path = scratch_path(spark, "splits")
    blocks.select(*BLOCK, "_first", "_off").write.parquet(path)
    small = broadcast_checked(spark.read.parquet(path))
    j = rows.join(small, BLOCK)
    return j.withColumn(out, b + F.col("_off") + F.col("row_pos") - F.col("_first") + 1).drop("_off", "_first")


def load_comments(parsed: DataFrame, website: str, params: Params, base: int | DataFrame = 0) -> DataFrame:
    """A5: language from the text (X1), site stamped, ids appended after ``base``."""
    rows = parsed.withColumn("comment_lang", detect_language("comment_text", "region", params)) \
                 .withColumn("website", F.lit(website))
    return assign_ids(rows, base)


def first_per_key(parsed: DataFrame, key: str = "article_id") -> DataFrame:
    """The first row per key in (file, line) order.

    ``min_by`` is an aggregate with a map-side partial step, so a key that
    holds a third of the rows never lands whole in one task (a window would).
    """
    place = [*BLOCK, "row_pos"]
    order = F.struct(*place)
    # a row's place is the order itself: kept beside the other columns it would be held twice
    agg = parsed.groupBy(key).agg(F.min_by(F.struct(*[c for c in parsed.columns if c != key and c not in place]), order).alias("_r"),
                                  F.min(order).alias("_o"))
    return agg.select(key, *[F.col(f"{'_o' if c in place else '_r'}.{c}") for c in parsed.columns if c != key])


def load_articles(parsed: DataFrame, website: str, params: Params) -> DataFrame:
    """Headline language, first row per article_id, site stamped."""
    first = first_per_key(parsed.where(F.col("article_id").isNotNull()))
    return (first.withColumn("headline_lang", detect_language("headline", "region", params))
            .withColumn("website", F.lit(website)))


def import_log(listing: DataFrame, parsed: DataFrame, n_columns: int, website: str) -> DataFrame:
    """One log row per listed file (``path``).

    The first line gives a file its width.  A file without lines or of another
    width than the expected one is ``Failed``; the others are ``Success``, with
    the count of skipped (too long) lines.  A failed file is selected again the
    next time (A9) and none of its rows are loaded (``loadable``).
    """
    per = parsed.groupBy("file_path").agg(
        F.count(F.lit(1)).alias("lines"), F.count(F.when(~F.col("_valid"), 1)).alias("skipped"),
        F.min_by("_n", F.struct("block_start", "row_pos")).alias("width"))
    each = listing.select(F.col("path").alias("file_path")).join(per, "file_path", "left")
    good = F.coalesce(F.col("width") == n_columns, F.lit(False))
    notes = (F.when(F.col("width").isNull(), F.lit("No columns to parse from file"))
             .when(~good, F.format_string(f"Length mismatch: expected {n_columns} columns, file has %d", "width"))
             .otherwise(F.format_string("File imported successfully. %d lines, %d skipped.", "lines", "skipped")))
    return each.select(
        "file_path", F.element_at(F.split("file_path", "/"), -1).alias("file_name"),
        F.when(good, "Success").otherwise("Failed").alias("status"), notes.alias("notes"),
        F.lit(website).alias("website"), F.current_timestamp().alias("import_timestamp"))


def loadable(parsed: DataFrame, log: DataFrame) -> DataFrame:
    """The valid rows of the files that the log calls a success."""
    good = log.where(F.col("status") == "Success").select("file_path")
    return parsed.join(good, "file_path", "left_semi").where("_valid").drop("_valid", "_n")
