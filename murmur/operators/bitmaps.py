"""Distinct articles over any range from stored rollups (K6, U4, E2): exact bitmaps.

A day's distinct articles cannot be added up over days, the sets can.  Article
ids are set as bits of pieces of 32,768 bits; a stored row is one piece of one
key's set on one day, so a hot day is many rows, and a key with few articles is
few pieces that compress to little.  A range query reads the stored rows of the
range, unites the pieces of equal number with ``bitmap_or_agg`` (combined
map-side) and adds up their bits; it never goes back to comments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions.periods import date_between
from murmur.params import Params


def day_bitmaps(rows: DataFrame, keys: tuple[str, ...], date: str = "date", value: str = "article_id") -> DataFrame:
    """(date, keys, piece, bits, rows): distinct values as bitmap pieces and the number of rows, ready to be stored.

    Rows without a value count in ``rows`` under a piece of their own that has no bits.
    """
    known = F.col(value).isNotNull()
    piece = F.when(known, F.bitmap_bucket_number(value)).otherwise(F.lit(-1).cast("long"))
    place = F.when(known, F.bitmap_bit_position(value)).otherwise(F.lit(0).cast("long"))
    return rows.select(F.col(date).alias("date"), *keys, piece.alias("piece"), place.alias("_bit")) \
               .groupBy("date", *keys, "piece").agg(F.bitmap_construct_agg("_bit").alias("bits"), F.count(F.lit(1)).alias("rows"))


def distinct_over(stored: DataFrame, keys: tuple[str, ...], start, end, period: Column | None = None, distinct: str = "article_count",
                  rows: str = "count") -> DataFrame:
    """(keys, [period], distinct, rows) between two days, per ``period`` of the column ``date`` if one is given."""
    s = stored.where(date_between("date", start, end))
    if period is not None:
        s = s.withColumn("period", period)
        keys = (*keys, "period")
    pieces = s.groupBy(*keys, "piece").agg(F.bitmap_or_agg("bits").alias("bits"), F.sum("rows").alias("_rows"))
    bits = F.when(F.col("piece") >= 0, F.bitmap_count("bits")).otherwise(F.lit(0).cast("long"))
    return pieces.groupBy(*keys).agg(F.sum(bits).alias(distinct), F.sum("_rows").alias(rows))


def keyword_bitmaps(hits: DataFrame, params: Params) -> DataFrame:
    """Stored form of K1's article sets: (date, language, website, word, piece, bits, rows); sites that are not listed are null."""
    site = F.when(F.col("website").isin(list(params.sites)), F.col("website"))
    return day_bitmaps(hits.select("date", "language", site.alias("website"), F.col("lemma").alias("word"), "article_id"), ("language", "website", "word"))


def keywords_over(stored: DataFrame, start, end, params: Params, website: str | None = None) -> DataFrame:
    """K6 from stored bitmaps: (language, word, count, article_count); ``website`` None or ``all`` unites every site."""
    if website and website != params.all_scope:
        stored = stored.where(F.col("website") == website)
    return distinct_over(stored, ("language", "word"), start, end)
