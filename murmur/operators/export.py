"""Exports (B1-B3) and the CSV sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.functions.sites import resolve_portal

# Output column names of the exports (original names: valoda,
# datums, portāls, komentārs; written without a header).
EXPORT_COLUMNS = ("valoda", "datums", "portals", "komentars")


def export_predicted(predictions: DataFrame, articles: DataFrame) -> DataFrame:
    """B1: predictions ⋈ articles, portal from URL, four columns, ordered by time."""
    a = articles.select("article_id", "url")
    j = predictions.join(a, "article_id", "inner")
    return j.select(F.col("text_lang").alias("valoda"), F.col("comment_timestamp").alias("datums"),
                    resolve_portal("url").alias("portals"), F.col("text").alias("komentars")) \
            .orderBy("datums")


def export_raw(comments: DataFrame, articles: DataFrame, params=None) -> DataFrame:
    """B2: as B1 for raw comments; language 'other' falls back to the region (else NULL)."""
    a = articles.select("article_id", "url")
    j = comments.join(a, "article_id", "inner")
    lang = F.when(F.col("comment_lang") == "other",
                  F.when(F.col("region") == "rus", F.lit("ru")).when(F.col("region") == "lat", F.lit("lv"))) \
            .otherwise(F.col("comment_lang"))
    return j.select(lang.alias("valoda"), F.col("timestamp").alias("datums"),
                    resolve_portal("url").alias("portals"), F.col("comment_text").alias("komentars")) \
            .orderBy("datums")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV without header, every field quoted (QUOTE_NONNUMERIC on text columns)."""
    (df.write.mode("overwrite").option("header", False).option("quoteAll", True)
       .option("escape", '"').csv(path))
