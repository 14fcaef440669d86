"""Lookups, paging and pending-work joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.params import Params


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table (metadata-only scans where the format allows)."""
    parts = [df.agg(F.lit(name).alias("tbl"), F.count(F.lit(1)).alias("n")) for name, df in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def exists(df: DataFrame, key: str, value) -> DataFrame:
    """P1 existence check as a one-row frame (limit 1 stops the scan early)."""
    return df.where(F.col(key) == F.lit(value)).select(key).limit(1)


def page(df: DataFrame, offset: int = 0, size: int = 100, order: str = "id") -> DataFrame:
    """offset/limit page in key order (T3: the reference leaves order undefined).

    Planned as a top-K (TakeOrderedAndProject): each task keeps offset+size rows.
    """
    return df.orderBy(order).offset(offset).limit(size)


def keyset_page(df: DataFrame, last_key, size: int = 100, key: str = "id") -> DataFrame:
    """Rows after ``last_key`` in key order; the predicate prunes row groups."""
    return df.where(F.col(key) > F.lit(last_key)).orderBy(key).limit(size)


def predictions_with_comment(predictions: DataFrame, comments: DataFrame) -> DataFrame:
    """Predictions with the raw comment beside it (left join, linked rows only)."""
    c = comments.select(F.col("id").alias("comment_id"), F.col("comment_text").alias("raw_comment_text"),
                        F.col("comment_lang").alias("raw_comment_lang"))
    return predictions.where(F.col("comment_id").isNotNull()).join(c, "comment_id", "left")


def pending_lemmatize(comments: DataFrame, lemmatized: DataFrame, params: Params) -> DataFrame:
    """Comments of listed languages without a lemmatized row (anti-join)."""
    done = lemmatized.select(F.col("comment_id").alias("id"))
    return comments.where(F.col("comment_lang").isin(list(params.languages))).join(done, "id", "left_anti")


def pending_predict(comments: DataFrame, articles: DataFrame, predictions: DataFrame, params: Params,
                    lang: str | None = None, website: str | None = None) -> DataFrame:
    """Language match ∧ article exists (semi) ∧ no prediction (anti) ∧ optional site."""
    c = comments.where(F.col("comment_lang") == lang) if lang else \
        comments.where(F.col("comment_lang").isin(list(params.languages)))
    if website:
        c = c.where(F.col("website") == website)
    c = c.join(articles.select("article_id"), "article_id", "left_semi")
    done = predictions.where(F.col("comment_id").isNotNull()).select(F.col("comment_id").alias("id"))
    return c.join(done, "id", "left_anti")


def backfill_site(rows: DataFrame, articles: DataFrame, key: str = "article_id") -> DataFrame:
    """Site from the article (resolved from its URL); orphans keep their value."""
    a = articles.select(F.col(key), F.col("website").alias("_site"))
    return rows.join(a, key, "left").withColumn("website", F.coalesce("_site", "website")).drop("_site")


def insert_if_absent(batch: DataFrame, target: DataFrame, key: str = "article_id") -> DataFrame:
    """Rows of ``batch`` whose key is not in ``target`` (existing row wins).

    Only the target's key column is read; AQE broadcasts or shuffles the keys
    by their measured size.
    """
    return batch.join(target.select(key), key, "left_anti")
