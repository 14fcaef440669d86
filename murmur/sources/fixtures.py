"""Domain views over the driver's parquet tables (see FIXTURES.md §2).

The reference works on comments, articles, predictions and a lexicon.  The
test data has documents, customers, orders, line items and embeddings, so each
domain table is a projection of one base table.  The same expressions are
written in DuckDB SQL in ``murmur.plans.oracle_views`` for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.functions.sites import resolve_site
from murmur.functions.text import detect_language
from murmur.params import Params
from murmur.sources.tables import Tables

# Fixed values of the fixture domain (FIXTURES.md §2).
COMMENT_SITES = ("site_a", "site_b", "site_c", "site_d")   # doc_id % 5 = 0..3, 4 → NULL
COMMENT_REGIONS = ("rus", "lat")                           # doc_id % 3 = 0..1, 2 → NULL
COMMENT_DAY0 = "2024-01-10"
ARTICLE_DAY0 = "2024-01-01"
ARTICLE_HOSTS = ("www.delfi.lv", "tvnet.lv/delfi", "APOLLO.lv", "rus.tvnet.lv", "example.org")
PREDICTION_SITES = ("site_a", "site_b", "site_c")          # o_custkey % 3
PREDICTION_LANG = (("F", "lv"), ("O", "ru"), ("P", "other"))
LEXICON_ROWS = (
    ("de", "fr", 0.5), ("la", "es", 0.25), ("en", "en", 0.75), ("die", "de", 1.0),
    ("ing", "en", 0.25), ("that", "en", 0.5), ("und", "de", 0.75), ("Der", "de", 1.0),
    ("zzzz", "en", 1.0),
)
INTERVAL_MONTHS = (("ev1", "2024-01", "2024-02"), ("ev2", "2024-02", "2024-04"))
# Stop words keyed by prediction language (the texts mix en/fr/de/es prose).
STOPWORD_ROWS = (
    ("lv", "the"), ("lv", "and"), ("lv", "of"), ("lv", "is"), ("lv", "in"),
    ("ru", "und"), ("ru", "der"), ("ru", "die"), ("ru", "le"), ("ru", "la"), ("ru", "et"),
    ("ru", "el"), ("ru", "the"),
)
SAMPLE_CLUSTERS = 20
ORPHAN_SHIFT = 10_000_000

FIXTURE_PARAMS = Params(
    languages=("en", "fr", "de", "es"),
    sites=("site_a", "site_b", "site_c"),
    prediction_types=("ekman",),
    emotions=("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"),
)
PREDICTION_PARAMS = FIXTURE_PARAMS.with_(languages=("lv", "ru"))

LEXICON_SCHEMA = T.StructType([
    T.StructField("word", T.StringType(), False),
    T.StructField("language", T.StringType(), False),
    T.StructField("weight", T.DoubleType(), False),
])


def _pick(idx: Column, values) -> Column:
    """values[idx] for 0 <= idx < len(values), else NULL."""
    expr = None
    for i, v in enumerate(values):
        expr = F.when(idx == i, F.lit(v)) if expr is None else expr.when(idx == i, F.lit(v))
    return expr


def comments(t: Tables) -> DataFrame:
    """D1 comments from documents."""
    return comments_from(t.documents)


def comments_from(d: DataFrame) -> DataFrame:
    """D1 projection of a documents frame (batch or stream)."""
    return d.select(
        F.col("doc_id").alias("id"),
        (F.col("doc_id") % 97).alias("article_id"),
        _pick(F.col("doc_id") % 5, COMMENT_SITES).alias("website"),
        _pick(F.col("doc_id") % 3, COMMENT_REGIONS).alias("region"),
        F.date_add(F.lit(COMMENT_DAY0).cast("date"),
                   ((F.col("doc_id") * 37) % 149).cast("int")).alias("day"),
        F.col("text").alias("comment_text"),
        F.col("lang").alias("comment_lang"),
    ).withColumn("timestamp", F.col("day").cast("timestamp_ntz"))


def articles(t: Tables) -> DataFrame:
    """D2 articles from customers."""
    c = t.customer
    key = F.col("c_custkey")
    return c.select(
        key.alias("article_id"),
        F.col("c_name").alias("headline"),
        F.when(key % 21 == 1, F.lit(None).cast("date"))
         .otherwise(F.date_add(F.lit(ARTICLE_DAY0).cast("date"), (key % 100).cast("int")))
         .alias("pub_day"),
        F.concat(F.lit("https://"), _pick(key % 5, ARTICLE_HOSTS), F.lit("/"),
                 key.cast("string")).alias("url"),
    ).withColumn("website", resolve_site("url")) \
     .withColumn("headline_lang", detect_language("headline", F.lit(None).cast("string")))


def shifted_article(key: str) -> Column:
    """Article id of a customer key; every tenth names an article that is not stored."""
    return F.when(F.col(key) % 10 == 0, F.col(key) + ORPHAN_SHIFT).otherwise(F.col(key))


def predictions(t: Tables) -> DataFrame:
    """D3 predictions from orders.  Status P rows have no comment link."""
    o = t.orders
    key = F.col("o_orderkey")
    lang = None
    for status, code in PREDICTION_LANG:
        cond = F.col("o_orderstatus") == status
        lang = F.when(cond, F.lit(code)) if lang is None else lang.when(cond, F.lit(code))
    return o.select(
        key.alias("id"),
        F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("bigint")).otherwise(key).alias("comment_id"),
        shifted_article("o_custkey").alias("article_id"),
        F.col("o_orderdate").alias("comment_timestamp"),
        F.when(key % 50 == 0, F.lit(None).cast("string"))
         .when(key % 50 == 1, F.lit(""))
         .otherwise(F.col("o_orderpriority")).alias("ekman_prediction_emotion"),
        lang.alias("text_lang"),
        ((key % 1000).cast("double") / F.lit(1000.0)).alias("ekman_prediction_score"),
        _pick(F.col("o_custkey") % 3, PREDICTION_SITES).alias("website"),
        F.concat(F.lit("comment "), key.cast("string")).alias("text"),
    )


def scores(t: Tables) -> DataFrame:
    """Classifier output per row: ordered array<struct<label, score>>."""
    li = t.lineitem
    arr = F.array(
        F.struct(F.lit("a").alias("label"), F.col("l_discount").alias("score")),
        F.struct(F.lit("b").alias("label"), F.col("l_tax").alias("score")),
        F.struct(F.lit("c").alias("label"), (F.col("l_quantity") / F.lit(100.0)).alias("score")),
    )
    return li.select("l_orderkey", "l_linenumber", arr.alias("prediction"))


def vectors(t: Tables) -> DataFrame:
    """Article embeddings with a stored cluster; label 9 is noise (-1)."""
    e = t.embeddings
    return e.select(
        F.col("vec_id").alias("article_id"),
        F.col("embedding"),
        F.when(F.col("label") == 9, F.lit(-1)).otherwise(F.col("label")).alias("cluster"),
    )


def sample_frame(t: Tables, cluster: str | None = None, emotion: Column | str = "o_orderpriority") -> DataFrame:
    """Comments for the quota sample (N7-N9): cluster, emotion, confidence, length."""
    o = t.orders
    key = F.col("o_orderkey")
    return o.select(
        key.alias("id"),
        (F.col("o_custkey") % SAMPLE_CLUSTERS if cluster is None else F.col(cluster)).alias("cluster"),
        (F.col(emotion) if isinstance(emotion, str) else emotion).alias("emotion"),
        ((key % 101).cast("double") / F.lit(100.0)).alias("confidence"),
        ((key * 7) % 230).alias("length"),
        F.col("o_orderdate").alias("timestamp"),
    )


def literal_table(spark: SparkSession, rows, schema: T.StructType) -> DataFrame:
    """A small literal table built in the JVM (inline over one row, no Python at run time)."""
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, schema.fields)])
               for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def lexicon(spark: SparkSession) -> DataFrame:
    """D6 lexicon (literal, 9 rows): words as stored, weights multiples of 0.25."""
    return literal_table(spark, LEXICON_ROWS, LEXICON_SCHEMA)


def interval_months(spark: SparkSession) -> DataFrame:
    """J11 named event intervals as (event, start_month, end_month); 2 rows, overlapping."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("event", "start_month", "end_month")])
    return literal_table(spark, INTERVAL_MONTHS, schema)


def stopwords(spark: SparkSession) -> DataFrame:
    schema = T.StructType([T.StructField("language", T.StringType()), T.StructField("word", T.StringType())])
    return literal_table(spark, STOPWORD_ROWS, schema)
