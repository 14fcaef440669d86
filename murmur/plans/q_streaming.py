"""Queries: Structured Streaming operators (S1-S3) run with availableNow."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.plans import q_ingest as qi
from murmur.plans import q_rollups as qr
from murmur.plans.oracle_views import with_views
from murmur.plans.registry import Ctx, flat, register
from murmur.session import scratch_path
from murmur.sources import files as fl
from murmur.sources import fixtures as fx
from murmur.streaming import streams as st


@register("stream_ingest", """
SELECT doc_id % 97 AS article_id, CASE doc_id % 3 WHEN 0 THEN 'rus' WHEN 1 THEN 'lat' END AS region,
       CAST(length(nullif(regexp_replace(text, '[\\t\\r\\n]', ' ', 'g'), '')) AS INTEGER) AS n_chars
FROM documents""")
def q_stream_ingest(spark, sf_dir):
    """A file-source stream over the comment drop folder into a parquet table."""
    ctx = Ctx(spark, sf_dir)
    root = scratch_path(spark, "stream-ingest")
    drop = qi.comment_drop(ctx, f"{root}/drops")
    out = st.stream_ingest(spark, drop, fl.COMMENT_COLUMNS, f"{root}/sink", f"{root}/checkpoint")
    return out.select("article_id", "region", F.length("comment_text").alias("n_chars"))


@register("stream_aggr_by_day", qr.AGGR_BY_DAY_SQL)
def q_stream_aggr_by_day(spark, sf_dir):
    """The documents arrive in three drops with mixed days; the streamed rollup equals ``aggr_by_day``."""
    ctx = Ctx(spark, sf_dir)
    root = scratch_path(spark, "stream-rollup")
    docs = ctx.t.documents
    for k in range(3):
        docs.where(F.col("doc_id") % 3 == k).write.parquet(f"{root}/drops/{k}")
    stream = (spark.readStream.schema(docs.schema).option("recursiveFileLookup", "true")
              .option("maxFilesPerTrigger", max(1, spark.sparkContext.defaultParallelism // 2)).parquet(f"{root}/drops"))
    out = st.stream_rollup(fx.comments_from(stream), ctx.lexicon, ctx.params, f"{root}/sink", f"{root}/checkpoint",
                           lexicon_rows=ctx.lexicon_rows)
    return flat(out.select("date", "language", "website", "aggressive_word_count", "aggressive_word_weight_sum",
                           "total_word_count", "aggressiveness_ratio", "weighted_aggressiveness_ratio"))


@register("stream_insert_if_absent", with_views(("fx_articles",), qi.ART_SQL, """
SELECT article_id, region, headline, pub_timestamp, url FROM b
WHERE article_id NOT IN (SELECT article_id FROM fx_articles)"""))
def q_stream_insert_if_absent(spark, sf_dir):
    """S3: article drops streamed into a target table that already holds the articles."""
    ctx = Ctx(spark, sf_dir)
    root = scratch_path(spark, "stream-insert")
    drop = qi.article_drop(ctx, f"{root}/drops")
    target = f"{root}/target"
    st.start_target(ctx.articles.select(F.lit(None).cast("string").alias("region"), "article_id", "headline",
                                        F.col("pub_day").cast("string").alias("pub_timestamp"), "url"), target)
    out = st.stream_insert_if_absent(spark, drop, fl.ARTICLE_COLUMNS, target, f"{root}/checkpoint")
    return out.select("article_id", "region", "headline", "pub_timestamp", "url")


WINDOWED = """
SELECT strftime(date, '%Y-%m-%d') AS window_start, language, website, aggressive_word_count, aggressive_word_weight_sum, total_word_count
FROM daily_r WHERE date + INTERVAL 1 DAY <= (SELECT max(day) FROM fx_comments WHERE comment_lang IN ({langs}) AND website IN ({sites})) - INTERVAL 2 DAY"""


@register("stream_hits_by_window", with_views((*qr.DAILY_VIEWS, "fx_comments"), qr.AGGR_BY_DAY_CTES, WINDOWED.format(langs=qr.LANGS, sites=qr.SITES)))
def q_stream_hits_by_window(spark, sf_dir):
    """S2 with event-time windows and a watermark: the windows that are closed once all documents have arrived."""
    ctx = Ctx(spark, sf_dir)
    root = scratch_path(spark, "stream-windows")
    docs = ctx.t.documents
    docs.write.parquet(f"{root}/drop")
    stream = spark.readStream.schema(docs.schema).parquet(f"{root}/drop")
    out = st.run_append(st.windowed_hits(fx.comments_from(stream), ctx.lexicon, ctx.params, lexicon_rows=ctx.lexicon_rows), f"{root}/sink", f"{root}/checkpoint")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "language", "website", *st.SUMS)


@register("stream_distinct_comments", with_views(("fx_comments",), "", "SELECT DISTINCT id, article_id, strftime(day, '%Y-%m-%d') AS day FROM fx_comments"))
def q_stream_distinct_comments(spark, sf_dir):
    """S3's repeats across batches: every comment is dropped twice, in different batches."""
    ctx = Ctx(spark, sf_dir)
    root = scratch_path(spark, "stream-distinct")
    docs = ctx.t.documents
    for k in range(2):
        docs.write.parquet(f"{root}/drops/{k}")
    stream = spark.readStream.schema(docs.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{root}/drops")
    rows = fx.comments_from(stream).select("id", "article_id", F.col("timestamp").cast("timestamp").alias("at"))
    out = st.run_append(st.distinct_stream(rows, "id", "at", "365 days"), f"{root}/sink", f"{root}/checkpoint")
    return out.select("id", "article_id", F.date_format("at", "yyyy-MM-dd").alias("day"))


@register("stream_aggr_compacted", qr.AGGR_BY_DAY_SQL)
def q_stream_aggr_compacted(spark, sf_dir):
    """The streamed rollup after its batch folders were compacted."""
    ctx = Ctx(spark, sf_dir)
    root = scratch_path(spark, "stream-compact")
    docs = ctx.t.documents
    for k in range(3):
        docs.where(F.col("doc_id") % 3 == k).write.parquet(f"{root}/drops/{k}")
    # about a drop a batch, in as many files as the input is read in
    per = max(1, len(spark.read.schema(docs.schema).option("recursiveFileLookup", "true").parquet(f"{root}/drops").inputFiles()) // 3)
    stream = spark.readStream.schema(docs.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per).parquet(f"{root}/drops")
    st.stream_rollup(fx.comments_from(stream), ctx.lexicon, ctx.params, f"{root}/sink", f"{root}/checkpoint", lexicon_rows=ctx.lexicon_rows)
    st.compact_batches(spark, f"{root}/sink")
    out = st.read_rollup_batches(spark, f"{root}/sink")
    return flat(out.select("date", "language", "website", *st.SUMS, "aggressiveness_ratio", "weighted_aggressiveness_ratio"))
