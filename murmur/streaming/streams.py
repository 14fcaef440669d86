"""Structured Streaming: drop-folder ingest (S1), daily rollup (S2), insert-if-absent (S3).

The reference re-runs batch steps that skip finished work (file log, key
checks).  Here the stream checkpoint is the file log, and each operator can
run continuously or with ``availableNow`` (process what is there, then stop).
Sinks are parquet tables in the shared checkpoint folder, so results survive
executor loss and never pass through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.operators.ingest import first_per_key
from murmur.operators.lookups import insert_if_absent
from murmur.operators.lexicon import token_measures
from murmur.operators.rollups import aggressiveness_by_day
from murmur.operators.text import lemmatize
from murmur.params import Params

ROLLUP = ["date", "language", "website"]
SUMS = ["aggressive_word_count", "aggressive_word_weight_sum", "total_word_count"]


def _run(writer, available_now: bool = True, timeout_s: float | None = None, spark: SparkSession | None = None,
         state_partitions: int | None = None):
    """Start a stream.  ``state_partitions`` fixes the number of state stores of a
    stateful query; it is read once, when the query first starts, and kept in
    its checkpoint (the stream runs on a clone of the session's settings, so
    the session value is restored right after the start)."""
    w = writer.trigger(availableNow=True) if available_now else writer
    if spark is not None and state_partitions:
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
        try:
            q = w.start()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)
    else:
        q = w.start()
    if available_now:
        q.awaitTermination(timeout_s)
    return q


def parse_tsv_stream(lines: DataFrame, columns, long_columns=("article_id",)) -> DataFrame:
    """A1 rules on a streaming text frame (too-long lines dropped, short ones padded)."""
    parts = F.split(F.col("value"), "\t", -1)
    cols = []
    for i, c in enumerate(columns):
        v = F.when(F.size(parts) > i, F.element_at(parts, i + 1))
        v = F.when(v == "", F.lit(None).cast("string")).otherwise(v)
        cols.append((v.try_cast("long") if c in long_columns else v).alias(c))
    return (lines.where(F.col("value") != "")
            .where(F.size(parts) <= len(columns))
            .select(*cols, F.col("_metadata.file_path").alias("file_path")))


def stream_ingest(spark: SparkSession, drop_dir: str, columns, sink_dir: str, checkpoint_dir: str,
                  available_now: bool = True, max_files_per_trigger: int | None = None) -> DataFrame:
    """The file source picks up new drop files; the checkpoint is the import log."""
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    parsed = parse_tsv_stream(r.load(drop_dir), columns)
    w = (parsed.writeStream.format("parquet").option("checkpointLocation", checkpoint_dir)
         .option("path", sink_dir).outputMode("append"))
    _run(w, available_now)
    return spark.read.parquet(sink_dir)


def comments_of_stream(c: DataFrame, params: Params) -> DataFrame:
    return c.where(F.col("comment_lang").isin(list(params.languages)) & F.col("website").isin(list(params.sites)))


def rollup_comments_stream(c: DataFrame, lexicon: DataFrame, params: Params, lexicon_rows: int | None = None,
                           watermark: str = "2 days") -> DataFrame:
    """S2 in append mode: G1+G2 sums per (date, language, scope) as a stateful stream.

    Scopes come from exploding each row into its site and ``all`` (grouping
    sets are a batch feature).  The watermark bounds the state: a day is
    written once, after the watermark has passed it, and rows that arrive
    later than that are dropped.  ``stream_rollup`` loses no row.
    """
    c = comments_of_stream(c, params)
    c = c.withColumn("event_ts", F.col("day").cast("timestamp")).withWatermark("event_ts", watermark)
    lm = lemmatize(c, keep=("website", "day", "comment_lang", "event_ts"))
    src = lm.select(F.col("day").alias("date"), F.col("comment_lang").alias("language"), "website",
                    "event_ts", "lemmas", "lemma_count")
    m = token_measures(src, lexicon, ("date", "language", "website", "event_ts"), lexicon_rows)
    m = m.withColumn("website", F.explode(F.array(F.col("website"), F.lit(params.all_scope))))
    return (m.groupBy("event_ts", *ROLLUP)
            .agg(F.sum("m_hit").alias("aggressive_word_count"),
                 F.sum("m_weight").alias("aggressive_word_weight_sum"),
                 F.sum("m_total").alias("total_word_count"))
            .drop("event_ts"))


def run_append_rollup(agg: DataFrame, sink_dir: str, checkpoint_dir: str, available_now: bool = True,
                      state_partitions: int | None = None):
    """Start the append-mode rollup into a parquet sink."""
    w = (agg.writeStream.outputMode("append").format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint_dir))
    return _run(w, available_now, spark=agg.sparkSession, state_partitions=state_partitions)


def add_rollup_batch(comments: DataFrame, batch_id: int, lexicon: DataFrame, params: Params, sink_dir: str,
                     lexicon_rows: int | None = None) -> None:
    """Write the partial sums of one micro-batch under its id; a replayed batch replaces its own."""
    lm = lemmatize(comments, keep=("website", "day", "comment_lang"))
    part = aggressiveness_by_day(lm, lexicon, params, lexicon_rows).select(*ROLLUP, *SUMS)
    part.write.mode("overwrite").parquet(f"{sink_dir}/batch_id={batch_id}")


def stream_rollup(comments: DataFrame, lexicon: DataFrame, params: Params, sink_dir: str, checkpoint_dir: str,
                  lexicon_rows: int | None = None, available_now: bool = True) -> DataFrame:
    """Daily rollup of a streaming comments frame; returns the rollup of all batches so far.

    Every micro-batch adds its partial sums, so a day stays right however late
    its rows arrive, without state and without a watermark.
    """
    spark = comments.sparkSession

    def add(batch: DataFrame, batch_id: int) -> None:
        add_rollup_batch(batch, batch_id, lexicon, params, sink_dir, lexicon_rows)

    _run(comments.writeStream.option("checkpointLocation", checkpoint_dir).foreachBatch(add), available_now)
    return read_rollup_batches(spark, sink_dir)


def read_rollup_batches(spark: SparkSession, sink_dir: str) -> DataFrame:
    """The rollup: partial sums of all batches added up, ratios computed."""
    total = _batches(spark, sink_dir).groupBy(*ROLLUP).agg(*[F.sum(c).alias(c) for c in SUMS])
    t = F.col("total_word_count")
    return (total.withColumn("aggressiveness_ratio",
                             F.when(t > 0, F.col("aggressive_word_count") / t).otherwise(F.lit(0.0)))
            .withColumn("weighted_aggressiveness_ratio",
                        F.when(t > 0, F.col("aggressive_word_weight_sum") / t).otherwise(F.lit(0.0))))


def start_target(rows: DataFrame, target_dir: str) -> None:
    """Write the first rows of a table that ``stream_insert_if_absent`` adds to."""
    rows.write.mode("overwrite").parquet(f"{target_dir}/batch_id=-1")


def stream_insert_if_absent(spark: SparkSession, drop_dir: str, columns, target_dir: str, checkpoint_dir: str,
                            key: str = "article_id", available_now: bool = True,
                            max_files_per_trigger: int | None = None) -> DataFrame:
    """S3: per micro-batch, the first row per key in file order, minus keys already in
    the target (existing row wins); returns the rows the stream has added.

    The target is partitioned by batch id.  A batch is held against the rows
    of all other batches and replaces its own partition, so a batch that is
    replayed after a failure changes nothing.
    """
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = r.load(drop_dir).select("value", F.col("_metadata.file_path").alias("file_path"),
                                    F.col("_metadata.file_block_start").alias("block_start"))

    def insert(batch: DataFrame, batch_id: int) -> None:
        insert_batch(batch, batch_id, columns, target_dir, key)

    _run(lines.writeStream.option("checkpointLocation", checkpoint_dir).foreachBatch(insert), available_now)
    return spark.read.parquet(target_dir).where("batch_id >= 0").drop("batch_id")


def insert_batch(batch: DataFrame, batch_id: int, columns, target_dir: str, key: str = "article_id") -> None:
    """One micro-batch of S3."""
    b = batch.withColumn("row_pos", F.monotonically_increasing_id())
    parts = F.split(F.col("value"), "\t", -1)
    cols = []
    for i, c in enumerate(columns):
        v = F.when(F.size(parts) > i, F.element_at(parts, i + 1))
        v = F.when(v == "", F.lit(None).cast("string")).otherwise(v)
        cols.append((v.try_cast("long") if c == key else v).alias(c))
    parsed = (b.where((F.col("value") != "") & (F.size(parts) <= len(columns)))
              .select(*cols, "file_path", "block_start", "row_pos"))
    first = first_per_key(parsed.where(F.col(key).isNotNull()), key).drop("file_path", "block_start", "row_pos")
    target = batch.sparkSession.read.parquet(target_dir)
    others = target.where(F.col("batch_id") != batch_id)
    new = insert_if_absent(first, others, key).select(*[c for c in target.columns if c != "batch_id"])
    new.write.mode("overwrite").parquet(f"{target_dir}/batch_id={batch_id}")


# ---------------------------------------------------------------- event-time windows, compaction, repeats

def windowed_hits(c: DataFrame, lexicon: DataFrame, params: Params, size: str = "1 day", slide: str | None = None, late: str = "2 days",
                  lexicon_rows: int | None = None) -> DataFrame:
    """S2 over event-time windows: sums per (window, language, scope) of a streaming comments frame, for append mode.

    A window is written once, when the watermark (``late`` behind the newest
    event time of the batches before) has passed its end; a row that is late
    but whose window is still open counts, one whose window is closed is dropped.
    State is bounded by the windows that are open.
    """
    c = comments_of_stream(c, params).withColumn("event_ts", F.col("timestamp").cast("timestamp")).withWatermark("event_ts", late)
    lm = lemmatize(c, keep=("website", "comment_lang", "event_ts"))
    src = lm.select(F.col("comment_lang").alias("language"), "website", "event_ts", "lemmas", "lemma_count")
    m = token_measures(src, lexicon, ("language", "website", "event_ts"), lexicon_rows)
    m = m.withColumn("website", F.explode(F.array(F.col("website"), F.lit(params.all_scope))))
    return (m.groupBy(F.window("event_ts", size, slide or size).alias("window"), "language", "website")
            .agg(F.sum("m_hit").alias("aggressive_word_count"), F.sum("m_weight").alias("aggressive_word_weight_sum"),
                 F.sum("m_total").alias("total_word_count"))
            .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "language", "website", *SUMS))


def distinct_stream(rows: DataFrame, key: str, event_time: str, late: str) -> DataFrame:
    """A stream without repeats of ``key`` that arrive within ``late`` of each other, whatever batches they come in; the state forgets older keys."""
    return rows.withWatermark(event_time, late).dropDuplicatesWithinWatermark([key])


def run_append(rows: DataFrame, sink_dir: str, checkpoint_dir: str, available_now: bool = True, state_partitions: int | None = None) -> DataFrame:
    """Run a stream in append mode into a parquet table and return the table."""
    run_append_rollup(rows, sink_dir, checkpoint_dir, available_now, state_partitions)
    return rows.sparkSession.read.schema(rows.schema).parquet(sink_dir)


def compact_batches(spark: SparkSession, sink_dir: str) -> int | None:
    """Add the folders of all batches but the newest up into one; returns the last batch it holds.

    The newest batch may still be replayed and stays a folder of its own.  The
    sums are written beside the batches, under the number of the last one they
    hold; readers take the highest finished number and the batches after it, so
    a compaction that fails half-way changes nothing, and folders up to that
    number can be removed at any later time.
    """
    done = compacted_upto(spark, sink_dir)
    ids = spark.read.parquet(sink_dir).where(F.col("batch_id") > done)
    upto = ids.agg(F.max("batch_id")).first()[0]
    if upto is None or upto - 1 <= done:
        return None
    rows = _batches(spark, sink_dir).where(F.col("batch_id") < upto)
    rows.groupBy(*ROLLUP).agg(*[F.sum(c).alias(c) for c in SUMS]).write.mode("overwrite").parquet(f"{sink_dir}-compacted/upto={upto - 1}")
    return upto - 1


def compacted_upto(spark: SparkSession, sink_dir: str) -> int:
    """The last batch of the newest finished compaction, -1 without one."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{sink_dir}-compacted")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return -1
    done = [f.getPath() for f in fs.listStatus(root)]
    return max([int(p.getName().split("=")[1]) for p in done if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))], default=-1)


def _batches(spark: SparkSession, sink_dir: str) -> DataFrame:
    """(batch_id, rollup keys, sums): the newest compaction as one batch, and the batches after it."""
    upto = compacted_upto(spark, sink_dir)
    rows = spark.read.parquet(sink_dir).where(F.col("batch_id") > upto).select("batch_id", *ROLLUP, *SUMS)
    if upto < 0:
        return rows
    old = spark.read.parquet(f"{sink_dir}-compacted/upto={upto}")
    return rows.unionByName(old.select(F.lit(upto).alias("batch_id"), *ROLLUP, *SUMS))
