"""Research jobs: article clusters and quota sampling.

Quota sampling is written without the reference's loop over clusters:
cell caps, a running sum over the (hash-shuffled) cluster order per emotion,
and per-stratum quotas.  Rows are ranked by a deterministic hash; the ranks
are first cut to a literal bound so Spark runs a partial top-k before the
shuffle (WindowGroupLimit), which keeps a hot cluster from landing whole in
one task.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions.select import confidence_bucket, length_bucket, mix_hash
from murmur.operators.joins import broadcast_checked
from murmur.session import scratch_path

MAX_PER_CELL = 6          # fixed value: most comments per (cluster, emotion)
ROW_SEED, CLUSTER_SEED = 42, 7
#: Cluster means that are broadcast at most; beyond that they are joined by shuffle.
MOST_CLUSTERS = 100_000


def articles_min_comments(articles: DataFrame, predictions: DataFrame, vectors: DataFrame,
                          language: str, since, min_comments: int = 10) -> DataFrame:
    """Articles since a date, one language, with an embedding and ≥ n same-language predictions."""
    counts = (predictions.where(F.col("text_lang") == language)
              .groupBy("article_id").agg(F.count(F.lit(1)).alias("n_comments"))
              .where(F.col("n_comments") >= min_comments))
    a = articles.where((F.col("pub_day") >= F.lit(str(since)).cast("date"))
                       & (F.col("headline_lang") == language))
    a = a.join(vectors.where(F.col("embedding").isNotNull()).select("article_id"), "article_id", "left_semi")
    return a.join(counts, "article_id").select("article_id", "headline", "n_comments")


def assign_clusters(vectors: DataFrame, k: int = 9, seed: int = 42, max_iter: int = 20) -> DataFrame:
    """Cluster ids from embeddings with pyspark.ml KMeans (distributed, iterative)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    feats = vectors.select("article_id", array_to_vector("embedding").alias("features"))
    feats.persist(StorageLevel.MEMORY_AND_DISK)          # every iteration reads it
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features",
                   predictionCol="cluster").fit(feats)
    feats.unpersist()
    return model.transform(feats).select("article_id", F.col("cluster").cast("int").alias("cluster"))


def attach_clusters(comments: DataFrame, clusters: DataFrame, noise: int = -1) -> DataFrame:
    """Cluster looked up by article_id; unmatched and noise rows dropped."""
    c = clusters.select("article_id", F.col("cluster").alias("cluster_id"))
    return comments.join(c, "article_id", "inner").where(F.col("cluster_id") != noise)


def cluster_sizes(clustered: DataFrame, noise: int = -1) -> DataFrame:
    """Cluster sizes, noise removed."""
    return clustered.where(F.col("cluster") != noise).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def cluster_samples(clustered: DataFrame, n: int = 5, key: str = "article_id", noise: int = -1) -> DataFrame:
    """Up to ``n`` rows per cluster in hash order (partial top-k before the shuffle)."""
    w = Window.partitionBy("cluster").orderBy(mix_hash(key, ROW_SEED), key)
    return (clustered.where(F.col("cluster") != noise).withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= n))


def core_boundary(clustered: DataFrame, quantile: float = 0.25, noise: int = -1,
                  digits: int = 9) -> DataFrame:
    """Distance to the cluster mean over all dimensions; core when ≤ the cluster's
    25th percentile (exact, linear interpolation).  Distances are rounded to
    ``digits`` so that the cut does not depend on summation order.

    Two reads of the vectors: one for the means, a vector aggregate with
    map-side partial sums (``Summarizer``) and one row per cluster, one for the
    distances, computed in the row and written once; the quantile only reads
    (cluster, distance) back.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    spark = clustered.sparkSession
    v = clustered.where(F.col("cluster") != noise).select("article_id", "cluster", "embedding")
    mean = v.groupBy("cluster").agg(Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>"))).alias("m")) \
            .select("cluster", vector_to_array("m").alias("mean"))
    gap = F.zip_with("embedding", "mean", lambda x, c: (x.cast("double") - c) ** 2)
    d = v.join(broadcast_checked(mean, max_rows=MOST_CLUSTERS), "cluster") \
         .select("cluster", "article_id", F.round(F.sqrt(F.aggregate(gap, F.lit(0.0), lambda a, x: a + x)), digits).alias("distance"))
    path = scratch_path(spark, "distances")
    d.write.parquet(path)
    d = spark.read.schema(d.schema).parquet(path)
    cut = exact_quantile(d, "cluster", "distance", quantile).withColumnRenamed("value", "threshold")
    return (d.join(cut, "cluster")
            .withColumn("point_type", F.when(F.col("distance") <= F.col("threshold"), F.lit("core"))
                        .otherwise(F.lit("boundary"))))


def exact_quantile(df: DataFrame, key: str, value: str, quantile: float, slots: int = 1024) -> DataFrame:
    """(key, value): linearly interpolated quantile per key without gathering a key's rows.

    Rows are counted in ``slots`` equal slots between the key's extremes; only
    rows of the one or two slots that hold the wanted ranks are numbered.
    """
    span = df.groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    pos = F.lit(quantile) * (F.col("_n") - 1)
    span = span.withColumn("_r0", F.floor(pos)).withColumn("_part", pos - F.floor(pos)).withColumn("_r1", F.least(F.col("_r0") + 1, F.col("_n") - 1))
    slot = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * slots)).otherwise(F.lit(0))
    rows = df.select(key, value).join(span, key).withColumn("_slot", slot)
    counts = rows.groupBy(key, "_slot").agg(F.count(F.lit(1)).alias("_m"), F.max("_r0").alias("_r0"), F.max("_r1").alias("_r1"))
    run = Window.partitionBy(key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_before", F.sum("_m").over(run) - F.col("_m"))
    held = counts.where(((F.col("_r0") >= F.col("_before")) & (F.col("_r0") < F.col("_before") + F.col("_m")))
                        | ((F.col("_r1") >= F.col("_before")) & (F.col("_r1") < F.col("_before") + F.col("_m")))).select(key, "_slot", "_before")
    near = rows.join(held, [key, "_slot"])
    rank = F.row_number().over(Window.partitionBy(key, "_slot").orderBy(value)) - 1 + F.col("_before")
    near = near.withColumn("_rank", rank)
    low = F.max(F.when(F.col("_rank") == F.col("_r0"), F.col(value)))
    high = F.max(F.when(F.col("_rank") == F.col("_r1"), F.col(value)))
    return near.groupBy(key).agg((low + (high - low) * F.max("_part")).alias("value"))


def with_buckets(df: DataFrame) -> DataFrame:
    """Confidence and length buckets (right-closed; outside → NULL)."""
    return df.withColumn("confidence_cat", confidence_bucket("confidence")) \
             .withColumn("length_cat", length_bucket("length"))


STRATUM = ("cluster", "emotion", "confidence_cat", "length_cat")


def non_neutral(comments: DataFrame, neutral: str = "neutral") -> DataFrame:
    """Comments whose emotion is known and not the neutral one."""
    return comments.where(F.col("emotion") != neutral)


def _strata(comments: DataFrame, exclude_emotion: str | None) -> DataFrame:
    """Rows per cell and bucket pair: the only aggregate over the comments, shared by the plan and the sample (one exchange, reused)."""
    c = comments if exclude_emotion is None else non_neutral(comments, exclude_emotion)
    return c.groupBy(*STRATUM).agg(F.count(F.lit(1)).alias("_ns"))


def quota_plan(comments: DataFrame, total_samples: int = 2000, max_per_cell: int = MAX_PER_CELL,
               exclude_emotion: str | None = "neutral") -> DataFrame:
    """N8 plan: rows taken per (cluster, emotion) cell.

    target = total // #emotions; clusters are walked in hash order; a cell
    takes min(cap, target − caps taken by earlier clusters), cap = min(n, 6).
    """
    strata = _strata(comments, exclude_emotion)
    cells = strata.groupBy("cluster", "emotion").agg(F.sum("_ns").alias("available"))
    n_em = strata.where(F.col("_ns") > 0).agg(F.count_distinct("emotion")).scalar()    # scalar subquery, no join
    cells = cells.withColumn("target", F.floor(F.lit(total_samples) / n_em).cast("long"))
    cells = cells.withColumn("cap", F.least(F.col("available"), F.lit(max_per_cell)).cast("long"))
    w = (Window.partitionBy("emotion").orderBy(mix_hash("cluster", CLUSTER_SEED), "cluster")
         .rowsBetween(Window.unboundedPreceding, -1))
    prev = F.coalesce(F.sum("cap").over(w), F.lit(0))
    return cells.withColumn("take", F.greatest(F.lit(0), F.least(F.col("cap"), F.col("target") - prev))
                            .cast("long"))


def quota_sample(comments: DataFrame, plan: DataFrame, max_per_cell: int = MAX_PER_CELL, exclude_emotion: str | None = "neutral") -> DataFrame:
    """N8 sample: per cell, proportional ceil quotas over non-NULL strata, then the
    exact take: quota rows first (hash order), topped up by the other rows (T15).

    Two reads of the comments, one for the strata sizes and one for the rows.
    Candidates come from one window over (cell, confidence bucket, length
    bucket) — NULL buckets form their own group — cut at ``max_per_cell``, the
    most a cell takes: every row that can be picked has at most take-1 picked
    rows ahead of it in its group, so the cut loses nothing, and as a literal
    Spark applies it as a partial top-k before the shuffle.
    """
    cell = ["cluster", "emotion"]
    full = F.col("confidence_cat").isNotNull() & F.col("length_cat").isNotNull()
    strata = _strata(comments, exclude_emotion).withColumn("_strat", full) \
        .withColumn("_nt", F.sum(F.when(F.col("_strat"), F.col("_ns"))).over(Window.partitionBy(*cell))) \
        .join(plan.where(F.col("take") > 0).select(*cell, "available", "take"), cell)
    quota = F.when(F.col("_strat"), F.least(F.ceil(F.col("take") * F.col("_ns") / F.col("_nt")), F.col("_ns"))).otherwise(F.lit(0))
    quota = F.when(F.col("available") <= F.col("take"), F.col("_ns")).otherwise(quota)
    strata = strata.select(*[F.col(c).alias(f"_{c}") for c in STRATUM], quota.alias("_quota"), F.col("take").alias("_take"))
    rows = comments if exclude_emotion is None else non_neutral(comments, exclude_emotion)
    rows = rows.withColumn("_h", mix_hash("id", ROW_SEED))
    wg = Window.partitionBy(*STRATUM).orderBy("_h", "id")
    cand = rows.withColumn("_rs", F.row_number().over(wg)).where(F.col("_rs") <= F.lit(max_per_cell))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in STRATUM]
    cand = cand.join(strata, same).withColumn("_q", F.col("_rs") <= F.col("_quota"))
    wf = Window.partitionBy(*cell).orderBy(F.desc("_q"), "_h", "id")
    picked = cand.withColumn("_r", F.row_number().over(wf)).where(F.col("_r") <= F.col("_take"))
    return picked.select(*comments.columns)


def sample_daily_counts(sample: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Per day and emotion, rows in the sample."""
    return sample.groupBy(F.col(ts).cast("date").alias("day"), "emotion").agg(F.count(F.lit(1)).alias("n"))
