"""Queries: article clusters and quota sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.operators import density as dn
from murmur.operators import research as rs
from murmur.plans.oracle_views import with_views
from murmur.plans.registry import Ctx, flat, register
from murmur.sources import fixtures as fx

# The operator default is 10 (the reference); fixture articles have at most ~9 same-language
# predictions, so the fixture query uses 5 to return rows at all.
LANGUAGE, SINCE, MIN_COMMENTS = "lv", "2024-01-01", 5
TOTAL_SAMPLES = 300


def mix(col: str, seed: int) -> str:
    return f"(((({col}) % 2147483647) + {seed}) * 2654435761) % 4294967296"


@register("articles_min_comments", with_views(("fx_articles", "fx_predictions", "fx_vectors"), f"""
cnt AS (SELECT article_id, count(*) AS n_comments FROM fx_predictions WHERE text_lang = '{LANGUAGE}'
        GROUP BY article_id HAVING count(*) >= {MIN_COMMENTS})""", f"""
SELECT a.article_id, a.headline, CAST(c.n_comments AS BIGINT) AS n_comments
FROM fx_articles a JOIN cnt c USING (article_id)
WHERE a.pub_day >= DATE '{SINCE}' AND a.headline_lang = '{LANGUAGE}'
  AND a.article_id IN (SELECT article_id FROM fx_vectors WHERE embedding IS NOT NULL)"""))
def q_articles_min_comments(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    return rs.articles_min_comments(ctx.articles, ctx.predictions, fx.vectors(ctx.t), LANGUAGE, SINCE,
                                    MIN_COMMENTS)


@register("cluster_assign")
def q_cluster_assign(spark, sf_dir):
    """N2 (iterative, no oracle): KMeans cluster per article embedding."""
    return rs.assign_clusters(fx.vectors(Ctx(spark, sf_dir).t), k=9)


@register("cluster_sizes", with_views(("fx_vectors",), "", """
SELECT cluster, CAST(count(*) AS BIGINT) AS n FROM fx_vectors WHERE cluster <> -1 GROUP BY cluster"""))
def q_cluster_sizes(spark, sf_dir):
    return rs.cluster_sizes(fx.vectors(Ctx(spark, sf_dir).t))


@register("cluster_samples", with_views(("fx_vectors",), "", f"""
SELECT cluster, article_id, rank FROM (
  SELECT cluster, article_id,
         CAST(row_number() OVER (PARTITION BY cluster ORDER BY {mix('article_id', 42)}, article_id) AS INTEGER)
           AS rank
  FROM fx_vectors WHERE cluster <> -1) WHERE rank <= 5"""))
def q_cluster_samples(spark, sf_dir):
    return rs.cluster_samples(fx.vectors(Ctx(spark, sf_dir).t), 5).select("cluster", "article_id", "rank")


@register("cluster_core_boundary", with_views(("fx_vectors",), """
v AS (SELECT article_id, cluster, unnest(embedding) AS x, unnest(generate_series(0, len(embedding) - 1)) AS pos
      FROM fx_vectors WHERE cluster <> -1),
c AS (SELECT cluster, pos, avg(CAST(x AS DOUBLE)) AS c FROM v GROUP BY ALL),
d AS (SELECT v.cluster, v.article_id, round(sqrt(sum((CAST(v.x AS DOUBLE) - c.c) ^ 2)), 9) AS distance
      FROM v JOIN c USING (cluster, pos) GROUP BY ALL),
t AS (SELECT cluster, quantile_cont(distance, 0.25) AS threshold FROM d GROUP BY cluster)""", """
SELECT d.cluster, d.article_id, d.distance, round(t.threshold, 9) AS threshold,
       CASE WHEN d.distance <= t.threshold THEN 'core' ELSE 'boundary' END AS point_type
FROM d JOIN t USING (cluster)"""))
def q_cluster_core_boundary(spark, sf_dir):
    out = rs.core_boundary(fx.vectors(Ctx(spark, sf_dir).t))
    return out.select("cluster", "article_id", "distance", F.round("threshold", 9).alias("threshold"),
                      "point_type")


BUCKETS = """
b AS (SELECT *,
             CASE WHEN confidence > 0 AND confidence <= 0.33 THEN 'low'
                  WHEN confidence > 0.33 AND confidence <= 0.66 THEN 'medium'
                  WHEN confidence > 0.66 AND confidence <= 1 THEN 'high' END AS confidence_cat,
             CASE WHEN length > 0 AND length <= 20 THEN 'short'
                  WHEN length > 20 AND length <= 50 THEN 'medium'
                  WHEN length > 50 AND length <= 100 THEN 'long'
                  WHEN length > 100 AND length <= 200 THEN 'very_long' END AS length_cat
      FROM fx_sample)"""


@register("bucketize", with_views(("fx_sample",), BUCKETS, "SELECT id, confidence_cat, length_cat FROM b"))
def q_bucketize(spark, sf_dir):
    return rs.with_buckets(fx.sample_frame(Ctx(spark, sf_dir).t)).select("id", "confidence_cat", "length_cat")


PLAN = BUCKETS + f""",
s AS (SELECT * FROM b WHERE emotion <> 'neutral'),
cells AS (SELECT cluster, emotion, count(*) AS available FROM s GROUP BY ALL),
ne AS (SELECT count(DISTINCT emotion) AS n FROM s),
p AS (SELECT cells.*, CAST(floor({TOTAL_SAMPLES} / ne.n) AS BIGINT) AS target,
             CAST(least(available, 6) AS BIGINT) AS cap FROM cells, ne),
plan AS (SELECT cluster, emotion, CAST(available AS BIGINT) AS available, target, cap,
                CAST(greatest(0, least(cap, target - coalesce(sum(cap) OVER (PARTITION BY emotion
                     ORDER BY {mix('cluster', 7)}, cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))
                     AS BIGINT) AS take
         FROM p)"""
SAMPLE = PLAN + f""",
r AS (SELECT s.*, plan.available, plan.take, {mix('id', 42)} AS h,
             (confidence_cat IS NOT NULL AND length_cat IS NOT NULL) AS strat
      FROM s JOIN plan USING (cluster, emotion) WHERE plan.take > 0),
rs AS (SELECT id, row_number() OVER w AS rs, count(*) OVER w AS ns FROM r WHERE strat
       WINDOW w AS (PARTITION BY cluster, emotion, confidence_cat, length_cat ORDER BY h, id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
nt AS (SELECT cluster, emotion, count(*) AS nt FROM r WHERE strat GROUP BY ALL),
q AS (SELECT r.*, CASE WHEN r.available <= r.take THEN true
                       ELSE coalesce(rs.rs <= least(ceil(r.take * rs.ns / nt.nt), rs.ns), false) END AS inq
      FROM r LEFT JOIN rs USING (id) LEFT JOIN nt USING (cluster, emotion)),
f AS (SELECT *, row_number() OVER (PARTITION BY cluster, emotion ORDER BY inq DESC, h, id) AS rk FROM q),
smp AS (SELECT id, cluster, emotion, confidence_cat, length_cat, timestamp FROM f WHERE rk <= take)"""


def plan(ctx: Ctx):
    return rs.quota_plan(rs.with_buckets(fx.sample_frame(ctx.t)), TOTAL_SAMPLES)


def sample(ctx: Ctx):
    b = rs.with_buckets(fx.sample_frame(ctx.t))
    return rs.quota_sample(b, plan(ctx)).select("id", "cluster", "emotion", "confidence_cat", "length_cat",
                                                "timestamp")


@register("quota_sample_plan", with_views(("fx_sample",), PLAN, "SELECT * FROM plan"))
def q_quota_sample_plan(spark, sf_dir):
    return plan(Ctx(spark, sf_dir)).select("cluster", "emotion", "available", "target", "cap", "take")


@register("quota_sample", with_views(("fx_sample",), SAMPLE, """
SELECT id, cluster, emotion, confidence_cat, length_cat, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp
FROM smp"""))
def q_quota_sample(spark, sf_dir):
    return flat(sample(Ctx(spark, sf_dir)))


@register("sample_daily_counts", with_views(("fx_sample",), SAMPLE, """
SELECT strftime(CAST(timestamp AS DATE), '%Y-%m-%d') AS day, emotion, CAST(count(*) AS BIGINT) AS n
FROM smp GROUP BY ALL"""))
def q_sample_daily_counts(spark, sf_dir):
    return flat(rs.sample_daily_counts(sample(Ctx(spark, sf_dir))))


# --------------------------------------------------------------------------- N2 with noise, feeding J7, N6 and N8
RADIUS, MIN_POINTS = 0.04, 8
STEP = RADIUS / dn.RESOLUTION
DENSITY = f"""
pt AS MATERIALIZED (SELECT vec_id AS article_id, CAST(floor(CAST(embedding[1] AS DOUBLE) / {STEP!r}::DOUBLE) AS BIGINT) AS x,
         CAST(floor(CAST(embedding[2] AS DOUBLE) / {STEP!r}::DOUBLE) AS BIGINT) AS y FROM embeddings),
core AS MATERIALIZED (SELECT a.article_id, a.x, a.y FROM pt a JOIN pt b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= {dn.RESOLUTION ** 2}
         GROUP BY ALL HAVING count(*) >= {MIN_POINTS}),
edge AS MATERIALIZED (SELECT a.article_id AS a, b.article_id AS b FROM core a JOIN core b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= {dn.RESOLUTION ** 2}),
reach AS (SELECT article_id AS a, article_id AS b FROM core UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
lab AS (SELECT a AS article_id, min(b) AS cluster FROM reach GROUP BY a),
hem AS (SELECT p.article_id, l.cluster, row_number() OVER (PARTITION BY p.article_id ORDER BY (p.x - c.x) ** 2 + (p.y - c.y) ** 2, l.cluster) AS rn
        FROM pt p JOIN core c ON (p.x - c.x) ** 2 + (p.y - c.y) ** 2 <= {dn.RESOLUTION ** 2} JOIN lab l ON l.article_id = c.article_id
        WHERE p.article_id NOT IN (SELECT article_id FROM core)),
den AS (SELECT p.article_id, coalesce(l.cluster, h.cluster, -1) AS cluster,
               CASE WHEN l.cluster IS NOT NULL THEN 'core' WHEN h.cluster IS NOT NULL THEN 'border' ELSE 'noise' END AS point_type
        FROM pt p LEFT JOIN lab l USING (article_id) LEFT JOIN (SELECT * FROM hem WHERE rn = 1) h USING (article_id))"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def plane_clusters(ctx: Ctx):
    """Density clusters over the first two components, which SQL can follow."""
    e = fx.vectors(ctx.t).select("article_id", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    return dn.density_clusters(dn.on_grid(e, RADIUS), MIN_POINTS)


@register("density_clusters")
def q_density_clusters(spark, sf_dir):
    """N2 (no oracle: principal components): density clusters with noise over all article embeddings."""
    return dn.cluster_articles(fx.vectors(Ctx(spark, sf_dir).t), RADIUS, MIN_POINTS)


@register("density_clusters_plane", recursive(with_views((), DENSITY, "SELECT article_id, cluster, point_type FROM den")))
def q_density_clusters_plane(spark, sf_dir):
    """The same clustering over two given components."""
    return plane_clusters(Ctx(spark, sf_dir))


@register("cluster_noise_share", recursive(with_views((), DENSITY, """
SELECT count(*) AS n_points, count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS n_clusters, count(*) FILTER (cluster = -1) AS n_noise,
       count(*) FILTER (cluster = -1) / count(*) AS noise_share FROM den""")))
def q_cluster_noise_share(spark, sf_dir):
    return dn.noise_share(plane_clusters(Ctx(spark, sf_dir)))


#: The label that counts as neutral in the fixture's predictions.
NEUTRAL = "4-NOT SPECIFIED"
CLUSTERED = f"""
fx_sample AS (SELECT o_orderkey AS id, den.cluster, CASE WHEN o_orderpriority = '{NEUTRAL}' THEN 'neutral' ELSE o_orderpriority END AS emotion,
         CAST(o_orderkey % 101 AS DOUBLE) / 100.0 AS confidence, o_orderkey * 7 % 230 AS length, o_orderdate AS timestamp
  FROM orders JOIN den ON den.article_id = o_custkey WHERE den.cluster <> -1),"""


def clustered_comments(ctx: Ctx):
    """Comments with the density cluster of their article; noise and articles without a vector dropped."""
    emotion = F.when(F.col("o_orderpriority") == NEUTRAL, "neutral").otherwise(F.col("o_orderpriority"))
    rows = fx.sample_frame(ctx.t, "o_custkey", emotion).withColumnRenamed("cluster", "article_id")
    return rs.attach_clusters(rows, plane_clusters(ctx)).withColumnRenamed("cluster_id", "cluster")


@register("clustered_non_neutral", recursive(with_views((), DENSITY + "," + CLUSTERED.rstrip(","), """
SELECT id, cluster, emotion FROM fx_sample WHERE emotion <> 'neutral'""")))
def q_clustered_non_neutral(spark, sf_dir):
    """J7 + N6."""
    return rs.non_neutral(clustered_comments(Ctx(spark, sf_dir))).select("id", "cluster", "emotion")


@register("quota_sample_clustered", recursive(with_views((), DENSITY + "," + CLUSTERED + SAMPLE, """
SELECT id, cluster, emotion, confidence_cat, length_cat, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp FROM smp""")))
def q_quota_sample_clustered(spark, sf_dir):
    """J7 + N6 + N8: the quota sample over density clusters, neutral comments left out."""
    b = rs.with_buckets(clustered_comments(Ctx(spark, sf_dir)))
    out = rs.quota_sample(b, rs.quota_plan(b, TOTAL_SAMPLES))
    return flat(out.select("id", "cluster", "emotion", "confidence_cat", "length_cat", "timestamp"))
