"""Queries: emotion analytics (E1-E9), argmax of scores (M1), selectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.functions.select import lang_selector
from murmur.operators import bitmaps as bm
from murmur.operators import emotions as em
from murmur.plans.oracle_views import with_views
from murmur.plans.registry import Ctx, flat, register
from murmur.plans.sqlutil import sql_list
from murmur.session import scratch_path
from murmur.sources import fixtures as fx

PP = fx.PREDICTION_PARAMS
PLANGS = sql_list(PP.languages)
KIND = "ekman"
START, END = "1990-01", "2030-12"        # chart range (P5), covers the data
PIVOT_LABELS = PP.emotions + ("",)
SELECTORS = ("lv", "ru", "all", "", "xx")


def rows(ctx: Ctx, grain: str = "month"):
    return em.chart_rows(ctx.predictions, KIND, grain, ctx.pparams, START, END)


def counts(ctx: Ctx, grain: str = "month"):
    return em.emotion_counts(rows(ctx, grain))


PR = f"""
pr AS (SELECT text_lang AS language, strftime(date_trunc('month', comment_timestamp), '%Y-%m') AS period,
              ekman_prediction_emotion AS emotion, article_id
       FROM fx_predictions
       WHERE text_lang IN ({PLANGS}) AND comment_timestamp >= TIMESTAMP '1990-01-01'
         AND comment_timestamp < TIMESTAMP '2031-01-01'),
ec AS (SELECT language, period, emotion, CAST(count(*) AS BIGINT) AS count
       FROM pr WHERE emotion IS NOT NULL GROUP BY ALL),
dense AS (SELECT pe.language, pe.period, le.emotion, CAST(coalesce(ec.count, 0) AS BIGINT) AS count
          FROM (SELECT DISTINCT language, period FROM ec) pe
          JOIN (SELECT DISTINCT language, emotion FROM ec) le USING (language)
          LEFT JOIN ec USING (language, period, emotion))"""
PV = ("fx_predictions",)


@register("allowed_months", with_views(PV, """
b AS (SELECT min(CAST(comment_timestamp AS DATE)) AS lo, max(CAST(comment_timestamp AS DATE)) AS hi
      FROM fx_predictions),
m AS (SELECT lo, hi, unnest(generate_series(CAST(date_trunc('month', lo) AS TIMESTAMP), CAST(hi AS TIMESTAMP),
                                            INTERVAL 1 MONTH)) AS m FROM b)""", """
SELECT strftime(m, '%Y-%m') AS month, strftime(lo, '%Y-%m') AS min_month, strftime(hi, '%Y-%m') AS max_month
FROM m WHERE m >= lo"""))
def q_allowed_months(spark, sf_dir):
    return em.allowed_months(Ctx(spark, sf_dir).predictions)


@register("comment_article_counts", with_views(PV, PR + """,
per AS (SELECT language, period, CAST(count(DISTINCT article_id) AS BIGINT) AS unique_articles,
               CAST(count(*) AS BIGINT) AS total_comments FROM pr GROUP BY ALL)""", """
SELECT * FROM per
UNION ALL
SELECT 'total', period, CAST(sum(unique_articles) AS BIGINT), CAST(sum(total_comments) AS BIGINT)
FROM per GROUP BY period"""))
def q_comment_article_counts(spark, sf_dir):
    return em.comment_article_counts(rows(Ctx(spark, sf_dir)))


@register("emotion_counts", with_views(PV, PR, "SELECT * FROM ec"))
def q_emotion_counts(spark, sf_dir):
    return counts(Ctx(spark, sf_dir))


@register("emotion_counts_dense", with_views(PV, PR, "SELECT * FROM dense"))
def q_emotion_counts_dense(spark, sf_dir):
    return em.densify(counts(Ctx(spark, sf_dir)))


@register("emotion_counts_pivot", with_views(PV, PR, "SELECT language, period, " + ", ".join(
    f"CAST(count(*) FILTER (WHERE emotion = '{lab}') AS BIGINT) AS {em.pivot_name(lab)}" for lab in PIVOT_LABELS)
    + " FROM pr WHERE emotion IS NOT NULL GROUP BY language, period"))
def q_emotion_counts_pivot(spark, sf_dir):
    return em.pivot_counts(counts(Ctx(spark, sf_dir)), PIVOT_LABELS)


@register("emotion_share", with_views(PV, PR, """
SELECT language, period, emotion, count,
       CASE WHEN sum(count) OVER w > 0 THEN count / sum(count) OVER w ELSE 0.0 END AS share
FROM dense WINDOW w AS (PARTITION BY language, period)"""))
def q_emotion_share(spark, sf_dir):
    return em.with_period_share(em.densify(counts(Ctx(spark, sf_dir))))


@register("emotion_share_overall", with_views(PV, PR, """
SELECT language, emotion, share FROM (
  SELECT language, emotion, n / sum(n) OVER (PARTITION BY language) AS share
  FROM (SELECT language, emotion, count(*) AS n FROM pr GROUP BY ALL))
WHERE emotion IS NOT NULL"""))
def q_emotion_share_overall(spark, sf_dir):
    return em.overall_share(rows(Ctx(spark, sf_dir)))


@register("emotion_total", with_views(PV, PR + """,
c AS (SELECT period, emotion, sum(count) AS count FROM ec GROUP BY ALL),
cd AS (SELECT p.period, e.emotion, CAST(coalesce(c.count, 0) AS BIGINT) AS count
       FROM (SELECT DISTINCT period FROM c) p CROSS JOIN (SELECT DISTINCT emotion FROM c) e
       LEFT JOIN c USING (period, emotion))""", """
SELECT period, emotion, count,
       CASE WHEN sum(count) OVER (PARTITION BY period) > 0
            THEN count / sum(count) OVER (PARTITION BY period) ELSE 0.0 END AS share,
       sum(count) OVER (PARTITION BY emotion) / sum(count) OVER () AS overall_share
FROM cd"""))
def q_emotion_total(spark, sf_dir):
    return em.combined_block(counts(Ctx(spark, sf_dir)))


@register("emotion_counts_week", with_views(PV, f"""
pw AS (SELECT text_lang AS language,
              strftime(date_trunc('week', comment_timestamp) + INTERVAL 1 DAY - INTERVAL 1 WEEK, '%Y-%m-%d')
                AS period,
              ekman_prediction_emotion AS emotion
       FROM fx_predictions WHERE text_lang IN ({PLANGS}))""", """
SELECT language, period, emotion, CAST(count(*) AS BIGINT) AS count FROM pw
WHERE emotion IS NOT NULL GROUP BY ALL"""))
def q_emotion_counts_week(spark, sf_dir):
    return counts(Ctx(spark, sf_dir), "week")


DAY_SQL = f"""
dc AS (SELECT p.id, p.text AS comment_text, p.article_id, a.headline AS article_title, a.url AS article_url,
              p.text_lang AS comment_lang, p.ekman_prediction_emotion AS prediction,
              round_even(p.ekman_prediction_score * 100.0, 2) AS prediction_score,
              strftime(CAST(p.comment_timestamp AS DATE), '%Y-%m-%d') AS day
       FROM fx_predictions p JOIN fx_articles a USING (article_id)
       WHERE p.ekman_prediction_emotion IS NOT NULL AND p.text_lang IN ({PLANGS}))"""
DV = ("fx_predictions", "fx_articles")


def day_rows(ctx: Ctx, day=None):
    return em.day_comments(ctx.predictions, ctx.articles, KIND, ctx.pparams, "all", day)


@register("comments_of_day", with_views(DV, DAY_SQL, "SELECT * FROM dc"))
def q_comments_of_day(spark, sf_dir):
    """E6 for every day (the single-day form adds the P7 range predicate)."""
    return flat(day_rows(Ctx(spark, sf_dir)))


@register("articles_with_emotion", with_views(DV, "", f"""
SELECT DISTINCT strftime(CAST(p.comment_timestamp AS DATE), '%Y-%m-%d') AS day, a.article_id AS id,
       a.headline AS article_title
FROM fx_predictions p JOIN fx_articles a USING (article_id)
WHERE p.ekman_prediction_emotion IS NOT NULL AND p.text_lang IN ({PLANGS})"""))
def q_articles_with_emotion(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    return flat(em.day_articles(ctx.predictions, ctx.articles, KIND, ctx.pparams, "all"))


@register("comments_grouped", with_views(DV, DAY_SQL, """
SELECT day, prediction, CAST(count(*) AS BIGINT) AS n FROM dc GROUP BY ALL"""))
def q_comments_grouped(spark, sf_dir):
    return flat(em.grouped_counts(day_rows(Ctx(spark, sf_dir)), "prediction"))


@register("comments_grouped_article", with_views(DV, DAY_SQL, """
SELECT day, article_id, CAST(count(*) AS BIGINT) AS n FROM dc GROUP BY ALL"""))
def q_comments_grouped_article(spark, sf_dir):
    return flat(em.grouped_counts(day_rows(Ctx(spark, sf_dir)), "article_id"))


@register("emotion_argmax", """
WITH s AS (SELECT l_orderkey, l_linenumber,
                  [round_even(l_discount, 5), round_even(l_tax, 5), round_even(l_quantity / 100.0, 5)] AS sc
           FROM lineitem)
SELECT l_orderkey, l_linenumber, sc[1] AS score_a, sc[2] AS score_b, sc[3] AS score_c,
       ['a', 'b', 'c'][list_position(sc, list_max(sc))] AS top_label, list_max(sc) AS top_score
FROM s""")
def q_emotion_argmax(spark, sf_dir):
    s = fx.scores(Ctx(spark, sf_dir).t)
    r = s.select("l_orderkey", "l_linenumber", em.argmax_prediction(F.col("prediction")).alias("r"))
    return r.select("l_orderkey", "l_linenumber",
                    F.col("r.scores")[0]["score"].alias("score_a"),
                    F.col("r.scores")[1]["score"].alias("score_b"),
                    F.col("r.scores")[2]["score"].alias("score_c"),
                    F.col("r.label").alias("top_label"), F.col("r.score").alias("top_score"))


@register("lang_selector", with_views(PV, "", "\nUNION ALL\n".join(
    f"SELECT '{s}' AS selector, CAST(count(*) AS BIGINT) AS n FROM fx_predictions WHERE "
    + (f"text_lang = '{s}'" if s in PP.languages else f"text_lang IN ({PLANGS})")
    for s in SELECTORS)))
def q_lang_selector(spark, sf_dir):
    """Rows selected by each selector value, in one scan."""
    ctx = Ctx(spark, sf_dir)
    aggs = [F.count(F.when(lang_selector("text_lang", s, ctx.pparams), 1)).alias(f"s{i}")
            for i, s in enumerate(SELECTORS)]
    stack = "stack({}, {}) as (selector, n)".format(
        len(SELECTORS), ", ".join(f"'{s}', s{i}" for i, s in enumerate(SELECTORS)))
    return ctx.predictions.agg(*aggs).select(F.expr(stack))


PERIOD_SQL = {
    "week": "strftime(date_trunc('week', comment_timestamp) + INTERVAL 1 DAY - INTERVAL 1 WEEK, '%Y-%m-%d')",
    "day": "strftime(date_trunc('day', comment_timestamp), '%Y-%m-%d')",
}


def pr_for(grain: str) -> str:
    return PR.replace("strftime(date_trunc('month', comment_timestamp), '%Y-%m')", PERIOD_SQL[grain])


@register("emotion_share_week", with_views(PV, pr_for("week"), """
SELECT language, period, emotion, count,
       CASE WHEN sum(count) OVER w > 0 THEN count / sum(count) OVER w ELSE 0.0 END AS share
FROM dense WINDOW w AS (PARTITION BY language, period)"""))
def q_emotion_share_week(spark, sf_dir):
    """E4 at week grain (E8 labels)."""
    return em.with_period_share(em.densify(counts(Ctx(spark, sf_dir), "week")))


@register("comment_article_counts_day", with_views(PV, pr_for("day") + """,
per AS (SELECT language, period, CAST(count(DISTINCT article_id) AS BIGINT) AS unique_articles,
               CAST(count(*) AS BIGINT) AS total_comments FROM pr GROUP BY ALL)""", """
SELECT * FROM per
UNION ALL
SELECT 'total', period, CAST(sum(unique_articles) AS BIGINT), CAST(sum(total_comments) AS BIGINT)
FROM per GROUP BY period"""))
def q_comment_article_counts_day(spark, sf_dir):
    """E2 at day grain."""
    return em.comment_article_counts(rows(Ctx(spark, sf_dir), "day"))


@register("comment_article_counts_bitmaps", with_views(PV, PR + """,
per AS (SELECT language, period, CAST(count(DISTINCT article_id) AS BIGINT) AS unique_articles,
               CAST(count(*) AS BIGINT) AS total_comments FROM pr GROUP BY ALL)""", """
SELECT * FROM per
UNION ALL
SELECT 'total', period, CAST(sum(unique_articles) AS BIGINT), CAST(sum(total_comments) AS BIGINT)
FROM per GROUP BY period"""))
def q_comment_article_counts_bitmaps(spark, sf_dir):
    """E2 by month from stored daily bitmaps."""
    ctx = Ctx(spark, sf_dir)
    path = scratch_path(spark, "article-bitmaps")
    bm.day_bitmaps(rows(ctx, "day").withColumn("date", F.to_date("period")), ("language",)).write.partitionBy("language").parquet(path)
    per = bm.distinct_over(spark.read.parquet(path), ("language",), "1990-01-01", "2030-12-31", F.date_format("date", "yyyy-MM"),
                           "unique_articles", "total_comments")
    return em.with_total(per)
