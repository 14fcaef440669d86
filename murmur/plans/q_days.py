"""Queries: single-day and sub-range forms (P5-P7), appended predictions (M2), lexicon listing with its flags (P10)."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from murmur.operators import emotions as em
from murmur.operators import keywords as kw
from murmur.operators import lexicon as lx
from murmur.operators import lookups as lk
from murmur.operators import models as md
from murmur.plans import q_emotions as qe
from murmur.plans import q_keywords as qk
from murmur.plans import q_models as qm
from murmur.plans import q_rollups as qr
from murmur.plans.oracle_views import with_views
from murmur.plans.registry import Ctx, flat, register
from murmur.session import scratch_path

DAY, COMMENT_DAY = "1996-03-13", "2024-03-01"
MONTHS = ("1996-02", "1996-05")
RANGE = ("2024-02-01", "2024-03-15")


# --------------------------------------------------------------------------- P5
@register("comment_article_counts_range", with_views(("fx_predictions",), f"""
per AS (SELECT text_lang AS language, strftime(comment_timestamp, '%Y-%m') AS period, count(DISTINCT article_id) AS unique_articles,
               count(*) AS total_comments
        FROM fx_predictions WHERE text_lang IN ({qe.PLANGS}) AND comment_timestamp >= TIMESTAMP '1996-02-01' AND comment_timestamp < TIMESTAMP '1996-06-01'
        GROUP BY ALL)""", """
SELECT language, period, CAST(unique_articles AS BIGINT) AS unique_articles, CAST(total_comments AS BIGINT) AS total_comments FROM per
UNION ALL SELECT 'total', period, CAST(sum(unique_articles) AS BIGINT), CAST(sum(total_comments) AS BIGINT) FROM per GROUP BY period"""))
def q_comment_article_counts_range(spark, sf_dir):
    """E2 over four months (P5, pushed to the scan)."""
    ctx = Ctx(spark, sf_dir)
    return em.comment_article_counts(em.chart_rows(ctx.predictions, qe.KIND, "month", ctx.pparams, *MONTHS))


# --------------------------------------------------------------------------- P7
@register("comments_of_one_day", with_views(qe.DV, qe.DAY_SQL, f"SELECT * FROM dc WHERE day = '{DAY}'"))
def q_comments_of_one_day(spark, sf_dir):
    """E6 for one day."""
    return flat(qe.day_rows(Ctx(spark, sf_dir), DAY))


@register("articles_with_emotion_one_day", with_views(qe.DV, "", f"""
SELECT DISTINCT strftime(CAST(p.comment_timestamp AS DATE), '%Y-%m-%d') AS day, a.article_id AS id, a.headline AS article_title
FROM fx_predictions p JOIN fx_articles a USING (article_id)
WHERE p.ekman_prediction_emotion IS NOT NULL AND p.text_lang IN ({qe.PLANGS}) AND CAST(p.comment_timestamp AS DATE) = DATE '{DAY}'"""))
def q_articles_with_emotion_one_day(spark, sf_dir):
    """E7 for one day."""
    ctx = Ctx(spark, sf_dir)
    return flat(em.day_articles(ctx.predictions, ctx.articles, qe.KIND, ctx.pparams, "all", DAY))


@register("lexicon_hits_one_day", with_views(qk.KV, "", f"""
SELECT strftime(day, '%Y-%m-%d') AS day, lemma AS word, lexicon_language AS language, weight, CAST(count(*) AS BIGINT) AS count
FROM fx_hits WHERE comment_lang IN ({qk.LANGS}) AND day = DATE '{COMMENT_DAY}' GROUP BY day, lemma, lexicon_language, weight"""))
def q_lexicon_hits_one_day(spark, sf_dir):
    """K4 for one day."""
    ctx = Ctx(spark, sf_dir)
    return flat(kw.live_day_counts(ctx.lemmatized, ctx.lexicon, ctx.params, "all", COMMENT_DAY, ctx.lexicon_rows))


# --------------------------------------------------------------------------- P6
@register("keywords_by_period_range", with_views(qk.KV, qk.PERIOD_CTES.replace("FROM h GROUP BY", f"FROM h WHERE date BETWEEN '{RANGE[0]}' AND '{RANGE[1]}' GROUP BY"),
                                                 "SELECT * FROM kp"))
def q_keywords_by_period_range(spark, sf_dir):
    """K6 over six weeks."""
    ctx = Ctx(spark, sf_dir)
    return kw.keywords_by_period(qk.hits(ctx), *RANGE, ctx.params)


# --------------------------------------------------------------------------- M2
SCORES = [f"score_{k}" for k in range(len(qm.PP.emotions))]


@register("predictions_appended", with_views(("fx_comments", "fx_articles", "fx_predictions"), qm.PEND, f"""
SELECT sc.id AS comment_id, c.article_id, strftime(c.day, '%Y-%m-%d %H:%M:%S') AS comment_timestamp, c.comment_lang AS text_lang, c.website,
       [{qm.sql_list(qm.PP.emotions)}][list_position(s, list_max(s))] AS ekman_prediction_emotion, list_max(s) AS ekman_prediction_score,
       {", ".join(f"s[{k + 1}] AS {c}" for k, c in enumerate(SCORES))}
FROM sc JOIN fx_comments c ON c.id = sc.id"""))
def q_predictions_appended(spark, sf_dir):
    """M2: pending comments are scored, appended to a predictions table with all its columns, and read back."""
    ctx = Ctx(spark, sf_dir)
    path = scratch_path(spark, "predictions")
    pending = lk.pending_predict(ctx.comments, ctx.articles, ctx.predictions, ctx.params)
    rows = md.prediction_rows(pending, partial(md.token_length_classifier, qm.PP.emotions), qm.KIND)
    md.append_predictions(rows.where("comment_id % 2 = 0"), path)
    md.append_predictions(rows.where("comment_id % 2 = 1"), path)
    stored = spark.read.parquet(path)
    score = [F.col("ekman_prediction_json")[e].alias(c) for e, c in zip(qm.PP.emotions, SCORES)]
    return flat(stored.select("comment_id", "article_id", "comment_timestamp", "text_lang", "website", "ekman_prediction_emotion",
                              "ekman_prediction_score", *score))


# --------------------------------------------------------------------------- P10
FLAGS = [f"category_{c.lower()}" for c in lx.CATEGORIES]


@register("lexicon_listing_flags", with_views(("fx_lemmatized", "fx_lexicon"), f"""
lx AS (SELECT word, language, weight, CASE WHEN language IN ({qr.LANGS}) THEN language ELSE '{qr.P.languages[0]}' END AS lang_key FROM fx_lexicon),
toks AS (SELECT comment_lang, unnest(lemmas) AS lemma FROM fx_lemmatized WHERE comment_lang IN ({qr.LANGS})),
counts AS (SELECT comment_lang, lemma, count(*) AS n FROM toks GROUP BY ALL)""", f"""
SELECT lx.word, lx.language, lx.weight, CAST(coalesce(c.n, 0) AS BIGINT) AS frequency,
       {", ".join(f"(length(lx.word) + {k}) % 3 = 0 AS {c}" for k, c in enumerate(FLAGS))},
       count(*) OVER (PARTITION BY lx.language) AS words_in_language,
       CAST(row_number() OVER (PARTITION BY lx.language ORDER BY lx.word) AS INTEGER) AS position
FROM lx LEFT JOIN counts c ON c.comment_lang = lx.lang_key AND c.lemma = lower(lx.word)"""))
def q_lexicon_listing_flags(spark, sf_dir):
    """P10: the listing carries the lexicon's category flags."""
    ctx = Ctx(spark, sf_dir)
    lexicon = ctx.lexicon.select("*", *[((F.length("word") + k) % 3 == 0).alias(c) for k, c in enumerate(FLAGS)])
    return lx.listing(lx.lexicon_frequency(ctx.lemmatized, lexicon, ctx.params, lexicon_rows=ctx.lexicon_rows))
