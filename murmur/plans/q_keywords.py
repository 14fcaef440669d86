"""Queries: keyword detail (K1, K4-K8) and keyword views."""

from __future__ import annotations


from pyspark.sql import functions as F

from murmur.operators import bitmaps as bm
from murmur.operators import keywords as kw
from murmur.operators.lexicon import search
from murmur.plans.oracle_views import with_views
from murmur.plans.registry import Ctx, flat, register
from murmur.plans.sqlutil import sql_list
from murmur.session import scratch_path
from murmur.sources import fixtures as fx

P = fx.FIXTURE_PARAMS
LANGS = sql_list(P.languages)
SITES = sql_list(P.sites)
RANGE = ("2000-01-01", "2099-12-31")
TOP_N, MIN_COUNT = 25, 2
SEARCH_TERM = "Ing"


def hits(ctx: Ctx):
    return kw.hits_fact(ctx.lemmatized, ctx.lexicon, ctx.params, ctx.lexicon_rows)


def by_day(ctx: Ctx):
    return kw.keywords_by_day(ctx.lemmatized, ctx.lexicon, ctx.params, ctx.lexicon_rows)


HITS_CTE = f"""
h AS (SELECT day AS date, comment_lang AS language, website,
             CASE WHEN website IN ({SITES}) THEN website END AS site,
             lemma, form, weight, article_id
      FROM fx_hits WHERE comment_lang IN ({LANGS}))"""

K1_CTES = HITS_CTE + f""",
k AS (SELECT date, language, site, lemma, grouping(site) AS g, count(*) AS cnt, sum(weight) AS wsum,
             count(DISTINCT article_id) AS arts
      FROM h GROUP BY GROUPING SETS ((date, language, site, lemma), (date, language, lemma))),
k2 AS (SELECT date, language, CASE WHEN g = 1 THEN 'all' ELSE site END AS website, lemma, cnt, wsum, arts
       FROM k WHERE g = 1 OR site IS NOT NULL),
t AS (SELECT day AS date, comment_lang AS language, CASE WHEN website IN ({SITES}) THEN website END AS site,
             len(lemmas) AS n
      FROM fx_lemmatized WHERE comment_lang IN ({LANGS})),
t1 AS (SELECT date, language, site, grouping(site) AS g, sum(n) AS total
       FROM t GROUP BY GROUPING SETS ((date, language, site), (date, language))),
t2 AS (SELECT date, language, CASE WHEN g = 1 THEN 'all' ELSE site END AS website,
              CAST(total AS BIGINT) AS total_word_count
       FROM t1 WHERE (g = 1 OR site IS NOT NULL) AND total > 0),
k1 AS (SELECT t2.date, t2.language, t2.website, k2.lemma AS word,
              CAST(coalesce(k2.cnt, 0) AS BIGINT) AS count, CAST(coalesce(k2.wsum, 0.0) AS DOUBLE) AS weight_sum,
              CAST(coalesce(k2.arts, 0) AS BIGINT) AS article_count, t2.total_word_count
       FROM t2 LEFT JOIN k2 USING (date, language, website))"""
KV = ("fx_lemmatized", "fx_hits")


@register("keywords_by_day", with_views(KV, K1_CTES, """
SELECT strftime(date, '%Y-%m-%d') AS date, language, website, word, count, weight_sum, article_count,
       total_word_count
FROM k1"""))
def q_keywords_by_day(spark, sf_dir):
    return flat(by_day(Ctx(spark, sf_dir)))


@register("keyword_forms_by_day", with_views(KV, HITS_CTE + """,
f AS (SELECT date, language, site, lemma, form, grouping(site) AS g, count(*) AS cnt
      FROM h GROUP BY GROUPING SETS ((date, language, site, lemma, form), (date, language, lemma, form)))""", """
SELECT strftime(date, '%Y-%m-%d') AS date, language, CASE WHEN g = 1 THEN 'all' ELSE site END AS website,
       lemma AS word, form, CAST(cnt AS BIGINT) AS count
FROM f WHERE g = 1 OR site IS NOT NULL"""))
def q_keyword_forms_by_day(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    return flat(kw.keyword_forms_by_day(hits(ctx), ctx.params))


@register("lexicon_hits_day", with_views(KV, "", f"""
SELECT strftime(day, '%Y-%m-%d') AS day, lemma AS word, lexicon_language AS language, weight,
       CAST(count(*) AS BIGINT) AS count
FROM fx_hits WHERE comment_lang IN ({LANGS})
GROUP BY day, lemma, lexicon_language, weight"""))
def q_lexicon_hits_day(spark, sf_dir):
    """K4 for every day at once (the single-day form is a filter on ``day``)."""
    ctx = Ctx(spark, sf_dir)
    return flat(kw.live_day_counts(ctx.lemmatized, ctx.lexicon, ctx.params, "all",
                                   lexicon_rows=ctx.lexicon_rows))


@register("keywords_day_sorted", with_views(KV, K1_CTES, """
SELECT strftime(date, '%Y-%m-%d') AS date, language, website, word, count, weight_sum, article_count,
       total_word_count,
       CAST(row_number() OVER (PARTITION BY date, language ORDER BY count DESC, word ASC) AS INTEGER) AS rank
FROM k1 WHERE website = 'all' AND word IS NOT NULL"""))
def q_keywords_day_sorted(spark, sf_dir):
    return flat(kw.ranked_day_detail(by_day(Ctx(spark, sf_dir))))


PERIOD_CTES = HITS_CTE + """,
kp AS (SELECT language, lemma AS word, CAST(count(*) AS BIGINT) AS count, CAST(sum(weight) AS DOUBLE) AS weight_sum,
              CAST(count(DISTINCT article_id) AS BIGINT) AS article_count
       FROM h GROUP BY language, lemma),
fp AS (SELECT language, lemma AS word, form, CAST(count(*) AS BIGINT) AS count FROM h GROUP BY ALL)"""


def period(ctx):
    return kw.keywords_by_period(hits(ctx), *RANGE, ctx.params)


def period_forms(ctx):
    return kw.keyword_forms_by_period(hits(ctx), *RANGE, ctx.params)


@register("keywords_by_period", with_views(KV, PERIOD_CTES, "SELECT * FROM kp"))
def q_keywords_by_period(spark, sf_dir):
    return period(Ctx(spark, sf_dir))


@register("keyword_forms_by_period", with_views(KV, PERIOD_CTES, "SELECT * FROM fp"))
def q_keyword_forms_by_period(spark, sf_dir):
    return period_forms(Ctx(spark, sf_dir))


@register("keyword_dates", with_views(KV, K1_CTES, """
SELECT DISTINCT language, website, strftime(date, '%Y-%m-%d') AS date FROM k1"""))
def q_keyword_dates(spark, sf_dir):
    return flat(kw.keyword_dates(by_day(Ctx(spark, sf_dir))))


ART_CTES = HITS_CTE + """,
ids AS (SELECT DISTINCT language, lemma AS word, article_id FROM h),
wa AS (SELECT i.article_id, i.language, i.word, a.headline, a.url, a.website, a.pub_day
       FROM ids i JOIN fx_articles a USING (article_id))"""
AV = KV + ("fx_articles",)


@register("keyword_articles", with_views(AV, ART_CTES, """
SELECT article_id, language, word, headline, url, website, strftime(pub_day, '%Y-%m-%d') AS pub_day FROM wa"""))
def q_keyword_articles(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    return flat(kw.keyword_articles(hits(ctx), ctx.articles, *RANGE, ctx.params))


@register("keyword_articles_top10", with_views(AV, ART_CTES, """
SELECT * FROM (
  SELECT article_id, language, word, headline, url, website, strftime(pub_day, '%Y-%m-%d') AS pub_day,
         CAST(row_number() OVER (PARTITION BY language, word ORDER BY pub_day DESC NULLS FIRST, article_id)
              AS INTEGER) AS rank
  FROM wa) WHERE rank <= 10"""))
def q_keyword_articles_top10(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    return flat(kw.first_articles(kw.keyword_articles(hits(ctx), ctx.articles, *RANGE, ctx.params), 10))


TOPN_SQL = f"""
top AS (SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY language ORDER BY count DESC, word ASC) AS INTEGER) AS rank
  FROM kp WHERE count >= {MIN_COUNT}) WHERE rank <= {TOP_N})"""


@register("topn_keywords", with_views(KV, PERIOD_CTES + "," + TOPN_SQL, "SELECT * FROM top"))
def q_topn_keywords(spark, sf_dir):
    return kw.top_keywords(period(Ctx(spark, sf_dir)), TOP_N, MIN_COUNT)


@register("cloud_scale", with_views(KV, PERIOD_CTES + "," + TOPN_SQL, """
SELECT language, word, count,
       CAST(round(14.0 + (count - min(count) OVER w) /
            (CASE WHEN max(count) OVER w - min(count) OVER w = 0 THEN 1
                  ELSE max(count) OVER w - min(count) OVER w END) * 56.0, 0) AS INTEGER) AS size
FROM top WINDOW w AS (PARTITION BY language)"""))
def q_cloud_scale(spark, sf_dir):
    top = kw.top_keywords(period(Ctx(spark, sf_dir)), TOP_N, MIN_COUNT)
    return kw.cloud_scale(top).select("language", "word", "count", "size")


@register("keyword_forms_ranked", with_views(KV, PERIOD_CTES, """
SELECT language, word, form, count,
       CAST(row_number() OVER (PARTITION BY language, word ORDER BY count DESC, form ASC) AS INTEGER) AS rank
FROM fp"""))
def q_keyword_forms_ranked(spark, sf_dir):
    return kw.ranked_forms(period_forms(Ctx(spark, sf_dir)))


@register("keyword_search", with_views(KV, PERIOD_CTES, f"""
SELECT * FROM kp WHERE contains(lower(word), lower('{SEARCH_TERM}'))"""))
def q_keyword_search(spark, sf_dir):
    """Substring filter (case-insensitive) on the keyword column."""
    p = period(Ctx(spark, sf_dir))
    return search(p, "word", SEARCH_TERM)


def stored_maps(ctx: Ctx):
    """D9 rows written once to the shared folder and read back (the stored table)."""
    from murmur.session import scratch_path
    path = scratch_path(ctx.spark, "keywords-by-day")
    kw.keywords_day_maps(ctx.lemmatized, hits(ctx), ctx.params).write.mode("overwrite").parquet(path)
    return ctx.spark.read.parquet(path)


@register("keywords_day_maps", with_views(KV, K1_CTES + """,
nf AS (SELECT date, language, CASE WHEN g = 1 THEN 'all' ELSE site END AS website, lemma AS word,
              CAST(count(DISTINCT form) AS INTEGER) AS n_forms
       FROM (SELECT date, language, site, lemma, form, grouping(site) AS g FROM h
             GROUP BY GROUPING SETS ((date, language, site, lemma, form), (date, language, lemma, form)))
       WHERE g = 1 OR site IS NOT NULL GROUP BY ALL)""", """
SELECT strftime(k1.date, '%Y-%m-%d') AS date, k1.language, k1.website, k1.word, k1.count, k1.weight_sum,
       k1.article_count, nf.n_forms, k1.total_word_count
FROM k1 JOIN nf USING (date, language, website, word)"""))
def q_keywords_day_maps(spark, sf_dir):
    """K1 stored shape (D9 maps per scope-day), flattened back for comparison."""
    return flat(kw.flatten_day_maps(stored_maps(Ctx(spark, sf_dir))))


@register("keywords_by_period_from_maps", with_views(KV, PERIOD_CTES, """
SELECT language, word, count, weight_sum, article_count FROM kp"""))
def q_keywords_by_period_from_maps(spark, sf_dir):
    """K6 as the reference computes it: merge stored day maps, union article ids."""
    return kw.period_from_day_maps(stored_maps(Ctx(spark, sf_dir)), *RANGE)


# --------------------------------------------------------------------------- K6 / U4 from stored bitmaps
BITMAP_RANGE = ("2024-02-03", "2024-04-17")


@register("keywords_by_period_bitmaps", with_views(KV, HITS_CTE, f"""
SELECT language, lemma AS word, count(DISTINCT article_id) AS article_count, count(*) AS count FROM h
WHERE date BETWEEN DATE '{BITMAP_RANGE[0]}' AND DATE '{BITMAP_RANGE[1]}' GROUP BY ALL"""))
def q_keywords_by_period_bitmaps(spark, sf_dir):
    """K6/U4: distinct articles over a range of days, from stored bitmaps alone."""
    ctx = Ctx(spark, sf_dir)
    path = scratch_path(spark, "keyword-bitmaps")
    bm.keyword_bitmaps(hits(ctx), ctx.params).write.partitionBy("language").parquet(path)
    return bm.keywords_over(spark.read.parquet(path), *BITMAP_RANGE, ctx.params)


@register("keywords_by_period_bitmaps_site", with_views(KV, HITS_CTE, f"""
SELECT language, lemma AS word, count(DISTINCT article_id) AS article_count, count(*) AS count FROM h
WHERE date BETWEEN DATE '{BITMAP_RANGE[0]}' AND DATE '{BITMAP_RANGE[1]}' AND site = 'site_b' GROUP BY ALL"""))
def q_keywords_by_period_bitmaps_site(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    path = scratch_path(spark, "keyword-bitmaps")
    bm.keyword_bitmaps(hits(ctx), ctx.params).write.partitionBy("language").parquet(path)
    return bm.keywords_over(spark.read.parquet(path), *BITMAP_RANGE, ctx.params, "site_b")
