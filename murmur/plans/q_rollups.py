"""Queries: text basics (X1, X2, X6, X7), rollups (G1-G8) and trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.functions.text import cyrillic_count, detect_language, latin_count, word_count
from murmur.operators import lexicon as lx
from murmur.operators import rollups as ro
from murmur.operators import trends as tr
from murmur.operators.layout import spread
from murmur.plans.oracle_views import with_views
from murmur.plans.registry import Ctx, flat, register
from murmur.plans.sqlutil import sql_list
from murmur.sources import fixtures as fx

P = fx.FIXTURE_PARAMS
LANGS = sql_list(P.languages)
SITES = sql_list(P.sites)
FULL_RANGE = ("2000-01-01", "2099-12-31")     # every rollup date


def daily(ctx: Ctx):
    return ro.aggressiveness_by_day(ctx.lemmatized, ctx.lexicon, ctx.params, ctx.lexicon_rows)


# --------------------------------------------------------------------------- G1+G2
AGGR_BY_DAY_CTES = f"""
per AS (
  SELECT l.day, l.comment_lang AS language, l.website, len(l.lemmas) AS total,
         coalesce(h.n, 0) AS n, coalesce(h.w, 0.0) AS w
  FROM fx_lemmatized l
  LEFT JOIN (SELECT comment_id, count(*) AS n, sum(weight) AS w FROM fx_hits GROUP BY comment_id) h
    USING (comment_id)
  WHERE l.comment_lang IN ({LANGS}) AND l.website IN ({SITES})
),
daily AS (
  SELECT day AS date, language,
         CASE WHEN grouping(website) = 1 THEN 'all' ELSE website END AS website,
         CAST(sum(n) AS BIGINT) AS aggressive_word_count,
         CAST(sum(w) AS DOUBLE) AS aggressive_word_weight_sum,
         CAST(sum(total) AS BIGINT) AS total_word_count
  FROM per GROUP BY GROUPING SETS ((day, language, website), (day, language))
),
daily_r AS (
  SELECT *,
         CASE WHEN total_word_count > 0 THEN aggressive_word_count / total_word_count ELSE 0.0 END
           AS aggressiveness_ratio,
         CASE WHEN total_word_count > 0 THEN aggressive_word_weight_sum / total_word_count ELSE 0.0 END
           AS weighted_aggressiveness_ratio
  FROM daily
)
"""
DAILY_VIEWS = ("fx_lemmatized", "fx_hits")


AGGR_BY_DAY_SQL = with_views(DAILY_VIEWS, AGGR_BY_DAY_CTES, """
SELECT strftime(date, '%Y-%m-%d') AS date, language, website, aggressive_word_count,
       aggressive_word_weight_sum, total_word_count, aggressiveness_ratio, weighted_aggressiveness_ratio
FROM daily_r""")


@register("aggr_by_day", AGGR_BY_DAY_SQL)
def q_aggr_by_day(spark, sf_dir):
    return flat(daily(Ctx(spark, sf_dir)))


# --------------------------------------------------------------------------- X1
@register("detect_language", with_views(("fx_comments",), f"""
c AS (SELECT id, region,
             len(regexp_extract_all(comment_text, '{'[Ѐ-ӿ]'}')) AS n_cyrillic,
             len(regexp_extract_all(comment_text, '{'[A-Za-zĀ-ž]'}')) AS n_latin
      FROM fx_comments)""", """
SELECT id, region, n_cyrillic, n_latin,
       CASE WHEN n_cyrillic + n_latin > 0 AND n_cyrillic / (n_cyrillic + n_latin) > 0.85 THEN 'ru'
            WHEN region = 'rus' THEN 'ru' WHEN region = 'lat' THEN 'lv' ELSE 'lv' END AS detected_lang
FROM c"""))
def q_detect_language(spark, sf_dir):
    c = spread(Ctx(spark, sf_dir).comments, "id")
    return c.select("id", "region",
                    cyrillic_count("comment_text").cast("long").alias("n_cyrillic"),
                    latin_count("comment_text").cast("long").alias("n_latin"),
                    detect_language("comment_text", "region").alias("detected_lang"))


# --------------------------------------------------------------------------- X2
@register("tokenize_lemmatize", with_views(("fx_lemmatized",), "", """
SELECT comment_id, CAST(len(lemmas) AS INTEGER) AS lemma_count, array_to_string(lemmas, ' ') AS lemma_text
FROM fx_lemmatized"""))
def q_tokenize(spark, sf_dir):
    lm = Ctx(spark, sf_dir).lemmatized
    return lm.select("comment_id", "lemma_count", F.array_join("lemmas", " ").alias("lemma_text"))


# --------------------------------------------------------------------------- X6
WS = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@register("word_length", with_views(("fx_comments",), "", f"""
SELECT id, CAST(len(list_filter(regexp_split_to_array(coalesce(comment_text, ''), '{WS}'), lambda x: x <> ''))
            AS INTEGER) AS length
FROM fx_comments"""))
def q_word_length(spark, sf_dir):
    c = spread(Ctx(spark, sf_dir).comments, "id")
    return c.select("id", word_count("comment_text").alias("length"))


# --------------------------------------------------------------------------- X7
@register("score_comment", with_views(DAILY_VIEWS, "", """
SELECT l.comment_id, CAST(len(l.lemmas) AS INTEGER) AS lemma_count,
       CAST(coalesce(h.n, 0) AS BIGINT) AS aggressive_word_count,
       CAST(coalesce(h.w, 0.0) AS DOUBLE) AS aggressive_word_weight_sum
FROM fx_lemmatized l
LEFT JOIN (SELECT comment_id, count(*) AS n, sum(weight) AS w FROM fx_hits GROUP BY comment_id) h
  USING (comment_id)"""))
def q_score_comment(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    return lx.score_comments(ctx.lemmatized, ctx.lexicon, lexicon_rows=ctx.lexicon_rows)


# --------------------------------------------------------------------------- G3
CUTOFF = "2024-03-01"


@register("rollup_incremental", with_views(DAILY_VIEWS, AGGR_BY_DAY_CTES + f""",
per_old AS (SELECT * FROM per WHERE day < DATE '{CUTOFF}'),
old_keys AS (
  SELECT DISTINCT day AS date, language,
         CASE WHEN grouping(website) = 1 THEN 'all' ELSE website END AS website
  FROM per_old GROUP BY GROUPING SETS ((day, language, website), (day, language))
)""", """
SELECT strftime(d.date, '%Y-%m-%d') AS date, d.language, d.website, d.aggressive_word_count,
       d.aggressive_word_weight_sum, d.total_word_count, d.aggressiveness_ratio,
       d.weighted_aggressiveness_ratio
FROM daily_r d ANTI JOIN old_keys k ON d.date = k.date AND d.language = k.language AND d.website = k.website"""))
def q_rollup_incremental(spark, sf_dir):
    """Target holds the rollup of comments before the cutoff; the new run adds missing keys."""
    ctx = Ctx(spark, sf_dir)
    old = ro.aggressiveness_by_day(ctx.lemmatized.where(F.col("day") < F.lit(CUTOFF).cast("date")),
                                   ctx.lexicon, ctx.params, ctx.lexicon_rows)
    return flat(ro.insert_missing(daily(ctx), old))


# --------------------------------------------------------------------------- G4
@register("month_worklist", with_views(("fx_comments",), f"""
c AS (SELECT comment_lang AS language, date_trunc('month', day) AS month
      FROM fx_comments WHERE comment_lang IN ({LANGS})),
counts AS (SELECT language, month, count(*) AS n FROM c GROUP BY ALL),
b AS (SELECT language, min(month) AS lo, max(month) AS hi FROM counts GROUP BY language),
m AS (SELECT language, unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS month FROM b)""", """
SELECT m.language, strftime(m.month, '%Y-%m-%d') AS month, CAST(coalesce(counts.n, 0) AS BIGINT) AS n_comments
FROM m LEFT JOIN counts USING (language, month)"""))
def q_month_worklist(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    return flat(ro.month_worklist(ctx.comments, ctx.params))


# --------------------------------------------------------------------------- G5 / G6
PERIOD_CTES = AGGR_BY_DAY_CTES + """,
wk AS (
  SELECT language, CAST(date_trunc('week', date) AS DATE) AS period,
         CAST(sum(aggressive_word_count) AS BIGINT) AS aggressive_word_count,
         CAST(sum(aggressive_word_weight_sum) AS DOUBLE) AS aggressive_word_weight_sum,
         CAST(sum(total_word_count) AS BIGINT) AS total_word_count
  FROM daily WHERE website = 'all' GROUP BY ALL
),
wk_p AS (
  SELECT *,
         CASE WHEN total_word_count > 0 THEN aggressive_word_count / total_word_count * 100.0 ELSE 0.0 END
           AS unweighted_aggressiveness_pct,
         CASE WHEN total_word_count > 0 THEN aggressive_word_weight_sum / total_word_count * 100.0 ELSE 0.0 END
           AS weighted_aggressiveness_pct
  FROM wk
)"""


@register("aggr_by_period", with_views(DAILY_VIEWS, PERIOD_CTES, """
SELECT language, strftime(period, '%Y-%m-%d') AS period, aggressive_word_count, aggressive_word_weight_sum,
       total_word_count, unweighted_aggressiveness_pct, weighted_aggressiveness_pct
FROM wk_p"""))
def q_aggr_by_period(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    return flat(ro.aggressiveness_by_period(daily(ctx), *FULL_RANGE, "week", ctx.params))


SITE_CTES = AGGR_BY_DAY_CTES + f""",
mo AS (
  SELECT language, website, CAST(date_trunc('month', date) AS DATE) AS period,
         sum(aggressive_word_count) AS c, sum(total_word_count) AS t
  FROM daily WHERE website IN ({SITES}) AND language IN ({LANGS}) GROUP BY ALL
),
mo_p AS (
  SELECT language, website, period,
         CASE WHEN t > 0 THEN CAST(c AS BIGINT) / CAST(t AS BIGINT) * 100.0 ELSE 0.0 END
           AS unweighted_aggressiveness_pct
  FROM mo
)"""


@register("aggr_by_period_site", with_views(DAILY_VIEWS, SITE_CTES, """
SELECT language, website, strftime(period, '%Y-%m-%d') AS period, unweighted_aggressiveness_pct FROM mo_p"""))
def q_aggr_by_period_site(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    return flat(ro.aggressiveness_by_period_site(daily(ctx), *FULL_RANGE, "month", ctx.params))


# --------------------------------------------------------------------------- W1 / W2 / B4 / J11
@register("sma", with_views(DAILY_VIEWS, AGGR_BY_DAY_CTES, """
SELECT language, strftime(date, '%Y-%m-%d') AS date, aggressiveness_ratio,
       round(avg(aggressiveness_ratio) OVER (PARTITION BY language ORDER BY date
             ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 10) AS aggressiveness_ratio_sma
FROM daily_r WHERE website = 'all'"""))
def q_sma(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    d = daily(ctx).where(F.col("website") == ctx.params.all_scope) \
                  .select("language", "date", "aggressiveness_ratio")
    out = tr.with_sma(d, "aggressiveness_ratio", tr.sma_width("day"), ["language"], "date")
    return flat(out.withColumn("aggressiveness_ratio_sma", F.round("aggressiveness_ratio_sma", 10)))


def weekly_trend(ctx: Ctx):
    wk = ro.aggressiveness_by_period(daily(ctx), *FULL_RANGE, "week", ctx.params)
    t = tr.with_sma(wk, ["unweighted_aggressiveness_pct", "weighted_aggressiveness_pct"],
                    tr.sma_width("week"), ["language"], "period")
    for c in ("unweighted_aggressiveness_pct_sma", "weighted_aggressiveness_pct_sma"):
        t = t.withColumn(c, F.round(c, 10))
    return t


TREND_CTES = PERIOD_CTES + """,
trend AS (
  SELECT language, period, unweighted_aggressiveness_pct, weighted_aggressiveness_pct,
         round(avg(unweighted_aggressiveness_pct) OVER w, 10) AS unweighted_aggressiveness_pct_sma,
         round(avg(weighted_aggressiveness_pct) OVER w, 10) AS weighted_aggressiveness_pct_sma
  FROM wk_p
  WINDOW w AS (PARTITION BY language ORDER BY period ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)
)"""


@register("aggr_trend", with_views(DAILY_VIEWS, TREND_CTES, """
SELECT language, strftime(period, '%Y-%m-%d') AS period, unweighted_aggressiveness_pct,
       weighted_aggressiveness_pct, unweighted_aggressiveness_pct_sma, weighted_aggressiveness_pct_sma
FROM trend"""))
def q_aggr_trend(spark, sf_dir):
    t = weekly_trend(Ctx(spark, sf_dir))
    return flat(t.select("language", "period", "unweighted_aggressiveness_pct", "weighted_aggressiveness_pct",
                         "unweighted_aggressiveness_pct_sma", "weighted_aggressiveness_pct_sma"))


@register("aggr_trend_site", with_views(DAILY_VIEWS, SITE_CTES, """
SELECT language, website, strftime(period, '%Y-%m-%d') AS period, unweighted_aggressiveness_pct,
       round(avg(unweighted_aggressiveness_pct) OVER (PARTITION BY language, website ORDER BY period
             ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 10) AS unweighted_aggressiveness_pct_sma
FROM mo_p"""))
def q_aggr_trend_site(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    m = ro.aggressiveness_by_period_site(daily(ctx), *FULL_RANGE, "month", ctx.params)
    t = tr.with_sma(m, "unweighted_aggressiveness_pct", tr.sma_width("month"), ["language", "website"], "period")
    return flat(t.withColumn("unweighted_aggressiveness_pct_sma", F.round("unweighted_aggressiveness_pct_sma", 10)))


@register("trend_side_by_side", with_views(DAILY_VIEWS, TREND_CTES, f"""
SELECT strftime(a.period, '%Y-%m-%d') AS period,
       a.unweighted_aggressiveness_pct AS primary_unweighted_aggressiveness_pct,
       a.unweighted_aggressiveness_pct_sma AS primary_unweighted_aggressiveness_pct_sma,
       a.weighted_aggressiveness_pct_sma AS primary_weighted_aggressiveness_pct_sma,
       b.unweighted_aggressiveness_pct AS secondary_unweighted_aggressiveness_pct,
       b.unweighted_aggressiveness_pct_sma AS secondary_unweighted_aggressiveness_pct_sma,
       b.weighted_aggressiveness_pct_sma AS secondary_weighted_aggressiveness_pct_sma
FROM (SELECT * FROM trend WHERE language = '{P.languages[0]}') a
LEFT JOIN (SELECT * FROM trend WHERE language = '{P.languages[1]}') b USING (period)"""))
def q_trend_side_by_side(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    return flat(tr.side_by_side(weekly_trend(ctx), ctx.params.languages[0], ctx.params.languages[1]))


@register("event_overlay", with_views(DAILY_VIEWS + ("fx_intervals",), AGGR_BY_DAY_CTES, """
SELECT strftime(d.date, '%Y-%m-%d') AS date, d.language, i.event, d.aggressiveness_ratio
FROM daily_r d JOIN fx_intervals i ON d.date >= i.start_day AND d.date <= i.end_day
WHERE d.website = 'all'"""))
def q_event_overlay(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    d = daily(ctx).where(F.col("website") == ctx.params.all_scope) \
                  .select("date", "language", "aggressiveness_ratio")
    bands = tr.intervals_from_months(fx.interval_months(spark))
    return flat(tr.overlay(d, bands).select("date", "language", "event", "aggressiveness_ratio"))


# --------------------------------------------------------------------------- G7
@register("lexicon_frequency", with_views(("fx_lemmatized", "fx_lexicon"), f"""
lx AS (SELECT word, language, weight,
              CASE WHEN language IN ({LANGS}) THEN language ELSE '{P.languages[0]}' END AS lang_key
       FROM fx_lexicon),
toks AS (SELECT comment_lang, unnest(lemmas) AS lemma FROM fx_lemmatized WHERE comment_lang IN ({LANGS})),
counts AS (SELECT comment_lang, lemma, count(*) AS n FROM toks GROUP BY ALL)""", """
SELECT lx.word, lx.language, lx.weight, CAST(coalesce(c.n, 0) AS BIGINT) AS frequency
FROM lx LEFT JOIN counts c ON c.comment_lang = lx.lang_key AND c.lemma = lower(lx.word)"""))
def q_lexicon_frequency(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    return lx.lexicon_frequency(ctx.lemmatized, ctx.lexicon, ctx.params, lexicon_rows=ctx.lexicon_rows)


# --------------------------------------------------------------------------- G8 / U1
COVERED = {"articles": "fx_articles", "comments": "fx_comments", "predicted_comments": "fx_predictions"}
#: One block per table: rows, rows with a site, rows without one, the latter counted directly.
COVERAGE = [f"SELECT '{name}' AS tbl, sum(1) AS total, sum(CASE WHEN website IS NULL THEN 0 ELSE 1 END) AS populated,"
            f" sum(CASE WHEN website IS NULL THEN 1 ELSE 0 END) AS nulls FROM {view}" for name, view in COVERED.items()]


@register("site_coverage", with_views(tuple(COVERED.values()), "", "SELECT tbl, " + ", ".join(
    f"CAST({c} AS BIGINT) AS {c}" for c in ("total", "populated", "nulls")) + " FROM (" + " UNION ALL ".join(COVERAGE) + ")"))
def q_site_coverage(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    return ro.site_coverage({"articles": ctx.articles, "comments": ctx.comments,
                             "predicted_comments": ctx.predictions})


# --------------------------------------------------------------------------- P10
@register("lexicon_listing", with_views(("fx_lemmatized", "fx_lexicon"), f"""
lx AS (SELECT word, language, weight,
              CASE WHEN language IN ({LANGS}) THEN language ELSE '{P.languages[0]}' END AS lang_key
       FROM fx_lexicon),
toks AS (SELECT comment_lang, unnest(lemmas) AS lemma FROM fx_lemmatized WHERE comment_lang IN ({LANGS})),
counts AS (SELECT comment_lang, lemma, count(*) AS n FROM toks GROUP BY ALL),
fr AS (SELECT lx.word, lx.language, lx.weight, CAST(coalesce(c.n, 0) AS BIGINT) AS frequency
       FROM lx LEFT JOIN counts c ON c.comment_lang = lx.lang_key AND c.lemma = lower(lx.word))""", """
SELECT *, count(*) OVER (PARTITION BY language) AS words_in_language,
       CAST(row_number() OVER (PARTITION BY language ORDER BY word) AS INTEGER) AS position
FROM fr"""))
def q_lexicon_listing(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    return lx.listing(lx.lexicon_frequency(ctx.lemmatized, ctx.lexicon, ctx.params,
                                           lexicon_rows=ctx.lexicon_rows))


# --------------------------------------------------------------------------- J1 with a stored D7
@register("aggr_by_day_stored", AGGR_BY_DAY_SQL)
def q_aggr_by_day_stored(spark, sf_dir):
    """G1 over a written lemmatized table: lemmas are stored once (lineage cut in the
    shared checkpoint folder), then joined back to the comments (J1)."""
    from murmur.operators.text import lemmatize
    from murmur.session import scratch_path
    ctx = Ctx(spark, sf_dir)
    path = scratch_path(spark, "lemmatized")
    lemmatize(ctx.comments).write.mode("overwrite").parquet(path)
    stored = spark.read.parquet(path)
    joined = lx.join_comments(stored, ctx.comments, ctx.params)
    return flat(ro.aggressiveness_by_day(joined, ctx.lexicon, ctx.params, ctx.lexicon_rows))


# --------------------------------------------------------------------------- G5, T9 compatibility
@register("aggr_by_period_compat", with_views(DAILY_VIEWS, AGGR_BY_DAY_CTES + """,
wc AS (
  SELECT language, CAST(date_trunc('week', date) AS DATE) AS period,
         CAST(sum(aggressive_word_count) AS BIGINT) AS aggressive_word_count,
         CAST(sum(aggressive_word_weight_sum) AS DOUBLE) AS aggressive_word_weight_sum,
         CAST(sum(total_word_count) AS BIGINT) AS total_word_count
  FROM daily GROUP BY ALL
)""", """
SELECT language, strftime(period, '%Y-%m-%d') AS period, aggressive_word_count, aggressive_word_weight_sum,
       total_word_count,
       CASE WHEN total_word_count > 0 THEN aggressive_word_count / total_word_count * 100.0 ELSE 0.0 END
         AS unweighted_aggressiveness_pct,
       CASE WHEN total_word_count > 0 THEN aggressive_word_weight_sum / total_word_count * 100.0 ELSE 0.0 END
         AS weighted_aggressiveness_pct
FROM wc"""))
def q_aggr_by_period_compat(spark, sf_dir):
    """G5 with the original behaviour: every site row and the all row are summed."""
    ctx = Ctx(spark, sf_dir)
    return flat(ro.aggressiveness_by_period(daily(ctx), *FULL_RANGE, "week", ctx.params, compat_all_sites=True))


# --------------------------------------------------------------------------- G5, G6 over a part of the days
PART_RANGE = ("2024-02-07", "2024-04-20")
IN_RANGE = f"date BETWEEN DATE '{PART_RANGE[0]}' AND DATE '{PART_RANGE[1]}'"


@register("aggr_by_period_range", with_views(DAILY_VIEWS, PERIOD_CTES.replace("FROM daily WHERE website = 'all'", f"FROM daily WHERE website = 'all' AND {IN_RANGE}"), """
SELECT language, strftime(period, '%Y-%m-%d') AS period, aggressive_word_count, aggressive_word_weight_sum,
       total_word_count, unweighted_aggressiveness_pct, weighted_aggressiveness_pct
FROM wk_p"""))
def q_aggr_by_period_range(spark, sf_dir):
    """G5 over days that begin and end inside a week."""
    ctx = Ctx(spark, sf_dir)
    return flat(ro.aggressiveness_by_period(daily(ctx), *PART_RANGE, "week", ctx.params))


@register("aggr_by_period_site_range", with_views(DAILY_VIEWS, SITE_CTES.replace("FROM daily WHERE website IN", f"FROM daily WHERE {IN_RANGE} AND website IN"), """
SELECT language, website, strftime(period, '%Y-%m-%d') AS period, unweighted_aggressiveness_pct FROM mo_p"""))
def q_aggr_by_period_site_range(spark, sf_dir):
    """G6 over days that begin and end inside a month."""
    ctx = Ctx(spark, sf_dir)
    return flat(ro.aggressiveness_by_period_site(daily(ctx), *PART_RANGE, "month", ctx.params))
