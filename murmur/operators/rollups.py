"""Daily rollups and period series.

G1+G2 is one scan: tokens are probed against the broadcast lexicon inside the
scan stage, three additive measures are partially aggregated map-side and one
shuffle on (date, language, site) finishes the sums.  The ``all`` scope comes
from a grouping set (Expand) in the same aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.functions.periods import date_between, rollup_period
from murmur.operators.lexicon import token_measures
from murmur.params import Params

ROLLUP_KEYS = ("date", "language", "website")


def _ratio(num, den):
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def _pct(num, den):
    return F.when(den > 0, num / den * F.lit(100.0)).otherwise(F.lit(0.0))


def aggressiveness_by_day(lemmatized: DataFrame, lexicon: DataFrame, params: Params,
                          lexicon_rows: int | None = None) -> DataFrame:
    """G1+G2 → D8 rows (date, language, website, counts, fraction ratios).

    ``lemmatized`` has day, comment_lang, website, lemmas, lemma_count.
    Only listed languages and sites count; ``all`` sums the listed sites.
    """
    src = (lemmatized
           .where(F.col("comment_lang").isin(list(params.languages))
                  & F.col("website").isin(list(params.sites)))
           .select(F.col("day").alias("date"), F.col("comment_lang").alias("language"),
                   "website", "lemmas", "lemma_count"))
    m = token_measures(src, lexicon, ROLLUP_KEYS, lexicon_rows)
    g = m.groupingSets([["date", "language", "website"], ["date", "language"]],
                       "date", "language", "website").agg(
        F.sum("m_hit").alias("aggressive_word_count"),
        F.sum("m_weight").alias("aggressive_word_weight_sum"),
        F.sum("m_total").alias("total_word_count"),
        F.grouping("website").alias("_g"))
    return g.select(
        "date", "language",
        F.when(F.col("_g") == 1, F.lit(params.all_scope)).otherwise(F.col("website")).alias("website"),
        "aggressive_word_count", "aggressive_word_weight_sum", "total_word_count",
        _ratio(F.col("aggressive_word_count"), F.col("total_word_count")).alias("aggressiveness_ratio"),
        _ratio(F.col("aggressive_word_weight_sum"), F.col("total_word_count")).alias("weighted_aggressiveness_ratio"),
    )


def insert_missing(new_rows: DataFrame, target: DataFrame, keys=ROLLUP_KEYS) -> DataFrame:
    """Rows of ``new_rows`` whose key is absent from ``target`` (insert-only mode)."""
    return new_rows.join(target.select(*keys).distinct(), list(keys), "left_anti")


def recompute_days(new_rows: DataFrame, target: DataFrame, touched: DataFrame,
                   keys=ROLLUP_KEYS) -> DataFrame:
    """T22 default: drop the touched dates from the target and take them from ``new_rows``."""
    kept = target.join(touched.select("date").distinct(), "date", "left_anti")
    fresh = new_rows.join(touched.select("date").distinct(), "date", "left_semi")
    return kept.unionByName(fresh)


def month_worklist(comments: DataFrame, params: Params, ts_col: str = "timestamp",
                   lang_col: str = "comment_lang") -> DataFrame:
    """Per language every calendar month from the first to the last, with counts.

    The month list is generated from min/max (no driver loop); a month with
    no rows gets 0.
    """
    c = comments.where(F.col(lang_col).isin(list(params.languages))) \
                .select(F.col(lang_col).alias("language"),
                        F.trunc(F.col(ts_col).cast("date"), "month").alias("month"))
    counts = c.groupBy("language", "month").agg(F.count(F.lit(1)).alias("n_comments"))
    bounds = counts.groupBy("language").agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    months = bounds.select("language", F.explode(F.sequence("lo", "hi", F.expr("interval 1 month")))
                           .alias("month"))
    return (months.join(counts, ["language", "month"], "left")
            .select("language", "month", F.coalesce("n_comments", F.lit(0)).alias("n_comments")))


def _period_sums(daily: DataFrame, keys: list[str], grain: str) -> DataFrame:
    return (daily.withColumn("period", rollup_period("date", grain))
            .groupBy(*keys, "period")
            .agg(F.sum("aggressive_word_count").alias("aggressive_word_count"),
                 F.sum("aggressive_word_weight_sum").alias("aggressive_word_weight_sum"),
                 F.sum("total_word_count").alias("total_word_count")))


def aggressiveness_by_period(daily: DataFrame, start, end, grain: str, params: Params,
                             language: str | None = None, compat_all_sites: bool = False) -> DataFrame:
    """Sums per (language, period), ratios in percent.

    By default only the ``all`` rows are summed; ``compat_all_sites=True``
    sums every site row as the reference does (T9 doubles the three sums).
    """
    d = daily.where(date_between("date", start, end))
    if language is not None:
        d = d.where(F.col("language") == language)
    if not compat_all_sites:
        d = d.where(F.col("website") == params.all_scope)
    s = _period_sums(d, ["language"], grain)
    return s.select("language", "period", "aggressive_word_count", "aggressive_word_weight_sum",
                    "total_word_count",
                    _pct(F.col("aggressive_word_count"), F.col("total_word_count")).alias("unweighted_aggressiveness_pct"),
                    _pct(F.col("aggressive_word_weight_sum"), F.col("total_word_count")).alias("weighted_aggressiveness_pct"))


def aggressiveness_by_period_site(daily: DataFrame, start, end, grain: str, params: Params) -> DataFrame:
    """Per (language, listed site, period), unweighted percent only."""
    d = daily.where(date_between("date", start, end)
                    & F.col("language").isin(list(params.languages))
                    & F.col("website").isin(list(params.sites)))
    s = _period_sums(d, ["language", "website"], grain)
    return s.select("language", "website", "period",
                    _pct(F.col("aggressive_word_count"), F.col("total_word_count")).alias("unweighted_aggressiveness_pct"))


def site_coverage(tables: dict[str, DataFrame], col: str = "website") -> DataFrame:
    """Per table total, populated and NULL counts of ``col``."""
    parts = [df.agg(F.lit(name).alias("tbl"), F.count(F.lit(1)).alias("total"),
                    F.count(col).alias("populated"))
             for name, df in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.withColumn("nulls", F.col("total") - F.col("populated"))


def aggressiveness_from_tokens(tokens: DataFrame, lexicon: DataFrame, params: Params, lexicon_rows: int | None = None) -> DataFrame:
    """G1+G2 from the long form (date, language, website, lemma): the same rows as ``aggressiveness_by_day``.

    A token counts one word, so the totals need no array of the comment's words.
    """
    from murmur.operators.lexicon import _lex
    t = tokens.where(F.col("language").isin(list(params.languages)) & F.col("website").isin(list(params.sites)))
    j = t.select(*ROLLUP_KEYS, F.col("lemma").alias("_lemma")).join(_lex(lexicon, lexicon_rows), "_lemma", "left")
    g = j.groupingSets([["date", "language", "website"], ["date", "language"]], "date", "language", "website").agg(
        F.count("_weight").alias("aggressive_word_count"), F.coalesce(F.sum("_weight"), F.lit(0.0)).alias("aggressive_word_weight_sum"),
        F.count(F.lit(1)).alias("total_word_count"), F.grouping("website").alias("_g"))
    return g.select(
        "date", "language", F.when(F.col("_g") == 1, F.lit(params.all_scope)).otherwise(F.col("website")).alias("website"),
        "aggressive_word_count", "aggressive_word_weight_sum", "total_word_count",
        _ratio(F.col("aggressive_word_count"), F.col("total_word_count")).alias("aggressiveness_ratio"),
        _ratio(F.col("aggressive_word_weight_sum"), F.col("total_word_count")).alias("weighted_aggressiveness_ratio"))
