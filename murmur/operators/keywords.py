"""Keyword detail (K1, K4-K8) and its client-side views.

All of it is aggregation over the lexicon-hits fact (one row per match).
Maps (forms histogram, article id sets) of the stored D9 table are built
only at the output edge by ``keywords_day_maps``; queries stay flat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions.periods import date_between
from murmur.functions.select import lang_selector
from murmur.operators.lexicon import lexicon_hits
from murmur.params import Params

SCOPE_KEYS = ("date", "language", "website")


def _scoped(df: DataFrame, params: Params) -> DataFrame:
    """site → listed site or NULL; the NULL rows only feed the ``all`` scope."""
    return df.withColumn("_site", F.when(F.col("website").isin(list(params.sites)), F.col("website")))


def _scope_sets(df: DataFrame, extra: tuple[str, ...], aggs, params: Params) -> DataFrame:
    """Per listed site and per ``all`` (every row) in one grouping-set aggregate."""
    g = (df.groupingSets([["date", "language", "_site", *extra], ["date", "language", *extra]],
                         "date", "language", "_site", *extra)
         .agg(*aggs, F.grouping("_site").alias("_g")))
    g = g.where((F.col("_g") == 1) | F.col("_site").isNotNull())
    return g.withColumn("website", F.when(F.col("_g") == 1, F.lit(params.all_scope))
                        .otherwise(F.col("_site"))).drop("_g", "_site")


def hits_fact(lemmatized: DataFrame, lexicon: DataFrame, params: Params,
              lexicon_rows: int | None = None) -> DataFrame:
    """Lexicon hits of listed languages with date, language, site and article."""
    src = (lemmatized.where(F.col("comment_lang").isin(list(params.languages)))
           .select("comment_id", "lemmas", "words", "article_id", "website",
                   F.col("day").alias("date"), F.col("comment_lang").alias("language")))
    return lexicon_hits(src, lexicon, keep=("date", "language", "website", "article_id"),
                        lexicon_rows=lexicon_rows)


def scope_totals(lemmatized: DataFrame, params: Params) -> DataFrame:
    """Total words per (date, language, scope); scopes with no words are dropped."""
    src = (lemmatized.where(F.col("comment_lang").isin(list(params.languages)))
           .select(F.col("day").alias("date"), F.col("comment_lang").alias("language"),
                   "website", "lemma_count"))
    t = _scope_sets(_scoped(src, params), (), [F.sum("lemma_count").alias("total_word_count")], params)
    return t.where(F.col("total_word_count") > 0)


def keywords_by_day(lemmatized: DataFrame, lexicon: DataFrame, params: Params,
                    lexicon_rows: int | None = None) -> DataFrame:
    """K1 flat: one row per (date, language, scope, word); a scope-day with words
    but no hit keeps one row with NULL word and zero measures.

    One pass over the text: each comment is exploded with a marker at
    position 0 that carries its word count, the tokens are probed against
    the broadcast lexicon, and only markers and hits go on.  One grouping-set
    aggregate yields both the per-word measures and the per-scope totals
    (NULL word); a window over that small output attaches the totals.
    """
    from murmur.operators.lexicon import _lex
    src = (lemmatized.where(F.col("comment_lang").isin(list(params.languages)))
           .select(F.col("day").alias("date"), F.col("comment_lang").alias("language"), "website",
                   "article_id", "lemma_count",
                   F.posexplode_outer(F.concat(F.array(F.lit(None).cast("string")), F.col("lemmas")))
                   .alias("pos", "_lemma")))
    j = src.join(_lex(lexicon, lexicon_rows), "_lemma", "left")
    rows = j.where((F.col("pos") == 0) | F.col("_weight").isNotNull()).select(
        "date", "language", "website", "article_id",
        F.when(F.col("pos") > 0, F.col("_lemma")).alias("word"),
        F.when(F.col("pos") == 0, F.col("lemma_count").cast("long")).otherwise(F.lit(0).cast("long")).alias("_t"),
        F.col("_weight").alias("weight"))
    hit = F.col("word").isNotNull()
    g = _scope_sets(_scoped(rows, params), ("word",),
                    [F.count(F.when(hit, 1)).alias("count"),
                     F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight_sum"),
                     F.count_distinct(F.when(hit, F.col("article_id"))).alias("article_count"),
                     F.sum("_t").alias("_total")], params)
    scope = Window.partitionBy(*SCOPE_KEYS)
    g = (g.withColumn("total_word_count", F.max(F.when(F.col("word").isNull(), F.col("_total"))).over(scope))
          .withColumn("_words", F.count("word").over(scope)))
    out = g.where((F.col("total_word_count") > 0) & (F.col("word").isNotNull() | (F.col("_words") == 0)))
    return out.select(*SCOPE_KEYS, "word", "count", "weight_sum", "article_count", "total_word_count")


def keyword_forms_by_day(hits: DataFrame, params: Params) -> DataFrame:
    """K1 forms histogram, flat: (date, language, scope, word, form, count)."""
    f = _scope_sets(_scoped(hits, params), ("lemma", "form"), [F.count(F.lit(1)).alias("count")], params)
    return f.select(*SCOPE_KEYS, F.col("lemma").alias("word"), "form", "count")


def keywords_day_maps(lemmatized: DataFrame, hits: DataFrame, params: Params) -> DataFrame:
    """D9 shape: keywords_json map<word, struct<count, weight_sum, article_count,
    article_ids, forms>> per (date, language, scope), plus total words.

    Built from the flat facts; article id sets are bounded by articles per day.
    """
    sc = _scoped(hits, params)
    words = _scope_sets(sc, ("lemma",),
                        [F.count(F.lit(1)).alias("count"), F.sum("weight").alias("weight_sum"),
                         F.array_sort(F.collect_set("article_id")).alias("article_ids")], params)
    forms = _scope_sets(sc, ("lemma", "form"), [F.count(F.lit(1)).alias("n")], params) \
        .groupBy(*SCOPE_KEYS, "lemma").agg(F.map_from_entries(F.collect_list(F.struct("form", "n"))).alias("forms"))
    w = words.join(forms, [*SCOPE_KEYS, "lemma"], "left")
    entry = F.struct(F.col("lemma").alias("key"), F.struct(
        "count", "weight_sum", F.size("article_ids").cast("long").alias("article_count"),
        "article_ids", "forms").alias("value"))
    per_scope = w.groupBy(*SCOPE_KEYS).agg(F.map_from_entries(F.collect_list(entry)).alias("keywords_json"))
    totals = scope_totals(lemmatized, params)
    return (totals.join(per_scope, list(SCOPE_KEYS), "left")
            .withColumn("keywords_json", F.coalesce("keywords_json", F.create_map().cast(
                per_scope.schema["keywords_json"].dataType))))


def live_day_counts(lemmatized: DataFrame, lexicon: DataFrame, params: Params, lang: str | None = None,
                    day=None, lexicon_rows: int | None = None) -> DataFrame:
    """Live count of lexicon words per day with the language selector."""
    src = lemmatized.where(lang_selector("comment_lang", lang, params))
    if day is not None:
        src = src.where(F.col("day") == F.lit(str(day)).cast("date"))
    h = lexicon_hits(src.select("comment_id", "lemmas", "words", "day"), lexicon, keep=("day",),
                     lexicon_rows=lexicon_rows)
    return (h.groupBy("day", F.col("lemma").alias("word"), F.col("lexicon_language").alias("language"), "weight")
            .agg(F.count(F.lit(1)).alias("count")))


def ranked_day_detail(by_day: DataFrame, website: str = "all") -> DataFrame:
    """K5: stored day detail of one scope, ranked by count desc then word."""
    w = Window.partitionBy("date", "language").orderBy(F.desc("count"), F.asc("word"))
    return (by_day.where((F.col("website") == website) & F.col("word").isNotNull())
            .withColumn("rank", F.row_number().over(w)))


def keywords_by_period(hits: DataFrame, start, end, params: Params, website: str | None = None,
                       lang: str | None = None) -> DataFrame:
    """K6: merge over a date range: sums, and distinct articles across days (U4).

    ``website`` None or ``all`` = every row (the ``all`` scope of K1).
    """
    h = hits.where(date_between("date", start, end))
    if lang is not None:
        h = h.where(F.col("language") == lang)
    if website and website != params.all_scope:
        h = h.where(F.col("website") == website)
    return (h.groupBy("language", F.col("lemma").alias("word"))
            .agg(F.count(F.lit(1)).alias("count"), F.sum("weight").alias("weight_sum"),
                 F.count_distinct("article_id").alias("article_count")))


def keyword_forms_by_period(hits: DataFrame, start, end, params: Params, website: str | None = None) -> DataFrame:
    h = hits.where(date_between("date", start, end))
    if website and website != params.all_scope:
        h = h.where(F.col("website") == website)
    return h.groupBy("language", F.col("lemma").alias("word"), "form").agg(F.count(F.lit(1)).alias("count"))


def keyword_dates(by_day: DataFrame) -> DataFrame:
    """K7: dates that have detail per (language, scope); distinct."""
    return by_day.select("language", "website", "date").distinct()


def keyword_articles(hits: DataFrame, articles: DataFrame, start, end, params: Params,
                     website: str | None = None, lemma: str | None = None) -> DataFrame:
    """Articles behind each word in a range (semi-join on hit article ids)."""
    h = hits.where(date_between("date", start, end))
    if website and website != params.all_scope:
        h = h.where(F.col("website") == website)
    if lemma is not None:
        h = h.where(F.col("lemma") == lemma)
    ids = h.select("language", F.col("lemma").alias("word"), "article_id").distinct()
    return ids.join(articles.select("article_id", "headline", "url", "website", "pub_day"), "article_id")


def first_articles(word_articles: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` articles per word, newest first, NULL dates first."""
    w = Window.partitionBy("language", "word").orderBy(F.col("pub_day").desc_nulls_first(), "article_id")
    return word_articles.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def top_keywords(period: DataFrame, n: int | None = 25, min_count: int = 0, by: str = "count") -> DataFrame:
    """Min-count filter, order by count (or weight_sum) desc, keep top ``n`` per language."""
    w = Window.partitionBy("language").orderBy(F.desc(by), F.asc("word"))
    out = period.where(F.col("count") >= min_count).withColumn("rank", F.row_number().over(w))
    return out if n is None else out.where(F.col("rank") <= n)


def cloud_scale(top: DataFrame, by: str = "count", lo: int = 14, hi: int = 70) -> DataFrame:
    """Min-max scale of the kept words to font sizes lo..hi (span 0 → 1)."""
    w = Window.partitionBy("language")
    mn, mx = F.min(by).over(w), F.max(by).over(w)
    span = F.when(mx - mn == 0, F.lit(1)).otherwise(mx - mn)
    size = F.round(F.lit(float(lo)) + (F.col(by) - mn) / span * F.lit(float(hi - lo)), 0).cast("int")
    return top.withColumn("size", size)


def ranked_forms(forms: DataFrame) -> DataFrame:
    """Surface forms of each word ranked by count desc (ties by form)."""
    w = Window.partitionBy("language", "word").orderBy(F.desc("count"), F.asc("form"))
    return forms.withColumn("rank", F.row_number().over(w))


def flatten_day_maps(stored: DataFrame) -> DataFrame:
    """Read side of the stored D9 maps: one row per (date, language, scope, word)."""
    e = stored.select(*SCOPE_KEYS, "total_word_count", F.explode("keywords_json").alias("word", "v"))
    return e.select(*SCOPE_KEYS, "word", F.col("v.count").alias("count"), F.col("v.weight_sum").alias("weight_sum"),
                    F.col("v.article_count").alias("article_count"),
                    F.size(F.map_keys("v.forms")).alias("n_forms"), "total_word_count")


def period_from_day_maps(stored: DataFrame, start, end, website: str = "all", lang: str | None = None) -> DataFrame:
    """K6 over stored D9 maps: sums of counts and weights, union of article ids (U4)."""
    s = stored.where(date_between("date", start, end) & (F.col("website") == website))
    if lang is not None:
        s = s.where(F.col("language") == lang)
    e = s.select("language", F.explode("keywords_json").alias("word", "v"))
    sums = e.groupBy("language", "word").agg(F.sum("v.count").alias("count"), F.sum("v.weight_sum").alias("weight_sum"))
    ids = e.select("language", "word", F.explode_outer("v.article_ids").alias("article_id")) \
           .groupBy("language", "word").agg(F.count_distinct("article_id").alias("article_count"))
    return sums.join(ids, ["language", "word"])
