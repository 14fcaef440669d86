
from pyspark.sql import functions as F

import __spark_entry__ as E
from murmur.operators import keywords as kw
from murmur.operators import rollups as ro
from murmur.plans.registry import Ctx
from tests.conftest import SF_SMALL


def test_sites_sum_to_all(spark):
    d = E.queries()["aggr_by_day"](spark, SF_SMALL)
    sites = d.where("website <> 'all'").groupBy("date", "language").agg(
        F.sum("aggressive_word_count").alias("c"), F.sum("total_word_count").alias("t"),
        F.sum("aggressive_word_weight_sum").alias("w"))
    alls = d.where("website = 'all'").select("date", "language", F.col("aggressive_word_count").alias("c"),
                                            F.col("total_word_count").alias("t"),
                                            F.col("aggressive_word_weight_sum").alias("w"))
    assert sites.exceptAll(alls).count() == 0 and alls.exceptAll(sites).count() == 0


def test_emotion_shares_sum_to_one(spark):
    s = E.queries()["emotion_share"](spark, SF_SMALL)
    sums = s.groupBy("language", "period").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r.s - 1.0) < 1e-9 for r in sums)


def test_period_merge_of_one_day_equals_day_detail(spark):
    ctx = Ctx(spark, SF_SMALL)
    h = kw.hits_fact(ctx.lemmatized, ctx.lexicon, ctx.params, ctx.lexicon_rows)
    day = h.select(F.min("date")).first()[0]
    one = kw.keywords_by_period(h, day, day, ctx.params).select("language", "word", "count", "article_count")
    k5 = (kw.keywords_by_day(ctx.lemmatized, ctx.lexicon, ctx.params, ctx.lexicon_rows)
          .where((F.col("date") == F.lit(day)) & (F.col("website") == "all") & F.col("word").isNotNull())
          .select("language", "word", "count", "article_count"))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, k5.collect()))


def test_period_merge_splits(spark):
    ctx = Ctx(spark, SF_SMALL)
    h = kw.hits_fact(ctx.lemmatized, ctx.lexicon, ctx.params, ctx.lexicon_rows)
    whole = kw.keywords_by_period(h, "2024-01-01", "2024-12-31", ctx.params)
    a = kw.keywords_by_period(h, "2024-01-01", "2024-03-01", ctx.params)
    b = kw.keywords_by_period(h, "2024-03-02", "2024-12-31", ctx.params)
    merged = a.unionByName(b).groupBy("language", "word").agg(F.sum("count").alias("count"))
    assert sorted(map(tuple, whole.select("language", "word", "count").collect())) == \
        sorted(map(tuple, merged.collect()))
    # article counts are distinct across days, so they do not add up in general
    assert whole.agg(F.sum("article_count")).first()[0] <= \
        a.unionByName(b).agg(F.sum("article_count")).first()[0]


def test_incremental_halves_equal_one_run(spark):
    ctx = Ctx(spark, SF_SMALL)
    full = ro.aggressiveness_by_day(ctx.lemmatized, ctx.lexicon, ctx.params, ctx.lexicon_rows)
    first = ro.aggressiveness_by_day(ctx.lemmatized.where("day < date'2024-03-01'"), ctx.lexicon, ctx.params, 9)
    both = first.unionByName(ro.insert_missing(full, first))
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, full.collect()))


def test_lexicon_case_rules_differ(spark):
    """T16: 'Der' never matches lower-cased lemmas in hits, but counts in frequencies."""
    q = E.queries()
    freq = {r.word: r.frequency for r in q["lexicon_frequency"](spark, SF_SMALL).collect()}
    hits = {r.word for r in q["keywords_by_period"](spark, SF_SMALL).collect()}
    assert "Der" not in hits
    ctx = Ctx(spark, SF_SMALL)
    der = (ctx.lemmatized.where("comment_lang = 'de'").select(F.explode("lemmas").alias("t"))
           .where("t = 'der'").count())
    assert freq["Der"] == der


def test_k1_k6_forms_articles_and_days(spark):
    """FIXTURES §3: one word in two forms, two articles, two days sharing one article."""
    import datetime as dt
    from murmur.operators.text import lemmatize
    from murmur.params import Params
    p = Params(languages=("en",), sites=("s",))
    comments = spark.createDataFrame([
        (1, 1, "s", dt.date(2024, 1, 1), "en", "Cats cat"),
        (2, 1, "s", dt.date(2024, 1, 2), "en", "cat"),
        (3, 2, "s", dt.date(2024, 1, 2), "en", "cat dog"),
    ], "id long, article_id long, website string, day date, comment_lang string, comment_text string")
    table = spark.createDataFrame([("en", "cats", "cat")], "language string, form string, lemma string")
    lm = lemmatize(comments, table, keep=("article_id", "website", "day", "comment_lang"), lemma_rows_bound=1)
    lex = spark.createDataFrame([("cat", "en", 0.5)], "word string, language string, weight double")
    hits = kw.hits_fact(lm, lex, p, 1)
    period = kw.keywords_by_period(hits, "2024-01-01", "2024-01-02", p).collect()
    assert [(r.word, r["count"], r.weight_sum, r.article_count) for r in period] == [("cat", 4, 2.0, 2)]
    forms = {r.form: r["count"] for r in kw.keyword_forms_by_period(hits, "2024-01-01", "2024-01-02", p).collect()}
    assert forms == {"cats": 1, "cat": 3}
    maps = {(r.date.day, r.website): r for r in kw.keywords_day_maps(lm, hits, p).collect()}
    day1 = maps[(1, "all")].keywords_json["cat"]
    assert (day1["count"], day1["article_ids"], dict(day1["forms"])) == (2, [1], {"cats": 1, "cat": 1})
    day2 = maps[(2, "s")].keywords_json["cat"]
    assert (day2["count"], day2["article_count"], maps[(2, "s")].total_word_count) == (2, 2, 3)
    stored = kw.period_from_day_maps(kw.keywords_day_maps(lm, hits, p), "2024-01-01", "2024-01-02").collect()
    assert [(r.word, r["count"], r.article_count) for r in stored] == [("cat", 4, 2)]
