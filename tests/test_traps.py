
import datetime as dt

import pytest
from pyspark.sql import functions as F

from murmur.functions.periods import chart_period_label, month_range
from murmur.functions.select import percent_2dp
from murmur.functions.sites import resolve_portal, resolve_site
from murmur.operators import emotions as em
from murmur.operators import keywords as kw
from murmur.operators import rollups as ro
from murmur.params import Params


def test_t2_two_site_resolvers_differ(spark):
    urls = ["https://www.delfi.lv/1", "https://tvnet.lv/delfi/2", "https://APOLLO.lv/3",
            "https://rus.tvnet.lv/4", "https://example.org/5"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [(r.p, r.s) for r in df.select(resolve_portal("url").alias("p"), resolve_site("url").alias("s")).collect()]
    assert got == [("delfi", "delfi"), ("delfi", "tvnet"), ("other", "apollo"), ("tvnet", "tvnet"),
                   ("other", "tvnet")]


def test_t4_half_even_percent(spark):
    df = spark.createDataFrame([(0.28125,), (0.28135,), (0.5,)], "s double")
    got = [r[0] for r in df.select(percent_2dp("s")).collect()]
    # 28.125 is exact: half-even gives 28.12 (half-up would give 28.13); 0.28135*100 is 28.13499…
    assert got == [28.12, 28.13, 50.0]


def _pred(spark, rows):
    return spark.createDataFrame(
        rows, "id long, comment_id long, article_id long, comment_timestamp timestamp_ntz, "
              "ekman_prediction_emotion string, text_lang string, ekman_prediction_score double, "
              "website string, text string")


def _ts(s):
    return dt.datetime.fromisoformat(s)


P2 = Params(languages=("lv", "ru"), prediction_types=("ekman",))


def test_t5_t13_t14_dense_shares_and_totals(spark):
    rows = [
        (1, 1, 10, _ts("2024-01-05"), "joy", "lv", 0.5, "a", "x"),
        (2, 2, 10, _ts("2024-01-06"), "joy", "lv", 0.5, "a", "x"),
        (3, 3, 11, _ts("2024-02-01"), None, "lv", 0.5, "a", "x"),     # NULL emotion
        (4, 4, 10, _ts("2024-02-02"), "anger", "ru", 0.5, "a", "x"),  # article 10 in both languages
        (5, 5, 12, _ts("2024-01-09"), "fear", "ru", 0.5, "a", "x"),
    ]
    r = em.chart_rows(_pred(spark, rows), "ekman", "month", P2, "2024-01", "2024-02")
    dense = {(x.language, x.period, x.emotion): x["count"] for x in em.densify(em.emotion_counts(r)).collect()}
    # lv has only joy; periods of lv with a non-NULL label: 2024-01 only (T13 drops the NULL row)
    assert dense[("lv", "2024-01", "joy")] == 2
    assert ("lv", "2024-02", "joy") not in dense
    # ru: anger × {01, 02}, fear × {01, 02}, missing cells are 0 (T5)
    assert dense[("ru", "2024-01", "anger")] == 0 and dense[("ru", "2024-02", "fear")] == 0
    overall = {(x.language, x.emotion): x.share for x in em.overall_share(r).collect()}
    assert overall[("lv", "joy")] == pytest.approx(2 / 3)        # NULL row stays in the denominator
    cnt = {(x.language, x.period): (x.unique_articles, x.total_comments)
           for x in em.comment_article_counts(r).collect()}
    # article 10 commented in lv (Jan) and ru (Feb); Jan total = lv 1 + ru 1 distinct
    assert cnt[("total", "2024-01")] == (2, 3)
    tot = em.combined_block(em.emotion_counts(r)).collect()
    share_sum = {}
    for x in tot:
        share_sum[x.period] = share_sum.get(x.period, 0) + x.share
    assert all(abs(v - 1.0) < 1e-12 for v in share_sum.values())


def test_t6_desc_nulls_first(spark):
    df = spark.createDataFrame([("lv", "w", 1, dt.date(2024, 1, 2)), ("lv", "w", 2, None),
                                ("lv", "w", 3, dt.date(2024, 1, 5))],
                               "language string, word string, article_id long, pub_day date")
    got = [r.article_id for r in kw.first_articles(df, 10).orderBy("rank").collect()]
    assert got == [2, 3, 1]


def _daily(spark):
    return spark.createDataFrame([
        (dt.date(2024, 1, 1), "lv", "a", 1, 1.0, 10),
        (dt.date(2024, 1, 1), "lv", "b", 3, 1.5, 30),
        (dt.date(2024, 1, 1), "lv", "all", 4, 2.5, 40),
    ], "date date, language string, website string, aggressive_word_count long, "
       "aggressive_word_weight_sum double, total_word_count long")


def test_t9_period_series_compat_doubles_sums(spark):
    p = Params(languages=("lv",), sites=("a", "b"))
    d = _daily(spark)
    fixed = ro.aggressiveness_by_period(d, "2024-01-01", "2024-01-31", "month", p).collect()[0]
    compat = ro.aggressiveness_by_period(d, "2024-01-01", "2024-01-31", "month", p, compat_all_sites=True).collect()[0]
    assert fixed.total_word_count == 40 and compat.total_word_count == 80
    assert fixed.unweighted_aggressiveness_pct == pytest.approx(10.0)
    assert compat.unweighted_aggressiveness_pct == pytest.approx(10.0)   # ratios unaffected (T20: percent)


def test_t10_all_scope_differs_between_g2_and_k1(spark):
    p = Params(languages=("lv",), sites=("a",))
    lm = spark.createDataFrame([
        (1, 7, "a", dt.date(2024, 1, 1), "lv", ["bad", "x"], ["bad", "x"]),
        (2, 8, None, dt.date(2024, 1, 1), "lv", ["bad"], ["bad"]),
        (3, 9, "zz", dt.date(2024, 1, 1), "lv", ["y"], ["y"]),
    ], "comment_id long, article_id long, website string, day date, comment_lang string, "
       "lemmas array<string>, words array<string>").withColumn("lemma_count", F.size("lemmas"))
    lex = spark.createDataFrame([("bad", "lv", 1.0)], "word string, language string, weight double")
    g = {r.website: (r.aggressive_word_count, r.total_word_count)
         for r in ro.aggressiveness_by_day(lm, lex, p, 1).collect()}
    assert g == {"a": (1, 2), "all": (1, 2)}                  # G2: listed sites only
    h = kw.hits_fact(lm, lex, p, 1)
    k = {(r.website, r.word): (r["count"], r.total_word_count) for r in kw.keywords_by_day(lm, lex, p, 1).collect()}
    assert k[("all", "bad")] == (2, 4)                           # K1: every row
    assert k[("a", "bad")] == (1, 2)


def test_t11_keyword_dates_distinct(spark):
    df = spark.createDataFrame([("lv", "all", dt.date(2024, 1, 1), "a"), ("lv", "all", dt.date(2024, 1, 1), "b")],
                               "language string, website string, date date, word string")
    assert kw.keyword_dates(df).count() == 1


def test_t12_allowed_months_partial_first_month(spark):
    rows = [(1, 1, 1, _ts("2020-01-15"), "joy", "lv", 0.1, "a", "x"),
            (2, 2, 1, _ts("2020-03-02"), "joy", "lv", 0.1, "a", "x")]
    p = _pred(spark, rows)
    got = [r.month for r in em.allowed_months(p).orderBy("month").collect()]
    assert got == ["2020-02", "2020-03"]
    first = em.allowed_months(p).first()
    assert (first.min_month, first.max_month) == ("2020-01", "2020-03")
    assert [r.month for r in em.allowed_months(p, include_partial=True).orderBy("month").collect()][0] == "2020-01"
    one = _pred(spark, [(1, 1, 1, _ts("2020-01-15"), "joy", "lv", 0.1, "a", "x")])
    assert em.allowed_months(one).count() == 0                 # within one month, not on its first day


def test_e8_week_labels(spark):
    df = spark.createDataFrame([(_ts("2024-01-07"),), (_ts("2024-01-08"),), (_ts("2021-01-01"),)], "t timestamp_ntz")
    got = [r[0] for r in df.select(chart_period_label("t", "week")).collect()]
    # Sunday 2024-01-07 → Monday 2024-01-01 → label Tuesday 2023-12-26; Monday 01-08 → 2024-01-02;
    # Friday 2021-01-01 → Monday 2020-12-28 → 2020-12-22
    assert got == ["2023-12-26", "2024-01-02", "2020-12-22"]


def test_p5_month_range_clamps_start(spark):
    df = spark.createDataFrame([(_ts("2024-03-31 23:59:59"),), (_ts("2024-04-01"),), (_ts("2024-02-29"),)],
                               "t timestamp_ntz")
    got = [r[0] for r in df.select(month_range("t", "2024-05", "2024-03")).collect()]
    assert got == [True, False, False]


def test_t18_empty_emotion_drops_nulls(spark):
    from murmur.operators.emotion_keywords import emotion_documents
    p = _pred(spark, [(1, 1, 1, _ts("2024-01-01"), None, "lv", 0.1, "a", "x"),
                      (2, 2, 1, _ts("2024-01-01"), "", "lv", 0.1, "a", "x"),
                      (3, 3, 1, _ts("2024-01-01"), "joy", "lv", 0.1, "a", "x")])
    lm = spark.createDataFrame([(1, ["a"]), (2, ["b"]), (3, ["c"])], "comment_id long, lemmas array<string>")
    assert [r.comment_id for r in emotion_documents(p, lm, "ekman", ["lv"]).collect()] == [3]


def test_t19_missing_language_block_is_empty_not_error(spark):
    p = _pred(spark, [(1, 1, 1, _ts("2024-01-01"), "joy", "lv", 0.1, "a", "x")])
    r = em.chart_rows(p, "ekman", "month", P2, "2024-01", "2024-01")
    langs = {x.language for x in em.comment_article_counts(r).collect()}
    assert langs == {"lv", "total"}


def test_t22_recompute_vs_insert_only(spark):
    old = _daily(spark)
    new = old.withColumn("total_word_count", F.col("total_word_count") + 1)
    assert ro.insert_missing(new, old).count() == 0
    touched = spark.createDataFrame([(dt.date(2024, 1, 1),)], "date date")
    re = ro.recompute_days(new, old, touched)
    assert sorted(r.total_word_count for r in re.collect()) == [11, 31, 41]


def test_t24_unknown_type_and_grain_raise(spark):
    p = _pred(spark, [(1, 1, 1, _ts("2024-01-01"), "joy", "lv", 0.1, "a", "x")])
    with pytest.raises(ValueError):
        em.chart_rows(p, "nope", "month", P2)
    with pytest.raises(ValueError):
        em.chart_rows(p, "ekman", "year", P2)


def test_m1_argmax_ties_and_rounding(spark):
    df = spark.createDataFrame([([("a", 0.3), ("b", 0.3), ("c", 0.1)],), ([("z", 0.123456)],),
                                ([("a", 0.1000049), ("b", 0.1000051)],)],
                               "p array<struct<label:string, score:double>>")
    got = [(r.r.label, r.r.score) for r in df.select(em.argmax_prediction(F.col("p")).alias("r")).collect()]
    assert got == [("a", 0.3), ("z", 0.12346), ("b", 0.10001)]


def test_t22_rollup_sink_replaces_only_touched_months(spark):
    import tempfile
    from murmur.sinks import read_rollup, write_rollup
    path = tempfile.mkdtemp(prefix="murmur-sink-") + "/daily"
    d = _daily(spark).unionByName(_daily(spark).withColumn("date", F.lit(dt.date(2024, 2, 1))))
    write_rollup(d, path)
    fresh = _daily(spark).withColumn("total_word_count", F.lit(99).cast("long"))
    write_rollup(fresh, path)                     # January only
    got = {(r.date.month, r.website): r.total_word_count for r in read_rollup(spark, path).collect()}
    assert got[(1, "a")] == 99 and got[(2, "a")] == 10


def test_g1_day_without_tokens_and_repeated_hits(spark):
    p = Params(languages=("lv",), sites=("a",))
    lm = spark.createDataFrame([
        (1, 1, "a", dt.date(2024, 1, 1), "lv", ["bad", "bad", "x"], ["bad", "bad", "x"]),
        (2, 2, "a", dt.date(2024, 1, 2), "lv", [], []),                # a day with no tokens
    ], "comment_id long, article_id long, website string, day date, comment_lang string, "
       "lemmas array<string>, words array<string>").withColumn("lemma_count", F.size("lemmas"))
    lex = spark.createDataFrame([("bad", "lv", 0.5)], "word string, language string, weight double")
    got = {(r.date.day, r.website): (r.aggressive_word_count, r.aggressive_word_weight_sum, r.total_word_count,
                                     r.aggressiveness_ratio)
           for r in ro.aggressiveness_by_day(lm, lex, p, 1).collect()}
    assert got[(1, "a")] == (2, 1.0, 3, 2 / 3)
    assert got[(2, "a")] == (0, 0.0, 0, 0.0) and got[(2, "all")] == (0, 0.0, 0, 0.0)
