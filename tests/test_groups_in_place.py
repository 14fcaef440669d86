"""N-grams of emotion keywords are counted where the comments of a group lie."""

import datetime as dt

import __spark_entry__ as E
from murmur.operators import emotion_keywords as ek
from tests.conftest import SF_SMALL


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_no_term_is_dealt(spark):
    for name in ("emotion_keywords", "ngram_candidates"):
        plan = plan_of(E.queries()[name](spark, SF_SMALL))
        assert not [x for x in plan.splitlines() if "hashpartitioning(" in x and "term" in x]


def test_large_group_is_dealt_by_term(spark):
    rows = [(dt.date(2024, 1, 1 + k % 3 // 2), "lv", "ab"[k % 2], [f"aa{k % 7}", "bb", f"cc{k % 5}"]) for k in range(200)]
    docs = spark.createDataFrame(rows, "date date, language string, emotion string, lemmas array<string>")
    assert "REPARTITION_BY_NUM" in plan_of(ek.by_group(docs))
    assert "REPARTITION_BY_NUM" not in plan_of(ek.by_group(docs, group_comments=100))
    assert ek.by_group(docs.limit(0)).count() == 0
    terms = ek.candidate_terms(docs, None)
    whole = sorted(ek.class_tfidf(terms, ["a", "b"], 5, 9).collect())
    assert whole == sorted(ek.class_tfidf(terms.repartition(4), ["a", "b"], 5, 9).collect())


def test_vector_scorer_forms_the_ngrams_once(spark):
    plan = plan_of(E.queries()["emotion_keywords_by_vector"](spark, SF_SMALL))
    assert "arrays_zip" not in plan and "o_orderkey" not in plan
