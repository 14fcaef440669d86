"""Learned endings (X2, X3), long-form lemmas, bitmaps of distinct articles (K6, U4, E2), scans of E5."""

import datetime as dt
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import __spark_entry__ as E
from murmur.operators import bitmaps as bm
from murmur.operators.text import learn_endings, lemmatize_tokens
from tests.conftest import SF_SMALL


def rules_of(pairs, longest=5, least=2):
    votes = Counter()
    for lang, form, lemma in set(pairs):
        n = 0
        while n < min(len(form), len(lemma)) and form[n] == lemma[n]:
            n += 1
        cut = len(form) - n
        for s in range(max(cut, 1), min(len(form), longest) + 1):
            votes[lang, form[-s:], cut, lemma[n:]] += 1
    by = defaultdict(list)
    for (lang, end, cut, add), n in votes.items():
        if n >= least:
            by[lang, end].append((-n, cut, add))
    return {k: min(v)[1:] for k, v in by.items()}


PAIRS = [("lv", f"{stem}{a}", f"{stem}{b}") for stem in ("mā", "kalnāj", "pils", "grāmat", "upe", "cilvēk", "sarkan") for a, b in (("as", "s"), ("iem", "s"), ("ām", "a"), ("", ""))]
PAIRS += [("en", "ran", "run"), ("en", "sang", "sing"), ("en", "went", "go"), ("en", "cities", "city"), ("en", "ladies", "lady"), ("en", "a", "")]


def test_rules_are_the_majority_edits(spark):
    got = {(r.language, r.ending): (r.cut, r.add) for r in learn_endings(spark.createDataFrame(PAIRS, "language string, form string, lemma string")).collect()}
    assert got == rules_of(PAIRS) and got["lv", "iem"] == (3, "s") and got["en", "dies" if ("en", "dies") in got else "ies"] == (3, "y")


def test_unseen_forms_and_the_table_first(spark):
    table = spark.createDataFrame(PAIRS + [("en", "ladies", "aaa")], "language string, form string, lemma string")
    docs = spark.createDataFrame([(1, "Bodies ladies, went", "en"), (2, "kokiem zvēriem went", "lv"), (3, "kokiem", None), (4, None, "en"), (5, "", "en")],
                                 "id long, comment_text string, comment_lang string")
    t = lemmatize_tokens(docs, table, learn_endings(table)).orderBy("comment_id", "pos").collect()
    assert [(r.comment_id, r.form, r.lemma) for r in t] == [(1, "bodies", "body"), (1, "ladies", "aaa"), (1, "went", "go"), (2, "kokiem", "koks"),
                                                            (2, "zvēriem", "zvērs"), (2, "went", "went"), (3, "kokiem", "kokiem")]


def test_long_form_moves_no_token(spark):
    table = spark.createDataFrame(PAIRS, "language string, form string, lemma string")
    docs = spark.range(1000).selectExpr("id", "'kokiem zvēriem' as comment_text", "'lv' as comment_lang").repartition(8, "id")
    plan = lemmatize_tokens(docs, table, learn_endings(table))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and plan.count("BroadcastHashJoin") == 6


def test_bitmaps_equal_distinct_counts(spark):
    r = random.Random(6)
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=r.randrange(40)), r.choice("ab"), r.choice([None, r.randrange(50), r.randrange(10**6), -r.randrange(9), 32768, 2**40 + r.randrange(5)]))
            for _ in range(3000)]
    stored = bm.day_bitmaps(spark.createDataFrame(rows, "date date, word string, article_id long"), ("word",))
    for start, end in (("2024-01-01", "2024-03-01"), ("2024-01-10", "2024-01-12"), ("2025-01-01", "2025-02-01")):
        inside = [x for x in rows if start <= str(x[0]) <= end]
        want = {w: (len({a for _, x, a in inside if x == w and a is not None}), sum(x == w for _, x, _ in inside)) for w in {x for _, x, _ in inside}}
        assert {x.word: (x.article_count, x["count"]) for x in bm.distinct_over(stored, ("word",), start, end).collect()} == want
    months = bm.distinct_over(stored, ("word",), "2024-01-01", "2024-03-01", F.date_format("date", "yyyy-MM")).collect()
    assert sum(x["count"] for x in months) == 3000 and {x.period for x in months} == {"2024-01", "2024-02"}


def test_a_hot_day_is_many_rows(spark):
    hot = spark.range(1, 200001).selectExpr("date'2024-01-01' as date", "'w' as word", "id as article_id")
    stored = bm.day_bitmaps(hot, ("word",))
    assert stored.count() == 7 and bm.distinct_over(stored, ("word",), "2024-01-01", "2024-01-01").first().article_count == 200000


def test_emotion_total_scans_once(spark):
    df = E.queries()["emotion_total"](spark, SF_SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1
