"""K2 by vectors against numpy, labels from the data, one exchange of n-grams."""

import collections
import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as E
from murmur.operators import emotion_keywords as ek
from tests.conftest import SF_SMALL

DAY = dt.date(2024, 1, 1)
SCHEMA = "date date, language string, emotion string, comment_id long, lemmas array<string>"


def corpus():
    r = random.Random(5)
    topics = {"joy": "sun sea gold warm light".split(), "fear": "dark cold storm night ice".split()}
    rows = []
    for k in range(60):
        e = r.choice(list(topics))
        rows.append((DAY + dt.timedelta(days=k % 2), r.choice(["lv", "ru"]), e, k, [r.choice(topics[e] + ["and", "to"]) for _ in range(r.randrange(12))]))
    return rows


def brute(spark, rows, dims, reach):
    vocabulary = sorted({w for *_, ws in rows for w in ws})
    hashes = {r.w: r.h for r in spark.createDataFrame([(w,) for w in vocabulary], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    vec = collections.defaultdict(lambda: np.zeros(dims))
    for _, lang, _, _, ws in rows:
        for i in range(len(ws)):
            for j in range(len(ws)):
                if 0 < abs(i - j) <= reach:
                    h = hashes[ws[j]]
                    vec[lang, ws[i]][h % dims] += 1 if h >> 40 & 1 else -1
    unit = {k: v / np.linalg.norm(v) for k, v in vec.items() if np.linalg.norm(v) > 0}
    group, seen = collections.defaultdict(lambda: np.zeros(dims)), collections.defaultdict(set)
    for day, lang, e, _, ws in rows:
        for w in ws:
            group[day, lang, e] += unit.get((lang, w), 0)
        for n in (1, 2, 3):
            seen[day, lang, e].update(tuple(ws[i:i + n]) for i in range(len(ws) - n + 1))
    out = {}
    for key, terms in seen.items():
        g = group[key]
        for t in terms:
            v = sum(unit[key[1], w] for w in t if (key[1], w) in unit)
            if np.linalg.norm(v) * np.linalg.norm(g) > 0:
                out[*key, " ".join(t)] = v @ g / np.linalg.norm(v) / np.linalg.norm(g)
    return out


def test_cosines_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(spark, rows, 16, 2)
    got = ek.vector_keywords(docs, ek.candidate_terms(docs, None), ["fear", "joy"], top_n=10**6, dimensions=16).collect()
    assert {(r.date, r.language, r.emotion, r.keyword) for r in got} == set(want)
    assert all(abs(r.confidence - want[r.date, r.language, r.emotion, r.keyword]) < 1e-8 for r in got)
    top = ek.vector_keywords(docs, ek.candidate_terms(docs, None), ["fear", "joy"], top_n=3, dimensions=16).collect()
    for r in top:
        better = sum(v > r.confidence + 1e-8 for k, v in want.items() if k[:3] == (r.date, r.language, r.emotion))
        assert better < 3 and r.rank <= 3


def test_labels_come_from_the_data(spark):
    p = spark.createDataFrame([(1, DAY, "lv", "joy"), (2, DAY, "lv", "a new label"), (3, DAY, "lv", ""), (4, DAY, "lv", None), (5, DAY, "xx", "other")],
                              "comment_id long, comment_timestamp date, text_lang string, m_prediction_emotion string")
    assert ek.label_set(p, "m", ("lv",)) == ["a new label", "joy"]
    lm = spark.createDataFrame([(k, ["aa", "bb", f"c{k}"]) for k in range(1, 6)], "comment_id long, lemmas array<string>")
    got = ek.emotion_keywords(p, lm, "m", ("lv",)).collect()
    assert {r.emotion for r in got} == {"a new label", "joy"}


def test_ngrams_cross_the_network_once(spark):
    df = E.queries()["emotion_keywords"](spark, SF_SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("hashpartitioning(date#") + plan.count("hashpartitioning(date ") <= 5
