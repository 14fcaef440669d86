"""The trained classifier of M2 and M3: held-out accuracy, score maps, storage, plan."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from murmur.operators import classifier as clf
from murmur.plans import q_models as qm
from murmur.plans.registry import Ctx
from murmur.session import scratch_path
from tests.conftest import SF_ORACLE


@pytest.fixture(scope="module")
def rows(spark):
    return qm.labelled_texts(Ctx(spark, "/root/testdata/sf0.1")).cache()


@pytest.fixture(scope="module")
def stored(spark, rows):
    path = scratch_path(spark, "test-classifier")
    clf.fit(rows.where("not held_out"), path)
    return path


def test_held_out_accuracy_beats_the_majority(rows, stored):
    held = rows.where("held_out")
    out = clf.predict_stored(held, stored, "m", "text", ("id", "label", "text")).select("label", "m_prediction_emotion").collect()
    n = len(out)
    right = sum(r.label == r.m_prediction_emotion for r in out) / n
    majority = max(sum(r.label == x for r in out) for x in {r.label for r in out}) / n
    assert n > 500 and right > majority + 0.1
    found = [r.m_prediction_emotion == "toxic" for r in out if r.label == "toxic"]
    assert sum(found) > 0.5 * len(found)


def test_scores_are_the_models_softmax(spark, rows, stored):
    model = PipelineModel.load(stored)
    some = rows.where("held_out").limit(40)
    weights, bias = model.stages[-1].coefficientMatrix.toArray(), model.stages[-1].interceptVector.toArray()
    labels = model.stages[-2].labels
    features = {r.id: r.features.toArray() for r in model.transform(some).select("id", "features").collect()}
    got = clf.predict_stored(some, stored, "m", "text").collect()
    assert labels == sorted(labels) and len(got) == len(features)
    for r in got:
        z = weights @ features[r.id] + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        want = dict(zip(labels, p))
        assert r.m_prediction_json.keys() == want.keys()
        assert all(abs(r.m_prediction_json[x] - want[x]) < 1.1e-5 for x in labels)
        assert abs(r.m_prediction_score - max(want.values())) < 1.1e-5
        assert want[r.m_prediction_emotion] > max(want.values()) - 1e-5


def test_scored_in_the_jvm(rows, stored):
    plan = clf.predict_stored(rows, stored, "m", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.split("InMemoryRelation")[0]


def test_null_and_empty_texts_get_the_same_scores(spark, stored):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " ,, !")], "id long, comment_text string")
    got = {r.id: tuple(sorted(r.m_prediction_json.items())) for r in clf.predict_stored(df, stored, "m").collect()}
    assert len(got) == 3 and len(set(got.values())) == 1


def test_a_language_without_two_labels_uses_the_pooled_model(spark):
    words = {"good": "sun tree river", "poor": "mud dirt slime"}
    data = [(f"{words[x]} {i % 7}", lang, x) for i in range(40) for lang in ("en", "fr") for x in words] + [("sun tree", "de", "good")] * 5
    path = scratch_path(spark, "test-many")
    clf.fit_many(spark.createDataFrame(data, "text string, language string, tone string"), path, ("tone",), ("en", "fr", "de"), features=256, max_iter=10, min_docs=2)
    docs = spark.createDataFrame([(1, "en", "mud"), (2, "de", "slime dirt"), (3, "de", "river"), (4, "xx", "mud"), (5, "fr", ""), (6, "fr", None), (7, "fr", "tree")],
                                 "id long, comment_lang string, comment_text string")
    out = clf.predict_many_stored(docs, path, ("tone",), ("en", "fr", "de"))
    got = {r.id: (r.language, r.prediction_type, r.m_prediction_emotion) for r in out.collect()}
    assert got == {1: ("en", "tone", "poor"), 2: ("de", "tone", "poor"), 3: ("de", "tone", "good"), 7: ("fr", "tone", "good")}


def test_queries(spark):
    got = qm.q_classifier_predict_pending(spark, SF_ORACLE)
    want = qm.q_predict_pending(spark, SF_ORACLE)
    assert {r.id for r in got.collect()} == {r.id for r in want.collect()}
    assert got.where(F.col("ekman_prediction_emotion").isin("good", "poor", "toxic")).count() == want.count()
    both = qm.q_classifier_two_label_sets(spark, SF_ORACLE)
    n = spark.read.parquet(f"{SF_ORACLE}/documents.parquet").where("length(text) > 0 and lang in ('en', 'fr', 'de', 'es')").count()
    got = {(r.prediction_type, r.m_prediction_emotion) for r in both.collect()}
    assert both.count() == 2 * n and got <= {("tone", "good"), ("tone", "poor"), ("toxic", "clean"), ("toxic", "toxic")} and len(got) > 2
