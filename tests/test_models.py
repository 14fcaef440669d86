"""Model plug-in points (X3, M2-M4) with small pandas functions."""

from functools import partial

import pandas as pd

from murmur.operators import models as md
from murmur.operators.text import lemmatize_with


def test_x3_lemmatizer_hook(spark):
    comments = spark.createDataFrame([(1, "Cats Ran", "en"), (2, "", "en")],
                                     "id long, comment_text string, comment_lang string")

    def lemmatizer(pdf: pd.DataFrame) -> pd.DataFrame:
        words = pdf["text"].fillna("").str.lower().str.split()
        return pd.DataFrame({"comment_id": pdf["comment_id"],
                             "lemmas": words.map(lambda ws: [w.rstrip("s") for w in ws]),
                             "words": words})

    out = {r.comment_id: r for r in lemmatize_with(comments, lemmatizer).collect()}
    assert out[1].lemmas == ["cat", "ran"] and out[1].words == ["cats", "ran"] and out[1].lemma_count == 2
    assert out[2].lemma_count == 0


def test_m2_default_classifier_and_argmax(spark):
    comments = spark.createDataFrame([(1, "aa bbb cc"), (2, None)], "id long, comment_text string")
    scored = md.predict(comments, partial(md.token_length_classifier, ["x", "y"]), "comment_text", ("id",))
    rows = {r.id: r for r in md.predictions_table(scored, "ekman").collect()}
    # two labels: lengths 2,3,2 → len%2: 0,1,0 → x=(1+2)/5, y=(1+1)/5
    assert rows[1].ekman_prediction_emotion == "x" and rows[1].ekman_prediction_score == 0.6
    assert rows[1].ekman_prediction_json == {"x": 0.6, "y": 0.4}
    assert rows[2].ekman_prediction_emotion == "x"          # empty text: (1, 1) / 2 → tie → first label


def test_m3_several_models_skip_empty_and_other_languages(spark):
    comments = spark.createDataFrame([(1, "aa", "lv"), (2, "bb", "ru"), (3, "", "lv"), (4, "cc", "en")],
                                     "id long, comment_text string, comment_lang string")
    models = {("ekman", "lv"): partial(md.token_length_classifier, ["a", "b"]),
              ("normal", "lv"): partial(md.token_length_classifier, ["c"]),
              ("ekman", "ru"): partial(md.token_length_classifier, ["d"])}
    out = md.predict_many(comments, models)
    got = sorted((r.id, r.prediction_type, r.m_prediction_emotion) for r in out.collect())
    assert got == [(1, "ekman", "a"), (1, "normal", "c"), (2, "ekman", "d")]
