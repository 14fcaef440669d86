"""Texts are hashed once, however many models are fitted."""

from pyspark.sql import functions as F

from murmur.operators import classifier as clf


def test_models_are_fitted_from_stored_counts(spark, tmp_path, monkeypatch):
    rows = [(("good fine day " if k % 2 else "bad poor night ") * 3 + f"w{k % 5}", "ab"[k % 3 // 2], "yes" if k % 2 else "no", "x" if k % 4 else "y") for k in range(80)]
    df = spark.createDataFrame(rows, "text string, language string, t1 string, t2 string")
    calls = []
    old = clf.counted
    monkeypatch.setattr(clf, "counted", lambda *a, **k: (calls.append(1), old(*a, **k))[1])
    clf.fit_many(df, str(tmp_path / "m"), ("t1", "t2"), ("a", "b"), features=256, max_iter=3, min_docs=1)
    assert len(calls) == 1
    out = clf.predict_many_stored(df.withColumnRenamed("language", "comment_lang").withColumn("id", F.monotonically_increasing_id()),
                                  str(tmp_path / "m"), ("t1", "t2"), ("a", "b"), text="text")
    assert out.count() == 160
    assert out.where("prediction_type = 't1' and m_prediction_emotion = 'yes'").count() == 40
