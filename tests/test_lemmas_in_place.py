"""Lemma tables without dealing tokens, and plug-ins that get bounded parts of a batch."""

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from murmur.operators import models as md
from murmur.operators import text as tx

SCHEMA = "id long, comment_text string, comment_lang string"


def test_rows_of_one_id_are_not_merged(spark):
    comments = spark.createDataFrame([(1, "Cats run", "en"), (1, "dogs", "en"), (None, "cats", "en"), (None, "cats cats", None), (4, None, "en")], SCHEMA)
    table = spark.createDataFrame([("en", "cats", "Cat"), ("en", "cats", "zat"), ("en", "run", "run"), ("en", "dogs", None)], "language string, form string, lemma string")
    got = sorted((r.comment_id or 0, r.words, r.lemmas, r.lemma_count) for r in tx.lemmatize(comments, table).collect())
    assert got == [(0, ["cats"], ["cat"], 1), (0, ["cats", "cats"], ["cats", "cats"], 2), (1, ["cats", "run"], ["cat", "run"], 2),
                   (1, ["dogs"], ["dogs"], 1), (4, [], [], 0)]


def test_only_changed_forms_are_dealt(spark):
    comments = spark.createDataFrame([(k, "cats and dogs and cats", "en") for k in range(50)], SCHEMA)
    df = tx.lemmatize(comments, spark.createDataFrame([("en", "cats", "cat"), ("en", "dogs", "dogs")], "language string, form string, lemma string"))
    assert {tuple(r.lemmas) for r in df.collect()} == {("cat", "and", "dogs", "and", "cat")}
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "posexplode" not in plan and "Inner" in plan


def test_slices_are_bounded_and_whole():
    texts = ["x" * (k * 37 % 90) for k in range(500)] + [None, "y" * 1000, ""]
    batch = pa.record_batch({"id": pa.array(range(503)), "t": pa.array(texts)})
    parts = list(tx.text_slices(batch, "t", 200, 7))
    assert [x for p in parts for x in p.column("t").to_pylist()] == texts
    assert all(p.num_rows <= 7 and (p.num_rows == 1 or sum(len(x or "") for x in p.column("t").to_pylist()) <= 200) for p in parts)
    assert list(tx.text_slices(batch.slice(0, 0), "t")) == []


def test_plug_ins_get_bounded_parts(spark):
    rows = spark.range(0, 4000, 1, 1).select("id", F.expr("repeat('word ', 600)").alias("comment_text"), F.lit("en").alias("comment_lang"))

    def lemmas(pdf):
        assert len(pdf) <= tx.SLICE_ROWS and pdf["text"].str.len().sum() <= tx.SLICE_CHARS
        return pd.DataFrame({"comment_id": pdf["comment_id"], "lemmas": [["w"]] * len(pdf), "words": [["w"]] * len(pdf)})

    def make():
        def classify(texts):
            assert len(texts) <= tx.SLICE_ROWS and texts.str.len().sum() <= tx.SLICE_CHARS
            return [[{"label": "a", "score": 1.0}]] * len(texts)
        return classify
    assert tx.lemmatize_with(rows, lemmas).agg(F.sum("lemma_count"), F.count_distinct("comment_id")).first()[:] == (4000, 4000)
    assert md.predict(rows, make).where("prediction[0].score = 1").count() == 4000
