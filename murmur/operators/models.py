"""Model plug-in points (M2-M4, X3, K2 scorer) and their deterministic defaults.

The reference runs transformer classifiers and a keyword model on a GPU.
Those weights cannot ship here, so each hook takes a pandas batch function
(run through ``mapInPandas``: Arrow batches, model loaded once per task) and
defaults to a small deterministic function so that the plumbing is testable.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from murmur.operators.emotions import argmax_prediction
from murmur.operators.text import text_slices

PREDICTION_TYPE = T.ArrayType(T.StructType([T.StructField("label", T.StringType()),
                                            T.StructField("score", T.DoubleType())]))
Classifier = Callable[[pd.Series], list]
LETTERS = regex.compile(r"\p{L}+")


def token_length_classifier(labels) -> Classifier:
    """Default classifier: score_i = (1 + #tokens with len % L == i) / (L + #tokens).

    Deterministic stand-in for a model; vectorised over the batch with numpy.
    """
    labels = list(labels)
    n_lab = len(labels)

    def classify(texts: pd.Series) -> list:
        out = []
        for text in texts.fillna(""):
            words = LETTERS.findall(text.lower())
            lens = np.fromiter((len(w) for w in words), dtype=np.int64, count=len(words))
            hist = np.bincount(lens % n_lab, minlength=n_lab) if len(words) else np.zeros(n_lab, dtype=np.int64)
            scores = (1.0 + hist) / float(n_lab + len(words))
            out.append([{"label": lab, "score": float(s)} for lab, s in zip(labels, scores)])
        return out

    return classify


def predict(comments: DataFrame, make: Callable[[], Classifier], text_col: str = "comment_text",
            keep: tuple[str, ...] = ("id",), sort_by_length: bool = True) -> DataFrame:
    """M2/M4: run the classifier that ``make`` builds, once per task, over text batches; rows
    sorted by length inside each partition so a padded batch holds texts of
    similar size (no extra shuffle).  A call gets a bounded amount of text; the
    kept columns pass as they are.
    """
    src = comments.select(*keep, F.col(text_col).alias("_text"))
    if sort_by_length:
        src = src.sortWithinPartitions(F.length("_text"))
    schema = T.StructType([comments.schema[k] for k in keep] + [T.StructField("prediction", PREDICTION_TYPE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = make()
        for batch in batches:
            for part in text_slices(batch, "_text"):
                scored = pa.array(classifier(part.column("_text").to_pandas()), to_arrow_type(PREDICTION_TYPE))
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keep], scored], [*keep, "prediction"])

    return src.mapInArrow(run, schema)


def predictions_table(scored: DataFrame, prediction_type: str, digits: int = 5) -> DataFrame:
    """M1 on classifier output: rounded score map, top label, top score."""
    r = argmax_prediction(F.col("prediction"), digits)
    out = scored.withColumn("_r", r)
    return (out.withColumn(f"{prediction_type}_prediction_json",
                           F.map_from_entries(F.col("_r.scores")))
            .withColumn(f"{prediction_type}_prediction_emotion", F.col("_r.label"))
            .withColumn(f"{prediction_type}_prediction_score", F.col("_r.score"))
            .drop("_r", "prediction"))


def prediction_rows(comments: DataFrame, make: Callable[[], Classifier], prediction_type: str) -> DataFrame:
    """M2: rows of the predictions table (D3) for ``comments``: keys, time, text, language, site, score map, label, score."""
    c = comments.select(F.col("id").alias("comment_id"), "article_id", F.col("timestamp").alias("comment_timestamp"),
                        F.col("comment_text").alias("text"), F.col("comment_lang").alias("text_lang"), "website")
    keep = ("comment_id", "article_id", "comment_timestamp", "text", "text_lang", "website")
    return predictions_table(predict(c, make, "text", keep), prediction_type)


def append_predictions(rows: DataFrame, path: str) -> None:
    """Append scored rows to the stored predictions; pending comments (J3) are those it does not have yet."""
    rows.write.mode("append").parquet(path)


def predict_many(comments: DataFrame, models: dict[tuple[str, str], Callable[[], Classifier]], lang_col: str = "comment_lang",
                 text_col: str = "comment_text", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """M3: several (prediction type, language) models in one pass; empty texts and other languages skipped.

    Output is long: one row per comment and prediction type.  A task builds a
    model when it first meets its language.
    """
    src = comments.where(F.col(lang_col).isin(sorted({lang for _, lang in models})) & (F.length(F.col(text_col)) > 0)) \
                  .select(*keep, F.col(lang_col).alias("language"), F.col(text_col).alias("_text"))
    schema = T.StructType([comments.schema[k] for k in keep]
                          + [T.StructField("language", T.StringType()), T.StructField("prediction_type", T.StringType()),
                             T.StructField("prediction", PREDICTION_TYPE)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded: dict[tuple[str, str], Classifier] = {}
        for pdf in batches:
            for lang, rows in pdf.groupby("language"):
                for (kind, own), make in models.items():
                    if own == lang:
                        if (kind, own) not in loaded:
                            loaded[kind, own] = make()
                        res = rows[[*keep, "language"]].copy()
                        res["prediction_type"] = kind
                        res["prediction"] = loaded[kind, own](rows["_text"])
                        yield res

    return predictions_table(src.mapInPandas(run, schema), "m")
