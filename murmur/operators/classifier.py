"""A trained text classifier for M2-M4: fitted with pyspark.ml, stored, and scored inside the JVM.

The model is a ``pyspark.ml`` pipeline: words (runs without blanks and sentence
marks, so that disguised spellings stay whole), word pairs, hashed and weighted
by inverse document frequency, multinomial logistic regression.  Terms of fewer
than ``MIN_DOCS`` texts count for nothing.  Fitting runs over a labelled table (text, label); a scoring job
only loads the stored pipeline.  Its output has the shape that the plug-in
hook of ``models`` has (an array of (label, score)), so M1 follows as before.

Texts without words get the scores of the intercepts; a null text counts as
empty.  A language with fewer than two labels in its own rows uses the pooled
model of all languages.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, SQLTransformer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.operators.models import predictions_table
from murmur.session import path_exists, scratch_path

FEATURES, MAX_ITER, REG, MIN_DOCS = 1 << 18, 30, 0.01, 20
POOLED = "all"
#: Stages of the pipeline before the first one that is fitted.
LEARNED = 5


def pipeline(features: int = FEATURES, max_iter: int = MAX_ITER, reg: float = REG, min_docs: int = MIN_DOCS) -> Pipeline:
    """Stages from (text, label) to (probability)."""
    return Pipeline(stages=[
        SQLTransformer(statement="SELECT *, coalesce(text, '') AS _text FROM __THIS__"),
        RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[^\s.,;:!?]+", gaps=False),
        NGram(n=2, inputCol="_words", outputCol="_pairs"),
        SQLTransformer(statement="SELECT *, concat(_words, _pairs) AS _terms FROM __THIS__"),
        HashingTF(inputCol="_terms", outputCol="_counts", numFeatures=features, binary=True),
        IDF(inputCol="_counts", outputCol="features", minDocFreq=min_docs),
        StringIndexer(inputCol="label", outputCol="_label", stringOrderType="alphabetAsc"),
        LogisticRegression(featuresCol="features", labelCol="_label", family="multinomial", maxIter=max_iter, regParam=reg, standardization=False),
    ])


def counted(labelled: DataFrame, **settings) -> DataFrame:
    """``labelled`` with the hashed terms of its texts in place of them (``_counts``), written once: every fit reads these and no text."""
    stages = pipeline(**settings).getStages()[:LEARNED]
    rows = PipelineModel(stages=stages).transform(labelled).select(*[c for c in labelled.columns if c != "text"], "_counts")
    path = scratch_path(labelled.sparkSession, "classifier-counts")
    rows.write.parquet(path)
    return labelled.sparkSession.read.schema(rows.schema).parquet(path)


def _fit_counted(rows: DataFrame, path: str, **settings) -> PipelineModel:
    """Fit on (_counts, label) and store the whole pipeline under ``path``; every optimiser step reads the prepared features, which are persisted."""
    stages = pipeline(**settings).getStages()
    rows = rows.where(F.col("label").isNotNull()).select("_counts", "label")
    prepared = Pipeline(stages=stages[LEARNED:-1]).fit(rows)
    features = prepared.transform(rows).select("features", "_label").persist()
    last = stages[-1].fit(features)
    features.unpersist()
    model = PipelineModel(stages=[*stages[:LEARNED], *prepared.stages, last])
    model.write().overwrite().save(path)
    return model


def fit(labelled: DataFrame, path: str, **settings) -> PipelineModel:
    """Fit on (text, label) and store under ``path``; texts are read once."""
    return _fit_counted(counted(labelled.where(F.col("label").isNotNull()).select("text", "label"), **settings), path, **settings)


def classify(comments: DataFrame, model: PipelineModel, text: str = "comment_text", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """(keep, prediction): label and probability of every class, in alphabetical order of the labels."""
    labels = next(s for s in model.stages if s.__class__.__name__ == "StringIndexerModel").labels
    rows = model.transform(comments.select(*keep, F.col(text).alias("text")) if "text" not in keep else comments.select(*keep))
    p = vector_to_array(F.col("probability"))
    scores = F.array(*[F.struct(F.lit(x).alias("label"), p[i].alias("score")) for i, x in enumerate(labels)])
    return rows.select(*keep, scores.alias("prediction"))


def predict_stored(comments: DataFrame, path: str, prediction_type: str, text: str = "comment_text", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """M2 with the model stored under ``path``: score map, top label, top score."""
    return predictions_table(classify(comments, PipelineModel.load(path), text, keep), prediction_type)


def fit_many(labelled: DataFrame, path: str, types: tuple[str, ...], languages: tuple[str, ...], **settings) -> None:
    """M3: a model per (type, language) under ``path``/type/language, and a pooled one per type.

    ``labelled`` has text, language and one label column per type.
    """
    rows = counted(labelled.select("text", "language", *types), **settings)
    kinds = rows.groupBy("language").agg(*[F.count_distinct(t).alias(t) for t in types]).where(F.col("language").isin(*languages)).collect()
    for t in types:
        own = rows.select("_counts", "language", F.col(t).alias("label"))
        _fit_counted(own, f"{path}/{t}/{POOLED}", **settings)
        for lang in sorted(r.language for r in kinds if r[t] > 1):
            _fit_counted(own.where(F.col("language") == lang), f"{path}/{t}/{lang}", **settings)


def predict_many_stored(comments: DataFrame, path: str, types: tuple[str, ...], languages: tuple[str, ...], lang_col: str = "comment_lang",
                        text: str = "comment_text", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """M3: one row per comment and type, scored by its language's model; empty texts and other languages skipped."""
    rows = comments.where(F.length(F.col(text)) > 0)
    out = None
    for t in types:
        own = [x for x in languages if path_exists(comments.sparkSession, f"{path}/{t}/{x}")]
        parts = [(F.col(lang_col) == x, x) for x in own]
        rest = [x for x in languages if x not in own]
        if rest:
            parts.append((F.col(lang_col).isin(*rest), POOLED))
        for cond, name in parts:
            part = rows.where(cond).withColumn("language", F.col(lang_col))
            part = classify(part, PipelineModel.load(f"{path}/{t}/{name}"), text, (*keep, "language")).withColumn("prediction_type", F.lit(t))
            out = part if out is None else out.unionByName(part)
    return predictions_table(out, "m")
