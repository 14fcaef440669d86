"""Queries: n-gram candidates (X4), emotion keywords (K2, K3), prediction plug-in (M2)."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from murmur.operators import classifier as clf
from murmur.operators import emotion_keywords as ek
from murmur.operators import lookups as lk
from murmur.operators import models as md
from murmur.plans.oracle_views import with_views
from murmur.plans.registry import Ctx, flat, register
from murmur.plans.sqlutil import sql_list
from murmur.session import scratch_path
from murmur.sources import fixtures as fx

PP = fx.PREDICTION_PARAMS
P = fx.FIXTURE_PARAMS
PLANGS = sql_list(PP.languages)
KIND = "ekman"


def docs_tf(ctx: Ctx):
    docs = ek.emotion_documents(ctx.predictions, ctx.lemmatized, KIND, PP.languages)
    return ek.candidate_terms(docs, fx.stopwords(ctx.spark), len(fx.STOPWORD_ROWS))


def keywords(ctx: Ctx):
    return ek.emotion_keywords(ctx.predictions, ctx.lemmatized, KIND, PP.languages,
                               fx.stopwords(ctx.spark), len(fx.STOPWORD_ROWS))


TF_CTES = f"""
docs AS (SELECT CAST(p.comment_timestamp AS DATE) AS date, p.text_lang AS language,
                p.ekman_prediction_emotion AS emotion, p.comment_id, l.lemmas
         FROM fx_predictions p JOIN fx_lemmatized l ON l.comment_id = p.comment_id
         WHERE p.text_lang IN ({PLANGS}) AND p.ekman_prediction_emotion <> ''),
tok AS (SELECT date, language, emotion, comment_id, unnest(lemmas) AS tok,
               unnest(generate_series(1, len(lemmas))) AS pos FROM docs),
kept AS (SELECT * FROM tok WHERE length(tok) >= 2 AND NOT EXISTS
           (SELECT 1 FROM fx_stopwords s WHERE s.language = tok.language AND s.word = tok.tok)),
seqs AS (SELECT date, language, emotion, comment_id, list(tok ORDER BY pos) AS toks FROM kept GROUP BY ALL),
g0 AS (SELECT date, language, emotion, toks, n, unnest(generate_series(1, len(toks) - n + 1)) AS i
       FROM seqs CROSS JOIN (VALUES (1), (2), (3)) ns(n)),
g AS (SELECT date, language, emotion, array_to_string(toks[i:i + n - 1], ' ') AS term FROM g0),
tf AS (SELECT date, language, emotion, term, count(*) AS tf FROM g GROUP BY ALL),
ft AS (SELECT date, language, term, CAST(sum(tf) AS BIGINT) AS f FROM tf GROUP BY date, language, term),
cand AS (SELECT * FROM (
           SELECT *, CAST(row_number() OVER (PARTITION BY date, language ORDER BY f DESC, term) AS INTEGER) AS rank
           FROM ft) WHERE rank <= {ek.MAX_FEATURES}),
t AS (SELECT tf.*, cand.f FROM tf JOIN cand USING (date, language, term)),
cls AS (SELECT date, language, emotion, sum(tf) AS ct FROM t GROUP BY ALL),
grp AS (SELECT date, language, sum(ct) / count(*) AS av FROM cls GROUP BY ALL),
sc AS (SELECT t.date, t.language, t.emotion, t.term,
              round(t.tf / cls.ct * ln(1.0 + grp.av / t.f), 12) AS confidence
       FROM t JOIN cls USING (date, language, emotion) JOIN grp USING (date, language)),
top AS (SELECT * FROM (
          SELECT *, CAST(row_number() OVER (PARTITION BY date, language, emotion ORDER BY confidence DESC, term)
                         AS INTEGER) AS rank
          FROM sc) WHERE rank <= {ek.TOP_N})"""
TV = ("fx_predictions", "fx_lemmatized", "fx_stopwords")


@register("ngram_candidates", with_views(TV, TF_CTES, """
SELECT strftime(date, '%Y-%m-%d') AS date, language, term, f, rank FROM cand"""))
def q_ngram_candidates(spark, sf_dir):
    return flat(ek.top_candidates(docs_tf(Ctx(spark, sf_dir))))


@register("emotion_keywords", with_views(TV, TF_CTES, f"""
SELECT strftime(date, '%Y-%m-%d') AS date, language, emotion, term AS keyword, confidence, rank,
       '{KIND}' AS prediction_type
FROM top"""))
def q_emotion_keywords(spark, sf_dir):
    return flat(keywords(Ctx(spark, sf_dir)))


@register("emotion_keywords_flat", with_views(TV, TF_CTES, """
SELECT strftime(date, '%Y-%m-%d') AS date, language || '_' || emotion AS emotion, term AS keyword, confidence
FROM top"""))
def q_emotion_keywords_flat(spark, sf_dir):
    """K3: stored map form (D5) flattened back to rows."""
    stored = ek.stored_form(keywords(Ctx(spark, sf_dir)))
    return flat(ek.flatten_stored(stored, KIND, PP.languages))


PEND = f"""
pend AS (SELECT c.id, c.comment_text FROM fx_comments c
         WHERE c.comment_lang IN ({sql_list(P.languages)})
           AND EXISTS (SELECT 1 FROM fx_articles a WHERE a.article_id = c.article_id)
           AND NOT EXISTS (SELECT 1 FROM fx_predictions p WHERE p.comment_id = c.id)),
tk AS (SELECT id, coalesce(regexp_extract_all(lower(comment_text), '\\p{{L}}+'), []::VARCHAR[]) AS toks FROM pend),
sc AS (SELECT id, [""" + ", ".join(
    f"round_even((1 + len(list_filter(toks, lambda t: length(t) % {len(PP.emotions)} = {i}))) "
    f"/ ({len(PP.emotions)} + len(toks)), 5)" for i in range(len(PP.emotions))) + "] AS s FROM tk)"


@register("predict_pending", with_views(("fx_comments", "fx_articles", "fx_predictions"), PEND, f"""
SELECT id, [{sql_list(PP.emotions)}][list_position(s, list_max(s))] AS ekman_prediction_emotion,
       list_max(s) AS ekman_prediction_score
FROM sc"""))
def q_predict_pending(spark, sf_dir):
    """M2: pending comments (J3) → classifier plug-in (mapInPandas) → M1."""
    ctx = Ctx(spark, sf_dir)
    pending = lk.pending_predict(ctx.comments, ctx.articles, ctx.predictions, ctx.params)
    scored = md.predict(pending, partial(md.token_length_classifier, PP.emotions), "comment_text", ("id",))
    out = md.predictions_table(scored, KIND)
    return out.select("id", "ekman_prediction_emotion", "ekman_prediction_score")


@register("lemmatize_plugin", with_views(("fx_lemmatized",), "", """
SELECT comment_id, CAST(len(lemmas) AS INTEGER) AS lemma_count, array_to_string(lemmas, ' ') AS lemma_text
FROM fx_lemmatized"""))
def q_lemmatize_plugin(spark, sf_dir):
    """The lemmatizer plug-in point (mapInPandas) with its default function."""
    from murmur.operators.text import lemmatize_with, regex_lemmatizer
    lm = lemmatize_with(Ctx(spark, sf_dir).comments, regex_lemmatizer)
    return lm.select("comment_id", "lemma_count", F.array_join("lemmas", " ").alias("lemma_text"))


M3_LABELS = {"ekman": PP.emotions, "normal": ("pos", "neg")}


def _m3_sql() -> str:
    parts = []
    for kind, labels in M3_LABELS.items():
        n = len(labels)
        scores = ", ".join(f"round_even((1 + len(list_filter(toks, lambda t: length(t) % {n} = {i}))) "
                           f"/ ({n} + len(toks)), 5)" for i in range(n))
        parts.append(f"""SELECT id, '{kind}' AS prediction_type, language,
       [{sql_list(labels)}][list_position(s, list_max(s))] AS m_prediction_emotion,
       list_max(s) AS m_prediction_score
FROM (SELECT id, language, [{scores}] AS s FROM tk)""")
    return with_views(("fx_comments",), f"""
tk AS (SELECT id, comment_lang AS language,
              regexp_extract_all(lower(comment_text), '\\p{{L}}+') AS toks
       FROM fx_comments
       WHERE comment_lang IN ({sql_list(P.languages)}) AND length(coalesce(comment_text, '')) > 0)""",
                      "\nUNION ALL\n".join(parts))


@register("predict_two_label_sets", _m3_sql())
def q_predict_two_label_sets(spark, sf_dir):
    """M3: two label sets per comment, one model per (type, language); empty texts skipped."""
    ctx = Ctx(spark, sf_dir)
    models = {(kind, lang): partial(md.token_length_classifier, labels)
              for kind, labels in M3_LABELS.items() for lang in P.languages}
    out = md.predict_many(ctx.comments, models)
    return out.select("id", "prediction_type", "language", "m_prediction_emotion", "m_prediction_score")


# --------------------------------------------------------------------------- M2, M3 with trained models
#: Held out from training: ids whose checksum is divisible by this.
HELD_OUT = 5


def labelled_texts(ctx: Ctx):
    """(id, text, language, label, tone, toxic, held_out): documents with their labels."""
    t = ctx.t
    rows = t.documents.join(t.labels, "doc_id")
    tone = F.when(F.col("quality") == 0, "poor").otherwise("good")
    toxic = F.when(F.col("toxic") == 1, "toxic").otherwise("clean")
    return rows.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("language"), F.when(F.col("toxic") == 1, "toxic").otherwise(tone).alias("label"),
                       tone.alias("tone"), toxic.alias("toxic"), (F.crc32(F.col("doc_id").cast("string")) % HELD_OUT == 0).alias("held_out"))


@register("classifier_predict_pending")
def q_classifier_predict_pending(spark, sf_dir):
    """M2 (no oracle: a trained model): fitted on labelled documents, stored, loaded, and applied to pending comments."""
    ctx = Ctx(spark, sf_dir)
    path = scratch_path(spark, "classifier")
    clf.fit(labelled_texts(ctx).where("not held_out"), path)
    pending = lk.pending_predict(ctx.comments, ctx.articles, ctx.predictions, ctx.params)
    return clf.predict_stored(pending, path, KIND).select("id", "ekman_prediction_emotion", "ekman_prediction_score")


@register("classifier_two_label_sets")
def q_classifier_two_label_sets(spark, sf_dir):
    """M3 (no oracle): two label sets, one trained model per (type, language)."""
    ctx = Ctx(spark, sf_dir)
    path = scratch_path(spark, "classifiers")
    clf.fit_many(labelled_texts(ctx).where("not held_out"), path, ("tone", "toxic"), P.languages, features=1 << 14, max_iter=15, min_docs=5)
    out = clf.predict_many_stored(ctx.comments, path, ("tone", "toxic"), P.languages)
    return out.select("id", "prediction_type", "language", "m_prediction_emotion", "m_prediction_score")


@register("emotion_keywords_by_vector")
def q_emotion_keywords_by_vector(spark, sf_dir):
    """K2 by vectors (no oracle): candidates by the cosine of their words' co-occurrence vectors with the group's."""
    ctx = Ctx(spark, sf_dir)
    docs = ek.stored_documents(ek.emotion_documents(ctx.predictions, ek.packed(ctx.lemmatized), KIND, PP.languages))
    terms = ek.candidate_terms(docs, fx.stopwords(spark), len(fx.STOPWORD_ROWS))
    return flat(ek.vector_keywords(docs, terms, ek.label_set(ctx.predictions, KIND, PP.languages)))
