"""Keywords typical of each emotion per day and language.

Re-aimed from an embedding keyword model: candidates are the 1-3-grams of
each comment after stop-word removal (n-grams never cross comments, T8),
the top 5000 by corpus count per (date, language); each candidate is scored
per emotion with class-based TF-IDF:

    score(t, c) = tf(t, c) / Σ_t tf(t, c) * ln(1 + A / f(t))

A = mean candidate count per emotion, f(t) = count of t over all emotions.
The 30 best per emotion are kept (ties by term).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.operators import word_vectors as wv
from murmur.operators.joins import broadcast_checked
from murmur.operators.text import explode_ngrams
from murmur.session import release, scratch_path

# Candidates kept per (date, language), keywords kept per emotion,
# longest n-gram, shortest token (the vectoriser's two-character token rule).
MAX_FEATURES, TOP_N, NGRAM_MAX, MIN_TOKEN_LEN = 5000, 30, 3, 2
KEYS = ["date", "language"]
# Comments of one task that holds whole (date, language) groups, and of the largest group that one task may hold.
TASK_COMMENTS, GROUP_COMMENTS = 500, 20_000


def by_group(docs: DataFrame, task_comments: int = TASK_COMMENTS, group_comments: int = GROUP_COMMENTS) -> DataFrame:
    """``docs`` dealt by (date, language), so that their n-grams are counted, cut and scored where the comments lie.

    A comment's n-grams are many times its own size, and most occur once or
    twice, so partial counts save little.  If a group is too large for one
    task the rows stay as they are, and the n-grams are dealt as partial counts.
    """
    sizes = docs.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n"), F.max("n").alias("top")).first()
    if sizes.top is None or sizes.top > group_comments:
        return docs
    least = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(max(least, -(-sizes.n // task_comments)), *KEYS)


def emotion_documents(predictions: DataFrame, lemmatized: DataFrame, prediction_type: str,
                      languages) -> DataFrame:
    """X5 input: one row per predicted comment with date, language, emotion and lemmas.

    ``emotion != ''`` also drops NULL labels (T18).
    """
    p = (predictions.where(F.col("text_lang").isin(list(languages))
                           & (F.col(f"{prediction_type}_prediction_emotion") != ""))
         .select("comment_id", F.col("comment_timestamp").cast("date").alias("date"),
                 F.col("text_lang").alias("language"),
                 F.col(f"{prediction_type}_prediction_emotion").alias("emotion")))
    return p.join(lemmatized.select("comment_id", "lemmas"), "comment_id", "inner")


def packed(lemmatized: DataFrame) -> DataFrame:
    """``lemmatized`` with the lemmas of a comment as one JSON text: less than half an array's bytes in a shuffle or file."""
    return lemmatized.withColumn("lemmas", F.to_json("lemmas"))


def lemma_list(docs: DataFrame) -> Column:
    """The lemmas of ``docs`` as an array, packed or not."""
    return F.from_json("lemmas", "array<string>") if docs.schema["lemmas"].dataType == T.StringType() else F.col("lemmas")


def stored_documents(docs: DataFrame) -> DataFrame:
    """``docs`` written to the shared folder once, for steps that read them one after the other."""
    path = scratch_path(docs.sparkSession, "emotion-documents")
    docs.select(*KEYS, "emotion", "lemmas").write.option("compression", "zstd").parquet(path)
    release(docs.sparkSession)
    return docs.sparkSession.read.parquet(path)


def candidate_terms(docs: DataFrame, stopwords: DataFrame | None, stop_rows: int | None = None) -> DataFrame:
    """N-gram occurrences, one row each: (date, language, emotion, term).

    Tokens shorter than two letters are dropped (the vectoriser's token
    rule), then stop words, then 1..3-grams are formed inside each comment.
    Each language's stop list travels as one array on a broadcast row, so
    the filter runs where the n-grams are formed.
    """
    d = by_group(docs).withColumn("lemmas", lemma_list(docs))
    if stopwords is not None:
        sw = stopwords.groupBy("language").agg(F.collect_set("word").alias("_sw"))
        d = d.join(broadcast_checked(sw, known_rows=stop_rows), "language", "left")
        keep = lambda t: (F.length(t) >= MIN_TOKEN_LEN) & ~F.coalesce(F.array_contains(F.col("_sw"), t),
                                                                       F.lit(False))
    else:
        keep = lambda t: F.length(t) >= MIN_TOKEN_LEN
    toks = d.select(*KEYS, "emotion", F.filter("lemmas", keep).alias("toks"))
    return explode_ngrams(toks, "toks", (*KEYS, "emotion"), "term", NGRAM_MAX)


def term_counts(terms: DataFrame) -> DataFrame:
    """(date, language, emotion, term, tf)."""
    return terms.groupBy(*KEYS, "emotion", "term").agg(F.count(F.lit(1)).alias("tf"))


def top_candidates(terms: DataFrame, max_features: int = MAX_FEATURES) -> DataFrame:
    """The ``max_features`` most frequent terms per (date, language), ties by term."""
    f = terms.groupBy(*KEYS, "term").agg(F.count(F.lit(1)).alias("f"))
    w = Window.partitionBy(*KEYS).orderBy(F.desc("f"), "term")
    return f.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_features)


def cut_counts(terms: DataFrame, emotions, max_features: int = MAX_FEATURES) -> DataFrame:
    """(date, language, term, f, c0, c1, ...) of the ``max_features`` most frequent terms per (date, language).

    ``terms`` are n-gram occurrences.  One aggregate by (date, language, term)
    holds a count per emotion of ``emotions``; if ``terms`` are not dealt by
    group the n-grams cross the network here, once, as partial counts.  The cut
    is a partial group limit.
    """
    emotions = list(emotions)
    counts = [F.count(F.when(F.col("emotion") == e, 1)).alias(f"c{k}") for k, e in enumerate(emotions)]
    t = terms.where(F.col("emotion").isin(emotions)).groupBy(*KEYS, "term").agg(F.count(F.lit(1)).alias("f"), *counts)
    cut = Window.partitionBy(*KEYS).orderBy(F.desc("f"), "term")
    return t.withColumn("_dr", F.row_number().over(cut)).where(F.col("_dr") <= max_features).drop("_dr")


def cut_terms(terms: DataFrame, emotions, max_features: int = MAX_FEATURES) -> DataFrame:
    """(date, language, term, f, emotion, tf) of the terms that ``cut_counts`` keeps."""
    emotions = list(emotions)
    t = cut_counts(terms, emotions, max_features)
    per = F.array(*[F.struct(F.lit(e).alias("emotion"), F.col(f"c{k}").alias("tf")) for k, e in enumerate(emotions)])
    return t.select(*KEYS, "term", "f", F.explode(per).alias("_e")).select(*KEYS, "term", "f", "_e.*").where("tf > 0")


def class_tfidf(terms: DataFrame, emotions, top_n: int = TOP_N, max_features: int = MAX_FEATURES,
                digits: int = 12) -> DataFrame:
    """K2 default scorer; output (date, language, emotion, keyword, confidence, rank).

    After ``cut_terms`` each (date, language) holds at most max_features ×
    #emotions rows, so the windows are bounded and reuse one partitioning.
    """
    t = cut_terms(terms, emotions, max_features)
    # class totals; the number of classes is the top dense rank of emotion (same sort order)
    t = (t.withColumn("_ct", F.sum("tf").over(Window.partitionBy(*KEYS, "emotion")))
          .withColumn("_ci", F.dense_rank().over(Window.partitionBy(*KEYS).orderBy("emotion"))))
    grp = Window.partitionBy(*KEYS)
    avg = F.sum("tf").over(grp) / F.max("_ci").over(grp)
    score = F.round(F.col("tf") / F.col("_ct") * F.log(F.lit(1.0) + avg / F.col("f")), digits)
    s = t.withColumn("confidence", score)
    w = Window.partitionBy(*KEYS, "emotion").orderBy(F.desc("confidence"), "term")
    return (s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
            .select(*KEYS, "emotion", F.col("term").alias("keyword"), "confidence", "rank"))


def label_set(predictions: DataFrame, prediction_type: str, languages) -> list[str]:
    """The labels the predictions hold, a classifier's label set: one column is read for it."""
    label = F.col(f"{prediction_type}_prediction_emotion")
    rows = predictions.where(F.col("text_lang").isin(list(languages)) & (label != "")).select(label.alias("emotion")).distinct()
    return sorted(r.emotion for r in rows.collect())


def emotion_keywords(predictions: DataFrame, lemmatized: DataFrame, prediction_type: str, languages,
                     stopwords: DataFrame | None = None, stop_rows: int | None = None,
                     processed: DataFrame | None = None) -> DataFrame:
    """K2: top keywords per (date, language, emotion) for every label the predictions hold; (date, language, type) triples already in ``processed`` are skipped."""
    docs = emotion_documents(predictions, lemmatized, prediction_type, languages)
    if processed is not None:
        done = processed.where(F.col("prediction_type") == prediction_type).select(*KEYS).distinct()
        docs = docs.join(done, KEYS, "left_anti")
    terms = candidate_terms(docs, stopwords, stop_rows)
    return class_tfidf(terms, label_set(predictions, prediction_type, languages)).withColumn("prediction_type", F.lit(prediction_type))


def stored_form(keywords: DataFrame) -> DataFrame:
    """D5 shape: map<emotion, array<struct<keyword, confidence>>> per (date, language, type)."""
    per = (keywords.groupBy(*KEYS, "prediction_type", "emotion")
           .agg(F.array_sort(F.collect_list(F.struct("rank", "keyword", "confidence"))).alias("_k"))
           .select(*KEYS, "prediction_type", "emotion",
                   F.transform("_k", lambda s: F.struct(s["keyword"].alias("keyword"),
                                                        s["confidence"].alias("confidence"))).alias("kw")))
    return per.groupBy(*KEYS, "prediction_type").agg(
        F.map_from_entries(F.collect_list(F.struct("emotion", "kw"))).alias("keywords_json"))


def flatten_stored(stored: DataFrame, prediction_type: str, languages, day=None) -> DataFrame:
    """K3: one row per (language_emotion, keyword, confidence) for a type (and day)."""
    s = stored.where((F.col("prediction_type") == prediction_type) & F.col("language").isin(list(languages)))
    if day is not None:
        s = s.where(F.col("date") == F.lit(str(day)).cast("date"))
    e = s.select("date", "language", F.explode("keywords_json").alias("emo", "kws"))
    k = e.select("date", "language", "emo", F.explode("kws").alias("kw"))
    return k.select("date", F.concat_ws("_", "language", "emo").alias("emotion"),
                    F.col("kw.keyword").alias("keyword"), F.col("kw.confidence").alias("confidence"))


# ---------------------------------------------------------------- vector scorer

#: Dimensions of a word's vector, and words to either side that make it.
DIMENSIONS, REACH = 64, 2
#: Comments whose words one task adds up, and tasks for fewer.  Each sends its share of every group's vector, so they are few.
WORD_COMMENTS, WORD_TASKS = 25_000, 16
#: Groups whose candidates one task asks for.
ASK_GROUPS = 1_000
KEYWORDS_DDL = "date date, language string, emotion string, keyword string, confidence double, rank int"
KEYWORDS = pa.schema([("date", pa.date32()), ("language", pa.string()), ("emotion", pa.string()), ("keyword", pa.string()), ("confidence", pa.float64()), ("rank", pa.int32())])


def word_notes(docs: DataFrame, emotions, dimensions: int = DIMENSIONS, reach: int = REACH) -> DataFrame:
    """One row per word and part of a task: what stands around the word, and its counts by group (``wv.NOTES_DDL``)."""
    emotions = list(emotions)
    h = lambda w: F.xxhash64(w)
    near = F.transform("lemmas", lambda w: (F.pmod(h(w), F.lit(dimensions)) * 2 + F.shiftright(h(w), 40).bitwiseAND(1)).cast("int"))
    d = docs.select(*KEYS, "emotion", lemma_list(docs).alias("lemmas")).select(*KEYS, "emotion", "lemmas", near.alias("near"))
    return d.mapInArrow(lambda batches: wv.note_words(batches, dimensions, reach, emotions), wv.NOTES_DDL)


def by_word(notes: DataFrame, comments: int) -> DataFrame:
    """``notes`` dealt and in order by (language, word)."""
    tasks = max(min(notes.sparkSession.sparkContext.defaultParallelism, WORD_TASKS), -(-comments // WORD_COMMENTS))
    return notes.repartition(tasks, "language", "word").sortWithinPartitions("language", "word")


def word_vectors(docs: DataFrame, dimensions: int = DIMENSIONS, reach: int = REACH) -> DataFrame:
    """(language, word, vector): what stands around a word, hashed into signed dimensions and scaled to length one.

    ``docs`` has (date, language, emotion, lemmas).  Every neighbour within
    ``reach`` adds one with its sign to its dimension; a task adds these up per
    word before anything is shuffled.
    """
    from pyspark.ml.functions import array_to_vector

    notes = by_word(word_notes(docs, (), dimensions, reach), docs.count())
    x = notes.mapInArrow(lambda batches: wv.vectors(batches, dimensions), "language string, word string, x array<double>")
    return x.select("language", "word", array_to_vector("x").alias("vector"))


def vector_keywords(docs: DataFrame, terms: DataFrame, emotions, top_n: int = TOP_N, max_features: int = MAX_FEATURES, dimensions: int = DIMENSIONS,
                    reach: int = REACH, digits: int = 9) -> DataFrame:
    """K2 by vectors: (date, language, emotion, keyword, confidence, rank).

    A group's vector adds up its words' vectors, a candidate's those of its one
    to three words; the confidence is the cosine of the two.  Candidates are cut
    once and stored.  Each word's vector is made where its notes and the days
    that ask for it meet, once; from there it goes to these days as whole
    numbers, and the word's share goes into the groups' vectors.  A group's
    candidates are then scored together: at most ``max_features`` of them.
    """
    spark, emotions = docs.sparkSession, list(emotions)
    path = scratch_path(spark, "cut-terms")
    held = F.array_compact(F.array(*[F.when(F.col(f"c{k}") > 0, F.lit(k)) for k in range(len(emotions))])).cast("array<int>")
    cut_counts(terms, emotions, max_features).select(*KEYS, "term", held.alias("emotions")).mapInArrow(wv.pack_terms, wv.CUT_DDL).write.parquet(path)
    release(spark)
    cut = spark.read.parquet(path)
    # few tasks ask, as a word's days are one row for each
    asks = cut.coalesce(max(spark.sparkContext.defaultParallelism, -(-cut.count() // ASK_GROUPS))).mapInArrow(wv.ask_words, wv.NOTES_DDL)
    notes = by_word(word_notes(docs, emotions, dimensions, reach).unionByName(asks), docs.count())
    parts = notes.mapInArrow(lambda batches: wv.answer(batches, dimensions, len(emotions)), wv.PARTS_DDL)
    score = lambda t, p: wv.score(t, p, dimensions, emotions, top_n, digits, KEYWORDS)
    return cut.groupBy(*KEYS).cogroup(parts.groupBy(*KEYS)).applyInArrow(score, KEYWORDS_DDL)
