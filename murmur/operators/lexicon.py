"""Lexicon operators: load (A10), hits fact (J6), comment score (X7), frequency.

The lexicon is a dimension (thousands of words): it is broadcast after a
row-count check, so token probes happen map-side inside the scan stage and
only partial aggregates cross the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.functions.text import word_language
from murmur.operators.joins import broadcast_checked, DEFAULT_BROADCAST_ROWS
from murmur.params import Params

# Category columns of the lexicon file, in file order.
CATEGORIES = ("DISKRIM", "LAMUV", "NETAISN", "AICIN", "DARB", "PERS", "ASOC", "MILIT",
              "NOSOD", "EMOC", "NODEV")


def lexicon_from_csv(raw: DataFrame) -> DataFrame:
    """A10: header CSV → lexicon rows: language from the alphabet, flags → boolean, frequency 0.

    The caller writes it with mode('overwrite') (full replace).
    """
    cols = [F.col("word"), word_language("word").alias("language"),
            F.col("weight").try_cast("double").alias("weight"), F.lit(0).alias("frequency")]
    for c in CATEGORIES:
        v = F.col(c).cast("string")
        flag = F.coalesce(~v.isin("0", "0.0", "False", "false", ""), F.lit(False))
        cols.append(flag.alias(f"category_{c.lower()}"))
    return raw.select(*cols)


def _lex(lexicon: DataFrame, bound: int | None) -> DataFrame:
    lx = lexicon.select(F.col("word").alias("_lemma"), F.col("weight").alias("_weight"),
                        F.col("language").alias("lexicon_language"))
    return broadcast_checked(lx, DEFAULT_BROADCAST_ROWS, bound)


def lexicon_hits(lemmatized: DataFrame, lexicon: DataFrame, keep: tuple[str, ...] = (),
                 lexicon_rows: int | None = None) -> DataFrame:
    """J6 fact: one row per lexicon match (lemma equal to the stored word, T16).

    ``lemmatized`` has comment_id, lemmas, words and the ``keep`` columns.
    Output: keep…, comment_id, pos, lemma, form, weight, lexicon_language.
    """
    ex = lemmatized.select(*keep, "comment_id",
                           F.posexplode_outer(F.arrays_zip(F.col("lemmas").alias("l"),
                                                     F.col("words").alias("w"))).alias("pos", "t"))
    ex = ex.select(*keep, "comment_id", "pos", F.col("t.l").alias("_lemma"), F.col("t.w").alias("form"))
    hits = ex.join(_lex(lexicon, lexicon_rows), "_lemma", "inner")
    return hits.select(*keep, "comment_id", "pos", F.col("_lemma").alias("lemma"), "form",
                       F.col("_weight").alias("weight"), "lexicon_language")


def score_comments(lemmatized: DataFrame, lexicon: DataFrame, keep: tuple[str, ...] = (),
                   lexicon_rows: int | None = None) -> DataFrame:
    """Per comment (hit count, weight sum); comments without hits get (0, 0.0).

    One pass: every token is probed against the broadcast lexicon; the
    per-comment totals ride along on position 0 so no second scan is needed.
    """
    ex = lemmatized.select(*keep, "comment_id", "lemma_count",
                           F.posexplode_outer("lemmas").alias("pos", "_lemma"))
    j = ex.join(_lex(lexicon, lexicon_rows), "_lemma", "left")
    return (j.groupBy(*keep, "comment_id")
             .agg(F.max("lemma_count").alias("lemma_count"),
                  F.count("_weight").alias("aggressive_word_count"),
                  F.coalesce(F.sum("_weight"), F.lit(0.0)).alias("aggressive_word_weight_sum")))


def token_measures(lemmatized: DataFrame, lexicon: DataFrame, keys: tuple[str, ...],
                   lexicon_rows: int | None = None) -> DataFrame:
    """Per-token rows with three additive measures for group-bys over ``keys``.

    total (lemma_count on the first position only), hit (0/1), weight.
    Summing them by any key set gives G1 without a join back to comments.
    """
    ex = lemmatized.select(*keys, "lemma_count",
                           F.posexplode_outer("lemmas").alias("pos", "_lemma"))
    j = ex.join(_lex(lexicon, lexicon_rows), "_lemma", "left")
    return j.select(
        *keys,
        F.when(F.coalesce(F.col("pos"), F.lit(0)) == 0, F.col("lemma_count").cast("long"))
         .otherwise(F.lit(0).cast("long")).alias("m_total"),
        F.when(F.col("_weight").isNotNull(), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")).alias("m_hit"),
        F.coalesce(F.col("_weight"), F.lit(0.0)).alias("m_weight"),
    )


def lexicon_frequency(lemmatized: DataFrame, lexicon: DataFrame, params: Params,
                      lang_col: str = "comment_lang", lexicon_rows: int | None = None) -> DataFrame:
    """Corpus count of lower(word) among lemmas of the word's language.

    A word whose language is not one of the parameters counts in the first
    (default) language, as the reference maps every non-ru word to lv.
    Tokens are semi-joined with the (small) set of lexicon keys before the
    count, so only matching tokens are shuffled.
    """
    langs = list(params.languages)
    more = [c for c in lexicon.columns if c not in ("word", "language", "weight", "frequency")]
    keyed = lexicon.select("word", "language", "weight", *more,
                           F.when(F.col("language").isin(langs), F.col("language"))
                            .otherwise(F.lit(params.primary_language)).alias("_lang"),
                           F.lower("word").alias("_lemma"))
    keys = broadcast_checked(keyed.select("_lang", "_lemma").distinct(), known_rows=lexicon_rows)
    ex = (lemmatized.where(F.col(lang_col).isin(langs))
          .select(F.col(lang_col).alias("_lang"), F.explode_outer("lemmas").alias("_lemma")))
    counts = ex.join(keys, ["_lang", "_lemma"], "left_semi").groupBy("_lang", "_lemma").count()
    return (keyed.join(counts, ["_lang", "_lemma"], "left")
            .select("word", "language", "weight",
                    F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("frequency"), *more))


def listing(lexicon_with_frequency: DataFrame) -> DataFrame:
    """P10: lexicon ordered by (language, word) with each language's word count."""
    from pyspark.sql import Window
    by_lang = Window.partitionBy("language")
    ordered = Window.partitionBy("language").orderBy("word")
    return (lexicon_with_frequency
            .withColumn("words_in_language", F.count(F.lit(1)).over(by_lang))
            .withColumn("position", F.row_number().over(ordered)))


def search(rows: DataFrame, column: str, term: str) -> DataFrame:
    """Case-insensitive substring filter on a text column (comment, emotion or keyword)."""
    return rows.where(F.lower(F.col(column)).contains(term.lower()))


def join_comments(lemmatized: DataFrame, comments: DataFrame, params: Params,
                  cols=("article_id", "website", "day", "comment_lang")) -> DataFrame:
    """Stored lemmas (D7) ⋈ comments on comment_id, listed languages only."""
    c = comments.where(F.col("comment_lang").isin(list(params.languages))) \
                .select(F.col("id").alias("comment_id"), *cols)
    return lemmatized.join(c, "comment_id", "inner")
