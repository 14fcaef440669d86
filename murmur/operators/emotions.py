"""Emotion analytics over predictions.

E2-E5 are one scan of the predictions in range: a period label column, a
group-by on (language, period, emotion) and window shares.  Dense matrices
are built by exploding each language's (small) emotion list against its
period rows, not by a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions.periods import chart_period_label, month_range, on_day
from murmur.functions.select import lang_selector, percent_2dp
from murmur.params import Params, check_grain, check_prediction_type


def argmax_prediction(pred: Column, digits: int = 5) -> Column:
    """M1: array<struct<label, score>> → struct(scores rounded half-even, top label, top score).

    Ties keep the first label in order, as ``max`` over a dict does.
    """
    rounded = F.transform(pred, lambda x: F.struct(x["label"].alias("label"),
                                                   F.bround(x["score"], digits).alias("score")))
    scores = F.transform(rounded, lambda x: x["score"])
    top = F.element_at(rounded, F.array_position(scores, F.array_max(scores)).cast("int"))
    return F.struct(rounded.alias("scores"), top["label"].alias("label"), top["score"].alias("score"))


def emotion_columns(predictions: DataFrame, prediction_type: str, params: Params) -> DataFrame:
    """Select the label and score of one prediction type (unknown type → ValueError, T24)."""
    check_prediction_type(prediction_type, params)
    return predictions.withColumn("emotion", F.col(f"{prediction_type}_prediction_emotion")) \
                      .withColumn("score", F.col(f"{prediction_type}_prediction_score"))


def chart_rows(predictions: DataFrame, prediction_type: str, grain: str, params: Params,
               start_month=None, end_month=None) -> DataFrame:
    """Rows of the chart queries: language, period label, emotion, article.

    P5 half-open month range on the raw timestamp (pushes down to the scan).
    """
    check_grain(grain)
    p = emotion_columns(predictions, prediction_type, params)
    p = p.where(F.col("text_lang").isin(list(params.languages)))
    if start_month is not None and end_month is not None:
        p = p.where(month_range("comment_timestamp", start_month, end_month))
    return p.select(F.col("text_lang").alias("language"),
                    chart_period_label("comment_timestamp", grain).alias("period"),
                    "emotion", "article_id")


def allowed_months(predictions: DataFrame, include_partial: bool = False) -> DataFrame:
    """min/max month and the month starts within [min, max]."""
    b = predictions.agg(F.min(F.col("comment_timestamp").cast("date")).alias("lo"),
                        F.max(F.col("comment_timestamp").cast("date")).alias("hi"))
    m = b.select("lo", "hi", F.explode(F.sequence(F.trunc("lo", "month"), "hi",
                                                  F.expr("interval 1 month"))).alias("m"))
    if not include_partial:
        m = m.where(F.col("m") >= F.col("lo"))
    return m.select(F.date_format("m", "yyyy-MM").alias("month"),
                    F.date_format("lo", "yyyy-MM").alias("min_month"),
                    F.date_format("hi", "yyyy-MM").alias("max_month"))


def comment_article_counts(rows: DataFrame, total_label: str = "total") -> DataFrame:
    """E2 per language and period; the combined block adds per-language distincts."""
    per = rows.groupBy("language", "period").agg(
        F.count_distinct("article_id").alias("unique_articles"),
        F.count(F.lit(1)).alias("total_comments"))
    return with_total(per, total_label)


def with_total(per: DataFrame, total_label: str = "total") -> DataFrame:
    """The rows of each language and period, and their sums over the languages."""
    tot = per.groupBy("period").agg(F.sum("unique_articles").alias("unique_articles"),
                                    F.sum("total_comments").alias("total_comments")) \
             .withColumn("language", F.lit(total_label))
    return per.select("language", "period", "unique_articles", "total_comments").unionByName(tot)


def emotion_counts(rows: DataFrame) -> DataFrame:
    """E3 long form; NULL emotions drop out of the matrix (T13), '' stays."""
    return (rows.where(F.col("emotion").isNotNull())
            .groupBy("language", "period", "emotion").agg(F.count(F.lit(1)).alias("count")))


def densify(counts: DataFrame, keys=("language",)) -> DataFrame:
    """E3 dense: every emotion of the block × every period of the block, 0 when absent (T5).

    The emotion list of a block is the classifier's label set (a handful of
    values); it is joined to the per-period rows on the block key and
    exploded, so no cross join is planned.
    """
    keys = list(keys)
    per_period = counts.groupBy(*keys, "period").agg(
        F.map_from_entries(F.collect_list(F.struct("emotion", "count"))).alias("_m"))
    labels = counts.groupBy(*keys).agg(F.array_sort(F.collect_set("emotion")).alias("_e"))
    j = per_period.join(labels, keys, "inner")
    return j.select(*keys, "period", F.explode("_e").alias("emotion"),
                    F.col("_m")).select(*keys, "period", "emotion",
                                        F.coalesce(F.element_at("_m", F.col("emotion")), F.lit(0)).cast("long")
                                        .alias("count"))


def with_period_share(dense: DataFrame, keys=("language",)) -> DataFrame:
    """Share of each emotion in its period; 0 on an empty period."""
    tot = F.sum("count").over(Window.partitionBy(*keys, "period"))
    return dense.withColumn("share", F.when(tot > 0, F.col("count") / tot).otherwise(F.lit(0.0)))


def overall_share(rows: DataFrame) -> DataFrame:
    """E4 over all periods; the denominator counts NULL-emotion rows too."""
    per = rows.groupBy("language", "emotion").agg(F.count(F.lit(1)).alias("n"))
    tot = F.sum("n").over(Window.partitionBy("language"))
    return per.withColumn("share", F.col("n") / tot).where(F.col("emotion").isNotNull()) \
              .select("language", "emotion", "share")


def combined_block(counts: DataFrame) -> DataFrame:
    """E5: both languages summed; shares recomputed on the combined matrix.

    One grouping-set aggregate gives the cells, the periods' and the emotions'
    sums and the grand total; the periods' rows are spread over the label list
    (a label set's size) by windows over that small output.
    """
    g = counts.groupingSets([["period", "emotion"], ["emotion"]], "period", "emotion") \
              .agg(F.sum("count").alias("count"), F.grouping("period").alias("_whole"))
    # the rows of an emotion over all periods travel with the cells, one list per label set
    per_period = g.groupBy("period", "_whole").agg(F.map_from_entries(F.collect_list(F.struct("emotion", "count"))).alias("_m"))
    whole = Window.partitionBy(F.lit(0))                # one row per period
    d = per_period.withColumn("_emo", F.max(F.when(F.col("_whole") == 1, F.map_entries("_m"))).over(whole)).where(F.col("_whole") == 0)
    grand = F.aggregate("_emo", F.lit(0).cast("long"), lambda a, e: a + e["value"])
    d = d.select("period", "_m", grand.alias("_grand"), F.explode("_emo").alias("_e"))
    d = d.select("period", F.col("_e.key").alias("emotion"), F.coalesce(F.element_at("_m", F.col("_e.key")), F.lit(0)).cast("long").alias("count"),
                 (F.col("_e.value") / F.col("_grand")).alias("overall_share"),
                 F.aggregate(F.map_values("_m"), F.lit(0).cast("long"), lambda a, x: a + x).alias("_per"))
    return d.select("period", "emotion", "count", F.when(F.col("_per") > 0, F.col("count") / F.col("_per")).otherwise(F.lit(0.0)).alias("share"), "overall_share")


def pivot_counts(counts: DataFrame, labels) -> DataFrame:
    """E3 wide: one column per label (explicit list, so no extra distinct job)."""
    names = {lab: pivot_name(lab) for lab in labels}
    w = counts.groupBy("language", "period").pivot("emotion", list(labels)).agg(F.first("count"))
    return w.select("language", "period",
                    *[F.coalesce(F.col(f"`{lab}`"), F.lit(0)).cast("long").alias(names[lab]) for lab in labels])


def pivot_name(label: str) -> str:
    import re
    return "e_" + (re.sub(r"[^a-z0-9]+", "_", label.lower()).strip("_") or "blank")


def day_comments(predictions: DataFrame, articles: DataFrame, prediction_type: str, params: Params,
                 lang: str | None = None, day=None) -> DataFrame:
    """Comments of a day with article title/url, label and score percent.

    J4: the reference's left join + non-null key is an inner join.  Without
    ``day`` every day is returned (with a ``day`` column).
    """
    p = emotion_columns(predictions, prediction_type, params)
    if day is not None:
        p = p.where(on_day("comment_timestamp", day))
    p = p.where(F.col("emotion").isNotNull() & lang_selector("text_lang", lang, params))
    a = articles.select("article_id", F.col("headline").alias("article_title"), F.col("url").alias("article_url"))
    return p.join(a, "article_id", "inner").select(
        "id", F.col("text").alias("comment_text"), "article_id", "article_title", "article_url",
        F.col("text_lang").alias("comment_lang"), F.col("emotion").alias("prediction"),
        percent_2dp("score").alias("prediction_score"),
        F.col("comment_timestamp").cast("date").alias("day"))


def day_articles(predictions: DataFrame, articles: DataFrame, prediction_type: str, params: Params,
                 lang: str | None = None, day=None) -> DataFrame:
    """Distinct articles that have a prediction that day (a semi-join)."""
    p = emotion_columns(predictions, prediction_type, params)
    if day is not None:
        p = p.where(on_day("comment_timestamp", day))
    p = p.where(F.col("emotion").isNotNull() & lang_selector("text_lang", lang, params)) \
         .select("article_id", F.col("comment_timestamp").cast("date").alias("day")).distinct()
    a = articles.select(F.col("article_id"), F.col("headline").alias("article_title"))
    return p.join(a, "article_id", "inner").select("day", F.col("article_id").alias("id"), "article_title")


def grouped_counts(day_rows: DataFrame, by: str) -> DataFrame:
    """Group a day's comments by article or by emotion with group sizes."""
    return day_rows.groupBy("day", by).agg(F.count(F.lit(1)).alias("n"))
