"""Queries: lexicon, stop-word and lemma sources written from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.functions.text import detect_language
from murmur.operators import keywords as kw
from murmur.operators import lexicon as lx
from murmur.operators import rollups as ro
from murmur.operators.text import MAX_ENDING, learn_endings, lemmatize, lemmatize_tokens
from murmur.plans.oracle_views import with_views
from murmur.plans.registry import Ctx, flat, register
from murmur.plans.sqlutil import sql_list
from murmur.session import scratch_path
from murmur.sources import files as fl
from murmur.sources import fixtures as fx

P = fx.FIXTURE_PARAMS
LANGS = sql_list(P.languages)
CYRILLIC = ("abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстувшхыз")

# --------------------------------------------------------------------------- A10
FLAG_SQL = ", ".join(f"CAST(floor(p_partkey / {2 ** i}) AS BIGINT) % 2 = 1 AS category_{c.lower()}" for i, c in enumerate(lx.CATEGORIES))


@register("lexicon_csv_load", f"""
SELECT CASE WHEN p_partkey % 3 = 0 THEN 'слово' || CAST(p_partkey AS VARCHAR) ELSE p_name END AS word,
       CASE WHEN p_partkey % 3 = 0 THEN 'ru' ELSE 'lv' END AS language,
       CAST(p_size AS DOUBLE) / 4 AS weight, CAST(0 AS INTEGER) AS frequency, {FLAG_SQL} FROM part""")
def q_lexicon_csv_load(spark, sf_dir):
    """A10: a lexicon CSV with header, weights and category flags, written from ``part`` and loaded."""
    root = scratch_path(spark, "lexicon-csv")
    key = F.col("p_partkey")
    word = F.when(key % 3 == 0, F.concat(F.lit("слово"), key.cast("string"))).otherwise(F.col("p_name"))
    flags = [F.expr(f"cast(floor(p_partkey / {2 ** i}) as bigint) % 2").cast("string").alias(c) for i, c in enumerate(lx.CATEGORIES)]
    part = Ctx(spark, sf_dir).t.part
    part.select(word.alias("word"), (F.col("p_size").cast("double") / 4).alias("weight"), *flags).write.option("header", True).csv(root)
    return lx.lexicon_from_csv(fl.read_lexicon_csv(spark, root))


# --------------------------------------------------------------------------- A11
@register("html_lexicon_pages", """
SELECT CAST(p_partkey AS INTEGER) AS rank, p_name || ' & ā' AS word, CAST(1000 + p_size AS BIGINT) AS frequency,
       CAST(p_size AS DOUBLE) / 4 AS weight, CAST(p_partkey % 2 AS INTEGER) AS flag FROM part""")
def q_html_lexicon_pages(spark, sf_dir):
    """Lexicon tables in HTML pages, one page per brand, written from ``part`` and parsed."""
    def td(*parts):
        return F.concat(F.lit("<td>"), *parts, F.lit("</td>"))
    weight = F.regexp_replace((F.col("p_size").cast("double") / 4).cast("string"), "[.]", ",")
    flag = F.when(F.col("p_partkey") % 2 == 1, F.lit("<img src='x'>")).otherwise(F.lit(""))
    row = F.concat(F.lit("<tr>"), td(F.lit("\n "), F.col("p_partkey").cast("string"), F.lit(". ")),
                   td(F.lit("<a href='#'>\n"), F.col("p_name"), F.lit(" &amp; &#257;</a>")), td(F.lit("p")),
                   td(F.lit("1&nbsp;"), F.lpad(F.col("p_size").cast("string"), 3, "0")), td(weight), td(flag),
                   F.lit("<td></td>" * 10), F.lit("</tr>"))
    pages = Ctx(spark, sf_dir).t.part.select("p_brand", row.alias("tr")).groupBy("p_brand").agg(
        F.concat(F.lit("<table class='t' id='data_table'>\n<tbody>"), F.array_join(F.collect_list("tr"), "\n"), F.lit("</tbody></table>")).alias("html"))
    return fl.html_lexicon_rows(pages).select("rank", "word", "frequency", "weight", F.col(lx.CATEGORIES[0]).alias("flag"))


# --------------------------------------------------------------------------- A12
@register("stopword_files", """
SELECT DISTINCT 'lv' AS language, trim(p_type) AS word FROM part
UNION SELECT DISTINCT 'ru', trim(p_brand) FROM part""")
def q_stopword_files(spark, sf_dir):
    """Stop-word files, one word per line with blanks and repeats, written from ``part`` and read."""
    root = scratch_path(spark, "stopwords")
    part = Ctx(spark, sf_dir).t.part
    part.select(F.concat(F.lit(" "), F.col("p_type"), F.lit("  "))).write.text(f"{root}/lv")
    part.select(F.col("p_brand")).union(spark.range(1).select(F.lit(""))).write.text(f"{root}/ru")
    return fl.read_stopwords(spark, {"lv": f"{root}/lv", "ru": f"{root}/ru", "en": f"{root}/none"})


# --------------------------------------------------------------------------- X1 on Cyrillic texts
MIXED = f"""CASE doc_id % 4 WHEN 0 THEN translate(text, '{CYRILLIC[0]}', '{CYRILLIC[1]}')
                 WHEN 1 THEN translate(text, 'aeinorst', 'аеинорст') ELSE text END"""


@register("detect_language_mixed", f"""
WITH c AS (SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'rus' WHEN 1 THEN 'lat' END AS region, {MIXED} AS t FROM documents),
n AS (SELECT id, region, len(regexp_extract_all(t, '[Ѐ-ӿ]')) AS k, len(regexp_extract_all(t, '[A-Za-zĀ-ž]')) AS l FROM c)
SELECT id, region, CASE WHEN k + l > 0 AND k / (k + l) > 0.85 THEN 'ru' WHEN region = 'rus' THEN 'ru' ELSE 'lv' END AS detected_lang
FROM n""")
def q_detect_language_mixed(spark, sf_dir):
    """A quarter of the texts in Cyrillic letters, a quarter in both scripts."""
    key, text = F.col("doc_id"), F.col("text")
    mixed = F.when(key % 4 == 0, F.translate(text, *CYRILLIC)).when(key % 4 == 1, F.translate(text, "aeinorst", "аеинорст")).otherwise(text)
    region = F.when(key % 3 == 0, "rus").when(key % 3 == 1, "lat")
    d = Ctx(spark, sf_dir).t.documents.select(key.alias("id"), region.alias("region"), mixed.alias("t"))
    return d.select("id", "region", detect_language("t", "region").alias("detected_lang"))


# --------------------------------------------------------------------------- X2, K1, W5 with a lemma table
# A form that starts with one of these words and has up to four letters more is a form of that word.
STEMS = "that|und|die|en|de|la"
FORM = rf"^({STEMS})\p{{L}}{{1,4}}$"
FORM_VIEWS = f"""
fw AS (SELECT comment_id, article_id, website, day, comment_lang, unnest(lemmas) AS form, unnest(generate_series(0, len(lemmas) - 1)) AS pos
       FROM fx_lemmatized),
ft AS (SELECT *, CASE WHEN regexp_extract(form, '{FORM}', 1) <> '' THEN regexp_extract(form, '{FORM}', 1) ELSE form END AS lemma FROM fw)"""


def lemma_table(ctx: Ctx):
    """(language, form, lemma) of the documents' vocabulary, each form also with a second, later lemma; written once and read back."""
    words = ctx.lemmatized.select(F.col("comment_lang").alias("language"), F.explode_outer("lemmas").alias("form")).distinct()
    rows = words.select("language", "form", F.regexp_extract("form", FORM, 1).alias("lemma")).where("lemma != ''")
    path = scratch_path(ctx.spark, "lemma-table")
    rows.select(F.col("language"), F.col("form"), F.explode(F.array("lemma", F.concat(F.lit("zz"), F.col("lemma")))).alias("lemma")).write.parquet(path)
    return ctx.spark.read.schema("language string, form string, lemma string").parquet(path)


def with_lemmas(ctx: Ctx):
    return lemmatize(ctx.comments, lemma_table(ctx), keep=("article_id", "website", "day", "comment_lang"))


@register("tokenize_lemma_table", with_views(("fx_lemmatized",), FORM_VIEWS, """
SELECT l.comment_id, CAST(len(l.lemmas) AS INTEGER) AS lemma_count, coalesce(x.t, '') AS lemma_text
FROM fx_lemmatized l LEFT JOIN (SELECT comment_id, string_agg(lemma, ' ' ORDER BY pos) AS t FROM ft GROUP BY 1) x ON l.comment_id = x.comment_id"""))
def q_tokenize_lemma_table(spark, sf_dir):
    """Lemmas looked up in a queried lemma table that has several lemmas for a form."""
    lm = with_lemmas(Ctx(spark, sf_dir))
    return lm.select("comment_id", "lemma_count", F.array_join("lemmas", " ").alias("lemma_text"))


FORMS_SQL = FORM_VIEWS + f""",
h AS (SELECT t.day AS date, t.comment_lang AS language, CASE WHEN t.website IN ({sql_list(P.sites)}) THEN t.website END AS site, t.lemma, t.form
      FROM ft t JOIN fx_lexicon l ON l.word = t.lemma WHERE t.comment_lang IN ({LANGS})),
f AS (SELECT date, language, site, lemma, form, grouping(site) AS g, count(*) AS cnt
      FROM h GROUP BY GROUPING SETS ((date, language, site, lemma, form), (date, language, lemma, form)))"""


def form_hits(ctx: Ctx):
    return kw.hits_fact(with_lemmas(ctx), ctx.lexicon, ctx.params, ctx.lexicon_rows)


@register("keyword_forms_lemma_table", with_views(("fx_lemmatized", "fx_lexicon"), FORMS_SQL, """
SELECT strftime(date, '%Y-%m-%d') AS date, language, CASE WHEN g = 1 THEN 'all' ELSE site END AS website,
       lemma AS word, form, CAST(cnt AS BIGINT) AS count
FROM f WHERE g = 1 OR site IS NOT NULL"""))
def q_keyword_forms_lemma_table(spark, sf_dir):
    """K1 forms: several surface forms per word."""
    ctx = Ctx(spark, sf_dir)
    return flat(kw.keyword_forms_by_day(form_hits(ctx), ctx.params))


@register("keyword_forms_ranked_lemma_table", with_views(("fx_lemmatized", "fx_lexicon"), FORMS_SQL + """,
fp AS (SELECT language, lemma AS word, form, CAST(sum(cnt) AS BIGINT) AS count FROM f WHERE g = 1 GROUP BY ALL)""", """
SELECT language, word, form, count, CAST(row_number() OVER (PARTITION BY language, word ORDER BY count DESC, form) AS INTEGER) AS rank FROM fp"""))
def q_keyword_forms_ranked_lemma_table(spark, sf_dir):
    """W5 over K6 forms: ranks above one."""
    ctx = Ctx(spark, sf_dir)
    return kw.ranked_forms(kw.keyword_forms_by_period(form_hits(ctx), "2000-01-01", "2099-12-31", ctx.params))


# --------------------------------------------------------------------------- P11 on the other columns
@register("search_comments", with_views(("fx_comments",), "", "SELECT id, article_id FROM fx_comments WHERE contains(lower(comment_text), 'erth')"))
def q_search_comments(spark, sf_dir):
    return lx.search(Ctx(spark, sf_dir).comments, "comment_text", "ERTH").select("id", "article_id")


@register("search_emotions", with_views(("fx_predictions",), "", """
SELECT id, ekman_prediction_emotion FROM fx_predictions WHERE contains(lower(ekman_prediction_emotion), 'high')"""))
def q_search_emotions(spark, sf_dir):
    return lx.search(Ctx(spark, sf_dir).predictions, "ekman_prediction_emotion", "High").select("id", "ekman_prediction_emotion")


# --------------------------------------------------------------------------- X2, X3 with learned endings
KNOWN_FORMS = "length(form) % 2 = 0"          # the forms the table holds; the others are unseen
ENDINGS = FORM_VIEWS + f""",
vocab AS (SELECT DISTINCT comment_lang AS language, form, regexp_extract(form, '{FORM}', 1) AS lemma FROM fw),
pairs AS (SELECT *, len(list_filter(range(1, length(lemma) + 1), lambda i: left(form, i) = left(lemma, i))) AS n
          FROM vocab WHERE lemma <> '' AND {KNOWN_FORMS}),
votes AS (SELECT language, right(form, s) AS ending, length(form) - n AS cut, substr(lemma, n + 1) AS add, count(*) AS n
          FROM (SELECT *, unnest(range(greatest(length(form) - n, 1), least(length(form), {MAX_ENDING}) + 1)) AS s FROM pairs) GROUP BY ALL HAVING count(*) >= 2),
rules AS (SELECT language, ending, cut, add FROM votes QUALIFY row_number() OVER (PARTITION BY language, ending ORDER BY n DESC, cut, add) = 1),
seen AS (SELECT comment_lang AS language, form, count(*) AS n FROM fw GROUP BY ALL),
ruled AS (SELECT s.language, s.form, left(s.form, length(s.form) - r.cut) || r.add AS lemma FROM seen s
          JOIN rules r ON r.language = s.language AND length(s.form) >= length(r.ending) AND right(s.form, length(r.ending)) = r.ending
          QUALIFY row_number() OVER (PARTITION BY s.language, s.form ORDER BY length(r.ending) DESC) = 1)"""


def known_pairs(ctx: Ctx):
    return lemma_table(ctx).where(f"not startswith(lemma, 'zz') and {KNOWN_FORMS}")


@register("lemma_endings", with_views(("fx_lemmatized",), ENDINGS, "SELECT language, ending, CAST(cut AS INTEGER) AS cut, add FROM rules"))
def q_lemma_endings(spark, sf_dir):
    """Edit rules learned from (language, form, lemma) pairs."""
    return learn_endings(known_pairs(Ctx(spark, sf_dir))).select("language", "ending", F.col("cut").cast("int").alias("cut"), "add")


@register("lemmatize_learned", with_views(("fx_lemmatized",), ENDINGS, """
SELECT s.language, s.form, coalesce(p.lemma, nullif(r.lemma, ''), s.form) AS lemma, s.n FROM seen s
LEFT JOIN pairs p USING (language, form) LEFT JOIN ruled r USING (language, form)"""))
def q_lemmatize_learned(spark, sf_dir):
    """Lemmas from the table, from learned endings for forms the table lacks, counted per form."""
    ctx = Ctx(spark, sf_dir)
    path = scratch_path(spark, "endings")
    pairs = known_pairs(ctx)
    learn_endings(pairs).write.parquet(path)
    t = lemmatize_tokens(ctx.comments, pairs, spark.read.parquet(path))
    return t.groupBy("language", "form", "lemma").agg(F.count(F.lit(1)).alias("n"))


@register("aggr_by_day_lemma_tokens", with_views(("fx_lemmatized", "fx_lexicon"), FORM_VIEWS + f""",
d AS (SELECT t.day AS date, t.comment_lang AS language, CASE WHEN grouping(t.website) = 1 THEN 'all' ELSE t.website END AS website,
             count(l.word) AS aggressive_word_count, coalesce(sum(l.weight), 0.0) AS aggressive_word_weight_sum, count(*) AS total_word_count
      FROM ft t LEFT JOIN fx_lexicon l ON l.word = t.lemma WHERE t.comment_lang IN ({LANGS}) AND t.website IN ({sql_list(P.sites)})
      GROUP BY GROUPING SETS ((t.day, t.comment_lang, t.website), (t.day, t.comment_lang)))""", """
SELECT strftime(date, '%Y-%m-%d') AS date, language, website, aggressive_word_count, aggressive_word_weight_sum, total_word_count,
       aggressive_word_count / total_word_count AS aggressiveness_ratio, aggressive_word_weight_sum / total_word_count AS weighted_aggressiveness_ratio FROM d"""))
def q_aggr_by_day_lemma_tokens(spark, sf_dir):
    """G1+G2 from the long form: a lemma table without putting comments together again."""
    ctx = Ctx(spark, sf_dir)
    t = lemmatize_tokens(ctx.comments, lemma_table(ctx), keep=("website", "day")).withColumnRenamed("day", "date")
    return flat(ro.aggressiveness_from_tokens(t, ctx.lexicon, ctx.params, ctx.lexicon_rows))
