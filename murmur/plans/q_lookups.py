"""Queries: lookups and paging (P1-P4), pending work (J2, J3), backfill (J8), exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.functions.sites import resolve_portal
from murmur.operators import export as ex
from murmur.operators import lookups as lk
from murmur.operators import stored as sto
from murmur.operators.text import lemmatize
from murmur.plans.oracle_views import with_views
from murmur.plans.registry import Ctx, flat, register
from murmur.plans.sqlutil import sql_list
from murmur.session import scratch_path
from murmur.sources import fixtures as fx

P = fx.FIXTURE_PARAMS
LANGS = sql_list(P.languages)
CUTOFF = "2024-03-01"          # comments before it are already lemmatized
PAGE_OFFSET, PAGE_SIZE, LAST_KEY = 100, 100, 500


@register("table_counts", with_views(("fx_comments", "fx_articles", "fx_predictions"), "", """
SELECT 'articles' AS tbl, CAST(count(*) AS BIGINT) AS n FROM fx_articles
UNION ALL SELECT 'comments', count(*) FROM fx_comments
UNION ALL SELECT 'predicted_comments', count(*) FROM fx_predictions"""))
def q_table_counts(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    return lk.table_counts({"articles": ctx.articles, "comments": ctx.comments,
                            "predicted_comments": ctx.predictions})


@register("page_comments", with_views(("fx_comments",), "", f"""
SELECT id, article_id, website, comment_lang FROM fx_comments ORDER BY id LIMIT {PAGE_SIZE} OFFSET {PAGE_OFFSET}"""))
def q_page_comments(spark, sf_dir):
    c = Ctx(spark, sf_dir).comments.select("id", "article_id", "website", "comment_lang")
    return lk.page(c, PAGE_OFFSET, PAGE_SIZE)


@register("page_predicted_with_comment", with_views(("fx_predictions", "fx_comments"), "", f"""
SELECT p.id, p.comment_id, p.ekman_prediction_emotion AS emotion, c.comment_lang AS raw_comment_lang,
       length(c.comment_text) AS raw_comment_chars
FROM fx_predictions p LEFT JOIN fx_comments c ON p.comment_id = c.id
WHERE p.comment_id IS NOT NULL ORDER BY p.id LIMIT {PAGE_SIZE}"""))
def q_page_predicted_with_comment(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    j = lk.predictions_with_comment(ctx.predictions, ctx.comments)
    j = j.select("id", "comment_id", F.col("ekman_prediction_emotion").alias("emotion"), "raw_comment_lang",
                 F.length("raw_comment_text").alias("raw_comment_chars"))
    return lk.page(j, 0, PAGE_SIZE)


@register("keyset_page", with_views(("fx_comments",), "", f"""
SELECT id, article_id, comment_lang FROM fx_comments
WHERE comment_lang = '{P.languages[0]}' AND id > {LAST_KEY} ORDER BY id LIMIT {PAGE_SIZE}"""))
def q_keyset_page(spark, sf_dir):
    c = Ctx(spark, sf_dir).comments.where(F.col("comment_lang") == P.languages[0])
    return lk.keyset_page(c.select("id", "article_id", "comment_lang"), LAST_KEY, PAGE_SIZE)


@register("pending_lemmatize", with_views(("fx_comments",), "", f"""
SELECT id, comment_lang FROM fx_comments
WHERE comment_lang IN ({LANGS}) AND NOT (day < DATE '{CUTOFF}')"""))
def q_pending_lemmatize(spark, sf_dir):
    """The lemmatized table holds the comments before the cutoff day."""
    ctx = Ctx(spark, sf_dir)
    done = lemmatize(ctx.comments.where(F.col("day") < F.lit(CUTOFF).cast("date")))
    return lk.pending_lemmatize(ctx.comments, done, ctx.params).select("id", "comment_lang")


PENDING = with_views(("fx_comments", "fx_articles", "fx_predictions"), f"""
pend AS (SELECT c.id, c.comment_lang, c.article_id, c.website FROM fx_comments c
         WHERE c.comment_lang IN ({LANGS})
           AND EXISTS (SELECT 1 FROM fx_articles a WHERE a.article_id = c.article_id)
           AND NOT EXISTS (SELECT 1 FROM fx_predictions p WHERE p.comment_id = c.id))""", "{body}")


def pending(ctx: Ctx):
    return lk.pending_predict(ctx.comments, ctx.articles, ctx.predictions, ctx.params)


@register("pending_predict", PENDING.replace("{body}", "SELECT * FROM pend"))
def q_pending_predict(spark, sf_dir):
    return pending(Ctx(spark, sf_dir)).select("id", "comment_lang", "article_id", "website")


@register("pending_predict_count", PENDING.replace(
    "{body}", "SELECT comment_lang, CAST(count(*) AS BIGINT) AS n FROM pend GROUP BY comment_lang"))
def q_pending_predict_count(spark, sf_dir):
    return pending(Ctx(spark, sf_dir)).groupBy("comment_lang").agg(F.count(F.lit(1)).alias("n"))


@register("backfill_site", with_views(("fx_comments", "fx_articles"), "", """
SELECT c.id, c.article_id, coalesce(a.website, c.website) AS website
FROM fx_comments c LEFT JOIN fx_articles a USING (article_id)"""))
def q_backfill_site(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    return lk.backfill_site(ctx.comments.select("id", "article_id", "website"), ctx.articles)


@register("backfill_site_predictions", with_views(("fx_predictions", "fx_articles"), "", """
SELECT p.id, p.article_id, coalesce(a.website, p.website) AS website
FROM fx_predictions p LEFT JOIN fx_articles a USING (article_id)"""))
def q_backfill_site_predictions(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    return lk.backfill_site(ctx.predictions.select("id", "article_id", "website"), ctx.articles)


@register("resolve_portal", with_views(("fx_articles",), "", """
SELECT article_id, url,
       CASE WHEN contains(url, 'delfi') THEN 'delfi' WHEN contains(url, 'tvnet') THEN 'tvnet'
            WHEN contains(url, 'apollo') THEN 'apollo' ELSE 'other' END AS portal,
       website AS site
FROM fx_articles"""))
def q_resolve_portal(spark, sf_dir):
    """B3 next to J8's resolver: the two differ in case and priority."""
    a = Ctx(spark, sf_dir).articles
    return a.select("article_id", "url", resolve_portal("url").alias("portal"), F.col("website").alias("site"))


@register("export_predicted", with_views(("fx_predictions", "fx_articles"), "", """
SELECT p.text_lang AS valoda, strftime(p.comment_timestamp, '%Y-%m-%d %H:%M:%S') AS datums,
       CASE WHEN contains(a.url, 'delfi') THEN 'delfi' WHEN contains(a.url, 'tvnet') THEN 'tvnet'
            WHEN contains(a.url, 'apollo') THEN 'apollo' ELSE 'other' END AS portals,
       p.text AS komentars
FROM fx_predictions p JOIN fx_articles a USING (article_id)"""))
def q_export_predicted(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    return flat(ex.export_predicted(ctx.predictions, ctx.articles))


@register("export_raw", with_views(("fx_comments", "fx_articles"), "", """
SELECT CASE WHEN c.comment_lang = 'other'
            THEN CASE WHEN c.region = 'rus' THEN 'ru' WHEN c.region = 'lat' THEN 'lv' END
            ELSE c.comment_lang END AS valoda,
       strftime(CAST(c.day AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS datums,
       CASE WHEN contains(a.url, 'delfi') THEN 'delfi' WHEN contains(a.url, 'tvnet') THEN 'tvnet'
            WHEN contains(a.url, 'apollo') THEN 'apollo' ELSE 'other' END AS portals,
       c.comment_text AS komentars
FROM fx_comments c JOIN fx_articles a USING (article_id)"""))
def q_export_raw(spark, sf_dir):
    ctx = Ctx(spark, sf_dir)
    return flat(ex.export_raw(ctx.comments, ctx.articles))


# --------------------------------------------------------------------------- P1, P4, P11 on stored tables
KEYS_ASKED = (0, 37, 4_000_000_000)
SEARCHED = ("erth", "ou", "Zz9")


@register("lookup_by_key", with_views(("fx_comments",), "", f"""
SELECT id, article_id, comment_lang FROM fx_comments WHERE id IN ({", ".join(map(str, KEYS_ASKED))})"""))
def q_lookup_by_key(spark, sf_dir):
    """Single comments by key from a clustered table; keys that are not stored give no row."""
    path = scratch_path(spark, "clustered")
    sto.save_clustered(Ctx(spark, sf_dir).comments.select("id", "article_id", "comment_lang"), path)
    return reduce(DataFrame.unionByName, [sto.lookup(spark, path, k) for k in KEYS_ASKED])


@register("key_exists", with_views(("fx_comments",), "", " UNION ALL ".join(
    f"SELECT CAST({k} AS BIGINT) AS id, (SELECT count(*) > 0 FROM fx_comments WHERE id = {k}) AS stored" for k in KEYS_ASKED)))
def q_key_exists(spark, sf_dir):
    """Existence of keys."""
    path = scratch_path(spark, "clustered")
    sto.save_clustered(Ctx(spark, sf_dir).comments.select("id", "article_id"), path)
    asked = [sto.has_key(spark, path, k).agg(F.lit(k).cast("long").alias("id"), (F.count(F.lit(1)) > 0).alias("stored")) for k in KEYS_ASKED]
    return reduce(DataFrame.unionByName, asked)


@register("keyset_page_stored", with_views(("fx_comments",), "", f"""
SELECT id, article_id, comment_lang FROM fx_comments WHERE id > {LAST_KEY} ORDER BY id LIMIT {PAGE_SIZE}"""))
def q_keyset_page_stored(spark, sf_dir):
    """P4 from a clustered table."""
    path = scratch_path(spark, "clustered")
    sto.save_clustered(Ctx(spark, sf_dir).comments.select("id", "article_id", "comment_lang"), path)
    return sto.page_after(spark, path, LAST_KEY, PAGE_SIZE)


@register("search_stored_comments", with_views(("fx_comments",), "", " UNION ALL ".join(
    f"SELECT '{t}' AS term, id, article_id FROM fx_comments WHERE contains(lower(comment_text), '{t.lower()}')" for t in SEARCHED)))
def q_search_stored_comments(spark, sf_dir):
    """P11 by trigram postings; one term has two letters, one occurs nowhere."""
    path = scratch_path(spark, "searchable")
    sto.save_searchable(Ctx(spark, sf_dir).comments.select("id", "article_id", "comment_text"), path, "comment_text")
    found = [sto.search_stored(spark, path, "comment_text", t).select(F.lit(t).alias("term"), "id", "article_id") for t in SEARCHED]
    return reduce(DataFrame.unionByName, found)


OTHER = "CASE WHEN id % 4 = 0 THEN 'other' ELSE comment_lang END"


@register("export_raw_other", with_views(("fx_comments", "fx_articles"), f"c AS (SELECT *, {OTHER} AS lang FROM fx_comments)", """
SELECT c.id, CASE WHEN c.lang <> 'other' THEN c.lang WHEN c.region = 'rus' THEN 'ru' WHEN c.region = 'lat' THEN 'lv' END AS valoda
FROM c JOIN fx_articles a USING (article_id)"""))
def q_export_raw_other(spark, sf_dir):
    """B2's fallback: a quarter of the comments has language ``other`` and takes the one of its region, or none."""
    ctx = Ctx(spark, sf_dir)
    c = ctx.comments.withColumn("comment_lang", F.expr(OTHER.replace("comment_lang", "`comment_lang`")))
    out = ex.export_raw(c.withColumn("comment_text", F.col("id").cast("string")), ctx.articles)
    return out.select(F.col("komentars").cast("long").alias("id"), "valoda")
