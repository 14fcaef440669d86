"""Queries: ingestion of drop files (A1-A9, A11) over drops derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.operators import ingest as ig
from murmur.operators.lookups import insert_if_absent
from murmur.plans.oracle_views import with_views
from murmur.plans.registry import Ctx, register
from murmur.session import scratch_path
from murmur.sources import files as fl
from murmur.sources import fixtures as fx
from murmur.sources.drops import write_drop, write_named

BASE_ID = 1_000_000
COMMENT_SITE, ARTICLE_SITE = "site_a", "delfi"
DROP_YEAR = "2024"


def comment_drop(ctx: Ctx, root: str, n_files: int | None = None) -> str:
    d = ctx.t.documents.withColumn("region", F.when(F.col("doc_id") % 3 == 0, F.lit("rus"))
                                   .when(F.col("doc_id") % 3 == 1, F.lit("lat")))
    cols = [F.col("region"), F.col("doc_id") % 97, F.col("source"), F.lit(None),
            F.date_format(F.date_add(F.lit("2024-01-10").cast("date"), ((F.col("doc_id") * 37) % 149).cast("int")),
                          "yyyy-MM-dd 00:00:00"),
            F.col("text")]
    return write_drop(d, f"{root}/comments/{DROP_YEAR}", cols, "doc_id", n_files)


def article_drop(ctx: Ctx, root: str) -> str:
    o = ctx.t.orders
    cols = [F.when(F.col("o_orderstatus") == "O", F.lit("rus")).otherwise(F.lit("lat")), fx.shifted_article("o_custkey"),
            F.concat(F.col("o_orderpriority"), F.lit(" #"), F.col("o_orderkey").cast("string")),
            F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"),
            F.concat(F.lit("https://www.delfi.lv/"), F.col("o_custkey").cast("string"))]
    return write_drop(o, f"{root}/articles-meta/{DROP_YEAR}", cols, "o_orderkey", gzip=True)


def parsed_comments(ctx: Ctx):
    root = scratch_path(ctx.spark, "drops")
    return fl.read_tsv(ctx.spark, comment_drop(ctx, root), fl.COMMENT_COLUMNS)


def loaded_articles(ctx: Ctx):
    root = scratch_path(ctx.spark, "drops")
    parsed = fl.valid_rows(fl.read_tsv(ctx.spark, article_drop(ctx, root), fl.ARTICLE_COLUMNS))
    return ig.load_articles(parsed, ARTICLE_SITE, ctx.params)


X1 = """CASE WHEN len(regexp_extract_all({t}, '[Ѐ-ӿ]')) + len(regexp_extract_all({t}, '[A-Za-zĀ-ž]')) > 0
              AND len(regexp_extract_all({t}, '[Ѐ-ӿ]')) /
                  (len(regexp_extract_all({t}, '[Ѐ-ӿ]')) + len(regexp_extract_all({t}, '[A-Za-zĀ-ž]'))) > 0.85
         THEN 'ru' WHEN {r} = 'rus' THEN 'ru' WHEN {r} = 'lat' THEN 'lv' ELSE 'lv' END"""


@register("load_comments", f"""
WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'rus' WHEN 1 THEN 'lat' END AS region,
                  nullif(regexp_replace(text, '[\\t\\r\\n]', ' ', 'g'), '') AS t FROM documents)
SELECT {BASE_ID} + row_number() OVER (ORDER BY doc_id) AS id, doc_id % 97 AS article_id, region,
       {X1.format(t='coalesce(t, \'\')', r='region')} AS comment_lang,
       '{COMMENT_SITE}' AS website, CAST(length(t) AS INTEGER) AS n_chars
FROM d""")
def q_load_comments(spark, sf_dir):
    """A1+A5: read the comment drop, detect language, stamp site, append dense ids."""
    ctx = Ctx(spark, sf_dir)
    rows = ig.load_comments(fl.valid_rows(parsed_comments(ctx)), COMMENT_SITE, ctx.params, BASE_ID)
    return rows.select("id", "article_id", "region", "comment_lang", "website",
                       F.length("comment_text").alias("n_chars"))


ART_SQL = f"""
a AS (SELECT CASE WHEN o_custkey % 10 = 0 THEN o_custkey + 10000000 ELSE o_custkey END AS article_id,
             arg_min(CASE WHEN o_orderstatus = 'O' THEN 'rus' ELSE 'lat' END, o_orderkey) AS region,
             arg_min(o_orderpriority || ' #' || CAST(o_orderkey AS VARCHAR), o_orderkey) AS headline,
             arg_min(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), o_orderkey) AS pub_timestamp,
             'https://www.delfi.lv/' || CAST(o_custkey AS VARCHAR) AS url
      FROM orders GROUP BY o_custkey),
b AS (SELECT article_id, headline, pub_timestamp, url, region,
             {X1.format(t='headline', r='region')} AS headline_lang, '{ARTICLE_SITE}' AS website FROM a)"""


@register("load_articles_dedup", with_views((), ART_SQL, "SELECT * FROM b"))
def q_load_articles_dedup(spark, sf_dir):
    """A1+A6: gzip drop; the first row per article_id in (file, line) order."""
    a = loaded_articles(Ctx(spark, sf_dir))
    return a.select("article_id", "headline", "pub_timestamp", "url", "region", "headline_lang", "website")


@register("insert_if_absent", with_views(("fx_articles",), ART_SQL, """
SELECT * FROM b WHERE article_id NOT IN (SELECT article_id FROM fx_articles)"""))
def q_insert_if_absent(spark, sf_dir):
    """Loaded articles whose id is not in the target yet (existing row wins)."""
    ctx = Ctx(spark, sf_dir)
    a = loaded_articles(ctx).select("article_id", "headline", "pub_timestamp", "url", "region",
                                    "headline_lang", "website")
    return insert_if_absent(a, ctx.articles, "article_id")


@register("select_import_files")
def q_select_import_files(spark, sf_dir):
    """A3/A4/A9 (rows-only): files of a drop folder not yet imported, routed by 'meta'."""
    ctx = Ctx(spark, sf_dir)
    root = scratch_path(spark, "drops")
    comment_drop(ctx, root)
    article_drop(ctx, root)
    listing = fl.list_files(spark, root)
    # the log marks the first comment file as already imported
    log = (listing.where(F.col("path").contains("/comments/"))
           .select(F.element_at(F.split("path", "/"), -1).alias("file_name"))
           .orderBy("file_name").limit(1).withColumn("status", F.lit("Success")))
    return fl.select_import_files(listing, log, ctx.params, root, year_in="path") \
             .select("file_name", "kind", "length")


@register("select_files_by_name", """
SELECT 'comment' AS kind, '2024' AS year, CAST(2 AS BIGINT) AS n_files, (SELECT count(*) FROM documents WHERE doc_id % 4 = 2) AS n_rows
UNION ALL SELECT 'article', '2023', 2, (SELECT count(*) FROM documents WHERE doc_id % 4 = 3)""")
def q_select_files_by_name(spark, sf_dir):
    """The year in the file's name, ``meta`` anywhere in the path, files of the log left out; the files selected are read.

    Four drops of two files each: 2019 is no import year, the files of 2021 are in the log.
    """
    ctx = Ctx(spark, sf_dir)
    root = scratch_path(spark, "named-drops")
    for k, (folder, base) in enumerate((("comments", "tvnet_2019"), ("comments", "tvnet_2021"), ("comments", "tvnet_2024"), ("2020-meta", "tvnet_2023"))):
        write_named(ctx.t.documents.where(F.col("doc_id") % 4 == k), f"{root}/{folder}", base, [F.col("lang"), F.col("doc_id")], gzip=k == 2)
    listing = fl.list_files(spark, root)
    log = listing.where(F.col("path").contains("tvnet_2021")).select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.lit("Success").alias("status"))
    chosen = fl.select_import_files(listing, log, ctx.params, root).withColumn("year", F.regexp_extract("file_name", "_([0-9]{4})", 1))
    lines = fl.read_tsv(spark, [f"{root}/comments", f"{root}/2020-meta"], ("region", "article_id"))
    n = lines.groupBy(F.element_at(F.split("file_path", "/"), -1).alias("file_name")).agg(F.count(F.lit(1)).alias("n"))
    return chosen.join(n, "file_name").groupBy("kind", "year").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n").alias("n_rows"))


@register("import_log_status", """
SELECT 'good' AS folder, 'Success' AS status, CAST(4 AS BIGINT) AS n_files, (SELECT count(*) FROM documents) AS n_loaded
UNION ALL SELECT 'narrow', 'Failed', 4, 0 UNION ALL SELECT 'empty', 'Failed', 1, 0""")
def q_import_log_status(spark, sf_dir):
    """Statuses of good, wrong-width and empty files, and the rows that are loaded of each."""
    ctx = Ctx(spark, sf_dir)
    root = scratch_path(spark, "import-log")
    comment_drop(ctx, f"{root}/good", 4)
    d = ctx.t.documents
    write_drop(d, f"{root}/narrow/{DROP_YEAR}", [F.col("lang"), F.col("doc_id"), F.col("text")], "doc_id", 4)
    spark.range(0).select(F.lit("").alias("value")).coalesce(1).write.text(f"{root}/empty/{DROP_YEAR}")
    listing = fl.list_files(spark, root)
    folder = F.regexp_extract("file_path", "/(good|narrow|empty)/", 1)
    parsed = fl.read_tsv(spark, [f"{root}/*/{DROP_YEAR}", f"{root}/*/*/{DROP_YEAR}"], fl.COMMENT_COLUMNS)
    log = ig.import_log(listing, parsed, len(fl.COMMENT_COLUMNS), COMMENT_SITE).withColumn("folder", folder)
    loaded = ig.loadable(parsed, log).groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("n"))
    per = log.groupBy("folder", "status").agg(F.count(F.lit(1)).alias("n_files"))
    return per.join(loaded, "folder", "left").select("folder", "status", "n_files", F.coalesce("n", F.lit(0)).alias("n_loaded"))


@register("html_table_extract")
def q_html_table_extract(spark, sf_dir):
    """A11 (rows-only): lexicon-table rows found in the pages' HTML."""
    return fl.html_lexicon_rows(Ctx(spark, sf_dir).t.pages)
