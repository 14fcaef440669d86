"""DuckDB text of the fixture views (same expressions as murmur.sources.fixtures).

The driver registers only the base tables, so every oracle inlines the views
it needs as CTEs.  ``with_views(names, body)`` builds the WITH clause.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {
    "fx_comments": """
  SELECT doc_id AS id,
         doc_id % 97 AS article_id,
         CASE doc_id % 5 WHEN 0 THEN 'site_a' WHEN 1 THEN 'site_b' WHEN 2 THEN 'site_c'
                         WHEN 3 THEN 'site_d' END AS website,
         CASE doc_id % 3 WHEN 0 THEN 'rus' WHEN 1 THEN 'lat' END AS region,
         DATE '2024-01-10' + CAST(doc_id * 37 % 149 AS INTEGER) AS day,
         text AS comment_text,
         lang AS comment_lang
  FROM documents""",
    "fx_lexicon": """
  SELECT * FROM (VALUES ('de', 'fr', 0.5::DOUBLE), ('la', 'es', 0.25::DOUBLE), ('en', 'en', 0.75::DOUBLE),
                        ('die', 'de', 1.0::DOUBLE), ('ing', 'en', 0.25::DOUBLE), ('that', 'en', 0.5::DOUBLE),
                        ('und', 'de', 0.75::DOUBLE), ('Der', 'de', 1.0::DOUBLE), ('zzzz', 'en', 1.0::DOUBLE))
         AS t(word, language, weight)""",
    "fx_lemmatized": """
  SELECT id AS comment_id, article_id, website, day, comment_lang,
         coalesce(regexp_extract_all(lower(comment_text), '\\p{L}+'), []::VARCHAR[]) AS lemmas
  FROM fx_comments""",
    "fx_tokens": """
  SELECT comment_id, article_id, website, day, comment_lang,
         unnest(lemmas) AS lemma, unnest(generate_series(0, len(lemmas) - 1)) AS pos
  FROM fx_lemmatized""",
    "fx_hits": """
  SELECT t.comment_id, t.article_id, t.website, t.day, t.comment_lang, t.pos, t.lemma,
         t.lemma AS form, l.weight, l.language AS lexicon_language
  FROM fx_tokens t JOIN fx_lexicon l ON l.word = t.lemma""",
    "fx_articles": """
  SELECT c_custkey AS article_id,
         c_name AS headline,
         CASE WHEN c_custkey % 21 = 1 THEN NULL
              ELSE DATE '2024-01-01' + CAST(c_custkey % 100 AS INTEGER) END AS pub_day,
         'https://' || CASE c_custkey % 5 WHEN 0 THEN 'www.delfi.lv' WHEN 1 THEN 'tvnet.lv/delfi'
                                          WHEN 2 THEN 'APOLLO.lv' WHEN 3 THEN 'rus.tvnet.lv'
                                          ELSE 'example.org' END
                     || '/' || CAST(c_custkey AS VARCHAR) AS url,
         CASE WHEN lower(url) LIKE '%tvnet%' THEN 'tvnet'
              WHEN lower(url) LIKE '%apollo%' THEN 'apollo'
              WHEN lower(url) LIKE '%delfi%' THEN 'delfi'
              ELSE 'tvnet' END AS website,
         CASE WHEN len(regexp_extract_all(c_name, '[Ѐ-ӿ]')) + len(regexp_extract_all(c_name, '[A-Za-zĀ-ž]')) > 0
                   AND len(regexp_extract_all(c_name, '[Ѐ-ӿ]'))
                       / (len(regexp_extract_all(c_name, '[Ѐ-ӿ]')) + len(regexp_extract_all(c_name, '[A-Za-zĀ-ž]')))
                       > 0.85 THEN 'ru'
              ELSE 'lv' END AS headline_lang
  FROM customer""",
    "fx_predictions": """
  SELECT o_orderkey AS id,
         CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderkey END AS comment_id,
         CASE WHEN o_custkey % 10 = 0 THEN o_custkey + 10000000 ELSE o_custkey END AS article_id,
         o_orderdate AS comment_timestamp,
         CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_orderkey % 50 = 1 THEN ''
              ELSE o_orderpriority END AS ekman_prediction_emotion,
         CASE o_orderstatus WHEN 'F' THEN 'lv' WHEN 'O' THEN 'ru' WHEN 'P' THEN 'other' END AS text_lang,
         CAST(o_orderkey % 1000 AS DOUBLE) / 1000.0 AS ekman_prediction_score,
         CASE o_custkey % 3 WHEN 0 THEN 'site_a' WHEN 1 THEN 'site_b' WHEN 2 THEN 'site_c' END AS website,
         'comment ' || CAST(o_orderkey AS VARCHAR) AS text
  FROM orders""",
    "fx_vectors": """
  SELECT vec_id AS article_id, embedding, CASE WHEN label = 9 THEN -1 ELSE label END AS cluster
  FROM embeddings""",
    "fx_sample": """
  SELECT o_orderkey AS id, o_custkey % 20 AS cluster, o_orderpriority AS emotion,
         CAST(o_orderkey % 101 AS DOUBLE) / 100.0 AS confidence,
         o_orderkey * 7 % 230 AS length, o_orderdate AS timestamp
  FROM orders""",
    "fx_intervals": """
  SELECT * FROM (VALUES ('ev1', DATE '2024-01-01', DATE '2024-02-28'),
                        ('ev2', DATE '2024-02-01', DATE '2024-04-28')) AS t(event, start_day, end_day)""",
    "fx_stopwords": """
  SELECT * FROM (VALUES ('lv', 'the'), ('lv', 'and'), ('lv', 'of'), ('lv', 'is'), ('lv', 'in'),
                        ('ru', 'und'), ('ru', 'der'), ('ru', 'die'), ('ru', 'le'), ('ru', 'la'), ('ru', 'et'),
                        ('ru', 'el'), ('ru', 'the')) AS t(language, word)""",
}

# view → views it reads
DEPS: dict[str, tuple[str, ...]] = {
    "fx_lemmatized": ("fx_comments",),
    "fx_tokens": ("fx_lemmatized",),
    "fx_hits": ("fx_tokens", "fx_lexicon"),
}


def _closure(names) -> list[str]:
    seen: list[str] = []

    def visit(n):
        for d in DEPS.get(n, ()):
            visit(d)
        if n not in seen:
            seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_views(names, ctes: str, body: str) -> str:
    """WITH <fixture views>, <query CTEs> <body>."""
    parts = [f"{n} AS ({VIEWS[n]}\n)" for n in _closure(names)]
    if ctes.strip():
        parts.append(ctes.strip().rstrip(","))
    return "WITH " + ",\n".join(parts) + "\n" + body
