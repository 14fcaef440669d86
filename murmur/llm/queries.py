"""Registered queries of the training-data operators and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from murmur.llm import decontam, jaccard, licences, mixing, orchard, pages, quality, rabitq, setm, substrings, tokens, toxicity, warc
from murmur.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS h,
                  CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             row_number() OVER (ORDER BY source IS NULL, source) AS rn FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(rn - 1) % 3 + 1] AS BIGINT) AS weight, 3 * source_size AS cap FROM s),
l AS (SELECT *, CAST(CAST((SELECT sum(source_size) FROM s) AS BIGINT)
             - sum(cap) OVER (ORDER BY cap / weight, rn ROWS UNBOUNDED PRECEDING) + cap AS DOUBLE)
             / CAST(sum(weight) OVER (ORDER BY cap / weight, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE)
             AS level, row_number() OVER (ORDER BY cap / weight, rn) AS pos FROM w),
o AS (SELECT *, CAST(cap AS DOUBLE) > weight * level AS open FROM l),
t AS (SELECT source, source_size, CASE WHEN open THEN weight * (SELECT arg_min(level, pos) FROM o WHERE open)
             ELSE CAST(cap AS DOUBLE) END AS target FROM o),
q AS (SELECT doc_id, h, size, source_size, target,
             CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT q.*, e, CAST(cum + e * source_size AS DOUBLE) / target AS finish
      FROM q, (SELECT unnest([0, 1, 2]) AS e) WHERE size > 0 AND target > 0),
r AS (SELECT *, sum(size) OVER (ORDER BY finish, h, doc_id, size, e ROWS UNBOUNDED PRECEDING) AS upto FROM c),
k AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM r
      WHERE upto <= (SELECT sum(source_size) FROM s) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0) AS taken FROM q LEFT JOIN k ON q.doc_id = k.doc_id
"""


@register("op4_mixing", MIX_SQL)
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(Tables(spark, sf_dir).documents)


#: The tokenizer file is found by name in the folder of public tokenizers; END_ID ends each document.
TOKENIZER, END_ID = "word_bpe_49k.json", 2


def tokenizer_path() -> str:
    import public_tokenizers
    return str(public_tokenizers.path(TOKENIZER))


@register("op1_token_shards")
def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_table(Tables(spark, sf_dir).documents, tokenizer_path(), END_ID)


@register("op3_ngram_jaccard")
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(Tables(spark, sf_dir).documents)


@register("op5_quality_perplexity")
def op5_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(Tables(spark, sf_dir).documents)


@register("op6_suffix_dedup")
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(Tables(spark, sf_dir).documents)


DECONTAM_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item, w, least(len(w), 13) AS size FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win
       FROM (SELECT item, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM bl)),
sizes AS (SELECT DISTINCT size FROM bl),
dw AS (SELECT rid, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win
       FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes)),
hit AS (SELECT rid, i, dw.size, item FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM hit) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos ON d.rid = pos.rid LEFT JOIN it ON d.rid = it.rid
"""


@register("op9_decontamination", DECONTAM_SQL)
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return decontam.contamination(t.documents, t.benchmark).drop("mark", "spans")


WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
k AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS d FROM p),
r AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d, n) END AS lead FROM k)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN lead IS NOT NULL AND lead IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN lead IS DISTINCT FROM page_id THEN lead END AS refers_to FROM r
"""


@register("op7_warc", WARC_SQL)
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(Tables(spark, sf_dir).pages).drop("target_uri")


@register("op10_tag_path_ratios")
def op10_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(Tables(spark, sf_dir).pages)


@register("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return toxicity.toxicity(t.documents, t.labels)


@register("op2_licence_scan")
def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(Tables(spark, sf_dir).documents)


def _orchard_sql(rounds: int = 10, k: int = 8, dim: int = 64) -> str:
    near = "list_sum(list_transform(list_zip(v.p, c.p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS p
      FROM embeddings WHERE len(embedding) = {dim} AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, p
      FROM (SELECT p, sha256('3:' || CAST(vec_id AS VARCHAR)) AS h FROM v ORDER BY h LIMIT {k}))"""]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT rid, min(CAST({near} AS BIGINT) * {k} + c) AS best FROM v, c{r} AS c GROUP BY rid)")
        if r < rounds:
            parts.append(f"""s{r} AS MATERIALIZED (SELECT a.best % {k} AS c, i, CAST(sum(v.p[i]) AS BIGINT) AS s, count(*) AS n
      FROM a{r} AS a JOIN v ON a.rid = v.rid, (SELECT unnest(range(1, {dim + 1})) AS i) GROUP BY 1, 2),
m{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS p FROM s{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m{r}.p, c{r}.p) AS p FROM c{r} LEFT JOIN m{r} ON c{r}.c = m{r}.c)""")
    return "WITH " + ",\n".join(parts) + f""",
t AS (SELECT v.vec_id, best % {k} AS c, best // {k} AS d FROM a{rounds} AS a JOIN v ON a.rid = v.rid)
SELECT vec_id, CAST(t.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY t.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(e.p, ',')) AS centroid_sha256
FROM t JOIN c{rounds} AS e ON t.c = e.c"""


@register("op13_orchard", _orchard_sql())
def op13_orchard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orchard.clusters(Tables(spark, sf_dir).embeddings)


SETM_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
o AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
f AS MATERIALIZED (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, count(*) AS f FROM o GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
i AS (SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS b FROM c, (SELECT unnest([2, 3, 4]) AS m) WHERE m < k),
v AS (SELECT lang, array_to_string(list_slice(w, b, b + m - 1), ' ') AS phrase, max(a) AS longer FROM i GROUP BY ALL),
k AS (SELECT c.* FROM c LEFT JOIN v ON c.lang = v.lang AND c.phrase = v.phrase WHERE longer IS NULL OR 100 * longer < 100 * a),
u AS (SELECT lang, phrase, a, w, unnest(range(1, k)) AS cut FROM k),
s AS (SELECT u.lang, u.phrase, a, cut, x.f AS l, y.f AS r, n, CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score FROM u JOIN t ON u.lang = t.lang
      JOIN f AS x ON x.lang = u.lang AND x.phrase = array_to_string(list_slice(w, 1, cut), ' ')
      JOIN f AS y ON y.lang = u.lang AND y.phrase = array_to_string(list_slice(w, cut + 1, len(w)), ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS first FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE first = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM r WHERE rank <= 2000
"""


@register("op11_setm", SETM_SQL)
def op11_setm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setm.collocations(Tables(spark, sf_dir).documents)


@register("op12_rabitq")
def op12_rabitq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabitq.near_vectors(Tables(spark, sf_dir).embeddings)
