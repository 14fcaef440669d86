import zlib

import numpy as np

import corpus_pipeline
from murmur.llm import decontam, quality, queries
from tests.llm import test_decontam, test_jaccard, test_mixing
from tests.llm.test_tokens import plain
from tests.llm.util import SF, frame

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def as_rows(df):
    return [tuple(r) for r in df.collect()]


def expected(spark, rows, items):
    """The stages by brute force; the language model's verdict is the operator's own (tested apart)."""
    verdict = {r.doc_id: r.kept for r in quality.quality(frame(spark, rows, SCHEMA)).collect()}
    rows = [r for r in rows if verdict[r[0]]]
    stages = [sorted(r[0] for r in rows)]
    comp = test_jaccard.brute([(r[0], r[1]) for r in rows])
    rows = [r for r in rows if comp[r[0]][1] == r[0]]
    stages.append(sorted(r[0] for r in rows))
    bad = {x[0] for x in test_decontam.brute([(r[0], r[1]) for r in rows], items) if x[5]}
    rows = [r for r in rows if r[0] not in bad]
    stages.append(sorted(r[0] for r in rows))
    taken = test_mixing.brute([(r[0], r[1], r[3]) for r in rows])
    rows = [r for r, t in zip(rows, taken) for _ in range(t[4] // t[1] if t[1] else 0)]
    stages.append(sorted(r[0] for r in rows))
    rows.sort(key=lambda r: r[0])
    start, out = 0, []
    for r, ids in zip(rows, plain([r[1] for r in rows])):
        out.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return stages, out


def test_run_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    stages, want = expected(spark, as_rows(docs), items)
    now = docs
    for (name, stage), ids in zip(corpus_pipeline.STAGES[:-1], stages):
        now = stage(spark, now, SF)
        assert now.columns == COLUMNS, name
        assert sorted(r.doc_id for r in now.select("doc_id").collect()) == ids, name
    assert sorted(as_rows(corpus_pipeline.run(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32")), key=lambda r: r[1]) == want


#: Columns of a table that working columns of the stages could be called.
CLASHES = ("mark", "key", "quality_mark", "row", "kept_key", "kept_mark", "bad_key", "bad_mark", "mix_turns", "mix_key", "mix_mark", "gone", "hit_key", "hit_words",
           "label", "total", "plain", "doc", "n_shingles", "kept", "turns", "size", "hash", "w", "place")


def test_stages_on_odd_rows(spark):
    text = " ".join(f"word{k % 97} other{k % 89}" for k in range(60))
    term, line = text.replace("word", "term"), text.replace("word", "line")
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text, "en", None, 1), (None, text, "en", "a", 1), (3, None, "en", "a", 0),
            (4, "", None, "a", 0), (5, term, None, "b", 1), (5, line, "en", "b", 1), (6, line + " more", "en", "b", 1)]
    df = frame(spark, rows, SCHEMA).selectExpr("*", *[f"{k} as {c}" for k, c in enumerate(CLASHES)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns
        assert all(tuple(r[5:]) == tuple(range(len(CLASHES))) for r in out.collect())
        assert stage(spark, df.limit(0), SF).count() == 0
    kept = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.near_duplicates(spark, df, SF).collect() if r.text)
    assert kept == sorted([(0, text), (1, text), (5, term), (5, line)])
    mixed = corpus_pipeline.source_mix(spark, df, SF).collect()
    assert mixed and all(r.text for r in mixed)
    assert corpus_pipeline.token_output(spark, df, SF).count() == len(rows)
    items = frame(spark, [("i", " ".join(line.split()[3:20]))], "item_id string, text string")
    cut = decontam.remove_spans(df, items)
    assert cut.columns == df.columns and cut.count() == len(rows) and {len(r.text.split()) for r in cut.collect() if r.doc_id == 6} == {104}


def test_query_is_registered():
    import __spark_entry__ as e
    assert {"pipeline", *queries.QUERIES} <= set(e.queries())
