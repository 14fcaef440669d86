"""Streams equal batch; late data and repeated drops."""

import datetime as dt
import os
import tempfile


import __spark_entry__ as E
from murmur.sources import files as fl
from murmur.streaming import streams as st
from tests.conftest import SF_SMALL


def _sorted(df):
    return sorted(tuple(r) for r in df.collect())


def test_stream_rollup_equals_batch(spark):
    q = E.queries()
    assert _sorted(q["stream_aggr_by_day"](spark, SF_SMALL)) == _sorted(q["aggr_by_day"](spark, SF_SMALL))


def test_stream_insert_across_batches_existing_wins(spark):
    d = tempfile.mkdtemp(prefix="murmur-s3-")
    os.makedirs(f"{d}/drop")
    target = f"{d}/target"
    st.start_target(spark.createDataFrame([("lat", 1, "old", "ts", "u")],
                                          "region string, article_id long, headline string, pub_timestamp string, url string"), target)
    with open(f"{d}/drop/a_2024.txt", "w") as f:
        f.write("lat\t1\tnew\tts\tu\nlat\t2\tfirst\tts\tu\nlat\t2\tsecond\tts\tu\n")
    out = st.stream_insert_if_absent(spark, f"{d}/drop", fl.ARTICLE_COLUMNS, target, f"{d}/ck")
    assert [(r.article_id, r.headline) for r in out.collect()] == [(2, "first")]
    # the same file content dropped again in a later batch adds nothing
    with open(f"{d}/drop/b_2024.txt", "w") as f:
        f.write("lat\t2\tagain\tts\tu\nlat\t3\tthree\tts\tu\n")
    out = st.stream_insert_if_absent(spark, f"{d}/drop", fl.ARTICLE_COLUMNS, target, f"{d}/ck")
    assert sorted((r.article_id, r.headline) for r in out.collect()) == [(2, "first"), (3, "three")]
    assert spark.read.parquet(target).count() == 3


def test_stream_ingest_picks_up_only_new_files(spark):
    d = tempfile.mkdtemp(prefix="murmur-s1-")
    os.makedirs(f"{d}/drop")
    with open(f"{d}/drop/c1_2024.txt", "w") as f:
        f.write("lat\t1\tn\tip\tts\ttext\n")
    out = st.stream_ingest(spark, f"{d}/drop", fl.COMMENT_COLUMNS, f"{d}/sink", f"{d}/ck")
    assert out.count() == 1
    with open(f"{d}/drop/c2_2024.txt", "w") as f:
        f.write("lat\t2\tn\tip\tts\ttext\nlat\t3\tn\tip\tts\ttext\textra\n")
    out = st.stream_ingest(spark, f"{d}/drop", fl.COMMENT_COLUMNS, f"{d}/sink", f"{d}/ck")
    assert sorted(r.article_id for r in out.collect()) == [1, 2]


def test_stream_insert_replayed_batch_changes_nothing(spark):
    d = tempfile.mkdtemp(prefix="murmur-s3r-")
    schema = "value string, file_path string, block_start long"
    st.start_target(spark.createDataFrame([("lat", 1, "old", "ts", "u")],
                                          "region string, article_id long, headline string, pub_timestamp string, url string"), f"{d}/t")
    one = spark.createDataFrame([("lat\t1\tnew\tts\tu", "a", 0), ("lat\t2\ttwo\tts\tu", "a", 0)], schema)
    two = spark.createDataFrame([("lat\t2\tagain\tts\tu", "b", 0), ("lat\t3\tthree\tts\tu", "b", 0)], schema)
    for batch, number in ((one, 0), (one, 0), (two, 1), (one, 0), (two, 1)):
        st.insert_batch(batch, number, fl.ARTICLE_COLUMNS, f"{d}/t")
    assert sorted((r.article_id, r.headline) for r in spark.read.parquet(f"{d}/t").collect()) == [(1, "old"), (2, "two"), (3, "three")]


ROWS = "id long, day date, comment_lang string, website string, comment_text string"


def test_rollup_over_batches_loses_no_late_row_and_survives_replay(spark):
    from murmur.operators.rollups import aggressiveness_by_day
    from murmur.operators.text import lemmatize
    from murmur.sources import fixtures as fx
    d = tempfile.mkdtemp(prefix="murmur-s2-")
    p = fx.FIXTURE_PARAMS
    lex = spark.createDataFrame([("und", "de", 1.0)], "word string, language string, weight double")
    drops = [[(1, dt.date(2024, 1, 10), "de", "site_a", "a b"), (2, dt.date(2024, 1, 20), "de", "site_a", "c")],
             [(3, dt.date(2024, 1, 19), "de", "site_a", "und x"), (4, dt.date(2023, 1, 5), "de", "site_b", "y und")],
             [(5, dt.date(2024, 1, 10), "de", "site_b", "und"), (6, dt.date(2023, 1, 5), "de", "site_b", "")]]
    for k, rows in enumerate(drops):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.parquet(f"{d}/src/b{k}")
        src = spark.readStream.schema(ROWS).option("recursiveFileLookup", "true").parquet(f"{d}/src")
        out = st.stream_rollup(src, lex, p, f"{d}/sink", f"{d}/ck", 1)
    everything = spark.createDataFrame([r for rows in drops for r in rows], ROWS)
    want = _sorted(aggressiveness_by_day(lemmatize(everything, keep=("website", "day", "comment_lang")), lex, p, 1))
    assert _sorted(out) == want
    assert len(spark.read.parquet(f"{d}/sink").select("batch_id").distinct().collect()) == 3
    st.add_rollup_batch(spark.createDataFrame(drops[1], ROWS), 1, lex, p, f"{d}/sink", 1)
    assert _sorted(st.read_rollup_batches(spark, f"{d}/sink")) == want


def test_append_mode_writes_a_day_once_the_watermark_passes(spark):
    from murmur.sources import fixtures as fx
    d = tempfile.mkdtemp(prefix="murmur-s2a-")
    schema = "id long, day date, comment_lang string, website string, comment_text string"
    lex = spark.createDataFrame([("und", "de", 1.0)], "word string, language string, weight double")
    spark.createDataFrame([(1, dt.date(2024, 1, 10), "de", "site_a", "und b"),
                           (2, dt.date(2024, 1, 20), "de", "site_a", "c")], schema).coalesce(1) \
         .write.parquet(f"{d}/src/b1")
    src = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{d}/src")
    st.run_append_rollup(st.rollup_comments_stream(src, lex, fx.FIXTURE_PARAMS, 1), f"{d}/sink", f"{d}/ck")
    out = spark.read.parquet(f"{d}/sink")
    days = {(r.date, r.website): (r.aggressive_word_count, r.total_word_count) for r in out.collect()}
    # the 10th is behind the watermark (20th - 2 days) and final; the 20th is still open
    assert days == {(dt.date(2024, 1, 10), "site_a"): (1, 2), (dt.date(2024, 1, 10), "all"): (1, 2)}
