"""Event-time windows, repeats within the watermark, compaction of batches."""

import datetime as dt
import tempfile

from murmur.sources import fixtures as fx
from murmur.streaming import streams as st

ROWS = "id long, timestamp timestamp_ntz, comment_lang string, website string, comment_text string"
P = fx.FIXTURE_PARAMS


def lexicon(spark):
    return spark.createDataFrame([("und", "de", 1.0)], "word string, language string, weight double")


def run(spark, d, k, rows, **window):
    """Drop file ``k`` arrives and the stream runs until it has read it."""
    if rows:
        spark.createDataFrame(rows, ROWS).coalesce(1).write.parquet(f"{d}/src/b{k}")
    src = spark.readStream.schema(ROWS).option("recursiveFileLookup", "true").parquet(f"{d}/src")
    out = st.run_append(st.windowed_hits(src, lexicon(spark), P, lexicon_rows=1, **window), f"{d}/sink", f"{d}/ck", state_partitions=2)
    return sorted((r.window_start.isoformat(), r.website, r.aggressive_word_count, r.total_word_count) for r in out.collect())


def at(day, hour=12):
    return dt.datetime(2024, 1, day, hour)


def test_late_rows_inside_and_beyond_the_watermark(spark):
    d = tempfile.mkdtemp(prefix="murmur-win-")
    assert run(spark, d, 0, [(1, at(10), "de", "site_a", "und b"), (2, at(11), "de", "site_a", "c")]) == []
    # the newest time is now the 11th, 12 h, so the watermark is the 9th, 12 h: the 9th is still open, the 8th is not
    assert run(spark, d, 1, [(3, at(9, 1), "de", "site_a", "und und"), (4, at(8, 1), "de", "site_a", "und"), (5, at(12), "de", "site_b", "x")]) == [
        ("2024-01-09T00:00:00", "all", 2, 2), ("2024-01-09T00:00:00", "site_a", 2, 2)]
    # restart without new files: nothing changes
    before = run(spark, d, 2, [])
    assert before == run(spark, d, 2, [])
    got = run(spark, d, 3, [(6, at(20), "de", "site_a", "y")])
    assert ("2024-01-10T00:00:00", "site_a", 1, 2) in got and ("2024-01-11T00:00:00", "all", 0, 1) in got and ("2024-01-12T00:00:00", "site_b", 0, 1) in got
    assert not any(w.startswith("2024-01-08") or w.startswith("2024-01-20") for w, *_ in got)
    assert len(got) == len(set((w, s) for w, s, *_ in got)) == 8


def test_sliding_windows(spark):
    d = tempfile.mkdtemp(prefix="murmur-win-")
    got = run(spark, d, 0, [(1, at(10), "de", "site_a", "und b"), (2, at(20), "de", "site_b", "c")], size="2 days", slide="1 day")
    assert got == [(f"2024-01-{x:02d}T00:00:00", s, 1, 2) for x in (9, 10) for s in ("all", "site_a")]


def test_repeats_across_batches(spark):
    d = tempfile.mkdtemp(prefix="murmur-rep-")
    schema = "id long, at timestamp, text string"
    for k, rows in enumerate([[(1, at(10), "a"), (2, at(10), "b"), (2, at(10, 13), "b")], [(2, at(11), "b"), (3, at(11), "c")], [(1, at(10), "a"), (3, at(11), "c"), (4, at(11), "d")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/src/b{k}")
        src = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{d}/src")
        out = st.run_append(st.distinct_stream(src, "id", "at", "5 days"), f"{d}/sink", f"{d}/ck", state_partitions=2)
    assert sorted((r.id, r.text) for r in out.collect()) == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]


def test_compaction_keeps_the_sums_and_a_replay(spark):
    d = tempfile.mkdtemp(prefix="murmur-comp-")
    rows = "id long, day date, comment_lang string, website string, comment_text string"
    drops = [[(k, dt.date(2024, 1, 10 + k % 2), "de", "site_a", "und " * k + "x")] for k in range(5)]
    for k, r in enumerate(drops):
        st.add_rollup_batch(spark.createDataFrame(r, rows), k, lexicon(spark), P, f"{d}/sink", 1)
    key = lambda: sorted(map(tuple, st.read_rollup_batches(spark, f"{d}/sink").collect()))
    want = key()
    assert st.compact_batches(spark, f"{d}/sink") == 3 and key() == want
    assert st.compact_batches(spark, f"{d}/sink") is None
    st.add_rollup_batch(spark.createDataFrame(drops[4], rows), 4, lexicon(spark), P, f"{d}/sink", 1)        # replay of the newest batch
    assert key() == want
    st.add_rollup_batch(spark.createDataFrame(drops[2], rows), 5, lexicon(spark), P, f"{d}/sink", 1)
    more = key()
    assert more != want and st.compact_batches(spark, f"{d}/sink") == 4 and key() == more
    spark.range(1).write.parquet(f"{d}/sink-compacted/upto=9/part")                                          # one that did not finish
    assert st.compacted_upto(spark, f"{d}/sink") == 4 and key() == more
