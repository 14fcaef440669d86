"""Key lookup, paging and substring search on stored tables (P1, P4, P11); scans of N5."""

import random

import pytest

from murmur.operators import research as rs
from murmur.operators import stored as sto
from murmur.session import scratch_path
from murmur.sources import fixtures as fx
from murmur.sources.tables import Tables
from tests.conftest import SF_SMALL


def files(df):
    return len(df.inputFiles())


def test_one_file_is_read_for_one_key(spark):
    path = scratch_path(spark, "test-clustered")
    ids = random.Random(3).sample(range(100000), 5000)
    sto.save_clustered(spark.createDataFrame([(i, f"t{i}") for i in ids] + [(7, "twice"), (7, "twice")], "id long, text string"), path, files=16)
    for k in (ids[0], ids[77], max(ids), min(ids)):
        found = sto.lookup(spark, path, k)
        assert files(found) == 1 and f"t{k}" in [r.text for r in found.collect()]
    assert sum(r.text == "twice" for r in sto.lookup(spark, path, 7).collect()) == 2
    for k in (-1, 10**9):
        assert files(sto.lookup(spark, path, k)) == 0 and sto.lookup(spark, path, k).count() == 0 and sto.has_key(spark, path, k).count() == 0
    missing = next(i for i in range(100000) if i not in set(ids) and min(ids) < i != 7)
    assert files(sto.lookup(spark, path, missing)) <= 1 and sto.has_key(spark, path, missing).count() == 0
    assert sto.has_key(spark, path, ids[5]).count() == 1


def test_pages_walk_through_the_table(spark):
    path = scratch_path(spark, "test-pages")
    ids = sorted(random.Random(4).sample(range(10000), 700))
    sto.save_clustered(spark.createDataFrame([(i,) for i in ids], "id long"), path, files=10)
    seen, last = [], -1
    while True:
        page = sto.page_after(spark, path, last, 90)
        rows = [r.id for r in page.collect()]
        if not rows:
            break
        assert files(page) <= 4
        seen += rows
        last = rows[-1]
    assert seen == ids


@pytest.mark.parametrize("term", ["needle", "NEED", "ab", "z", "é日", "日本", "", "nowhere", "x y", "end", "d"])
def test_search_equals_the_scan(spark, searchable, term):
    path, rows = searchable
    got = sorted(r.id for r in sto.search_stored(spark, path, "text", term).collect())
    assert got == sorted(i for i, t in rows if t is not None and term.lower() in t.lower())


@pytest.fixture(scope="module")
def searchable(spark):
    r = random.Random(9)
    rows = [(i, "".join(r.choice("abcxy ") for _ in range(r.randrange(12)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "Needle"), (1003, "a needle here"), (1004, "zé日本"), (1005, "at the end"), (1006, "z"), (2000, "NEED")]
    path = scratch_path(spark, "test-search")
    sto.save_searchable(spark.createDataFrame(rows, "id long, text string"), path, "text", blocks=16)
    return path, rows


def test_blocks_are_pruned(spark, searchable):
    path, _ = searchable
    assert len(sto.blocks_with(spark, path, "needle")) <= 2 and sto.blocks_with(spark, path, "qqq") == []
    assert files(sto.search_stored(spark, path, "text", "needle")) <= 2
    assert sto.search_stored(spark, path, "text", "qqq").count() == 0


def test_core_boundary_reads_the_vectors_twice(spark):
    v = fx.vectors(Tables(spark, SF_SMALL))
    seen = []
    parquet = type(v.write).parquet

    def watch(self, path, *a, **k):
        seen.append(self._df._jdf.queryExecution().executedPlan().toString().count("FileScan"))
        return parquet(self, path, *a, **k)
    type(v.write).parquet = watch
    try:
        out = rs.core_boundary(v)
    finally:
        type(v.write).parquet = parquet
    assert seen == [2] and out.where("point_type = 'core'").count() > 0
    assert "embeddings" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_trigrams_are_cut_in_pieces_and_sent_once(monkeypatch):
    r = random.Random(5)
    texts = ["".join(r.choice("ab\0é日😀 ") for _ in range(n)) for n in (0, 1, 2, 3, 40, 700, 7, 64, 62, 63, 65, 0)]
    want = {(t + "\0\0")[i:i + 3] for t in texts for i in range(len(t))}
    block = sto.pa.record_batch({"block": sto.pa.array([4] * len(texts), sto.pa.int32()), "text": texts})
    for piece, held in ((1 << 20, 1 << 21), (64, 1 << 21), (1, 0)):
        monkeypatch.setattr(sto, "PIECE", piece)
        monkeypatch.setattr(sto, "HELD", held)
        got = [x for b in sto._gram_rows(iter([block, block.slice(3)])) for x in zip(*(c.to_pylist() for c in b.columns))]
        assert {b for b, _ in got} == {4} and {g for _, g in got} == want
        assert held == 0 or len(got) == len(want)
