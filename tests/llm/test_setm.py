import collections
import re
from functools import partial

import duckdb
import numpy as np
import pytest

from murmur.llm import queries, setm
from tests.llm.util import SF, frame

SCHEMA = "doc_id long, lang string, text string"


def brute(rows, least=100, top=2000, percent=100, longest=5):
    """Phrases by counting tuples of words."""
    n, f = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i:i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    cands = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    covered = {(p[0], *q) for p, a in cands.items() for k in range(2, len(p) - 1) for i in range(1, len(p) - k + 1)
               for q in [p[i:i + k]] if 100 * a >= percent * cands[(p[0], *q)]}
    out = collections.defaultdict(list)
    for p, a in cands.items():
        if p not in covered:
            lang = p[0]
            score, _, x, y = min((1000 * a * n[lang] // (f[p[:k]] * f[(lang, *p[k:])]), k, f[p[:k]], f[(lang, *p[k:])]) for k in range(2, len(p)))
            out[lang].append((-score, -a, " ".join(p[1:]).encode(), x, y))
    return sorted((lang, r, t.decode(), -a, x, y, n[lang], -s) for lang, xs in out.items()
                  for r, (s, a, t, x, y) in enumerate(sorted(xs)[:top], 1))


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def small_parts(monkeypatch):
    """Tasks with parts of 64 bytes that send groups on early."""
    def small(f, *args):
        from murmur.llm import setm as here
        here.TEXT_BLOCK, here.HELD = 64, 20
        try:
            yield from f(*args)
        finally:
            here.TEXT_BLOCK, here.HELD = 1 << 20, 1 << 20
    monkeypatch.setattr(setm, "partial", lambda f, *a: partial(small, f, *a))


def corpus(seed, n=120):
    rng = np.random.default_rng(seed)
    marks = [" ", " ", " ", "  ", "\t", " ", ". ", ", ", "\n", "!?", "   ", "\r\n"]
    word = ["a", "B", "the", "Été", "x'y", "日本", "no-one", "Zz", "1"]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(int(rng.integers(0, 40))):
            parts += [word[int(rng.zipf(1.7)) % len(word)], marks[rng.integers(len(marks))]]
        rows.append((["en", "de", None, "und", ""][int(rng.integers(5))], "".join(parts)))
    return rows + [("en", None), ("en", ""), (None, " ,. "), rows[5], rows[5], ("en", "of course it is " * 40), ("zz", "alone")]


@pytest.mark.parametrize("least,percent", [(2, 100), (5, 100), (3, 60)])
def test_equals_counting(spark, least, percent):
    rows = corpus(least)
    docs = frame(spark, [(i, *r) for i, r in enumerate(rows)], SCHEMA).selectExpr("*", "1 as key", "2 as n", "'x' as word").repartition(3)
    df = setm.collocations(docs, least, top=25, percent=percent)
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert got(df) == brute(rows, least, 25, percent)


def test_small_blocks(spark, small_parts):
    rows = corpus(9)
    docs = frame(spark, [(i, *r) for i, r in enumerate(rows)], SCHEMA).repartition(2)
    assert got(setm.collocations(docs, 3)) == brute(rows, 3)


def test_nothing_frequent(spark):
    assert setm.collocations(frame(spark, [], SCHEMA)).count() == 0
    assert setm.collocations(frame(spark, [(1, "en", "a b c"), (2, None, None)], SCHEMA)).count() == 0
    assert setm.collocations(frame(spark, [(1, "en", "a. b. " * 200)], SCHEMA)).count() == 0


def test_long_text_and_large_products(spark):
    text = "so to say, " * 300000 + "w " * 200000
    assert got(setm.collocations(frame(spark, [(1, "en", text)], SCHEMA))) == brute([("en", text)])
    levels = spark.createDataFrame([(1, 10**12)], "x int, a long").selectExpr(
        "(cast(a as decimal(38,0)) * cast(10 * a as decimal(38,0)) * 1000) div (cast(a as decimal(38,0)) * cast(a as decimal(38,0))) as s")
    assert levels.first().s == 10000


def test_filter_has_no_false_negatives(spark):
    keys = np.random.default_rng(2).integers(0, 1 << 63, 5000, dtype=np.uint64)
    table = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "key long")
    f = setm.key_filter(table, 5000).value
    others = np.random.default_rng(3).integers(0, 1 << 63, 5000, dtype=np.uint64)
    assert f.has(keys).all() and f.has(others).mean() < 0.05


def test_relations_shrink(spark):
    """A relation holds occurrences of frequent phrases only, however many others the texts have."""
    rng = np.random.default_rng(4)
    rows = [(i, "en", " ".join(f"w{rng.integers(50000)}" for _ in range(60)) + " then we go home") for i in range(300)]
    seen = []
    whole = setm.written

    def watch(df, name):
        out = whole(df, name)
        seen.append((name, sum(len(r.codes) for r in out.collect()) if name == "setm-relation" else out.count()))
        return out
    setm.written = watch
    try:
        best = got(setm.collocations(frame(spark, rows, SCHEMA)))
    finally:
        setm.written = whole
    assert [r[2] for r in best] == ["then we go home"]
    assert max(n for name, n in seen if name == "setm-relation") <= 2 * 5 * 300 + 300
    assert max(n for name, n in seen if name == "setm-phrases") <= 3


def test_query_equals_brute_force_and_sql(spark):
    sf = SF.replace("0.001", "0.01")
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    mine = got(queries.op11_setm(spark, sf))
    assert mine and mine == brute(rows)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert mine == sorted(con.execute(queries.ORACLES["op11_setm"]).fetchall())
