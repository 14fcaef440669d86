import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmur.llm import queries, rabitq
from tests.llm.util import SF, frame

SCHEMA = "vec_id long, embedding array<float>"


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute(rows, threshold=0.95):
    """(linked pairs, expected rows) from all pairs."""
    at = collections.defaultdict(list)
    for r, (_, v) in enumerate(rows):
        if good(v):
            at[len(v)].append(r)
    parent, links, pairs = list(range(len(rows))), [0] * len(rows), set()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for own in at.values():
        x = np.array([rows[r][1] for r in own], np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for i, j in zip(*np.nonzero(np.triu(x @ x.T >= threshold, 1))):
            a, b = own[i], own[j]
            pairs.add((a, b))
            links[a] += 1
            links[b] += 1
            parent[root(a)] = root(b)
    low = {}
    for r, (i, _) in enumerate(rows):
        if i is not None:
            low[root(r)] = min(low.get(root(r), i), i)
    return pairs, sorted(((i, links[r], low.get(root(r))) for r, (i, _) in enumerate(rows)), key=str)


def planted(seed, n=600, dim=64, near=300, low=0.951, high=0.97):
    """Random vectors, and partners at cosines right above the threshold."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = list(x)
    for k in range(near):
        v = x[rng.integers(n)]
        g = rng.normal(size=dim)
        g -= g @ v * v
        c = rng.uniform(low, high)
        out.append((c * v + math.sqrt(1 - c * c) * g / np.linalg.norm(g)) * rng.uniform(0.1, 9))
    return [(i, [float(np.float32(a)) for a in v]) for i, v in enumerate(out)]


def got(df):
    return sorted(((r[0], r[1], r[2]) for r in df.collect()), key=str)


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(5)
    for c in (0.3, 0.95):
        x = rng.normal(size=(3000, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        g = rng.normal(size=x.shape)
        g -= (g * x).sum(1, keepdims=True) * x
        y = c * x + math.sqrt(1 - c * c) * g / np.linalg.norm(g, axis=1, keepdims=True)
        a, b = (rabitq.Sketches(rabitq.sketches(v, rng.integers(0, 1 << 62, len(v))), 64) for v in (x, y))
        est = np.concatenate([np.diag(rabitq.Sketches.estimate(_cut(a, i), _cut(b, i))) for i in range(0, 3000, 500)])
        assert abs(est.mean() - c) < 0.004
        assert 0.01 < est.std() < 0.09
        possible = np.concatenate([np.diag(_cut(a, i).possible(_cut(b, i), 0.95)) for i in range(0, 3000, 500)])
        assert possible.mean() == 1 if c == 0.95 else possible.mean() < 0.01


def _cut(s, i):
    out = object.__new__(rabitq.Sketches)
    out.dim = s.dim
    for name in ("factor", "signs", "turned", "step"):
        setattr(out, name, getattr(s, name)[i:i + 500])
    return out


def test_pairs_right_above_the_threshold(spark):
    """Many bands of many signs: at least 0.95 of the links, none that is not one, each counted once."""
    rows = planted(1)
    pairs, want = brute(rows)
    assert len(pairs) >= 300
    links = {i: n for i, n, _ in want}
    for k in (4, 9):
        mine = {i: n for i, n, _ in got(rabitq.near_vectors(frame(spark, rows, SCHEMA).repartition(3), k=k))}
        assert all(mine[i] <= links[i] for i in links)
        assert sum(mine.values()) >= 0.95 * sum(links.values())
    assert got(rabitq.near_vectors(frame(spark, rows, SCHEMA), k=0)) == want


def test_hot_buckets(spark):
    """Blocks of a hot bucket are compared two by two; a group of near copies leaves a forest, not its pairs."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=32)
    rows = [(i, [float(np.float32(a)) for a in v + rng.normal(size=32) * 0.05]) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)] + [(i + 2000, r[1]) for i, r in enumerate(planted(4, 100, 32, 20))]
    _, want = brute(rows)
    seen = []
    whole = rabitq.written

    def watch(df, name):
        out = whole(df, name)
        seen.append((name, out.count()))
        return out
    rabitq.written = watch
    try:
        assert got(rabitq.near_vectors(frame(spark, rows, SCHEMA).repartition(4), k=2, bands=12, block=50)) == want
    finally:
        rabitq.written = whole
    assert max(n for name, n in seen if name == "rabitq-links") < 40 * len(rows)
    assert next(n for name, n in seen if name == "rabitq-classes") == 520


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]),
            (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.01]), (None, [0.0, 5.0]), (None, None), (2, [0.0, 1.0]), (2, [2.0, 0.0]), (10, [3e38, 1e30]), (11, [1e-40, 0.0]),
            (12, [-1.0, 0.0]), (13, [-1.0, -0.0])]
    docs = frame(spark, rows, SCHEMA).selectExpr("*", "1 as cls", "2 as id", "'x' as label", "3 as component")
    df = rabitq.near_vectors(docs)
    assert df.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert got(df) == brute(rows)[1]
    assert df.where(F.col("kept") != F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))).count() == 0
    for k in (0, 3):
        assert rabitq.near_vectors(frame(spark, [], SCHEMA), k=k).count() == 0
    assert got(rabitq.near_vectors(frame(spark, [(1, None)], SCHEMA))) == [(1, 0, 1)]
    wide = frame(spark, [(1, [1e300, 1e300]), (2, [1e-300, 1e-300])], "vec_id long, embedding array<double>")
    assert got(rabitq.near_vectors(wide)) == [(1, 1, 1), (2, 1, 1)]


def test_bands_follow_the_number_of_vectors():
    small, large = rabitq.Plan(1000), rabitq.Plan(10**9)
    assert small.k == 2 and large.k == 22 and small.bands < large.bands < 40
    for p in (small, large):
        assert 1 - (1 - (1 - math.acos(0.95) / math.pi) ** p.k) ** p.bands >= rabitq.RECALL


@pytest.mark.parametrize("k", [None, 7])
def test_query_recall(spark, k):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/check_s/embeddings.parquet").collect()]
    table = spark.read.parquet("/root/testdata/check_s/embeddings.parquet") if k else None
    df = rabitq.near_vectors(table, k=k) if k else queries.op12_rabitq(spark, "/root/testdata/check_s")
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = np.concatenate([(x[i:i + 2000] @ x.T >= 0.95).sum(1) - 1 for i in range(0, len(x), 2000)])
    mine = {r.vec_id: r.n_links for r in df.collect()}
    mine = np.array([mine[i] for i, _ in rows])
    assert (mine <= true).all() and mine.sum() >= 0.98 * true.sum() > 1000
    assert rabitq.near_vectors(spark.read.parquet(f"{SF}/embeddings.parquet")).count() > 0
