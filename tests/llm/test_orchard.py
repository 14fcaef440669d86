import hashlib

import duckdb
import numpy as np
import pytest

from murmur.llm import orchard, queries
from tests.llm.util import SF, frame

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=8, dim=64, scale=1024, rounds=10, seed=3):
    """Lloyd's rounds over Python integers."""
    kept = [(i, [int(np.floor(np.float64(x) * scale)) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    now = [p for _, p in sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i8").tobytes()))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(p, c)), n) for n, c in enumerate(now)) for _, p in kept]
    for _ in range(rounds):
        own = assign()
        for c in range(len(now)):
            mine = [p for (_, p), (_, n) in zip(kept, own) if n == c]
            if mine:
                now[c] = [sum(x) // len(mine) for x in zip(*mine)]
    own = assign()
    inertia = {c: sum(d for d, n in own if n == c) for c in range(len(now))}
    sha = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in now]
    return sorted((i, n, d, inertia[n], sum(inertia.values()), sha[n]) for (i, _), (d, n) in zip(kept, own))


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("k", [1, 2, 9, 60])
def test_walk_finds_the_nearest(k):
    rng = np.random.default_rng(k)
    points = rng.integers(-3, 4, (k, 4))                # small numbers: many ties, equal centroids too
    x = rng.integers(-4, 5, (5000, 4))
    d = ((x[:, None, :] - points[None]) ** 2).sum(2)
    at, best = orchard.Centroids(points).nearest(x)
    assert (at == d.argmin(1)).all() and (best == d.min(1)).all()


def test_walk_measures_few_centroids():
    rng = np.random.default_rng(1)
    points = rng.integers(-100000, 100000, (500, 2))
    x = points[rng.integers(0, 500, 2000)] + rng.integers(-50, 50, (2000, 2))
    c, seen = orchard.Centroids(points), []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, np.ndarray):
                seen.append(len(key))
            return super().__getitem__(key).view(np.ndarray)
    c.points = points.view(Watched)
    at, _ = c.nearest(x)
    assert (at == ((x[:, None] - points[None]) ** 2).sum(2).argmin(1)).all()
    assert sum(seen) < 0.25 * 500 * 2000


def test_odd_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=4).round(1)]) for i in range(60)]
    rows += [(3, rows[3][1]), (3, [0.5, 0.5, 0.5, 0.5]), (100, None), (101, []), (102, [1.0, 2.0, 3.0]), (103, [1.0, None, 2.0, 3.0]),
             (104, [float("nan"), 1.0, 1.0, 1.0]), (105, [float("inf"), 1.0, 1.0, 1.0]), (106, [0.0] * 4), (107, [-0.0] * 4)]
    docs = frame(spark, rows, SCHEMA).selectExpr("*", "1 as cluster", "'x' as id", "2 as point", "3 as n")
    df = orchard.clusters(docs.repartition(3), k=5, dim=4)
    assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert got(df) == brute(rows, 5, 4)
    assert got(orchard.clusters(frame(spark, rows[:3], SCHEMA), k=5, dim=4)) == brute(rows[:3], 5, 4)
    assert got(orchard.clusters(frame(spark, [(9, [1.0] * 4)] * 20, SCHEMA), k=3, dim=4)) == brute([(9, [1.0] * 4)] * 20, 3, 4)
    assert orchard.clusters(frame(spark, [], SCHEMA)).count() == 0
    assert orchard.clusters(frame(spark, [(1, None), (2, [1.0])], SCHEMA)).count() == 0
    large = orchard.clusters(frame(spark, [(None, [3e38] * 4), (2, [-3e38] * 4)], SCHEMA), k=1, dim=4, rounds=0).collect()
    assert len(large) == 2 and {r.distance for r in large} == {0, 4 * (2 * orchard.LIMIT) ** 2}
    with pytest.raises(ValueError):
        orchard.cluster_points(orchard.points(docs, dim=4), np.zeros((orchard.MOST_CENTROIDS + 1, 4), np.int64))


def test_query_equals_brute_force_and_sql(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    mine = got(queries.op13_orchard(spark, SF))
    assert mine == brute(rows)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    assert mine == sorted(con.execute(queries.ORACLES["op13_orchard"]).fetchall())
