"""N2 density clusters: labels against brute force, crowded places, noise, the projection; J7 + N6 + N8 on top."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmur.operators import density as dn
from murmur.operators import research as rs
from murmur.sources import fixtures as fx
from murmur.sources.tables import Tables
from tests.conftest import SF_ORACLE


def brute(points, radius, min_points):
    """id → (cluster, kind) by all pairs; points are (id, x, y)."""
    ids = np.array([p[0] for p in points])
    xy = np.array([p[1:] for p in points], np.int64)
    d = ((xy[:, None] - xy[None]) ** 2).sum(2)
    near = d <= radius * radius
    core = near.sum(1) >= min_points
    label = {i: i for i in np.flatnonzero(core)}
    changed = True
    while changed:
        changed = False
        for i in label:
            low = min(label[j] for j in np.flatnonzero(near[i] & core))
            if low < label[i]:
                label[i], changed = low, True
    name = {}
    for i, c in label.items():
        name[c] = min(name.get(c, ids[i]), ids[i])
    out = {}
    for i, p in enumerate(points):
        reach = [(d[i, j], name[label[j]]) for j in np.flatnonzero(near[i] & core)]
        out[p[0]] = (int(name[label[i]]), "core") if core[i] else (int(min(reach)[1]), "border") if reach else (-1, "noise")
    return out


def clusters(spark, points, min_points, resolution):
    df = spark.createDataFrame(points, "article_id long, x long, y long").repartition(3)
    return {r.article_id: (r.cluster, r.point_type) for r in dn.density_clusters(df, min_points, resolution).collect()}


@pytest.mark.parametrize("seed,min_points,resolution", [(1, 4, 6), (2, 7, 10), (3, 1, 3)])
def test_labels_equal_brute_force(spark, seed, min_points, resolution):
    rng = np.random.default_rng(seed)
    centre = rng.integers(-150, 150, (6, 2))
    xy = np.concatenate([centre[rng.integers(6, size=400)] + rng.normal(0, 5, (400, 2)).round().astype(int), rng.integers(-200, 200, (100, 2))])
    ids = rng.permutation(10000)[:500]
    points = [(int(i), int(x), int(y)) for i, (x, y) in zip(ids, xy)]
    got = clusters(spark, points, min_points, resolution)
    assert got == brute(points, resolution, min_points)
    if seed < 3:
        assert {k for _, k in got.values()} == {"core", "border", "noise"} and len({c for c, _ in got.values()}) > 3


def test_crowded_places_and_edges(spark):
    crowd = [(i, 0, 0) for i in range(5000)] + [(6000 + i, 1, 0) for i in range(3000)] + [(9000, 24, 0), (9001, 49, 0), (9002, -25, 0), (9003, 500, 500)]
    got = clusters(spark, crowd, 10, 24)
    assert got[4] == got[6001] == (0, "core") and got[9000] == (0, "core") and got[9001] == got[9002] == got[9003] == (-1, "noise")
    assert clusters(spark, [(7, 3, 3), (8, 3, 3)], 2, 5) == {7: (7, "core"), 8: (7, "core")}
    assert clusters(spark, [(7, 3, 3)], 2, 5) == {7: (-1, "noise")}
    assert clusters(spark, [], 2, 5) == {}


def test_crowded_places_are_one_row_each(spark):
    """A radius holds a bounded number of places: the neighbour join does not grow with the points on them."""
    one = spark.range(20000).select(F.col("id").alias("article_id"), (F.col("id") % 10).alias("x"), F.lit(0).cast("long").alias("y"))
    places = one.groupBy("x", "y").agg(F.count("*").alias("ow"))
    near = dn._near(places.drop("ow"), places.select(F.col("x").alias("ox"), F.col("y").alias("oy"), "ow"), 6)
    assert near.count() <= 100
    assert {r.cluster for r in dn.density_clusters(one, 5, 6).select("cluster").distinct().collect()} == {0}


def test_projection_and_noise_share(spark):
    v = fx.vectors(Tables(spark, SF_ORACLE))
    p = {r.article_id: (r.x, r.y) for r in dn.project(v).collect()}
    x = np.array([r.embedding for r in v.orderBy("article_id").collect()], float)
    _, _, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    want = x @ axes[:2].T
    got = np.array([p[i] for i in sorted(p)])
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-9)
    points = [(int(i), int(np.floor(a / (0.04 / 24))), int(np.floor(b / (0.04 / 24)))) for i, (a, b) in sorted(p.items())]
    out = dn.cluster_articles(v, 0.04, 8)
    rows = {r.article_id: (r.cluster, r.point_type) for r in out.collect()}
    assert rows == brute(points, 24, 8)
    share = dn.noise_share(out).first()
    assert share.n_points == 500 and share.n_noise == sum(c == -1 for c, _ in rows.values()) and 0 < share.noise_share < 1
    assert share.n_clusters == len({c for c, _ in rows.values()} - {-1})


def test_star_components(spark):
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1100)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.node: r.label for r in dn.star_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for n in parent}


def test_quota_sample_reads_the_comments_twice(spark):
    """No job while the plan is made; the strata are counted once and their exchange is reused."""
    rows = rs.with_buckets(fx.sample_frame(Tables(spark, SF_ORACLE)))
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    out = rs.quota_sample(rows, rs.quota_plan(rows, 300))
    assert len(tracker.getJobIdsForGroup(None)) == before
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("FileScan") <= 2 + final.count("ReusedExchange")
