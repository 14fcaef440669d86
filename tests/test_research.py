"""Quota sampling and cluster helpers (N4, N5, N7, N8, J7) on hand-made rows and invariants."""

import datetime as dt

from pyspark.sql import functions as F

import __spark_entry__ as E
from murmur.operators import research as rs
from tests.conftest import SF_SMALL


def _rows(spark, rows):
    return rs.with_buckets(spark.createDataFrame(
        rows, "id long, cluster long, emotion string, confidence double, length long, timestamp timestamp_ntz"))


T0 = dt.datetime(2024, 1, 1)


def test_n7_buckets_right_closed(spark):
    df = _rows(spark, [(1, 0, "joy", 0.33, 20, T0), (2, 0, "joy", 0.0, 0, T0), (3, 0, "joy", 1.0, 200, T0),
                       (4, 0, "joy", 0.34, 201, T0)])
    got = [(r.confidence_cat, r.length_cat) for r in df.orderBy("id").collect()]
    assert got == [("low", "short"), (None, None), ("high", "very_long"), ("medium", None)]


def test_n8_small_cell_taken_whole_and_null_strata_top_up(spark):
    rows = [(i, 0, "joy", 0.5, 30, T0) for i in range(4)]                  # cell with 4 rows ≤ 6
    rows += [(100 + i, 1, "joy", 0.0, 0, T0) for i in range(9)]           # all rows NULL bucket
    rows += [(200 + i, 0, "fear", 0.1 + i / 100, 10 + i * 20, T0) for i in range(20)]
    df = _rows(spark, rows)
    plan = rs.quota_plan(df, total_samples=1000)
    cells = {(r.cluster, r.emotion): r.take for r in plan.collect()}
    assert cells == {(0, "joy"): 4, (1, "joy"): 6, (0, "fear"): 6}
    s = rs.quota_sample(df, plan)
    per = {(r.cluster, r.emotion): r["count"] for r in s.groupBy("cluster", "emotion").count().collect()}
    assert per == cells
    assert s.select("id").distinct().count() == s.count()


def test_n8_target_reached_mid_cluster(spark):
    rows = [(c * 100 + i, c, "joy", 0.5, 30, T0) for c in range(5) for i in range(10)]
    df = _rows(spark, rows)
    plan = rs.quota_plan(df, total_samples=14).collect()    # one emotion → target 14 = 6 + 6 + 2
    takes = sorted((r.take for r in plan), reverse=True)
    assert takes == [6, 6, 2, 0, 0]
    assert rs.quota_sample(df, rs.quota_plan(df, total_samples=14)).count() == 14


def test_n8_invariants_on_fixture(spark):
    plan = E.queries()["quota_sample_plan"](spark, SF_SMALL)
    assert plan.where(F.col("take") > 6).count() == 0
    per_emotion = plan.groupBy("emotion").agg(F.sum("take").alias("t"), F.first("target").alias("target"))
    assert per_emotion.where(F.col("t") > F.col("target")).count() == 0
    sample = E.queries()["quota_sample"](spark, SF_SMALL)
    got = {(r.cluster, r.emotion): r["count"] for r in sample.groupBy("cluster", "emotion").count().collect()}
    want = {(r.cluster, r.emotion): r.take for r in plan.where("take > 0").collect()}
    assert got == want


def test_n4_n5_cluster_helpers(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [0.0, 2.0], 0), (4, [2.0, 2.0], 0),
                               (5, [9.0, 9.0], -1)], "article_id long, embedding array<float>, cluster int")
    assert rs.cluster_samples(v, 2).count() == 2
    cb = {r.article_id: r.point_type for r in rs.core_boundary(v).collect()}
    assert set(cb) == {1, 2, 3, 4}            # noise removed
    assert list(cb.values()).count("core") == 4   # all at the same distance → all ≤ 25th percentile
    sizes = {r.cluster: r.n for r in rs.cluster_sizes(v).collect()}
    assert sizes == {0: 4}


def test_j7_attach_clusters_drops_noise_and_orphans(spark):
    c = spark.createDataFrame([(1, 10), (2, 11), (3, 12)], "id long, article_id long")
    k = spark.createDataFrame([(10, 0), (11, -1)], "article_id long, cluster int")
    assert [r.id for r in rs.attach_clusters(c, k).collect()] == [1]


def test_quota_sample_takes_what_the_plan_says_with_a_larger_cap(spark):
    df = rs.with_buckets(spark.createDataFrame([(k, 0, "joy", 0.2 + (k % 3) * 0.3, 10 + k % 60, None) for k in range(100)],
                                               "id long, cluster int, emotion string, confidence double, length long, timestamp timestamp"))
    plan = rs.quota_plan(df, total_samples=20, max_per_cell=20)
    assert plan.first().take == 20 and rs.quota_sample(df, plan).count() == 20
