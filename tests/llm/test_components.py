"""Contraction of an edge table, whole and stopped early."""

import random

import pytest

from murmur.llm import common, jaccard
from murmur.llm.components import _stars, components, contracted, labels


def brute(edges):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {x: find(x) for x in top if find(x) != x}


def path(n, seed):
    names = random.Random(seed).sample(range(10 * n), n)
    return list(zip(names, names[1:]))


@pytest.mark.parametrize("edges", [path(300, 1), path(40, 2) + [(7000 + a, 7000 + b) for a, b in path(200, 3)], [(5, 5), (1, 2), (2, 1)]])
def test_components(spark, edges):
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute(edges)


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_contraction_stopped_early_keeps_components_together(spark, rounds):
    """Names in random order along a path: after a few rounds a node has edges to several smaller ones."""
    edges = path(300, 4)
    left = contracted(spark.createDataFrame(edges, "a long, b long"), rounds)
    rows = [(r.a, r.b) for r in left.collect()]
    assert len({a for a, _ in rows}) < len(rows)
    assert brute(rows) == brute(edges)
    whole = brute(edges)
    assert all(whole.get(r.node, r.node) == whole.get(r.label, r.label) for r in labels(left).collect())


def one_round(edges):
    """Large-star, then small-star, of edges (larger, smaller)."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    large = {(b, min(near[a] | {a})) for a in near for b in near[a] if b > a}
    low = {a: min(b for x, b in large if x == a) for a, _ in large}
    return {(b, low[a]) for a, b in large if b > low[a]} | set(low.items())


@pytest.mark.parametrize("seed", range(5))
def test_a_round_gives_the_rows_of_both_stars(spark, seed):
    pick = random.Random(seed)
    edges = {(max(x), min(x)) for x in (pick.sample(range(60), 2) for _ in range(70))} | {(k, 0) for k in range(100, 140)}
    rows = [tuple(r) for r in _stars(spark.createDataFrame(sorted(edges), "a long, b long")).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == one_round(edges)


def test_a_round_needs_few_tasks(spark):
    """The driver keeps a record of each task, so a round's stages count: nine runs of it were most of the tasks of a Jaccard join."""
    sc, name, parts = spark.sparkContext, "spark.sql.adaptive.coalescePartitions.enabled", 20
    old = {k: spark.conf.get(k) for k in (name, "spark.sql.shuffle.partitions")}
    edges = common.written(spark.createDataFrame(path(50, 5), "a long, b long").selectExpr("greatest(a, b) as a", "least(a, b) as b"), "edges")
    try:
        spark.conf.set(name, "false")
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        sc.setJobGroup("one-round", "")
        common.written(_stars(edges), "edges")
        told = sc.statusTracker()
        stages = {x for j in told.getJobIdsForGroup("one-round") for x in told.getJobInfo(j).stageIds}
        dealt = [i.numTasks for i in map(told.getStageInfo, stages) if i and i.numCompletedTasks and i.numTasks >= parts]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            spark.conf.set(k, v)
    assert dealt and sum(dealt) <= 3 * parts + parts // 2


def test_the_driver_lets_go_between_the_steps_of_the_join(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append("python"))
    common.release(spark)
    assert calls == ["python"]
    monkeypatch.setattr(jaccard, "release", lambda s: calls.append("join"), raising=False)
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " x"), (3, "other words here and there")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3} and calls.count("join") >= 3
