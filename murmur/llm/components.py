"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import written


def _stars(edges: DataFrame) -> DataFrame:
    """One contraction: every node and its larger neighbours move to its smallest neighbour, then the same for the rest."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.where("b > a").join(low.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
    large = large.repartition("a").distinct()           # one shuffle by node serves the distinct rows, their minimum and the join
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low.hint("merge"), "a")
    return small.select(F.when(F.expr("b > m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b")).distinct()


def contracted(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(a, b), a > b: edges that connect what ``edges`` connects, contracted until each component is a star around its smallest node.

    ``edges`` has (a, b).  Each round is written to the shared folder, so the
    plan does not grow and lost executors only re-read files.  With ``rounds``
    the contraction stops early: a node may then have several edges left, and
    all of them are needed to keep its component together.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen, k = None, 0
    while rounds is None or k < rounds:
        now = written(_stars(now), "edges")
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        k += 1
        if mark == seen or mark[0] == 0:
            break
        seen = mark
    return now


def labels(edges: DataFrame) -> DataFrame:
    """(node, label) of contracted edges: equal labels mean connected nodes, and one component carries one label once it is a star."""
    return edges.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node that is not the smallest of its component; label is the smallest."""
    return labels(contracted(edges))
