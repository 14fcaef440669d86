"""Centroid clustering with exact integers: k-means rounds whose nearest centroid is found by Orchard's search.

Vectors are scaled to integers, so that every distance and every centroid is
exact and reruns agree on any number of tasks.

*Search.*  Every centroid has the list of the others, nearest first.  A vector
starts at some centroid and walks its list; a centroid that is closer (or as
close with a smaller number) takes over at once and the walk goes on in that
one's list.  Centroids that were met are marked and measured once.  The walk
ends where the list is strictly beyond twice the distance at hand: by the
triangle inequality all that follow are strictly farther, so ties are decided
as well.  Tasks walk all vectors of a block side by side with numpy.

*Rounds.*  The lists and centroids are broadcast; their size depends on ``k``
alone, and ``k`` is checked against ``MOST_CENTROIDS``.  Tasks add up their
vectors per centroid before anything is shuffled, Spark sums these rows, and
the ``k`` sums go to the driver, which divides them with whole numbers.

Defined cases: vectors that are null, of another dimension or hold a null or
non-finite component are left out; components beyond ``LIMIT`` / scale either
way count as that limit, since a distance has to fit a long; fewer vectors
than ``k`` make that many centroids; a null id sorts as the text ``null``, and
vectors with equal ids by their components; repeated rows are vectors of their
own; only the two named columns are read, so further columns do no harm; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import written

K, DIM, SCALE, ROUNDS, SEED = 8, 64, 1024, 10, 3
#: Bound of a scaled component; 64 squared differences of twice this fit a long.
LIMIT = 1 << 27
#: Bound of the broadcast: lists and distances take 12 bytes a pair of centroids.
MOST_CENTROIDS = 2048
#: Vectors walked side by side; each holds a mark per centroid.
BLOCK = 4096


class Centroids:
    """Centroids with their neighbour lists."""

    def __init__(self, points: np.ndarray):
        self.points = points
        k = len(points)
        self.apart = np.stack([((points - p) ** 2).sum(1) for p in points]) if k else np.zeros((0, 0), np.int64)
        self.order = np.stack([np.lexsort((np.arange(k), row)) for row in self.apart]).astype(np.int32) if k else self.apart

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each row; ties go to the smaller number."""
        n, k = len(x), len(self.points)
        at = np.zeros(n, np.int64)
        best = ((x - self.points[0]) ** 2).sum(1)
        met = np.zeros((n, k), bool)
        met[:, 0] = True
        place = np.ones(n, np.int64)                    # a list starts with the centroid itself
        walk = np.arange(n if k > 1 else 0)
        while len(walk):
            here = at[walk]
            other = self.order[here, place[walk]]
            # distances are squared: beyond means gap > 4 * best, compared by quarters so that nothing overflows
            gap = self.apart[here, other]
            beyond = (gap >> 2 > best[walk]) | ((gap >> 2 == best[walk]) & ((gap & 3) > 0))
            place[walk] += 1
            new = np.flatnonzero(~beyond & ~met[walk, other])
            rows, cand = walk[new], other[new]
            met[rows, cand] = True
            d = ((x[rows] - self.points[cand]) ** 2).sum(1)
            closer = (d < best[rows]) | ((d == best[rows]) & (cand < at[rows]))
            rows, cand = rows[closer], cand[closer]
            at[rows], best[rows], place[rows] = cand, d[closer], 1
            walk = walk[~beyond]
            walk = walk[place[walk] < k]
        return at, best


def _scaled(dim: int, scale: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, point): point is the vector's integers as 8-byte little-endian numbers."""
    for batch in batches:
        lists = batch.column(1)
        size = np.asarray(lists.value_lengths().fill_null(-1))
        rows = np.flatnonzero(size == dim)
        flat = lists.take(pa.array(rows)).flatten().cast(pa.float64())
        x = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
        good = np.isfinite(x).all(1)
        with np.errstate(over="ignore"):
            v = np.clip(np.floor(x[good] * scale), -LIMIT, LIMIT).astype("<i8")
        yield pa.record_batch({"id": batch.column(0).take(pa.array(rows[good])), "point": pa.array([r.tobytes() for r in v], pa.binary())})


def points(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(id, point) of the vectors that are kept."""
    kind = dict(vectors.dtypes)[key]
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(partial(_scaled, dim, scale), f"id {kind}, point binary")


def _walk(dim: int, shared, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    centroids = shared.value
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK):
            part = batch.slice(i, BLOCK)
            x = np.frombuffer(b"".join(part.column(1).to_pylist()), "<i8").reshape(-1, dim)
            yield part.column(0), x, *centroids.nearest(x)


def _sums(dim: int, shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cluster, place, total, n): this task's sums of each component of each centroid's vectors."""
    k = len(shared.value.points)
    total, n = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
    for _, x, at, _ in _walk(dim, shared, batches):
        order = np.argsort(at, kind="stable")
        own, first = np.unique(at[order], return_index=True)
        total[own] += np.add.reduceat(x[order], first)
        n += np.bincount(at, minlength=k)
        if n.max() > 1 << 34:                           # 2**27 * 2**34 still fits a long
            yield from _rows(total, n)
            total[:], n[:] = 0, 0
    yield from _rows(total, n)


def _rows(total: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    own, dim = np.flatnonzero(n), total.shape[1]
    if len(own):
        yield pa.record_batch({"cluster": pa.array(np.repeat(own, dim).astype(np.int32)), "place": pa.array(np.tile(np.arange(dim, dtype=np.int32), len(own))),
                               "total": pa.array(total[own].ravel()), "n": pa.array(np.repeat(n[own], dim))})


def _assigned(dim: int, shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, _, at, best in _walk(dim, shared, batches):
        yield pa.record_batch({"id": ids, "cluster": pa.array(at.astype(np.int32)), "distance": pa.array(best)})


def starts(table: DataFrame, k: int, dim: int, seed: int = SEED) -> np.ndarray:
    """The ``k`` points whose id hashes lowest, in that order."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256)
    rows = table.select("point", mark.alias("mark")).orderBy("mark", "point").limit(k).collect()
    return np.array([np.frombuffer(r.point, "<i8") for r in rows], np.int64).reshape(-1, dim)


def cluster_points(table: DataFrame, first: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, DataFrame]:
    """(final centroids, (id, cluster, distance) of every point) after ``rounds`` rounds from the centroids ``first``."""
    k, dim = first.shape
    if k > MOST_CENTROIDS:
        raise ValueError(f"{k} centroids; at most {MOST_CENTROIDS} are broadcast with their lists")
    now = first.copy()
    sc = table.sparkSession.sparkContext
    for _ in range(rounds):
        shared = sc.broadcast(Centroids(now))
        sums = table.mapInArrow(partial(_sums, dim, shared), "cluster int, place int, total long, n long") \
                    .groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        new = now.copy()
        for r in sums.collect():                        # k * dim rows
            new[r.cluster, r.place] = int(r.total) // r.n
        shared.unpersist()
        if (new == now).all():                          # further rounds would change nothing
            break
        now = new
    shared = sc.broadcast(Centroids(now))
    return now, table.mapInArrow(partial(_assigned, dim, shared), f"id {dict(table.dtypes)['id']}, cluster int, distance long")


def _long(total):
    return F.least(total, F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")


def clusters(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, dim: int = DIM, scale: int = SCALE,
             rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that is kept.

    The inertias are sums of squared distances over the cluster and over all;
    ``centroid_sha256`` hashes the final centroid's components, joined by commas.
    """
    table = written(points(vectors, key, vector, dim, scale), "orchard-points")
    centroids, rows = cluster_points(table, starts(table, k, dim, seed), rounds) if table.take(1) else \
        (np.zeros((0, dim), np.int64), table.selectExpr("id", "0 as cluster", "0L as distance"))
    rows = written(rows, "orchard-clusters")
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"), F.count("*").alias("n")).collect()
    digest = {c: hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for c, p in enumerate(centroids.tolist())}
    small = table.sparkSession.createDataFrame([(r.cluster, r.own, sum(x.own for x in sums), digest.get(r.cluster)) for r in sums],
                                               "cluster int, own decimal(38,0), whole decimal(38,0), digest string")
    return rows.join(F.broadcast(small), "cluster").select(                     # one row per centroid
        F.col("id").alias(key), "cluster", "distance", _long(F.col("own")).alias("cluster_inertia"), _long(F.col("whole")).alias("inertia"),
        F.col("digest").alias("centroid_sha256"))
