"""Near duplicates among vectors by cosine: randomised-rotation binary codes with stored correction factors.

*Codes.*  A unit vector is turned by random rotations, the same for all; the
signs of its turned components are its code.  Stored beside the signs of the
first rotation are the correction factor, the inner product of the vector with
its own signs, and the turned vector in 4 bits a component, rounded at random.
Signs of one vector times the turned other one, over the correction factor, is
an unbiased estimate of their inner product, with an error of known spread.

*Candidates.*  ``k`` further signs make a band; vectors with equal bands meet.
A pair at the threshold agrees in a sign with probability 1 - angle / pi, so as
many bands are taken as make meeting ``RECALL`` likely for it (closer pairs
meet oftener); ``k`` grows with the logarithm of the number of vectors, so that
a bucket holds about ``SHARE`` unrelated ones.  Bands pass in groups of
``AT_ONCE``, so what is shuffled at a time stays a small multiple of the input.

*Bounds.*  In a bucket every pair is estimated from the codes.  Pairs whose
upper confidence bound (``EPS`` deviations) lies below the threshold are done.
A vector with a pair left is sent on with all its components, and such pairs
are recomputed exactly, in double precision, in the first band they share only,
so that no pair counts twice.  What leaves a bucket is a number of links per
vector and a spanning forest, never its pairs.

*Hot buckets.*  A bucket of more than ``BLOCK`` vectors is cut into blocks and
the blocks are compared two by two in tasks of their own.  Exact copies are one
class from the start and count with their number.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; so do vectors of different dimension; a null id
links like any other but names no component (the component is null where no
member has an id); rows that repeat an id are vectors of their own; further
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import release, written
from murmur.llm.components import components
from murmur.operators.joins import broadcast_checked

THRESHOLD = 0.95
#: Chance that a pair at the threshold meets; unrelated vectors in a bucket; deviations of the confidence bound.
RECALL, SHARE, EPS = 0.96, 256, 4.0
#: Vectors of a block of a hot bucket; bands shuffled at a time.
BLOCK, AT_ONCE = 2048, 6
SEED = 12


class Plan:
    """Number of bands and signs a band for ``n`` vectors."""

    def __init__(self, n: int, threshold: float = THRESHOLD, k: int | None = None, bands: int | None = None):
        self.threshold = threshold
        self.k = min(60, max(0, math.ceil(math.log2(max(n, 1) / SHARE)))) if k is None else k
        meet = (1 - math.acos(threshold) / math.pi) ** self.k
        self.bands = (1 if self.k == 0 else math.ceil(math.log(1 - RECALL) / math.log(1 - meet))) if bands is None else bands


@lru_cache(maxsize=64)
def rotation(dim: int, turn: int) -> np.ndarray:
    """Random orthogonal matrix number ``turn``."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64([SEED, dim, turn])).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


# ---------------------------------------------------------------- vectors

def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, cls, cls2, dim, vector): a 128-bit hash and the bytes of each vector; null where it links with nothing."""
    for batch in batches:
        h1, h2, raw, dims = [], [], [], []
        for v in batch.column(1):
            x = None if not v.is_valid else v.values.fill_null(np.nan).to_numpy(zero_copy_only=False) + 0.0     # no -0
            good = x is not None and len(x) > 0 and bool(np.isfinite(x).all()) and bool(x.any())
            b = x.tobytes() if good else None
            a, c = np.frombuffer(hashlib.blake2b(b, digest_size=16).digest(), np.int64).tolist() if good else (None, None)
            h1.append(a), h2.append(c), raw.append(b), dims.append(len(x) if good else None)
        yield pa.record_batch({"id": batch.column(0), "cls": pa.array(h1, pa.int64()), "cls2": pa.array(h2, pa.int64()),
                               "dim": pa.array(dims, pa.int32()), "vector": pa.array(raw, pa.binary())})


def unit(col, dim: int, kind: str) -> np.ndarray:
    """Unit vectors in double precision."""
    x = np.frombuffer(b"".join(col), kind).reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)             # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


# ---------------------------------------------------------------- codes

def band_keys(x: np.ndarray, plan: Plan) -> np.ndarray:
    """(rows, bands) the signs of each band as a number."""
    n, dim = x.shape
    need = plan.k * plan.bands
    signs = np.concatenate([x @ rotation(dim, 1 + t) >= 0 for t in range(-(-need // dim))], 1)[:, :need] if need else np.zeros((n, 0), bool)
    weight = np.left_shift(np.int64(1), np.arange(plan.k, dtype=np.int64))
    return signs.reshape(n, plan.bands, plan.k).astype(np.int64) @ weight


def sketches(x: np.ndarray, seeds: np.ndarray) -> list[bytes]:
    """Correction factor, scale and offset of the 4-bit vector, signs, 4-bit vector."""
    n, dim = x.shape
    turned = x @ rotation(dim, 0)
    signs = turned >= 0
    factor = np.abs(turned).sum(1) / math.sqrt(dim)
    low, high = turned.min(1), turned.max(1)
    step = np.maximum((high - low) / 15, 1e-30)
    # a number in [0, 1) for each component, fixed by the vector's hash
    mixed = (seeds.view(np.uint64)[:, None] + np.arange(dim, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    level = np.floor((turned - low[:, None]) / step[:, None] + (mixed >> np.uint64(40)) / float(1 << 24)).astype(np.uint8).clip(0, 15)
    level = np.pad(level, ((0, 0), (0, dim % 2)))
    head = np.stack([factor, low, step], 1).astype(np.float32)
    body = np.concatenate([head.view(np.uint8).reshape(n, -1), np.packbits(signs, 1), level[:, ::2] | level[:, 1::2] << 4], 1)
    return [r.tobytes() for r in body]


class Sketches:
    """Codes read back for estimates."""

    def __init__(self, col, dim: int):
        body = np.frombuffer(b"".join(col), np.uint8).reshape(len(col), -1)
        self.dim = dim
        self.factor, low, step = (x.astype(np.float64) for x in body[:, :12].copy().view(np.float32).T)
        cut = 12 + -(-dim // 8)
        self.signs = (np.unpackbits(body[:, 12:cut], 1, count=dim).astype(np.float32) * 2 - 1) / np.float32(math.sqrt(dim))
        level = np.stack([body[:, cut:] & 15, body[:, cut:] >> 4], 2).reshape(len(body), -1)[:, :dim]
        self.turned = (low[:, None] + level * step[:, None]).astype(np.float32)
        self.step = step

    def estimate(self, other: Sketches) -> np.ndarray:
        """Inner products of all rows with all of ``other``: the mean of both unbiased estimates."""
        a = (self.turned @ other.signs.T) / other.factor[None, :]
        b = (self.signs @ other.turned.T) / self.factor[:, None]
        return (a + b) / 2

    def spread(self, threshold: float) -> np.ndarray:
        """Deviation of an estimate that uses this row's signs, for a pair at the threshold."""
        return math.sqrt(1 - threshold ** 2) * np.sqrt(np.maximum(1 - self.factor ** 2, 0)) / self.factor / math.sqrt(max(self.dim - 1, 1))

    def possible(self, other: Sketches, threshold: float) -> np.ndarray:
        """Pairs whose upper confidence bound reaches the threshold; rounding to 4 bits deviates by half a step at most."""
        a = other.spread(threshold)[None, :] + self.step[:, None] / 2 / other.factor[None, :]
        b = self.spread(threshold)[:, None] + other.step[None, :] / 2 / self.factor[:, None]
        return self.estimate(other) + EPS * (a + b) / 2 >= threshold


def _sketch(plan: Plan, kind: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, dim, keys, sketch) of every class."""
    for batch in batches:
        dims = batch.column(1).to_numpy()
        for dim in np.unique(dims).tolist():
            part = batch.take(pa.array(np.flatnonzero(dims == dim)))
            x = unit(part.column(2).to_pylist(), dim, kind)
            keys = band_keys(x, plan)
            yield pa.record_batch({"cls": part.column(0), "dim": part.column(1), "keys": pa.ListArray.from_arrays(np.arange(len(x) + 1) * plan.bands, keys.ravel()),
                                   "sketch": pa.array(sketches(x, part.column(0).to_numpy()), pa.binary())})


# ---------------------------------------------------------------- buckets

def _dealt(rows: DataFrame, block: int) -> DataFrame:
    """Rows of (band, bucket, dim, cls, ...) with the two blocks (p, q) of the task they go to."""
    place = ["band", "dim", "bucket"]
    hot = rows.groupBy(*place).agg(F.count("*").alias("size")).where(F.col("size") > block)
    hot = broadcast_checked(written(hot.selectExpr(*place, f"cast(ceil(size / {block}) as int) as blocks"), "rabitq-hot"))
    rows = rows.join(hot, place, "left").selectExpr("*", "cast(pmod(xxhash64(cls), coalesce(blocks, 1)) as int) as own")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
    rows = rows.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other")).drop("other")
    key = [*place, "p", "q"]
    return rows.repartition(*key).sortWithinPartitions(*key, "cls")


def _buckets(batches: Iterator[pa.RecordBatch], width: int = 5) -> Iterator[pa.Table]:
    """Runs of rows with equal first ``width`` columns."""
    held: list[pa.RecordBatch] = []

    def same(a: pa.RecordBatch, i: int, b: pa.RecordBatch, j: int) -> bool:
        return all(a.column(c)[i] == b.column(c)[j] for c in range(width))
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, bool)
        for c in range(width):
            v = batch.column(c).to_numpy()
            change |= v[1:] != v[:-1]
        cuts = np.concatenate(([0], np.flatnonzero(change) + 1, [batch.num_rows])).tolist()
        for i, j in zip(cuts[:-1], cuts[1:]):
            if held and not same(held[-1], 0, batch, i):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _sides(own: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    return np.flatnonzero(own == p), np.flatnonzero(own == q)


def _numbers(col: pa.ChunkedArray, width: int) -> np.ndarray:
    return col.combine_chunks().flatten().to_numpy().reshape(-1, width)


def _first_here(mask: np.ndarray, left: np.ndarray, right: np.ndarray, keys: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of the mask (as rows of ``keys``) that share no earlier band."""
    i, j = np.nonzero(mask)
    for b in range(band):
        if not len(i):
            break
        new = keys[left[i], b] != keys[right[j], b]
        i, j = i[new], j[new]
    return i, j


def _estimate(plan: Plan, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, dim, bucket, cls): vectors with a pair that the bounds leave open and that meets here first."""
    for rows in _buckets(batches):
        if rows.num_rows < 2:
            continue
        band, dim, bucket, p, q = (rows.column(c)[0].as_py() for c in range(5))
        left, right = _sides(rows.column("own").to_numpy(), p, q)
        if not len(left) or not len(right):
            continue
        col = rows.column("sketch").to_pylist()
        a = Sketches([col[k] for k in left], dim)
        b = a if p == q else Sketches([col[k] for k in right], dim)
        mask = a.possible(b, plan.threshold)
        if p == q:
            mask = np.triu(mask, 1)
        i, j = _first_here(mask, left, right, _numbers(rows.column("keys"), plan.bands), band)
        if len(i):
            at = np.unique(np.concatenate((left[i], right[j])))
            n = len(at)
            yield pa.record_batch({"band": pa.array(np.full(n, band, np.int32)), "dim": pa.array(np.full(n, dim, np.int32)),
                                   "bucket": pa.array(np.full(n, bucket)), "cls": pa.array(rows.column("cls").to_numpy()[at])})


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of the graph with edges (i, j), without the smallest themselves."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def _exact(plan: Plan, kind: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, links, b): vectors linked with class a by pairs that meet here first, and a linked class or null."""
    for rows in _buckets(batches):
        if rows.num_rows < 2:
            continue
        band, dim, _, p, q = (rows.column(c)[0].as_py() for c in range(5))
        left, right = _sides(rows.column("own").to_numpy(), p, q)
        if not len(left) or not len(right):
            continue
        x = unit(rows.column("vector").to_pylist(), dim, kind)
        mask = x[left] @ x[right].T >= plan.threshold
        if p == q:
            mask = np.triu(mask, 1)
        i, j = _first_here(mask, left, right, _numbers(rows.column("keys"), plan.bands), band)
        i, j = left[i], right[j]
        if not len(i):
            continue
        cls, copies = rows.column("cls").to_numpy(), rows.column("copies").to_numpy()
        links = (np.bincount(i, copies[j], len(cls)) + np.bincount(j, copies[i], len(cls))).astype(np.int64)
        at = np.flatnonzero(links)
        node, low = _forest(len(cls), i, j)
        yield pa.record_batch({"a": pa.array(np.concatenate((cls[at], cls[node]))),
                               "links": pa.array(np.concatenate((links[at], np.zeros(len(node), np.int64)))),
                               "b": pa.array(np.concatenate((cls[at], cls[low])), mask=np.arange(len(at) + len(node)) < len(at))})


# ---------------------------------------------------------------- operator

def _linked(classes: DataFrame, plan: Plan, kind: str, block: int) -> DataFrame:
    """(a, links, b) over all bands, written."""
    coded = written(classes.select("cls", "dim", "vector").mapInArrow(partial(_sketch, plan, kind), "cls long, dim int, keys array<long>, sketch binary"), "rabitq-codes")
    out = None
    for first in range(0, plan.bands, AT_ONCE):
        bands = F.array(*[F.lit(b) for b in range(first, min(first + AT_ONCE, plan.bands))])
        entries = coded.withColumn("band", F.explode(bands)).withColumn("bucket", F.expr("keys[band]"))
        met = _dealt(entries.select("band", "dim", "bucket", "cls", "keys", "sketch"), block)
        met = met.select("band", "dim", "bucket", "p", "q", "own", "cls", "keys", "sketch")
        left = written(met.mapInArrow(partial(_estimate, plan), "band int, dim int, bucket long, cls long").distinct(), "rabitq-open")
        rows = left.join(coded.select("cls", "keys"), "cls").join(classes.select("cls", "copies", "vector"), "cls")
        rows = _dealt(rows.select("band", "dim", "bucket", "cls", "keys", "copies", "vector"), block)
        rows = rows.select("band", "dim", "bucket", "p", "q", "own", "cls", "keys", "copies", "vector")
        part = written(rows.mapInArrow(partial(_exact, plan, kind), "a long, links long, b long"), "rabitq-links")
        out = part if out is None else out.union(part)
        if plan.bands > AT_ONCE:
            release(classes.sparkSession)
    return out


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding", k: int | None = None,
                 bands: int | None = None, block: int = BLOCK) -> DataFrame:
    """(key, n_links, component_id, kept) of every row.

    Two vectors link when the cosine of their angle is at least ``threshold``;
    ``n_links`` counts those found, ``component_id`` is the smallest id
    reachable, and ``kept`` tells whether it is the row's own.
    """
    kinds = dict(vectors.dtypes)
    kind = "<f4" if kinds[vector] == "array<float>" else "<f8"
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast(f"array<{'float' if kind == '<f4' else 'double'}>").alias("v"))
    rows = written(rows.mapInArrow(_classes, f"id {kinds[key]}, cls long, cls2 long, dim int, vector binary"), "rabitq-rows")
    classes = rows.where("cls is not null").groupBy("cls", "cls2", "dim", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = written(classes.drop("cls2"), "rabitq-classes")
    found = _linked(classes, Plan(classes.count(), threshold, k, bands), kind, block)
    counts = found.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    label = components(found.where("b is not null").select("a", "b"))
    named = classes.select("cls", "rep", "copies").join(label.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    named = written(named, "rabitq-labels")
    first = named.groupBy("label").agg(F.min("rep").alias("component"))
    named = named.join(first, "label").join(counts, "cls", "left") \
                 .selectExpr("cls", "copies - 1 + coalesce(links, 0L) as n_links", "component")
    out = rows.select("id", "cls").join(named, "cls", "left").withColumn("component", F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component")))
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("component").alias("component_id"),
                      F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
