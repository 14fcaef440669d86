"""Density clusters with a noise label (N2) over projected vectors.

Vectors are projected to two dimensions by PCA and put on an integer grid of
``RESOLUTION`` steps per neighbourhood radius.  From there on all arithmetic is
on integers, so labels do not depend on the order of rows or tasks:

1. Points on one grid place are one row with a weight, counted map-side first.
   A radius therefore holds a bounded number of places, however many articles
   crowd into it.
2. A place is *core* when the weights within the radius reach ``min_points``.
   Neighbours meet by an equi-join on square cells as wide as the radius: each
   place goes to its own cell and the eight around it.
3. Core places within the radius of each other belong together.  All core
   places of one small square (diagonal below the radius) do so anyway, so the
   graph has squares as nodes and one edge for each two squares that touch;
   its components are contracted by star steps on written tables.
4. A place that is not core joins the nearest core place (the smaller cluster
   on a tie); without one in reach it is noise.

A cluster's id is its smallest article id on a core place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.session import scratch_path

#: Grid steps per radius; a radius holds about 3.2 times its square of places.
RESOLUTION = 24
NOISE = -1


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def project(vectors: DataFrame, dims: int = 2, key: str = "article_id", vector: str = "embedding") -> DataFrame:
    """(key, x, y, ...): the first principal components of the vectors; rows without a vector are left out."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.where(F.col(vector).isNotNull()).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    model = PCA(k=dims, inputCol="_v", outputCol="_p").fit(rows)
    names = "xyzuvw"
    parts = vector_to_array(F.col("_p"))
    return model.transform(rows).select(key, *[parts[i].alias(names[i]) for i in range(dims)])


def on_grid(points: DataFrame, radius: float, resolution: int = RESOLUTION) -> DataFrame:
    """``points`` with x and y as whole grid steps."""
    step = radius / resolution
    return points.withColumns({c: F.floor(F.col(c).cast("double") / F.lit(step)).cast("long") for c in ("x", "y")})


def star_components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for every node of the edge table (a, b)."""
    both = edges.select("a", "b").union(edges.selectExpr("b as a", "a as b"))
    now = _stored(both.where("a <> b").distinct(), "star")
    before = None
    while True:
        # every node points its larger neighbours, then its other smaller ones, to its smallest neighbour
        low = now.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        up = now.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        up = _stored(up.where("a > b").distinct(), "star")
        low = up.groupBy("a").agg(F.min("b").alias("m"))
        down = up.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        tree = _stored(down.union(low.select("a", F.col("m").alias("b"))).distinct(), "star")
        mark = tree.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == before:
            break
        before = mark
        now = tree.union(tree.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = tree.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node")
    return label.union(label.select("label", "label").distinct())


def _near(places: DataFrame, others: DataFrame, radius: int) -> DataFrame:
    """Pairs of places (x, y, ...) and others (ox, oy, ...) at most ``radius`` steps apart, itself included."""
    around = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    left = places.withColumn("_d", F.explode(around)).withColumn("_cx", F.floor(F.col("x") / radius) + F.col("_d.dx")) \
                 .withColumn("_cy", F.floor(F.col("y") / radius) + F.col("_d.dy")).drop("_d")
    right = others.withColumn("_cx", F.floor(F.col("ox") / radius)).withColumn("_cy", F.floor(F.col("oy") / radius))
    apart = (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy"))
    return left.join(right, ["_cx", "_cy"]).withColumn("apart", apart).where(F.col("apart") <= radius * radius).drop("_cx", "_cy")


def density_clusters(grid: DataFrame, min_points: int, resolution: int = RESOLUTION, key: str = "article_id") -> DataFrame:
    """(key, cluster, point_type) of every grid point (key, x, y): ``core``, ``border`` or ``noise`` (cluster -1)."""
    r = resolution
    places = grid.groupBy("x", "y").agg(F.count(F.lit(1)).alias("weight"), F.min(key).alias("least"))
    places = _stored(places, "places")
    others = places.select(F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("weight").alias("ow"))
    within = _near(places, others, r).groupBy("x", "y", "least").agg(F.sum("ow").alias("n"))
    side = max(1, int(r / 2 ** 0.5))                     # diagonal of a square: side * sqrt(2) <= r
    core = within.where(F.col("n") >= min_points).select("x", "y", "least", F.floor(F.col("x") / side).alias("sx"), F.floor(F.col("y") / side).alias("sy"))
    core = _stored(core, "core")
    square = F.struct("sx", "sy")
    touch = _near(core.select("x", "y", square.alias("a")), core.select(F.col("x").alias("ox"), F.col("y").alias("oy"), square.alias("b")), r)
    label = star_components(touch.where("a < b").select("a", "b").distinct())
    squares = core.select(square.alias("node"), "least").groupBy("node").agg(F.min("least").alias("least"))
    squares = squares.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = squares.groupBy("label").agg(F.min("least").alias("cluster"))
    squares = squares.select("node", "label").join(named, "label").select(F.col("node.sx").alias("sx"), F.col("node.sy").alias("sy"), "cluster")
    core = _stored(core.join(squares, ["sx", "sy"]).select("x", "y", "cluster"), "core-labels")
    edge = places.join(core, ["x", "y"], "left_anti").select("x", "y")
    edge = _near(edge, core.select(F.col("x").alias("ox"), F.col("y").alias("oy"), "cluster"), r) \
        .groupBy("x", "y").agg(F.min(F.struct("apart", "cluster")).getField("cluster").alias("cluster"))
    kinds = core.withColumn("point_type", F.lit("core")).unionByName(edge.withColumn("point_type", F.lit("border")))
    return grid.join(kinds, ["x", "y"], "left").select(
        key, F.coalesce("cluster", F.lit(NOISE)).alias("cluster"), F.coalesce("point_type", F.lit("noise")).alias("point_type"))


def cluster_articles(vectors: DataFrame, radius: float, min_points: int, resolution: int = RESOLUTION, key: str = "article_id") -> DataFrame:
    """Density clusters of the projected vectors; noise is cluster -1."""
    return density_clusters(on_grid(project(vectors, key=key), radius, resolution), min_points, resolution, key)


def noise_share(clustered: DataFrame) -> DataFrame:
    """(n_points, n_clusters, n_noise, noise_share) of a clustering."""
    return clustered.agg(F.count(F.lit(1)).alias("n_points"), F.count_distinct(F.when(F.col("cluster") != NOISE, F.col("cluster"))).alias("n_clusters"),
                         F.count(F.when(F.col("cluster") == NOISE, 1)).alias("n_noise")) \
        .withColumn("noise_share", F.try_divide(F.col("n_noise"), F.col("n_points")))
