"""Clustering of cells: density-based on the sphere, hierarchical on a distance table.

Every algorithm is a loop of joins and combining aggregations over DataFrames.  The loop
state is checkpointed once per round, so lineage stays short and a lost executor costs one
round's recomputation from files.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from fieldcast.functions.geo import haversine_km
from fieldcast.functions.ranks import rank_counts
from fieldcast.operators.distances import chord, cube_of, near_cubes
from fieldcast.session import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)``: every node of an edge table ``(a, b)`` with its component's least node.

    Alternates two star contractions (neighbours hook to the least node in reach), which
    needs a logarithmic number of rounds on long chains too.  Minima are combined on the map
    side before any shuffle, so a hub with most of the edges is no hot spot.
    """
    given = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    nodes = given.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    state = given.where("a <> b")
    previous = None
    while True:
        # Large star: larger neighbours of a node hook to the least node around it.
        both = state.select("a", "b").unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # Small star: a node and its smaller neighbours hook to the least of them.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        floor = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(floor, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        state = cut(small.unionByName(floor.withColumnRenamed("m", "b")).where("a <> b").distinct())
        # Checksum of the edge set: unchanged edges mean the stars are final.
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == previous:
            break
        previous = now
    hooked = nodes.join(state.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left")
    return cut(hooked.select("node", F.coalesce("root", "node").alias("root")))


def dbscan(points: DataFrame, eps_km: float, min_samples: int) -> DataFrame:
    """``(cell, clustid)`` by DBSCAN on great-circle distance; noise is NULL.

    Space is cut into cubes whose diagonal is ``eps``: points of one cube are all
    neighbours.  A cube with ``min_samples`` points is core as a whole without looking at
    any pair; only points of sparser cubes count their neighbours.  Clusters are connected
    components of cubes, so the graph never has more nodes than occupied cubes.  Points
    that share coordinates are one weighted site.  Ids follow the least core cell; a border
    point goes to the first cluster that reaches it.
    """
    side = chord(eps_km) / math.sqrt(3) * (1 - 1e-9)
    sites = cut(
        points.groupBy("lat", "lon")
        .agg(F.count(F.lit(1)).alias("w"), F.min("cell").alias("first"))
        .withColumn("cube", cube_of(side))
    )
    cubes = sites.groupBy("cube").agg(F.sum("w").alias("total"))
    # Cubes two steps away can still hold a neighbour, as the side is eps / sqrt(3).
    linked = cubes.select("cube", "total", F.explode(near_cubes(F.col("cube"), 2)).alias("near")).where("near <> cube")
    linked = cut(linked.join(cubes.select(F.col("cube").alias("near")), "near", "left_semi"))

    def within(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        """Pairs of sites in linked cubes that are at most eps apart."""
        a = left.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), *[c for c in left.columns if c not in ("lat", "lon")])
        b = right.select(F.col("lat").alias("_blat"), F.col("lon").alias("_blon"), F.col("cube").alias("_cube"),
                         *[F.col(c).alias(f"_b{c}") for c in right.columns if c not in ("lat", "lon", "cube")])
        near = F.col("near") == F.col("_cube")
        close = haversine_km(F.col("_lat"), F.col("_lon"), F.col("_blat"), F.col("_blon")) <= eps_km
        return a.join(linked.select("cube", "near"), "cube").join(b, near & close, how)

    sparse = sites.join(cubes.where(F.col("total") < min_samples), "cube")
    reached = within(sparse.drop("w", "first"), sites.drop("first")).groupBy("_lat", "_lon").agg(F.sum("_bw").alias("more"))
    lonely = sparse.join(reached, (F.col("lat") == F.col("_lat")) & (F.col("lon") == F.col("_lon")), "left")
    lonely = lonely.where(F.col("total") + F.coalesce("more", F.lit(0)) >= min_samples).select("lat", "lon", "first", "cube")
    dense = sites.join(cubes.where(F.col("total") >= min_samples), "cube", "left_semi").select("lat", "lon", "first", "cube")
    core = cut(dense.unionByName(lonely))

    bridges = within(core.drop("first"), core.drop("first"), "left_semi").select(
        F.col("cube").alias("a"), F.col("near").alias("b")
    )
    own = core.select(F.col("cube").alias("a"), F.col("cube").alias("b"))
    parts = connected_components(bridges.unionByName(own).distinct())
    rooted = core.join(parts.withColumnRenamed("node", "cube"), "cube")
    firsts = cut(rooted.groupBy("root").agg(F.min("first").alias("first_core")))
    numbers = rank_counts(firsts, [], "first_core").select("first_core", (F.col("n_upto") - 1).cast("int").alias("clustid"))
    clusters = firsts.join(numbers, "first_core").select("root", "clustid")
    core_labels = cut(rooted.join(clusters, "root").select("lat", "lon", "cube", "clustid"))

    rest = sites.join(core_labels, ["lat", "lon"], "left_anti").drop("w", "first")
    same = rest.join(core_labels.select("cube", "clustid"), "cube").select("lat", "lon", "clustid")
    near = within(rest, core_labels).select(F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), F.col("_bclustid").alias("clustid"))
    border = same.unionByName(near).groupBy("lat", "lon").agg(F.min("clustid").alias("clustid"))
    labels = core_labels.select("lat", "lon", "clustid").unionByName(border)
    return points.join(labels, ["lat", "lon"], "left").select("cell", "clustid")


def average_linkage(pairs: DataFrame, max_height: float | None = None) -> DataFrame:
    """``(a, b, height, size)``: the merges of average-linkage clustering of ``(i, j, dist)``.

    All pairs of clusters that are each other's nearest merge in the same round; average
    linkage cannot bring a third cluster closer than either, so the tree is the one a
    pair-by-pair procedure builds.  Distances are carried as sums over member pairs, merged
    by one combining aggregation per round.  ``a`` is the lesser of the two least members
    and names the merged cluster.  Stops early when nothing is left below ``max_height``.
    """
    spark = pairs.sparkSession
    state = cut(
        pairs.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.col("dist").alias("total"),
                     F.lit(1).cast("bigint").alias("ni"), F.lit(1).cast("bigint").alias("nj"))
    )
    merged = None
    while True:
        average = state.withColumn("avg", F.col("total") / (F.col("ni") * F.col("nj")))
        if max_height is not None:
            average_kept = average.where(F.col("avg") <= max_height)
        else:
            average_kept = average
        order = F.struct("avg", "i", "j")
        ends = average_kept.select(F.explode(F.array("i", "j")).alias("c"), order.alias("best"), F.col("ni"), F.col("nj"))
        nearest = ends.groupBy("c").agg(F.min("best").alias("best"), F.min_by(F.col("ni") + F.col("nj"), "best").alias("size"))
        mutual = (
            nearest.groupBy("best").agg(F.count(F.lit(1)).alias("_n"), F.max("size").alias("size")).where("_n = 2")
            .select(F.col("best.i").alias("a"), F.col("best.j").alias("b"), F.col("best.avg").alias("height"), "size")
        )
        mutual = cut(mutual)
        if mutual.isEmpty():
            break
        merged = mutual if merged is None else merged.unionByName(mutual)
        moves = mutual.select(F.explode(F.array("a", "b")).alias("c"), F.col("a").alias("to"), "size")
        moved = state
        for end, n in (("i", "ni"), ("j", "nj")):
            step = moves.select(F.col("c").alias(end), F.col("to").alias("_to"), F.col("size").alias("_size"))
            moved = moved.join(step, end, "left").withColumns(
                {end: F.coalesce("_to", end), n: F.coalesce("_size", n)}
            ).drop("_to", "_size")
        moved = moved.where("i <> j")
        swap = F.col("i") > F.col("j")
        moved = moved.select(
            F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "total",
            F.when(swap, F.col("nj")).otherwise(F.col("ni")).alias("ni"),
            F.when(swap, F.col("ni")).otherwise(F.col("nj")).alias("nj"),
        )
        state = cut(
            moved.groupBy("i", "j").agg(F.sum("total").alias("total"), F.max("ni").alias("ni"), F.max("nj").alias("nj"))
        )
    if merged is None:
        kind = pairs.schema["i"].dataType.simpleString()
        return spark.createDataFrame([], f"a {kind}, b {kind}, height double, size bigint")
    return merged


def cut_tree(merges: DataFrame, cells: DataFrame, n_clusters: int | None = None, height: float | None = None) -> DataFrame:
    """``(cell, clustid)`` of a merge table cut at a height or into a number of clusters.

    Heights never fall along the tree, so both cuts keep a lowest part of the merges.  Ids
    follow the least cell of each cluster.
    """
    if n_clusters is not None:
        order = F.struct("height", "a", "b")
        ranked = merges.withColumn("_r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order)))
        kept = ranked.where(F.col("_r") <= F.lit(cells.agg(F.count(F.lit(1)) - n_clusters).scalar())).drop("_r")
    else:
        kept = merges.where(F.col("height") <= height)
    own = cells.select(F.col("cell").alias("a"), F.col("cell").alias("b"))
    parts = connected_components(kept.select("a", "b").unionByName(own))
    roots = cut(parts.select("root").distinct())
    numbers = rank_counts(roots, [], "root").select("root", (F.col("n_upto") - 1).cast("int").alias("clustid"))
    return parts.join(numbers, "root").select(F.col("node").alias("cell"), "clustid")


def cut_heights(merges: DataFrame, cells: DataFrame, heights: Sequence[float]) -> DataFrame:
    """One labelling per dissimilarity threshold: ``(dissim_threshold, cell, clustid)``."""
    out = None
    for h in heights:
        part = cut_tree(merges, cells, height=h).withColumn("dissim_threshold", F.lit(float(h)))
        out = part if out is None else out.unionByName(part)
    return out


def centroid_clusters(points: DataFrame, n_clusters: Sequence[int], bisecting: bool = False, seed: int = 7) -> DataFrame:
    """``(nclusters, cell, clustid)`` by k-means on positions in space, one labelling per k.

    The distributed alternative to clustering a precomputed matrix: straight-line distance
    on the unit sphere grows with great-circle distance.
    """
    phi, lam = F.radians("lat"), F.radians("lon")
    placed = points.select("cell", (F.cos(phi) * F.cos(lam)).alias("x"), (F.cos(phi) * F.sin(lam)).alias("y"), F.sin(phi).alias("z"))
    vectors = VectorAssembler(inputCols=["x", "y", "z"], outputCol="features").transform(placed)
    vectors = vectors.persist(StorageLevel.MEMORY_AND_DISK)
    kind = BisectingKMeans if bisecting else KMeans
    out = None
    for k in n_clusters:
        fitted = kind(k=k, seed=seed, predictionCol="clustid").fit(vectors)
        part = fitted.transform(vectors).select(F.lit(k).alias("nclusters"), "cell", "clustid")
        out = part if out is None else out.unionByName(part)
    return out
