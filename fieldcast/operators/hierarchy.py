"""Hierarchical density clustering (HDBSCAN) of points on the sphere, many fields at once.

The quadratic part, neighbour search and the spanning tree, is joins and aggregations over
all fields together.  What is left per field is its tree of n - 1 edges; a field is one
grid, whose cells the catalogue of regions and spacings bounds, so walking the tree is a
linear pass in one Arrow group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldcast.functions.geo import EARTH_RADIUS_KM
from fieldcast.operators.distances import meetings, near_places
from fieldcast.session import cut

HALF_EARTH_KM = 20100.0  # Fixed value: no two points are farther apart.
#: Sites that one meets in its own and the adjoining cubes at the first radius, and where halving ends.
MEET, LEAST_KM = 64, 1e-3


def fitting(sites: DataFrame, km: float, keys: Sequence[str] = ()) -> float:
    """``km``, halved until the cubes of that side let a site meet ``MEET`` others on average at most."""
    rows = sites.count()
    while km > LEAST_KM:
        met = near_places(sites, km, keys).agg(F.sum(F.col("_n").cast("double") * F.col("_m"))).first()[0] or 0
        if met <= MEET * rows:
            break
        km /= 2
    return km


def core_distances(points: DataFrame, min_samples: int, keys: Sequence[str] = (), start_km: float = 300.0) -> DataFrame:
    """``(keys, cell, core)``: distance in km to the ``min_samples``-th other point.

    Points of one place are one weighted site.  Sites with too few neighbours inside the search radius are searched again at twice
    the radius, until every one is settled; only pairs with an open site are made.  Fields with too few points have NULL.
    """
    keys = list(keys)
    place = [*keys, "lat", "lon"]
    located = points.where("lat is not null and lon is not null")
    sites = cut(located.groupBy(*place).agg(F.min("cell").alias("cell"), F.count(F.lit(1)).alias("_n")))
    radius = fitting(sites, start_km, keys)
    needed = F.lit(min_samples) - F.col("_n") + 1
    done = sites.where(needed <= 0).select(*place, F.lit(0.0).alias("core"))
    searched = cut(sites.withColumn("open", needed > 0))
    while not searched.where("open").isEmpty():
        met = meetings(searched, radius, keys)
        seen = [
            met.where(f"{x}_open").select(*keys, *(F.col(f"{x}_{c}").alias(c) for c in ("cell", "lat", "lon", "_n")), "km", F.col(f"{y}__n").alias("_near"))
            for x, y in ("lr", "rl")
        ]
        # Every site holds a point at least, so the nearest min_samples sites are enough.
        own = Window.partitionBy(*keys, "cell").orderBy("km")
        nearest = seen[0].unionByName(seen[1]).withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= min_samples)
        summed = nearest.withColumn("_sum", F.sum("_near").over(own.rowsBetween(Window.unboundedPreceding, 0)))
        found = cut(summed.where(F.col("_sum") >= needed).groupBy(*place).agg(F.min("km").alias("core")))
        done = done.unionByName(found)
        if radius >= HALF_EARTH_KM:
            break
        settled = found.select(*place, F.lit(True).alias("_found"))
        searched = cut(searched.join(settled, place, "left").withColumn("open", F.col("open") & F.isnull("_found")).drop("_found"))
        radius = min(radius * 2, HALF_EARTH_KM)
    return points.select(*place, "cell").join(done, place, "left").select(*keys, "cell", "core")


def _follow(hooks: DataFrame) -> DataFrame:
    """``(c, to)`` with every chain of hooks followed to its end by pointer doubling.

    Each component hooks to the one across its lightest edge, so the only cycles are two
    components hooked to each other; the lesser of them becomes the end.
    """
    back = hooks.select(F.col("c").alias("to"), F.col("to").alias("_back"))
    ends = hooks.join(back, "to", "left")
    mutual = (F.col("_back") == F.col("c")) & (F.col("c") < F.col("to"))
    state = cut(
        ends.groupBy("c", "to").agg(F.max(mutual).alias("_end"))
        .select("c", F.when(F.coalesce("_end", F.lit(False)), F.col("c")).otherwise(F.col("to")).alias("to"))
    )
    while True:
        further = state.select(F.col("c").alias("to"), F.col("to").alias("_next"))
        jumped = state.join(further, "to", "left").select("c", F.coalesce("_next", "to").alias("_new"), "to")
        jumped = cut(jumped)
        done = jumped.where("_new <> to").isEmpty()
        state = jumped.select("c", F.col("_new").alias("to"))
        if done:
            return state


def spanning_tree(points: DataFrame, cores: DataFrame, keys: Sequence[str] = (), start_km: float = 300.0) -> DataFrame:
    """``(keys, a, b, w)``: minimum spanning tree of mutual reachability per field.

    Rounds of Boruvka: every component takes its lightest outgoing edge, then components
    contract.  Edges up to a radius hold every reachability up to that radius, so the tree
    is final below it; the radius doubles for what is still apart, and then only pairs of
    different components meet, of each two components the lightest edge is written.  Points of one place hang on the one
    with the least core distance, as no edge to elsewhere is lighter than their own core distance.
    """
    keys = list(keys)
    named, place = [*keys, "cell"], [*keys, "lat", "lon"]
    settled = points.join(cores.where(F.col("core").isNotNull()), named)
    head = F.min(F.struct("core", "cell")).alias("_h")
    sites = cut(settled.groupBy(*place).agg(head).select(*place, "_h.cell", "_h.core"))
    labels = cut(sites.select(F.struct(*named).alias("node"), F.struct(*named).alias("root")))
    heads = sites.select(*place, F.col("cell").alias("_h"))
    hung = settled.join(heads, place).where(F.col("cell") != F.col("_h"))
    tree = hung.select(*keys, F.least("cell", "_h").alias("a"), F.greatest("cell", "_h").alias("b"), F.col("core").alias("w"))
    # No edge is lighter than the core distances at its ends, so where sites are few a search
    # below the largest one would only be repeated.
    widest = sites.agg(F.max("core")).first()[0] or start_km
    radius = fitting(sites, min(max(start_km, widest), HALF_EARTH_KM), keys)

    def lightest(edges: DataFrame) -> DataFrame:
        """Of each two components ``ca, cb`` the least edge ``e``; minima are combined before the shuffle."""
        ends = edges.where("ca <> cb").select(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb"), "e")
        return cut(ends.groupBy("ca", "cb").agg(F.min("e").alias("e")))

    while True:
        rooted = sites.where(F.col("core") <= radius).join(labels.select("node.*", "root"), named)
        met = meetings(cut(rooted), radius, keys)
        w = F.greatest("km", "l_core", "r_core")
        e = F.struct(w.alias("w"), *keys, F.least("l_cell", "r_cell").alias("a"), F.greatest("l_cell", "r_cell").alias("b"))
        edges = lightest(met.where(w <= radius).select(F.col("l_root").alias("ca"), F.col("r_root").alias("cb"), e.alias("e")))
        while not edges.isEmpty():
            offers = edges.select(F.explode(F.array("ca", "cb")).alias("c"), "e", "ca", "cb")
            offers = offers.withColumn("to", F.when(F.col("c") == F.col("ca"), F.col("cb")).otherwise(F.col("ca")))
            chosen = cut(offers.groupBy("c").agg(F.min("e").alias("e"), F.min_by("to", "e").alias("to")))
            tree = tree.unionByName(chosen.select("e.*").distinct().select(*keys, "a", "b", "w"))
            parts = _follow(chosen.select("c", "to"))
            moved = labels.join(parts.select(F.col("c").alias("root"), F.col("to").alias("_new")), "root", "left")
            labels = cut(moved.select("node", F.coalesce("_new", "root").alias("root")))
            for end in ("ca", "cb"):
                edges = edges.join(parts.select(F.col("c").alias(end), F.col("to").alias("_to")), end).drop(end).withColumnRenamed("_to", end)
            edges = lightest(edges)
        apart = labels.groupBy(*[F.col(f"node.{k}").alias(k) for k in keys]).agg(F.count_distinct("root").alias("_n"))
        if radius >= HALF_EARTH_KM or apart.where("_n > 1").isEmpty():
            return tree
        radius = min(radius * 2, HALF_EARTH_KM)


class _Tree:
    """Condensed cluster tree, grown from the lightest edge up.

    Small components carry their members along.  When a component first reaches the
    minimum size it becomes a cluster; a small one that meets a cluster falls into it; two
    clusters that meet become children of a new one.
    """

    def __init__(self, min_size: int):
        self.min_size = min_size
        self.parent: list[int] = []
        self.birth: list[float] = []
        self.size: list[int] = []
        self.mass: list[float] = []  # sum of size x lambda over everything that leaves
        self.children: list[list[int]] = []
        self.home: dict[int, tuple[int, float]] = {}

    def new(self, children: list[int]) -> int:
        number = len(self.parent)
        self.parent.append(-1)
        self.birth.append(0.0)
        self.size.append(0)
        self.mass.append(0.0)
        self.children.append(children)
        return number

    def leave(self, cluster: int, members: list[int], lam: float) -> None:
        self.size[cluster] += len(members)
        self.mass[cluster] += len(members) * lam
        for m in members:
            self.home[m] = (cluster, lam)

    def grow(self, n: int, edges: list[tuple[int, int, float]]) -> int:
        up = list(range(n))
        members: dict[int, list[int]] = {i: [i] for i in range(n)}
        cluster: dict[int, int] = {}

        def find(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        start = 0
        while start < len(edges):
            # Edges of one weight act at once, so the result does not depend on which of
            # several equally light spanning trees was found.
            w, stop = edges[start][2], start
            groups: dict[int, list[int]] = {}
            while stop < len(edges) and edges[stop][2] == w:
                a, b = find(edges[stop][0]), find(edges[stop][1])
                up[b] = a
                groups[a] = groups.pop(a, [a]) + groups.pop(b, [b])
                stop += 1
            start, lam = stop, 1.0 / max(w, 1e-300)
            for head, parts in groups.items():
                big = [cluster.pop(x) for x in parts if x in cluster]
                loose = sorted((members.pop(x) for x in parts if x in members), key=len)
                fallen = loose.pop() if loose else []
                for more in loose:
                    fallen.extend(more)
                if len(big) > 1:
                    top = self.new(big)
                    for c in big:
                        self.parent[c], self.birth[c] = top, lam
                        self.size[top] += self.size[c]
                        self.mass[top] += self.size[c] * lam
                    self.leave(top, fallen, lam)
                    cluster[head] = top
                elif big:
                    self.leave(big[0], fallen, lam)
                    cluster[head] = big[0]
                elif len(fallen) >= self.min_size:
                    cluster[head] = self.new([])
                    self.leave(cluster[head], fallen, lam)
                else:
                    members[head] = fallen
        return len(self.parent) - 1

    def stability(self, c: int) -> float:
        return self.mass[c] - self.size[c] * self.birth[c]

    def below(self, c: int) -> list[int]:
        out, stack = [], list(self.children[c])
        while stack:
            x = stack.pop()
            out.append(x)
            stack.extend(self.children[x])
        return out

    def select(self, method: str, single: bool, epsilon: float) -> set[int]:
        root = len(self.parent) - 1
        if method == "leaf":
            chosen = {c for c in range(root + 1) if not self.children[c] and (c != root or single)}
        else:
            chosen, best = set(), {}
            for c in range(root + 1):  # children come before their parent
                inner = sum(best[k] for k in self.children[c])
                if c == root and not single:
                    break
                if inner > self.stability(c):
                    best[c] = inner
                else:
                    best[c] = self.stability(c)
                    chosen.difference_update(self.below(c))
                    chosen.add(c)
        if not epsilon or chosen <= {root}:
            return chosen
        out, covered = set(), set()
        for c in sorted(chosen):
            if c in covered:
                continue
            while c != root and 1.0 / self.birth[c] < epsilon:
                if self.parent[c] == root and not single:
                    break
                c = self.parent[c]
            out.add(c)
            covered.update(self.below(c))
        return {c for c in out if not any(c in self.below(o) for o in out if o != c)}


def tree_labels(n: int, edges: list[tuple[int, int, float]], min_cluster_size: int, epsilon: float = 0.0,
                method: str = "eom", single: bool = True) -> np.ndarray:
    """Cluster number per point from a spanning tree sorted by weight; -1 is noise."""
    out = np.full(n, -1)
    tree = _Tree(min_cluster_size)
    root = tree.grow(n, edges)
    if root < 0:
        return out
    chosen = tree.select(method, single, epsilon)
    alone = chosen == {root}
    top = max((lam for c, lam in tree.home.values() if c == root), default=np.inf)
    if tree.children[root]:
        top = max(top if np.isfinite(top) else 0.0, tree.birth[tree.children[root][0]])
    needed = 1.0 / epsilon if epsilon else top
    found: dict[int, int] = {}
    for point in range(n):
        if point not in tree.home:
            continue
        c, lam = tree.home[point]
        if alone and c == root and lam < needed:
            continue
        while c >= 0 and c not in chosen:
            c = tree.parent[c]
        if c >= 0:
            out[point] = found.setdefault(c, len(found))
    return out


def hdbscan(points: DataFrame, min_samples: int, min_cluster_size: int, keys: Sequence[str] = (),
            epsilon_rad: float = 0.0, method: str = "eom", allow_single_cluster: bool = True,
            min_points: int = 0, start_km: float = 300.0) -> DataFrame:
    """``(keys, cell, clustid)`` per field; noise is NULL.

    ``epsilon_rad`` joins clusters that split at less than that distance.  Fields with
    fewer than ``min_points`` points stay without clusters.
    """
    keys = list(keys)
    sizes = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    big = sizes.where(F.col("_n") >= max(min_points, min_cluster_size)).drop("_n")
    usable = cut(points.join(big, keys, "left_semi") if keys else points)
    cores = cut(core_distances(usable, min_samples, keys, start_km))
    edges = spanning_tree(usable, cores, keys, start_km)
    kind = points.schema["cell"].dataType.simpleString()
    key_ddl = "".join(f"{k} {points.schema[k].dataType.simpleString()}, " for k in keys)
    epsilon_km = epsilon_rad * EARTH_RADIUS_KM

    def label(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["w", "a", "b"])
        cells, flat = np.unique(np.concatenate([frame["a"], frame["b"]]), return_inverse=True)
        a, b = flat[: len(frame)], flat[len(frame) :]
        links = list(zip(a.tolist(), b.tolist(), frame["w"].tolist()))
        found = tree_labels(len(cells), links, min_cluster_size, epsilon_km, method, allow_single_cluster)
        out = pd.DataFrame({k: v for k, v in zip(keys, key)}, index=range(len(cells)))
        return out.assign(cell=cells, clustid=found)

    labels = edges.groupBy(*keys).applyInPandas(label, f"{key_ddl}cell {kind}, clustid int")
    clean = labels.withColumn("clustid", F.when(F.col("clustid") >= 0, F.col("clustid")))
    return points.select(*keys, "cell").join(clean, [*keys, "cell"], "left")
