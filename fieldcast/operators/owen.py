"""Owen values of a forest: Shapley values whose coalitions respect a tree of related features.

A feature joins a coalition together with the others of its group, groups together with their parent group, and so on up
to the root.  For one row, one background row and one leaf only the features count that exactly one of both rows fulfils:
the leaf's value is reached when all of the row's own (``gain``) are in the coalition and all of the background's
(``loss``) are out.  Level by level the share of orderings that allow it is ``p! q! / (p + q + 1)!`` with ``p`` sibling
groups holding gains alone and ``q`` holding losses alone, and nothing when a sibling holds both.  A flat tree gives
Shapley values.

What is joined are three tables: leaves, the patterns that rows show at a leaf, and the patterns that the background
shows there with their counts.  Equal patterns are computed once, all rows of the background count, and no row meets
another row.  A leaf has at most ``2^depth`` patterns, whatever the number of rows.  Rows that lie between the same limits
of the leaves in every feature fulfil the same conditions everywhere, so they are one kind, and each kind is worked off once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcast.operators.clustering import average_linkage
from fieldcast.session import cut

#: Leaves that are looked at together by one task.
BLOCK = 256
#: A pattern is the bits of one number.
MOST_FEATURES = 62

Tree = int | tuple["Tree", ...]


def leaf_table(spark: SparkSession, leaves: Sequence) -> DataFrame:
    """``(block, leaf, value, features, low, high)`` of the leaves of :mod:`fieldcast.operators.shapley`."""
    if any(len(leaf.features) > MOST_FEATURES for leaf in leaves):
        raise ValueError(f"a path over more than {MOST_FEATURES} features has no pattern in one number")
    rows = [
        (k // BLOCK, k, float(leaf.value), leaf.features.tolist(), leaf.low.tolist(), leaf.high.tolist())
        for k, leaf in enumerate(leaves)
    ]
    return spark.createDataFrame(
        rows, "block int, leaf int, value double, features array<int>, low array<double>, high array<double>"
    )


def features_of(tree: Tree) -> list[int]:
    """The features below a node, each of which may stand there once."""
    out, open_nodes = [], [tree]
    while open_nodes:
        node = open_nodes.pop()
        if isinstance(node, tuple):
            open_nodes += node
        else:
            out.append(node)
    if len(out) != len(set(out)):
        raise ValueError("a feature stands twice in the tree")
    return out


def meetings(tree: Tree) -> list[tuple[int, int, int, int]]:
    """``(i, j, level, branch)``: seen from feature i, j lies in that sibling branch at that level of the tree."""
    out, open_nodes = [], [(tree, 0)]
    while open_nodes:
        node, level = open_nodes.pop()
        if not isinstance(node, tuple):
            continue
        below = [features_of(child) for child in node]
        out += [
            (i, j, level, b)
            for a, mine in enumerate(below) for b, theirs in enumerate(below) if a != b for i in mine for j in theirs
        ]
        open_nodes += [(child, level + 1) for child in node]
    return out


def correlation_tree(rows: DataFrame) -> Tree:
    """The features of a ``features`` vector, merged by average linkage of ``1 - correlation``.

    The correlations are one pass over the rows; the tree has as many merges as the model has features less one.  A feature
    that never varies correlates with none.
    """
    matrix = Correlation.corr(rows, "features").head()[0].toArray()
    n = len(matrix)
    if n == 1:
        return (0,)
    apart = [
        (i, j, 1.0 - (float(matrix[i, j]) if math.isfinite(matrix[i, j]) else 0.0)) for i in range(n) for j in range(i + 1, n)
    ]
    merges = average_linkage(rows.sparkSession.createDataFrame(apart, "i int, j int, dist double")).collect()
    nodes: dict[int, Tree] = dict(enumerate(range(n)))
    for merge in sorted(merges, key=lambda m: (m["size"], m["a"])):  # a part is smaller than what it is part of
        nodes[merge["a"]] = (nodes[merge["a"]], nodes[merge["b"]])
    return nodes[0]


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def patterns(rows: DataFrame, keys: Sequence[str], leaves: DataFrame) -> DataFrame:
    """``(keys, leaf, mask)``: the conditions of each leaf that each row's array ``x`` fulfils; NULL and NaN fulfil none."""
    blocks = leaves.groupBy("block").agg(F.collect_list(F.struct("leaf", "features", "low", "high")).alias("_leaves"))
    last = leaves.agg(F.max("block")).scalar()
    spread = rows.select(*keys, "x", F.explode(F.sequence(F.lit(0), last)).alias("block"))
    met = spread.join(blocks, "block").select(*keys, "x", F.explode("_leaves").alias("_l"))

    def held(feature: Column, place: Column) -> Column:
        x, low, high = F.get("x", feature), F.get("_l.low", place), F.get("_l.high", place)
        return F.when((x > low) & (x <= high), _bit(place)).otherwise(0)

    mask = F.aggregate(F.transform("_l.features", held), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return met.select(*keys, F.col("_l.leaf").alias("leaf"), mask.alias("mask"))


def with_kind(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """Adds ``kind``: per feature how many of the leaves' limits its value exceeds; -1 for NULL, and NaN exceeds them all.

    Rows of one kind fulfil the same conditions at every leaf, which tests ``low < x <= high``.
    """
    bounds = leaves.select(F.explode(F.arrays_zip("features", "low", "high")).alias("_c"))
    limits = bounds.select(F.col("_c.features").alias("f"), F.explode(F.array("_c.low", "_c.high")).alias("c")).distinct()
    found = {r.f: r.c for r in limits.groupBy("f").agg(F.sort_array(F.collect_list("c")).alias("c")).collect()}  # the model's own numbers

    def above(f: int, cuts: list[float]) -> Column:
        x = F.get("x", F.lit(f))
        # NULL exceeds nothing and is told apart from the least values, which do not either.
        return F.when(x.isNull(), -1).otherwise(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: x > c)))

    return rows.withColumn("kind", F.array(*[above(f, cuts) for f, cuts in sorted(found.items())]).cast("array<int>"))


def _players(leaves: DataFrame, tree: Tree) -> DataFrame:
    """Per leaf its features as ``(bit, feature, levels)``; a level is the masks of the sibling branches that the leaf asks."""
    spark = leaves.sparkSession
    meets = spark.createDataFrame(meetings(tree), "feature int, other int, level int, branch int")
    owners = leaves.select("leaf", F.posexplode("features").alias("place", "feature"))
    owners = owners.select("leaf", "feature", _bit(F.col("place")).alias("bit"))
    others = owners.select("leaf", F.col("feature").alias("other"), F.col("bit").alias("_bit"))
    masks = (
        owners.join(others, "leaf").join(meets, ["feature", "other"])
        .groupBy("leaf", "feature", "level", "branch").agg(F.sum("_bit").alias("mask"))
        .groupBy("leaf", "feature", "level").agg(F.sort_array(F.collect_list("mask")).alias("masks"))
        .groupBy("leaf", "feature").agg(F.sort_array(F.collect_list(F.struct("level", "masks"))).alias("_levels"))
    )
    none = F.array().cast("array<array<bigint>>")
    joined = owners.join(masks, ["leaf", "feature"], "left")
    player = F.struct("bit", "feature", F.coalesce(F.col("_levels.masks"), none).alias("levels"))
    return joined.groupBy("leaf").agg(F.sort_array(F.collect_list(player)).alias("players"), F.sum("bit").alias("full"))


def _share(levels: Column, gain: Column, loss: Column) -> Column:
    """Share of the orderings in which the siblings on all levels stand as the leaf needs them."""
    factorial = F.array(*[F.lit(float(math.factorial(k))) for k in range(MOST_FEATURES + 2)])

    def level(masks: Column) -> Column:
        gains = F.filter(masks, lambda m: m.bitwiseAND(gain) != 0)
        losses = F.size(F.filter(masks, lambda m: m.bitwiseAND(loss) != 0))
        both = F.exists(gains, lambda m: m.bitwiseAND(loss) != 0)
        p = F.size(gains)
        orderings = F.get(factorial, p) * F.get(factorial, losses) / F.get(factorial, p + losses + 1)
        return F.when(both, 0.0).otherwise(orderings)

    return F.aggregate(levels, F.lit(1.0), lambda share, masks: share * level(masks))


def owen_values(rows: DataFrame, keys: Sequence[str], background: DataFrame, leaves: DataFrame, tree: Tree,
                names: Sequence[str]) -> DataFrame:
    """``(keys, feature, shap)`` of every row, and one ``expected_value`` row with the background's mean prediction.

    ``rows`` and ``background`` hold the features as an array ``x``; ``keys`` identify a row.  The values of a row and the
    expected value add up to its prediction.  An empty background is an error: there is nothing to compare with.
    """
    keys, n = list(keys), len(names)
    if sorted(features_of(tree)) != list(range(n)):
        raise ValueError("the tree holds each feature once")
    rows = cut(with_kind(rows.select(*keys, "x"), leaves).select(*keys, "x", "kind"))  # read twice, and both readings must show the same kinds
    kinds = cut(rows.groupBy("kind").agg(F.first("x").alias("x")))
    there = cut(with_kind(background.select("x"), leaves).groupBy("kind").agg(F.first("x").alias("x"), F.count(F.lit(1)).alias("n")))
    counted = cut(patterns(there, ["n"], leaves).groupBy("leaf", "mask").agg(F.sum("n").alias("n")))
    total = counted.where("leaf = 0").agg(F.sum("n").cast("double")).head()[0]
    if not total:
        raise ValueError("the background has no rows")
    players = cut(_players(leaves, tree).join(leaves.select("leaf", "value"), "leaf"))
    shown = patterns(kinds, ["kind"], leaves)

    # The row's and the background's pattern must together fulfil the whole leaf, or no coalition reaches it.
    mine, theirs = F.col("mask"), F.col("other")
    pairs = (
        shown.select("leaf", "mask").distinct()
        .join(counted.select("leaf", F.col("mask").alias("other"), "n"), "leaf").join(players, "leaf")
        .where((mine.bitwiseOR(theirs) == F.col("full")) & (mine != theirs))
        .select("leaf", "mask", "n", "value", mine.bitwiseAND(F.bitwise_not(theirs)).alias("gain"),
                theirs.bitwiseAND(F.bitwise_not(mine)).alias("loss"), F.explode("players").alias("_p"))
    )
    in_gain, in_loss = (F.col("_p.bit").bitwiseAND(F.col(c)) != 0 for c in ("gain", "loss"))
    share = _share(F.col("_p.levels"), F.col("gain"), F.col("loss")) * F.col("n") / total * F.col("value")
    parts = (
        pairs.where(in_gain | in_loss)
        .select("leaf", "mask", F.col("_p.feature").alias("_f"), F.when(in_gain, share).otherwise(-share).alias("shap"))
        .groupBy("leaf", "mask", "_f").agg(F.sum("shap").alias("shap"))
    )
    found = shown.join(parts, ["leaf", "mask"]).groupBy("kind", "_f").agg(F.sum("shap").alias("shap"))
    # One number per feature, in their order; features that no leaf of a kind moves have none.
    moved = found.groupBy("kind").agg(F.map_from_entries(F.collect_list(F.struct("_f", "shap"))).alias("_shap"))

    reached = counted.join(players, "leaf").where("mask = full").select(F.col("value") * F.col("n"))
    stumps = leaves.where(F.size("features") == 0).select(F.col("value") * F.lit(total))  # trees without a split
    expected = reduce(DataFrame.union, [reached, stumps]).toDF("_v").agg(F.coalesce(F.sum("_v"), F.lit(0.0)) / total).head()[0]
    label = F.array(*[F.lit(name) for name in [*names, "expected_value"]])
    own = F.transform(
        F.sequence(F.lit(0), F.lit(n)),
        lambda f: F.struct(
            F.get(label, f).alias("feature"), F.when(f == n, F.lit(expected)).otherwise(F.coalesce(F.element_at("_shap", f), F.lit(0.0))).alias("shap")
        ),
    )
    return rows.join(moved, "kind", "left").select(*keys, F.inline(own))
