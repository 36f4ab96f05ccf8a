"""Owen values against the mean over all orders that keep groups together."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from fieldcast.operators import owen, shapley

NAMES = ["a", "b", "c", "d", "e"]


def random_leaves(rng, n, depth, path=()):
    """A tree with splits at random; a feature may return on a path."""
    if depth == 0 or (path and rng.random() < 0.2):
        return [shapley.leaf_of(path, float(rng.normal()))]
    feature, at = int(rng.integers(n)), float(rng.normal(scale=0.7))
    return [leaf for left in (True, False) for leaf in random_leaves(rng, n, depth - 1, (*path, (feature, left, at)))]


def turns(tree):
    """All orders of the features in which those below a node stand side by side."""
    if not isinstance(tree, tuple):
        return [(tree,)]
    return [
        tuple(itertools.chain(*chosen)) for order in itertools.permutations(tree)
        for chosen in itertools.product(*[turns(child) for child in order])
    ]


def brute(tree, one, rows, leaves):
    def value(known):
        both = rows.copy()
        both[:, known] = one[known]
        return shapley.predict(both, leaves).mean()

    out, orders = np.zeros(len(one)), turns(tree)
    for order in orders:
        for at, feature in enumerate(order):
            out[feature] += value(list(order[: at + 1])) - value(list(order[:at]))
    return out / len(orders)


def frame(spark, x, keyed=True):
    rows = [(k, [None if v is None else float(v) for v in row]) for k, row in enumerate(x)]
    out = spark.createDataFrame(rows, "id int, x array<double>")
    return out if keyed else out.select("x")


def values(found):
    table = {}
    for r in found.collect():
        assert r.feature not in table.setdefault(r.id, {})
        table[r.id][r.feature] = r.shap
    return table


@pytest.mark.parametrize("tree", [(0, 1, 2, 3, 4), ((0, 3), (1, 4), 2), ((((0, 1), 2), 3), 4), (((4, 0, 2), 1), 3)])
def test_equals_the_mean_over_allowed_orders(spark, tree):
    rng = np.random.default_rng(len(str(tree)))
    rows, x = rng.normal(size=(60, 5)), rng.normal(size=(6, 5))
    leaves = random_leaves(rng, 5, 4) + random_leaves(rng, 5, 3)
    table = owen.leaf_table(spark, leaves)
    found = values(owen.owen_values(frame(spark, x), ["id"], frame(spark, rows, False), table, tree, NAMES))
    for k, one in enumerate(x):
        wanted = brute(tree, one, rows, leaves)
        assert [found[k][n] for n in NAMES] == pytest.approx(wanted, abs=1e-9)
        assert sum(found[k].values()) == pytest.approx(shapley.predict(x[[k]], leaves)[0], abs=1e-9)
    if tree == tuple(range(5)):
        flat = shapley.interventional(x, shapley.pattern_counts(rows, leaves), leaves, 5)
        assert [[found[k][n] for n in NAMES] for k in range(len(x))] == [pytest.approx(one, abs=1e-9) for one in flat]


def test_odd_rows(spark):
    leaves = [shapley.leaf_of([(0, True, 0.0)], 1.0), shapley.leaf_of([(0, False, 0.0)], 3.0), shapley.leaf_of([], 10.0)]
    table = owen.leaf_table(spark, leaves)
    x = [[-1.0, 0.0], [None, 1.0], [math.nan, 1.0], [5.0, None]]
    found = values(owen.owen_values(frame(spark, x), ["id"], frame(spark, [[-1.0, 0], [2.0, 0], [2.0, 9.0]], False), table, (0, 1), ["a", "b"]))
    mean = 10 + 7 / 3
    assert all(v["expected_value"] == pytest.approx(mean) and v["b"] == 0 for v in found.values())
    # A row without the feature falls in no leaf that asks for it.
    assert [found[k]["a"] + mean for k in range(4)] == pytest.approx([11.0, 10.0, 10.0, 13.0])
    empty = owen.owen_values(frame(spark, x).limit(0), ["id"], frame(spark, x, False), table, (0, 1), ["a", "b"])
    assert empty.count() == 0
    with pytest.raises(ValueError):
        owen.owen_values(frame(spark, x), ["id"], frame(spark, x, False).limit(0), table, (0, 1), ["a", "b"])
    with pytest.raises(ValueError):
        owen.owen_values(frame(spark, x), ["id"], frame(spark, x, False), table, (0, 0), ["a", "b"])


def test_related_features_share_a_branch(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 2))
    x = np.column_stack([base[:, 0], base[:, 1], base[:, 0] + 0.1 * rng.normal(size=300), np.ones(300), base[:, 1] + 0.2 * rng.normal(size=300)])
    tree = owen.correlation_tree(frame(spark, x).select(array_to_vector(F.col("x")).alias("features")))
    branches, open_nodes = [], [tree]
    while open_nodes:
        node = open_nodes.pop()
        if isinstance(node, tuple):
            branches.append(sorted(owen.features_of(node)))
            open_nodes += node
    assert [0, 2] in branches and [1, 4] in branches and [0, 1, 2, 3, 4] in branches


def test_rows_of_one_kind_are_worked_off_once(spark):
    """Rows between the same limits share a kind, however many; NULL, NaN and infinities have kinds of their own."""
    leaves = [shapley.leaf_of(((0, left, 1.0), (1, side, 5.0)), 1.0 + left + 2 * side) for left in (True, False) for side in (True, False)]
    table = owen.leaf_table(spark, leaves)
    x = np.random.default_rng(5).normal(size=(3000, 2)) * 6
    kinds = owen.with_kind(frame(spark, x), table)
    assert kinds.select("kind").distinct().count() == 4
    assert owen.patterns(kinds.dropDuplicates(["kind"]), ["kind"], table).count() == 4 * len(leaves)
    odd = [[None, 0.0], [math.nan, 0.0], [math.inf, 0.0], [-math.inf, 0.0], [1.0, 0.0], [1.5, 0.0]]
    masks = owen.patterns(owen.with_kind(frame(spark, odd), table), ["kind"], table).collect()
    shown = {}
    for r in masks:
        shown.setdefault((tuple(r.kind), r.leaf), set()).add(r.mask)
    assert all(len(found) == 1 for found in shown.values())
