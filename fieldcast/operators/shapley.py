"""Shapley values of forest predictions, computed where the rows are.

A fitted forest is a fixed list of leaves (at most ``trees x 2^depth``), each a path of conditions and a value.  What the
values need of the background or training rows are counts per leaf: how many rows show which pattern of fulfilled
conditions, or reach which step of the path.  They are added up over all rows in one Spark aggregation; leaves and
counts travel to the tasks, and the explained rows stay partitioned.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcast.operators import owen
from fieldcast.operators.models import _fit, each_fold
from fieldcast.session import cut, ensure_checkpoint_dir


@dataclass(frozen=True)
class Leaf:
    """One leaf: the conditions ``lower < x[feature] <= upper`` in the order of its path, and its share of the prediction.

    ``features`` are the distinct features of the path by first appearance, ``owner`` the place of each step's feature
    among them, ``low`` and ``high`` their joint bounds.
    """

    steps: np.ndarray
    lower: np.ndarray
    upper: np.ndarray
    value: float
    features: np.ndarray
    owner: np.ndarray
    low: np.ndarray
    high: np.ndarray


def leaf_of(path: Sequence[tuple[int, bool, float]], value: float) -> Leaf:
    """A leaf from ``(feature, left, threshold)`` steps; left means at most the threshold."""
    steps = np.array([j for j, _, _ in path], int)
    lower = np.array([-math.inf if left else t for _, left, t in path], float)
    upper = np.array([t if left else math.inf for _, left, t in path], float)
    features = np.array(list(dict.fromkeys(steps.tolist())), int)
    owner = np.array([features.tolist().index(j) for j in steps], int)
    low = np.array([lower[owner == k].max() for k in range(len(features))], float)
    high = np.array([upper[owner == k].min() for k in range(len(features))], float)
    return Leaf(steps, lower, upper, value, features, owner, low, high)


def forest_leaves(forest, spark: SparkSession | None = None) -> list[Leaf]:
    """All leaves of a fitted forest; the values of the leaves a row falls in add up to its prediction.

    They are read from the model's stored node table, by ``spark`` where the calling thread has no session of its own.  The prediction of a classifier is the probability of the
    positive class, so the value of its leaf is the share of positives there.
    """
    spark = spark or SparkSession.active()
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/forest-{uuid.uuid4()}"
    forest.write().session(spark).save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()  # trees x 2^(depth + 1) at most
    classes = hasattr(forest, "numClasses")
    trees: dict[int, dict[int, object]] = {}
    for node in nodes:
        trees.setdefault(node.treeID, {})[node.id] = node
    leaves: list[Leaf] = []
    for tree in trees.values():
        open_nodes: list[tuple[int, list]] = [(0, [])]
        while open_nodes:
            at, steps = open_nodes.pop()
            node = tree[at]
            if node.leftChild < 0:
                stats = node.impurityStats
                value = stats[1] / sum(stats) if classes else node.prediction
                leaves.append(leaf_of(steps, value / len(trees)))
                continue
            feature, threshold = node.split.featureIndex, node.split.leftCategoriesOrThreshold[0]
            open_nodes.append((node.rightChild, [*steps, (feature, False, threshold)]))
            open_nodes.append((node.leftChild, [*steps, (feature, True, threshold)]))
    return leaves


def _inside(x: np.ndarray, leaf: Leaf) -> np.ndarray:
    """Per row and distinct feature whether all the path's conditions on it hold."""
    part = x[:, leaf.features]
    return (part > leaf.low) & (part <= leaf.high)


def _fulfilled(x: np.ndarray, leaf: Leaf) -> np.ndarray:
    """Per row and step whether its condition holds."""
    part = x[:, leaf.steps]
    return (part > leaf.lower) & (part <= leaf.upper)


def _patterns(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows of a boolean matrix, the index of each row's pattern, and counts."""
    rows, index, counts = np.unique(inside, axis=0, return_inverse=True, return_counts=True)
    return rows, index.reshape(-1), counts


Counted = list[tuple[np.ndarray, np.ndarray]]


def pattern_counts(background: np.ndarray, leaves: Sequence[Leaf]) -> Counted:
    """Per leaf the patterns of fulfilled features among the rows, and how many rows show each."""
    out = []
    for leaf in leaves:
        rows, _, counts = _patterns(_inside(background, leaf))
        out.append((rows, counts))
    return out


def path_reach(training: np.ndarray, leaves: Sequence[Leaf]) -> list[np.ndarray]:
    """Per leaf how many rows arrive at each node of its path, the root first."""
    return [
        np.concatenate([[len(training)], np.logical_and.accumulate(_fulfilled(training, leaf), axis=1).sum(axis=0)])
        for leaf in leaves
    ]


def interventional(x: np.ndarray, counted: Counted, leaves: Sequence[Leaf], n_features: int) -> np.ndarray:
    """Shapley values against a background given by its pattern counts: exact, leaf by leaf.

    For one row, one background row and one leaf, only path features where exactly one of
    both lies inside matter; p come from the row and q from the background.  A feature of
    the row earns ``(p-1)! q! / (p+q)!`` of the leaf value, one of the background loses
    ``p! (q-1)! / (p+q)!``.  Rows with equal patterns share one computation, and all pairs of
    patterns of a leaf are computed at once.
    """
    out = np.zeros((len(x), n_features))
    fact = np.cumprod([1.0, *range(1, 64)])
    for leaf, (others, counts) in zip(leaves, counted):
        if not len(leaf.features):
            continue
        rows, index, _ = _patterns(_inside(x, leaf))
        mine, theirs = rows[:, None, :], others[None, :, :]
        weight = counts * (mine | theirs).all(axis=2)
        gain, loss = mine & ~theirs, theirs & ~mine
        p, q = gain.sum(axis=2), loss.sum(axis=2)
        earned = np.where(p > 0, weight * fact[np.maximum(p - 1, 0)] * fact[q] / fact[p + q], 0.0)
        lost = np.where(q > 0, weight * fact[p] * fact[np.maximum(q - 1, 0)] / fact[p + q], 0.0)
        phi = (gain * earned[:, :, None] - loss * lost[:, :, None]).sum(axis=1)
        out[:, leaf.features] += (phi * leaf.value / counts.sum())[index]
    return out


def path_dependent(x: np.ndarray, reach: Sequence[np.ndarray], leaves: Sequence[Leaf], n_features: int) -> np.ndarray:
    """Shapley values where a hidden feature follows the training rows down the tree.

    The share of a feature in a leaf is the product, over the path's splits on it, of the part of the rows at that node
    which go the leaf's way.
    """
    out = np.zeros((len(x), n_features))
    for leaf, covers in zip(leaves, reach):
        d = len(leaf.features)
        if not d:
            continue
        ways = np.divide(covers[1:], covers[:-1], out=np.zeros(len(covers) - 1), where=covers[:-1] > 0)
        share = np.array([ways[leaf.owner == k].prod() for k in range(d)])
        rows, index, _ = _patterns(_inside(x, leaf))
        known = rows.astype(float)
        phi = np.zeros_like(known)
        weight = np.array([math.factorial(s) * math.factorial(d - 1 - s) / math.factorial(d) for s in range(d)])
        for i in range(d):
            # Polynomial in the number of known features among the others.
            poly = np.zeros((len(rows), d))
            poly[:, 0] = 1.0
            for j in (k for k in range(d) if k != i):
                grown = poly * share[j]
                grown[:, 1:] += poly[:, :-1] * known[:, [j]]
                poly = grown
            phi[:, i] = (poly @ weight) * (known[:, i] - share[i])
        out[:, leaf.features] += (phi * leaf.value)[index]
    return out


def predict(x: np.ndarray, leaves: Sequence[Leaf]) -> np.ndarray:
    return sum(np.where(_inside(x, leaf).all(axis=1), leaf.value, 0.0) for leaf in leaves)


def _vectors(rows: DataFrame) -> DataFrame:
    return rows.select(vector_to_array("features").alias("x"))


def count_rows(rows: DataFrame, leaves: Sequence[Leaf]) -> tuple[Counted, list[np.ndarray]]:
    """Pattern counts and path covers of every leaf over all ``rows``, added up by Spark.

    A leaf has at most 2^depth patterns and ``depth`` nodes, whatever the number of rows.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            x = np.stack(frame["x"].to_numpy())
            found = []
            for k, (patterns, counts) in enumerate(pattern_counts(x, leaves)):
                found += [(k, "p", "".join("01"[int(b)] for b in row), int(c)) for row, c in zip(patterns, counts)]
            for k, covers in enumerate(path_reach(x, leaves)):
                found += [(k, "r", str(s), int(c)) for s, c in enumerate(covers)]
            yield pd.DataFrame(found, columns=["leaf", "part", "at", "n"])

    summed = _vectors(rows).mapInPandas(run, "leaf int, part string, at string, n long").groupBy("leaf", "part", "at").agg(F.sum("n").alias("n"))
    patterns: list[dict[str, int]] = [{} for _ in leaves]
    covers = [np.zeros(len(leaf.steps) + 1) for leaf in leaves]
    for leaf, part, at, n in summed.collect():
        if part == "p":
            patterns[leaf][at] = n
        else:
            covers[leaf][int(at)] = n
    counted = []
    for leaf, found in zip(leaves, patterns):
        keys = sorted(found)
        bits = np.array([[c == "1" for c in key] for key in keys], bool).reshape(len(keys), len(leaf.features))
        counted.append((bits, np.array([found[k] for k in keys])))
    return counted, covers


def _least_hashes(background: DataFrame, sample: int | None, seed: int) -> DataFrame:
    return background if sample is None else background.orderBy(F.xxhash64(F.lit(seed), "time")).limit(sample)


def explain_grouped(forest, rows: DataFrame, background: DataFrame, names: Sequence[str], sample: int | None = None,
                    seed: int = 7) -> DataFrame:
    """The same frame by Owen values: features that go together in the background enter coalitions together."""
    background = cut(_least_hashes(background, sample, seed).select("features"))
    leaves = owen.leaf_table(rows.sparkSession, forest_leaves(forest, rows.sparkSession))
    tree = owen.correlation_tree(background)
    vectors = rows.select("time", vector_to_array("features").alias("x"))
    return owen.owen_values(vectors, ["time"], _vectors(background), leaves, tree, names)


def explain(forest, rows: DataFrame, background: DataFrame, names: Sequence[str], use_background: bool = True,
            sample: int | None = None, seed: int = 7) -> DataFrame:
    """``(time, feature, shap)`` of each row, plus one ``expected_value`` row per time.

    All rows of ``background`` count, or the ``sample`` rows with the least hashes of their day if that is given.
    """
    background = _least_hashes(background, sample, seed)
    leaves, n = forest_leaves(forest, rows.sparkSession), len(names)
    counted, covers = count_rows(background, leaves)
    whole = [int(c[b.all(axis=1)].sum()) / c.sum() if len(c) else 0.0 for b, c in counted]
    expected = float(sum(leaf.value * share for leaf, share in zip(leaves, whole)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            x = np.stack(frame["x"].to_numpy())
            phi = interventional(x, counted, leaves, n) if use_background else path_dependent(x, covers, leaves, n)
            shap = np.column_stack([phi, np.full(len(x), expected)])
            yield pd.DataFrame(
                {
                    "time": np.repeat(frame["time"].to_numpy(), n + 1),
                    "feature": [*names, "expected_value"] * len(x),
                    "shap": shap.ravel(),
                }
            )

    vectors = rows.select("time", vector_to_array("features").alias("x"))
    return vectors.mapInPandas(run, "time date, feature string, shap double")


def compute_shaps(model, data: DataFrame, names: Sequence[str], n_folds: int, on_validation: bool = True,
                  use_background: bool = True, bg_from_training: bool = True, sample: str = "standard",
                  max_background: int | None = None) -> DataFrame:
    """Shapley values of the forest stage per fold: ``(fold, time, feature, shap)``.

    For a classifier they explain the probability of the positive class.  ``sample`` is ``standard``, ``negative`` for a
    background of non-events only, or ``correlation`` for Owen values over the tree of correlated features of the events,
    against those events.  ``max_background`` bounds the background rows, by default all count.
    """
    if sample not in ("standard", "negative", "correlation"):
        raise ValueError(f"no background is called {sample}")
    if sample == "correlation" and not use_background:
        raise ValueError("grouped features are hidden by rows of a background")

    def work(k: int, train: DataFrame, val: DataFrame) -> DataFrame:
        fitted = _fit(model, train, val, None)
        background = train if bg_from_training else val
        if sample == "negative":
            background = background.where(F.col("y") == 0)
        explained = val if on_validation else train
        if sample == "correlation":
            found = explain_grouped(fitted.forest, explained, background.where(F.col("y") == 1), names, max_background)
        else:
            found = explain(fitted.forest, explained, background, names, use_background, max_background)
        return found.select(F.lit(k).alias("fold"), "time", "feature", "shap")

    return each_fold(data, n_folds, work)
