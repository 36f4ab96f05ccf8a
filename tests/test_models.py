"""Model stages on a small synthetic training frame."""

import datetime as dt
import itertools
import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from fieldcast.operators import models, shapley

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(12)
    rows = []
    for year in range(1990, 1998):
        for day in range(60):
            x = rng.normal(size=3)
            p = 1 / (1 + np.exp(-(1.5 * x[0] + 0.15 * (year - 1994))))
            rows.append((dt.date(year, 6, 1) + dt.timedelta(days=day), float(rng.random() < p), [float(v) for v in x], (year - 1990) // 2))
    df = spark.createDataFrame(rows, "time date, y double, x array<double>, fold int")
    return df.select("time", "y", array_to_vector("x").alias("features"), "fold").cache()


def test_base_rate_solves_the_penalised_likelihood(data):
    fit = models.BaseRate(C=1.0).fit(data)
    rows = data.select("time", "y").collect()
    j = np.array([r.time.toordinal() for r in rows], float)
    z, y = (j - j.mean()) / j.std(), np.array([r.y for r in rows])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(w[0] + w[1] * z)))
        grad = np.array([(p - y).sum(), ((p - y) * z).sum() + w[1]])
        h = p * (1 - p)
        hess = np.array([[h.sum(), (h * z).sum()], [(h * z).sum(), (h * z * z).sum() + 1]])
        w -= np.linalg.solve(hess, grad)
    assert (fit.intercept, fit.slope) == pytest.approx(tuple(w), abs=1e-4)
    assert not fit.negative_trend


def test_bases_of_all_folds_are_fitted_together(data):
    together = models.fold_bases(models.Hybrid(base=models.BaseRate(C=0.2)), data, 4)
    for k in range(4):
        alone = models.BaseRate(C=0.2).fit(data.where(F.col("fold") != k))
        assert (together[k].mean, together[k].scale, together[k].slope, together[k].intercept) == pytest.approx(
            (alone.mean, alone.scale, alone.slope, alone.intercept), abs=1e-8
        )
    assert len({round(b.slope, 6) for b in together.values()}) == 4
    greedy = models.fold_bases(models.Hybrid(greedy_base=True), data, 4)
    assert set(greedy.values()) == {models.BaseRate().fit(data)}
    assert models.fold_bases(models.Hybrid(), data, 4, "oversample") == {} == models.fold_bases(models.Classifier(), data, 4)


def test_base_rate_of_odd_rows(data):
    for y in (0.0, 1.0):
        same = models.BaseRate().fit(data.withColumn("y", F.lit(y)))
        assert data.select(same.predict().alias("p")).distinct().first().p == y
    one_day = data.where(F.col("time") == dt.date(1990, 6, 1)).select("time", "features", "fold")
    both = one_day.withColumn("y", F.explode(F.array(F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(None).cast("double"))))
    flat = models.BaseRate().fit(both)
    assert flat.slope == 0 and flat.intercept == pytest.approx(np.log(2), abs=1e-9)
    steep = data.withColumn("y", (F.year("time") >= 1994).cast("double"))  # told apart by the day alone
    assert models.BaseRate(C=100.0).fit(steep).slope > 5
    with pytest.raises(ValueError):
        models.BaseRate().fit(data.limit(0))


def test_hybrid_beats_its_base_and_stays_in_range(data):
    model = models.Hybrid(n_estimators=20, max_depth=4, max_features=3)
    out = models.fit_predict(model, data, 4).cache()
    assert out.count() == data.count()
    s = out.agg(
        F.avg((F.col("p") - F.col("y")) ** 2), F.avg((F.col("base") - F.col("y")) ** 2), F.min("p"), F.max("p")
    ).first()
    assert s[0] < s[1] and s[2] >= 0 and s[3] <= 1


def brute_shapley(value, d):
    """From the definition, over all subsets of d features."""
    out = []
    for i in range(d):
        rest, phi = [j for j in range(d) if j != i], 0.0
        for size in range(d):
            for subset in itertools.combinations(rest, size):
                w = math.factorial(size) * math.factorial(d - size - 1) / math.factorial(d)
                phi += w * (value({*subset, i}) - value(set(subset)))
        out.append(phi)
    return out


def conditional(tree, x, known, rows):
    """Prediction of a nested tree (feature, threshold, left, right) where unknown features follow ``rows``."""
    if not isinstance(tree, tuple):
        return tree
    feature, threshold, left, right = tree
    goes = rows[:, feature] <= threshold
    if feature in known:
        return conditional(left, x, known, rows[goes]) if x[feature] <= threshold else conditional(right, x, known, rows[~goes])
    share = goes.mean() if len(rows) else 0.0
    return share * conditional(left, x, known, rows[goes]) + (1 - share) * conditional(right, x, known, rows[~goes])


def leaves_of(tree, path=()):
    if not isinstance(tree, tuple):
        return [shapley.leaf_of(path, tree)]
    feature, threshold, left, right = tree
    return leaves_of(left, (*path, (feature, True, threshold))) + leaves_of(right, (*path, (feature, False, threshold)))


def test_shap_of_a_given_tree_on_dependent_inputs():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(400, 3))
    rows[:, 0] = 0.8 * rows[:, 1] + 0.6 * rows[:, 0]
    tree = (2, 0.1, (1, 0.0, (0, -0.3, 1.0, 4.0), (2, -0.8, 2.5, -1.0)), (1, 0.4, (0, 0.6, 3.0, 0.5), 7.0))  # not in the order of numbers
    leaves = leaves_of(tree)
    x = rng.normal(size=(20, 3))
    dependent = shapley.path_dependent(x, shapley.path_reach(rows, leaves), leaves, 3)
    against = shapley.interventional(x, shapley.pattern_counts(rows, leaves), leaves, 3)
    for i, one in enumerate(x):
        assert dependent[i] == pytest.approx(brute_shapley(lambda known: conditional(tree, one, known, rows), 3), abs=1e-9)

        def mixed(known, one=one):
            both = rows.copy()
            both[:, sorted(known)] = one[sorted(known)]
            return shapley.predict(both, leaves).mean()

        assert against[i] == pytest.approx(brute_shapley(mixed, 3), abs=1e-9)


@pytest.mark.parametrize("kind", ["hybrid", "classifier"])
def test_shap_explains_what_the_model_predicts(data, kind):
    model = (models.Hybrid if kind == "hybrid" else models.Classifier)(n_estimators=5, max_depth=3, max_features=3).fit(data)
    predicted = {r.time: r["_anom"] if kind == "hybrid" else r["p"] for r in (model.forest.transform(data) if kind == "hybrid" else model.predict(data)).collect()}
    leaves = shapley.forest_leaves(model.forest)
    every = np.array([r.features.toArray() for r in data.select("features").collect()])
    counted, covers = shapley.count_rows(data, leaves)
    for (bits, n), (own_bits, own_n) in zip(counted, shapley.pattern_counts(every, leaves)):
        assert sorted(zip(bits.tolist(), n.tolist())) == sorted(zip(own_bits.tolist(), own_n.tolist()))
    assert all((a == b).all() for a, b in zip(covers, shapley.path_reach(every, leaves)))
    for use_background in (True, False):
        total = shapley.explain(model.forest, data, data, NAMES, use_background).groupBy("time").agg(F.sum("shap").alias("s"))
        assert all(r.s == pytest.approx(predicted[r.time], abs=1e-9) for r in total.collect())


def test_informative_feature_is_most_important(data):
    model = models.Hybrid(n_estimators=10, max_depth=4, max_features=3)
    two = data.withColumn("fold", F.col("fold") % 2)
    out = models.permutation_importance(model, two, NAMES, 2, n_important=2, draws=3).cache()
    best = out.where("pass = 'singlepass' and rank = 0").select("feature").distinct().collect()
    assert [r.feature for r in best] == ["a"]
    assert out.where("pass = 'multipass'").count() == 4


def test_balancing_reaches_even_classes(data):
    skewed = data.where((F.col("y") == 0) | (F.dayofmonth("time") <= 10))
    for how in ("oversample", "undersample"):
        share = models.balance(skewed, how).agg(F.avg("y")).first()[0]
        assert share == pytest.approx(0.5, abs=0.08)


def test_too_deep_trees_are_refused(data):
    with pytest.raises(ValueError):
        replace(models.Hybrid(n_estimators=1, max_depth=31, max_features=3)).fit(data)
    deep = replace(models.Hybrid(n_estimators=1, max_depth=30, max_features=3)).fit(data)
    depth, nodes, leaves = models.forest_properties(deep.forest)
    assert depth <= 30 and nodes == 2 * leaves - 1


def test_grouped_background_explains_the_model_against_events(data):
    model = models.Classifier(n_estimators=4, max_depth=3, max_features=3)
    two = data.withColumn("fold", F.col("fold") % 2)
    out = shapley.compute_shaps(model, two, NAMES, 2, sample="correlation").cache()
    assert out.count() == two.count() * (len(NAMES) + 1)
    fitted = model.fit(two.where("fold <> 0"))
    events = two.where("fold <> 0 and y = 1")
    expected = fitted.predict(events).agg(F.avg("p")).first()[0]
    found = out.where("fold = 0 and feature = 'expected_value'").agg(F.min("shap"), F.max("shap")).first()
    assert found[0] == pytest.approx(expected, abs=1e-9) and found[1] == pytest.approx(expected, abs=1e-9)
    sums = out.where("fold = 0").groupBy("time").agg(F.sum("shap").alias("s"))
    predicted = fitted.predict(two.where("fold = 0")).select("time", "p")
    assert all(r.s == pytest.approx(r.p, abs=1e-9) for r in sums.join(predicted, "time").collect())
    with pytest.raises(ValueError):
        shapley.compute_shaps(model, two, NAMES, 2, sample="other")
