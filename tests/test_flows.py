"""The whole chain on a small synthetic field with one known source of predictability."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldcast.operators import association as assoc
from fieldcast.operators import clustering, models, trends
from fieldcast.plans import flows
from fieldcast.sources import fields


@pytest.fixture(scope="module")
def world(spark):
    """Twenty cells over six years; the first ten lead the target by ten days."""
    rng = np.random.default_rng(13)
    n = 6 * 365
    signal = np.convolve(rng.normal(size=n + 40), np.ones(15) / 15, "same")[:n]
    start = dt.date(2001, 1, 1)
    dates = [start + dt.timedelta(days=i) for i in range(n)]
    season = 5 * np.sin(2 * np.pi * np.arange(n) / 365.25)
    rows = []
    for c in range(20):
        noise = rng.normal(scale=0.1, size=n)
        values = season + noise + (signal if c < 10 else 0)
        rows += [(c, d, float(v)) for d, v in zip(dates, values)]
    field = spark.createDataFrame(rows, "cell int, time date, value double")
    target = [(d, float(signal[max(0, i - 10)] + rng.normal(scale=0.05))) for i, d in enumerate(dates)]
    series = spark.createDataFrame(target, "time date, y double")
    points = spark.createDataFrame(
        [(c, 40.0 + c % 5, float(c // 5) + (30.0 if c >= 10 else 0.0)) for c in range(20)], "cell int, lat double, lon double"
    )
    return field, series, points


def test_known_source_is_found_clustered_and_used(spark, world, tmp_path):
    field, series, points = world
    anom = flows.anomalies(field).cache()
    found = flows.find_precursors(anom, series, [3], 3, [7], alpha=1e-4).cache()
    significant = found.where("lag = -10 and corr is not null").groupBy("cell").count().collect()
    assert {r.cell for r in significant if r["count"] == 3} == set(range(10))
    clustered = flows.cluster_precursors(found, points, settings={"standard": (3, 5, 0.0)}, min_points=8).cache()
    assert {r.cell for r in clustered.where("lag = -10 and fold = 0 and clustid is not null").collect()} <= set(range(10))
    features = flows.extract_features(anom, clustered, "sst", [3]).cache()
    assert features.where("metric = 'mean' and separation = -7").count() > 0
    table = flows.response_table(series, [3]).cache()
    model = models.Hybrid(greedy_base=True, n_estimators=5, max_depth=4, max_features=2)
    out = flows.forecast(features, table, 3, -7, 0.666, 3, model).cache()
    s = out.agg(F.avg((F.col("p") - F.col("y")) ** 2).alias("p"), F.avg((F.col("base") - F.col("y")) ** 2).alias("b"), F.count("*").alias("n")).first()
    assert s.n > 500 and s.p < 0.8 * s.b
    path = f"{tmp_path}/importance"
    small = models.Hybrid(greedy_base=True, n_estimators=2, max_depth=2, max_features=2)
    flows.importance_grid(features, table, [3], [-7], 0.666, 3, small, path, n_important=1, draws=2)
    kept = fields.read_importances(spark, path, 3, -7).cache()
    assert {"fold", "variable", "timeagg", "lag", "separation", "clustid", "metric", "respagg", "pass", "rank", "score"} <= set(kept.columns)
    assert {r.fold for r in kept.select("fold").distinct().collect()} == {0, 1, 2}
    assert kept.where("pass = 'multipass'").count() == 3 and kept.where("lag <> -10 or timeagg <> 3").count() == 0


def test_centroids_separate_two_patches(spark, world):
    out = clustering.centroid_clusters(world[2], [2]).collect()
    sides = {r.cell < 10: set() for r in out}
    for r in out:
        sides[r.cell < 10].add(r.clustid)
    assert all(len(v) == 1 for v in sides.values())


def test_trend_lines():
    x = np.repeat(np.arange(20.0), 10)
    rng = np.random.default_rng(14)
    y = 2 * x + rng.normal(size=len(x))
    y[::50] += 100
    assert np.abs(trends.local_regression(x, y) - 2 * x).max() < 2
    line = trends.quantile_line(x, 3 * x + rng.normal(size=len(x)), 0.8)
    assert 0.75 < np.mean(3 * x + rng.normal(size=len(x)) <= line) < 0.85


def test_loess_detrend_runs_per_cell(spark, world):
    few = world[0].where("cell < 2 and month(time) = 7")
    out = trends.loess_detrend(few, robust_steps=2)
    assert out.count() == few.count()


def test_features_are_never_selected_on_their_validation_years(spark):
    """Six years, three folds: a cell that leads the target only in two years must not pass for the fold that holds them out."""
    rng = np.random.default_rng(21)
    start, n = dt.date(2001, 1, 1), 6 * 365
    dates = [start + dt.timedelta(days=i) for i in range(n)]
    target = np.convolve(rng.normal(size=n + 40), np.ones(9) / 9, "same")[:n]
    rows = []
    for held, years in enumerate(((2001, 2002), (2003, 2004), (2005, 2006))):
        lead = np.roll(target, -10)
        for copy in range(4):
            noise = rng.normal(scale=1.0, size=n)
            rows += [(held * 4 + copy, d, float(lead[i] if d.year in years else noise[i] * 0.3)) for i, d in enumerate(dates)]
    field = spark.createDataFrame(rows, "cell int, time date, value double")
    series = spark.createDataFrame([(d, float(v)) for d, v in zip(dates, target)], "time date, y double")
    response = assoc.prepare_response(series)
    found = assoc.masked(assoc.associate(field, response, [-10], n_folds=3), 1e-3).where("corr is not null")
    kept = {(r.fold, r.cell // 4) for r in found.collect()}
    assert all((k, k) not in kept for k in range(3)) and len(kept) == 6
    # The model that takes the features of field fold k validates on the years they were selected without.
    bounds = {r.fieldfold: (r.valstart.year, r.valend.year) for r in flows.fold_training_years(response, 3).collect()}
    assert bounds == {0: (2001, 2002), 1: (2003, 2004), 2: (2005, 2006)}
