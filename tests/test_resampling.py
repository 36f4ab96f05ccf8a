"""The counter-based bootstrap against plain Python, and weighted Kendall tau against all pairs."""

import datetime as dt
import math
import time

import numpy as np
import pytest

from fieldcast.functions import stats
from fieldcast.operators import resampling, verification


def mixed(x):
    for shift, factor in resampling.MIXERS:
        x = ((x ^ (x >> shift)) * factor) & resampling.MASK
    return x ^ (x >> 15)


def block_of(draw, position, n, seed):
    start = (draw * resampling.DRAW_STEP + seed) & resampling.MASK
    first = mixed((mixed(start) + position * resampling.POSITION_STEP) & resampling.MASK)
    return (mixed(first ^ mixed(start ^ resampling.SECOND)) * n) >> 31


def series(spark, n, keys=1):
    rng = np.random.default_rng(4)
    rows = [(k, dt.date(2000, 1, 1) + dt.timedelta(days=3 * i), *map(float, rng.normal(size=2))) for k in range(keys) for i in range(n + k)]
    return rows, spark.createDataFrame(rows, "k int, time date, x double, y double").repartition(5)


def test_draws_are_those_of_the_hash(spark):
    rows, df = series(spark, 23, keys=2)
    found = {(r.k, r.blocksize, r.draw): r.stat for r in resampling.bootstrap(df, ["x", "y"], resampling.PEARSON, 40, (None, 4, 50), ["k"], seed=3).collect()}
    assert len(found) == 2 * 3 * 40
    for (k, size, draw), stat in found.items():
        own = np.array([r[2:] for r in rows if r[0] == k])
        blocks = [own[i : i + (size or 1)] for i in range(0, len(own), size or 1)]
        taken = np.concatenate([blocks[block_of(draw, p, len(blocks), 3)] for p in range(len(blocks))])
        assert stat == pytest.approx(np.corrcoef(taken.T)[0, 1], abs=1e-9)


def test_blocks_are_drawn_evenly():
    n, draws = 50, 4000
    counts = np.zeros((draws, n))
    for d in range(draws):
        for p in range(n):
            counts[d, block_of(d, p, n, 7)] += 1
    expected = draws * n / n
    assert np.abs(counts.sum(axis=0) - expected).max() < 5 * math.sqrt(expected)
    assert counts.var() == pytest.approx(1 - 1 / n, rel=0.03)  # of a multinomial with one expected
    assert abs(np.corrcoef(counts[:-1].ravel(), counts[1:].ravel())[0, 1]) < 0.02


def test_constant_series_have_no_correlation(spark):
    rows = [(dt.date(2001, 1, 1 + i), 1.0, float(i)) for i in range(9)]
    df = spark.createDataFrame(rows, "time date, x double, y double")
    draws = verification.bootstrap(df, ["x", "y"], verification.pearson_statistic, 5)
    assert draws.count() == 5 and draws.where("stat is not null").count() == 0
    assert verification.bootstrap(df.limit(0), ["x", "y"], verification.pearson_statistic, 5).count() == 0
    with pytest.raises(Exception, match="one row per day"):
        verification.bootstrap(df.union(df), ["x", "y"], verification.pearson_statistic, 5).count()


def all_pairs(x, y, w):
    xy = xx = yy = 0.0
    for i in range(len(x) - 1):
        a, b, pair = np.sign(x[i] - x[i + 1 :]), np.sign(y[i] - y[i + 1 :]), w[i] + w[i + 1 :]
        xy, xx, yy = xy + (a * b * pair).sum(), xx + (a * a * pair).sum(), yy + (b * b * pair).sum()
    return xy / math.sqrt(xx * yy) if xx > 0 and yy > 0 else math.nan


def test_weighted_tau_equals_all_pairs():
    rng = np.random.default_rng(8)
    for n in (1, 2, 3, 17, 120):
        for ties in (1, 3, 1000):
            x, y = rng.integers(0, ties, n).astype(float), rng.integers(0, ties, n).astype(float)
            rank = rng.permutation(n).astype(float)
            assert stats.weighted_tau(x, y, rank) == pytest.approx(all_pairs(x, y, 1 / (rank + 1)), abs=1e-12, nan_ok=True)
    x, y = rng.normal(size=3000), rng.normal(size=3000)
    start = time.perf_counter()
    wanted = all_pairs(x, y, 1 / (np.arange(3000.0) + 1))
    middle = time.perf_counter()
    assert stats.weighted_tau(x, y, np.arange(3000.0)) == pytest.approx(wanted, abs=1e-12)
    assert (time.perf_counter() - middle) * 3 < middle - start
