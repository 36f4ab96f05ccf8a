"""The set-similarity join against all pairs."""

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldcast.operators import distances, similarity, tiles

ORIGIN = dt.date(1990, 1, 1)


def marked(spark, sets):
    """Every cell has a day without an event too; NULL is none."""
    rows = [(k, ORIGIN + dt.timedelta(days=int(day)), True) for k, days in sets.items() for day in days]
    rows += [(k, ORIGIN - dt.timedelta(days=1 + k % 3), None if k % 2 else False) for k in sets]
    return spark.createDataFrame(rows, "cell int, time date, y boolean")


def families(rng, n, size=4, days=40):
    """``n`` bases over days of their own, each with copies a few days apart."""
    out = {}
    for f in range(n):
        base = rng.choice(2000, days, replace=False) + 2000 * (f % 8)
        for k in range(size):
            kept = base[rng.random(days) > 0.04 * k]
            out[f * size + k] = set(kept.tolist()) | {int(v) for v in rng.choice(2000, k)}
    return out


def near(sets, max_dist):
    out = {}
    for (i, a), (j, b) in itertools.combinations(sorted(sets.items()), 2):
        dist = 1 - len(a & b) / len(a | b) if a | b else 0.0
        if dist <= max_dist:
            out[i, j] = dist
    return out


@pytest.mark.parametrize("max_dist", [0.0, 0.2, 0.5, 0.75, 0.96])
def test_no_pair_is_lost(spark, max_dist, monkeypatch):
    monkeypatch.setattr(similarity, "LIST", 3)  # lists are dealt over tasks
    rng = np.random.default_rng(8)
    sets = families(rng, 6)
    n = len(sets)
    sets |= {n: set(), n + 1: set(), n + 2: set(sets[0]), n + 3: set(sets[0]), n + 4: {5}, n + 5: {5, 6}, n + 6: set(range(500))}
    sets |= {n + 7 + k: set(rng.choice(12, rng.integers(1, 8), replace=False).tolist()) for k in range(12)}
    found = distances.jaccard_distances(marked(spark, sets), max_dist=max_dist).collect()
    assert len({(r.i, r.j) for r in found}) == len(found)
    assert {(r.i, r.j): r.dist for r in found} == pytest.approx(near(sets, max_dist), abs=1e-12)


def test_equal_sets_take_part_once(spark):
    sets = {k: {1, 2, 3} for k in range(300)} | {300: {1, 2, 3, 4}, 301: set(), 302: set()}
    pairs, members = similarity.similar_sets(marked(spark, sets), 0.5)
    assert [(r.i, r.j, r.dist) for r in pairs.collect()] == [(0, 300, 0.25)]
    roots = {r.cell: r.root for r in members.collect()}
    assert roots == {k: 0 for k in range(300)} | {300: 300, 301: 301, 302: 301}


def test_unrelated_halves_add_up(spark):
    """Twice the families cost twice the candidates, not four times; all pairs would be over 25 times as many."""
    rng, counts = np.random.default_rng(4), []
    for n in (40, 80):
        sets = families(rng, n)
        packed = similarity.day_sets(marked(spark, sets))
        counts.append((similarity.candidate_pairs(packed, 0.4).count(), len(near(sets, 0.4)), len(sets) * (len(sets) - 1) // 2))
    print("candidates, results, all pairs:", counts)
    assert counts[1][0] < 2.5 * counts[0][0]
    assert counts[1][0] * 25 < counts[1][2]
    assert all(found <= candidates for candidates, found, _ in counts)


def test_bounds_and_empty_tables(spark):
    none = marked(spark, {0: {1}}).limit(0)
    assert distances.jaccard_distances(none, max_dist=0.5).count() == 0
    for wrong in (-0.1, 1.0):
        with pytest.raises(ValueError):
            similarity.root_pairs(similarity.day_sets(none), wrong)


@pytest.mark.parametrize("max_dist", [0.0, 0.3, 0.65, 0.96])
def test_common_days_are_compared_in_tiles(spark, monkeypatch, max_dist):
    """With a quarter of 90 days each, cells meet nearly all others; nothing but near pairs is written."""
    monkeypatch.setattr(similarity, "MEETINGS", -1)
    monkeypatch.setattr(tiles, "LEAST", 9)
    monkeypatch.setattr(similarity, "candidate_pairs", None)  # the index is not asked
    rng = np.random.default_rng(3)
    sets = {k: set(rng.choice(90, 22, replace=False).tolist()) for k in range(40)}
    sets |= {40 + k: (sets[k] | {91 + k}) - {min(sets[k])} for k in range(10)} | {50: set(), 51: set(), 52: set(sets[3])}
    found = distances.jaccard_distances(marked(spark, sets), max_dist=max_dist).collect()
    assert len({(r.i, r.j) for r in found}) == len(found)
    assert {(r.i, r.j): r.dist for r in found} == pytest.approx(near(sets, max_dist), abs=1e-12)


def test_crowded_cubes_are_dealt_over_parts(spark, monkeypatch):
    """A dense field around the pole and the date line: every pair once, with cubes asked by far more points than a part takes."""
    monkeypatch.setattr(distances, "LIST", 5)
    rng = np.random.default_rng(11)
    places = [(k, f, float(rng.uniform(70, 90)), float(rng.uniform(-180, 180))) for f in (0, 1) for k in range(60)]
    places += [(60 + k, 0, 80.0, 179.9 - 359.8 * (k % 2)) for k in range(6)]
    points = spark.createDataFrame(places, "cell int, fold int, lat double, lon double")
    monkeypatch.setattr(distances, "PAIRS", 200)
    near = distances.neighbours(points, 900.0, ["fold"])
    assert near.select(F.spark_partition_id()).distinct().count() > 4  # not one task, as the few bytes would make it
    found = [((r.fold, r.i, r.j), r.km) for r in near.collect()]
    want = {}
    for (i, f, a, x), (j, g, b, y) in itertools.combinations(sorted(places, key=lambda p: (p[1], p[0])), 2):
        h = np.sin(np.radians(a - b) / 2) ** 2 + np.cos(np.radians(a)) * np.cos(np.radians(b)) * np.sin(np.radians(x - y) / 2) ** 2
        km = 2 * 6371.0088 * np.arcsin(np.sqrt(min(1.0, h)))
        if f == g and km <= 900:
            want[f, i, j] = km
    assert len(found) == len(dict(found))
    assert dict(found) == pytest.approx(want, abs=1e-6)
