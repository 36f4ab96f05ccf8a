"""The join of correlated series against the whole matrix."""

import datetime as dt
import itertools
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldcast import session
from fieldcast.operators import distances, seriesjoin, tiles
from fieldcast.plans import queries

ORIGIN = dt.date(2001, 1, 1)


def field(spark, series):
    rows = [(k, ORIGIN + dt.timedelta(days=t), float(v)) for k, one in series.items() for t, v in enumerate(one) if v is not None]
    return spark.createDataFrame(rows, "cell int, time date, value double")


def waves(rng, groups, size, days=400, noise=0.25):
    """Groups of series around a slow wave of their own."""
    t, out = np.arange(days), {}
    for g in range(groups):
        base = sum(rng.normal() * np.cos(2 * np.pi * m * t / days + rng.uniform(0, 6.28)) for m in (1, 2, 3, 5))
        for k in range(size):
            out[g * size + k] = list(base + noise * rng.normal(size=days))
    return out


@pytest.mark.parametrize("max_dist,length", [(0.02, 2048), (0.3, 2), (0.9, 5)])
def test_same_pairs_as_the_matrix(spark, monkeypatch, max_dist, length):
    monkeypatch.setattr(seriesjoin, "LIST", length)  # crowded cubes are dealt over tasks
    rng = np.random.default_rng(2)
    series = waves(rng, 5, 3)
    series[15] = [None if rng.random() < 0.3 else v for v in series[0]]  # gaps
    series[16] = [None] * 150 + series[3][150:]  # a later start
    series[17] = series[6][4:] + series[6][:4]  # four days early
    series[18], series[19] = [7.0] * 400, [None] * 399 + [3.0]  # nothing to correlate
    series[20] = list(series[4])
    rows = field(spark, series)
    every = {(r.i, r.j): r.dist for r in distances.max_correlation_distances(rows, [-4, 0, 4]).collect()}
    near = {k: v for k, v in every.items() if v is not None and v <= max_dist}
    found = distances.max_correlation_distances(rows, [-4, 0, 4], max_dist=max_dist).collect()
    assert len({(r.i, r.j) for r in found}) == len(found)
    assert {(r.i, r.j): r.dist for r in found} == pytest.approx(near, abs=1e-9)
    assert len(near) >= 2  # the copy and the early one at the least


def test_waves_leave_few_candidates(spark):
    rng = np.random.default_rng(6)
    counts = []
    for groups in (20, 40):
        packed = seriesjoin.packed_series(seriesjoin.unit_series(field(spark, waves(rng, groups, 3)), [0]))
        n = 3 * groups
        counts.append((seriesjoin.candidate_series(packed, 0.1).count(), n * (n - 1) // 2))
    print("candidates, all pairs:", counts)
    assert all(found >= 3 * groups for (found, _), groups in zip(counts, (20, 40)))
    assert all(found * 8 < pairs for found, pairs in counts)


def test_empty_and_constant_fields(spark):
    for series in ({}, {0: [None] * 3, 1: [None] * 3}, {0: [1.0] * 9, 1: [2.0] * 9}):
        assert distances.max_correlation_distances(field(spark, series), [0], max_dist=0.5).count() == 0


@pytest.mark.parametrize("max_dist", [0.02, 0.4, 0.9])
def test_noise_is_compared_in_tiles(spark, monkeypatch, max_dist):
    """Sums over runs of noise, as neighbours of the supplier field are: waves tell nothing apart, and tiles lose no pair."""
    monkeypatch.setattr(seriesjoin, "candidate_series", None)  # the cubes are not asked
    monkeypatch.setattr(seriesjoin, "BLOCK", 4)
    monkeypatch.setattr(tiles, "LEAST", 7)
    rng = np.random.default_rng(7)
    noise = rng.integers(0, 10**6, (30, 300)).astype(float)
    series = {k: list(noise[k : k + 5].sum(0)) for k in range(20)}
    series |= {20: list(series[3]), 21: list(series[3]), 22: series[8][4:] + [None] * 4, 23: [None] * 2 + [v if rng.random() < 0.7 else None for v in series[9][2:]]}
    series |= {24: [7.0] * 300, 25: [None] * 299 + [3.0], 26: [5.0] * 299 + [9.0], 27: [None] * 297 + [1.0, 2.0, 9.0]}
    rows = field(spark, series)
    every = {(r.i, r.j): r.dist for r in distances.max_correlation_distances(rows, [-4, 0, 4]).collect()}
    near = {k: v for k, v in every.items() if v is not None and v <= max_dist}
    found = seriesjoin.tiled_join(rows, [-4, 0, 4], max_dist).collect()
    assert len({(r.i, r.j) for r in found}) == len(found)
    assert {(r.i, r.j): r.dist for r in found} == pytest.approx(near, abs=1e-9)
    assert len(near) >= 4


def test_noise_goes_by_tiles_and_waves_by_cubes(spark):
    rng = np.random.default_rng(1)
    noise = {k: list(rng.normal(size=300)) for k in range(12)}
    assert not seriesjoin.waves_tell_apart(field(spark, noise), [-4, 0, 4], 0.4)
    assert seriesjoin.waves_tell_apart(field(spark, waves(rng, 20, 2, noise=0.02)), [0], 0.02)


def on_disk(spark):
    """Sizes of the written tables and of the shuffles of this machine's block manager."""
    session.ensure_checkpoint_dir(spark)
    jvm = spark.sparkContext._jvm
    blocks = [d.getPath() for d in jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    folders = [spark.sparkContext.getCheckpointDir().removeprefix("file:"), *blocks]
    return {f: f.stat().st_size for d in folders for f in Path(d).rglob("*") if f.is_file() and not f.name.startswith("broadcast")}


def test_disk_follows_the_field_not_the_ranges(spark, monkeypatch):
    """The series are written once, in few bytes, and a row is not sent to every range: no more than 8 bytes a value in all."""
    monkeypatch.setattr(tiles, "MOST", 40)
    monkeypatch.setattr(seriesjoin, "SOME", 8)  # the trial is a fixed share
    cells, days = 800, 500
    value = F.pmod(F.xxhash64("id"), F.lit(10**8))
    time = F.date_add(F.lit(ORIGIN), (F.col("id") % days).cast("int"))
    rows = spark.range(cells * days).select((F.col("id") / days).cast("int").alias("cell"), time.alias("time"), value.alias("value"))
    before = on_disk(spark)
    assert seriesjoin.correlation_join(rows, [-4, 0, 4], 0.4).count() == 0
    written = sum(size for f, size in on_disk(spark).items() if f not in before)
    print("bytes a value:", written / (cells * days))
    assert written < 8 * cells * days


@pytest.mark.parametrize("cell_type", ["int", "string"])
def test_pieces_hold_the_field(spark, monkeypatch, cell_type):
    """Rows of a cell that lie apart, without a cell, a value or a day, come back as they were; repeated days too."""
    rng = np.random.default_rng(4)
    kinds = [lambda: int(rng.integers(-99, 99)), lambda: int(rng.integers(-(10**9), 10**9)), lambda: int(rng.integers(2**40)), lambda: float(rng.normal())]
    name = str if cell_type == "string" else int
    rows = [(name(k), ORIGIN + dt.timedelta(days=int(t)), float(kinds[k % 4]())) for k in range(9) for t in rng.choice(700, 40 * (k + 1), replace=False)]
    rows += [(name(9), ORIGIN, 1.0), (name(9), ORIGIN, 5.0), (name(9), ORIGIN, 1.0), (name(10), ORIGIN + dt.timedelta(days=5000), 7.0), (name(10), ORIGIN, -7.0)]
    bare = [(None, ORIGIN + dt.timedelta(days=900), 3.0), (name(3), ORIGIN + dt.timedelta(days=901), None), (None, ORIGIN + dt.timedelta(days=902), None)]
    field = spark.createDataFrame(rows + bare + [(name(1), None, 5.0)], f"cell {cell_type}, time date, value double").orderBy(F.rand(3))
    want = sorted(map(str, rows + [(None, t, None) for _, t, _ in bare]))
    for packed, parts in itertools.product((7, 1 << 22), (1, 4)):
        monkeypatch.setattr(seriesjoin, "PACKED", packed)
        series = seriesjoin.whole_series(field.repartition(parts))
        assert series.where("cell IS NOT NULL").groupBy("cell").count().where("count > 1").count() == 0
        assert sorted(str(tuple(r)) for r in seriesjoin.series_rows(series).distinct().collect()) == sorted(set(want))
        assert series.where(F.col("cell") == name(9)).select("values").first()[0] == bytes([1, 1, 5])
        first, axis = seriesjoin.calendar(series)
        assert {dt.date(1970, 1, 1) + dt.timedelta(days=int(d)) for d in first + np.flatnonzero(axis)} == {t for _, t, _ in rows + bare}


def test_equal_series_share_a_digest(spark):
    series = {0: [1.0, None, 3.0], 1: [1.0, None, 3.0], 2: [1.0, 3.0], 3: [None, 1.0, None, 3.0], 4: [1.0, None, 3.5]}
    found = {r.cell: r.same for r in seriesjoin.whole_series(field(spark, series)).collect()}
    assert found[0] == found[1] and len(set(found.values())) == 4


@pytest.mark.parametrize("rows", [1 << 21, 40])
def test_smooth_field_is_shuffled_once(spark, monkeypatch, tmp_path, rows):
    """Sums over eight cells in a row, over the ends of blocks; rows are dealt before they are fanned out, crowded blocks included."""
    monkeypatch.setattr(session, "ROWS", rows)
    rng = np.random.default_rng(9)
    cells = [None if rng.random() < 0.05 else int(k) for k in [*rng.integers(-70, 200, 500), *[64] * 300]]
    items = [(k, None if rng.random() < 0.05 else ORIGIN + dt.timedelta(days=int(rng.integers(20))), None if rng.random() < 0.1 else float(rng.integers(10**6)) / 100) for k in cells]
    table = spark.createDataFrame(items, "l_suppkey bigint, l_shipdate date, l_extendedprice double")
    table.select("l_suppkey", F.col("l_shipdate").cast("timestamp_ntz").alias("l_shipdate"), "l_extendedprice").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {}
    for k, t, v in items:
        for at in range(k - 7, k + 1) if k is not None else ():
            had = want.setdefault((at, t), [])
            had += [] if v is None else [round(v * 100)]
    smooth = queries._smooth_field(spark, str(tmp_path))
    found = [((r.cell, r.time), r.value) for r in smooth.collect()]
    assert len(found) == len(dict(found))
    assert dict(found) == {key: sum(had) if had else None for key, had in want.items()}
    plan = smooth._jdf.queryExecution().executedPlan().toString()
    after, shuffled, _ = plan.partition("Exchange hashpartitioning(_block")  # the last steps stand first
    assert shuffled and "greatest(" in after and "Exchange" not in after


@pytest.mark.parametrize("dense", [0.0, 1.0])
def test_first_days_lose_no_pair(spark, monkeypatch, dense):
    """Series that vary early, late or all the time, with lags longer than some records: whether the pairs left are worked out singly or together."""
    monkeypatch.setattr(seriesjoin, "DENSE", dense)
    monkeypatch.setattr(tiles, "LEAST", 9)
    monkeypatch.setattr(tiles, "MOST", 25)
    rng = np.random.default_rng(12)
    noise = rng.integers(0, 10**6, (40, 200)).astype(float)
    series = {k: list(noise[k : k + 5].sum(0)) for k in range(30)}
    for k in range(30, 40):  # nearly constant but for a stretch of their own
        begin = 150 * (k % 2)
        series[k] = [1000.0 * v if begin <= t < begin + 50 else v for t, v in enumerate(noise[30 + k // 4 % 2] + rng.integers(0, 5 * 10**4, 200))]
    rows = field(spark, series)
    every = {(r.i, r.j): r.dist for r in distances.max_correlation_distances(rows, [-6, 0, 6]).collect()}
    near = {k: v for k, v in every.items() if v is not None and v <= 0.4}
    found = seriesjoin.tiled_join(rows, [-6, 0, 6], 0.4).collect()
    assert len({(r.i, r.j) for r in found}) == len(found)
    assert {(r.i, r.j): r.dist for r in found} == pytest.approx(near, abs=1e-9)
    assert len(near) > 60
    short = field(spark, {k: [1.0 * k, 2.0, 2.0 * k, 7.0] for k in range(4)})
    assert seriesjoin.tiled_join(short, [-6, 0, 6], 0.4).count() == seriesjoin.tiled_join(short, [0], 0.4).count() > 0


def test_pairs_of_equal_cells_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS", 100)
    rng = np.random.default_rng(5)
    base = list(rng.normal(size=60))
    found = seriesjoin.tiled_join(field(spark, {k: base for k in range(60)} | {60: list(rng.normal(size=60))}), [0], 0.1)
    assert found.groupBy(F.spark_partition_id()).count().count() > 16  # the session has 8
    assert {(r.i, r.j) for r in found.collect()} == set(itertools.combinations(range(60), 2)) and found.count() == 60 * 59 // 2
