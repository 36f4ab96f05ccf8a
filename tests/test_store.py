"""Appends to a field with a manifest, against a dictionary."""

import datetime as dt
import random

import pytest

from fieldcast.sources import store

DAY0 = dt.date(2000, 1, 1)
SCHEMA = "cell int, time date, value int"


def content(spark, path):
    rows = store.read_days(spark, path).collect()
    assert len({(r.cell, r.time) for r in rows}) == len(rows)
    return {(r.cell, r.time): r.value for r in rows}


def test_random_appends(spark, tmp_path):
    path, want, rng = str(tmp_path / "s"), {}, random.Random(3)
    for step in range(7):
        low = rng.randrange(20)
        rows = {(rng.randrange(low, low + 8), DAY0 + dt.timedelta(days=rng.randrange(4))): rng.choice([None, 1, 2, 3]) for _ in range(14)}
        store.append_days(spark.createDataFrame([(*k, v) for k, v in rows.items()], SCHEMA), path)
        want |= rows
        if step == 4:
            store.compact(spark, path)
        if step > 2:
            assert content(spark, path) == {k: v for k, v in want.items() if v is not None}
    assert store.manifest(spark, path).select("commit").distinct().count() == 3  # the compaction and two appends


def test_repeats_and_new_days(spark, tmp_path):
    path = str(tmp_path / "s")
    first = spark.createDataFrame([(1, DAY0, 5), (1, DAY0, 7), (2, DAY0, 6)], SCHEMA)
    store.append_new(first, path)
    store.append_days(first, path)
    assert content(spark, path) == {(1, DAY0): 7, (2, DAY0): 6}
    assert store.append_new(first, path) is None
    store.append_new(spark.createDataFrame([(1, DAY0, 0), (3, DAY0, 9)], SCHEMA), path)
    assert content(spark, path) == {(1, DAY0): 7, (2, DAY0): 6, (3, DAY0): 9}


def test_half_an_append_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "s")
    store.append_days(spark.createDataFrame([(1, DAY0, 5)], SCHEMA), path)
    lost = spark.createDataFrame([(1, DAY0, 8), (4, DAY0, 8)], SCHEMA)
    lost.write.parquet(f"{path}/data/commit=0000000001-lost")  # its manifest was never written
    assert content(spark, path) == {(1, DAY0): 5}
    with pytest.raises(Exception, match="without a cell or a day"):
        store.append_days(spark.createDataFrame([(None, DAY0, 5)], SCHEMA), path)
    store.append_days(spark.createDataFrame([], SCHEMA), path)
    assert content(spark, path) == {(1, DAY0): 5}
    with pytest.raises(FileNotFoundError):
        store.read_days(spark, str(tmp_path / "none"))


def test_parts_alone_are_not_shuffled(spark, tmp_path):
    path = str(tmp_path / "s")
    for low in (0, 10, 20):
        store.append_days(spark.createDataFrame([(low + i, DAY0, i) for i in range(5)], SCHEMA), path)
    parts = store.clashes(store.manifest(spark, path))
    assert [r.clash for r in parts.collect()] == [False] * 3
    store.append_days(spark.createDataFrame([(12, DAY0, 1), (30, DAY0, 1)], SCHEMA), path)
    clash = {(r.first, r.last): r.clash for r in store.clashes(store.manifest(spark, path)).collect()}
    assert clash == {(0, 4): False, (10, 14): True, (20, 24): True, (12, 30): True}
