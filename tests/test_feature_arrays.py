"""Feature vectors built by one aggregation, against plain Python."""

import datetime as dt
import random

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from fieldcast.operators import models, reduction

DAY0 = dt.date(2001, 3, 1)
SCHEMA = "time date, feature string, value double"


def day(i):
    return DAY0 + dt.timedelta(days=i)


def test_gaps_repeats_and_unknown_features(spark):
    rng = random.Random(5)
    rows = [(day(rng.randrange(12)), f"f{rng.randrange(9)}", rng.choice([None, 1.0, 2.0, 3.0])) for _ in range(90)]
    rows += [(day(40), "f1", None), (day(41), "other", 9.0)]
    long = spark.createDataFrame(rows, SCHEMA)
    names = sorted({f for _, f, v in rows if v is not None and f != "other"})
    numbers = reduction.numbered(long.where("feature <> 'other'"))
    assert [(r.feature, r["index"]) for r in numbers.orderBy("index").collect()] == list(zip(names, range(len(names))))
    want = {t: [None] * len(names) for t, _, _ in rows}
    for t, f, v in rows:
        if v is not None and f in names:
            old = want[t][names.index(f)]
            want[t][names.index(f)] = v if old is None else min(old, v)
    got = {r.time: r["values"] for r in reduction.feature_arrays(long, numbers, complete=False).collect()}
    assert got == want
    whole = {r.time: r["values"] for r in reduction.feature_arrays(long, numbers).collect()}
    assert whole == {t: v for t, v in want.items() if None not in v}
    columns = reduction.wide(long, ["f3", "absent", "f0"]).collect()
    assert {r.time: (r.f3, r.absent, r.f0) for r in columns} == {
        t: (v[names.index("f3")], None, v[names.index("f0")]) for t, v in want.items()
    }


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert reduction.feature_arrays(empty, reduction.numbered(empty)).count() == 0
    assert reduction.wide(empty, ["a"]).collect() == []


def test_twenty_thousand_features(spark):
    n, days = 20_000, 12
    long = spark.range(n * days).select(
        F.add_months(F.lit(DAY0), (F.col("id") % days * 12).cast("int")).alias("time"),  # a day a year
        F.format_string("g%05d", F.floor(F.col("id") / days)).alias("feature"),
        (F.floor(F.col("id") / days) * 7 % 1000 + F.col("id") % days * 1000).cast("double").alias("value"),
    ).where("not (feature = 'g00007' and time = date'2002-03-01')")  # one day is not complete
    response = spark.createDataFrame([(DAY0.replace(year=2001 + i), i % 2) for i in range(days)], "time date, y int")
    frame = models.training_frame(long, response, reduction.numbered(long), 3)
    assert len(frame.columns) == 4  # time, y, features, fold
    rows = frame.select("time", vector_to_array("features").alias("v")).collect()
    assert sorted(r.time for r in rows) == [DAY0.replace(year=2001 + i) for i in range(days) if i != 1]
    base = np.arange(n) * 7 % 1000
    for r in rows:
        assert np.array_equal(np.array(r.v), base + (r.time.year - 2001) * 1000)
