"""Fields along the curve: order of places, and what a box reads."""

import datetime as dt
import random

from pyspark.sql import functions as F

from fieldcast.catalog import REGIONS
from fieldcast.sources import fields, layout

DAY0 = dt.date(2000, 1, 1)


def globe(spark, days=40):
    """A grid of 2.5 degrees, every day."""
    return spark.range(72 * 144 * days).select(
        (F.col("id") % (72 * 144)).alias("cell"),
        (F.floor(F.col("id") % (72 * 144) / 144) * 2.5 - 88.75).alias("lat"),
        (F.col("id") % 144 * 2.5 - 178.75).alias("lon"),
        F.date_add(F.lit(DAY0), F.floor(F.col("id") / (72 * 144)).cast("int")).alias("time"),
        (F.xxhash64("id") % 1000).cast("double").alias("value"),
    )


def rows_read(df):
    """Rows that the scan hands on after row groups and pages are ruled out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().head()
    return plan.metrics().apply("numOutputRows").value()


def test_key_interleaves_bits(spark):
    rng = random.Random(2)
    points = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(200)] + [(90.0, 180.0), (-95.0, 999.0), (0.0, 0.0)]

    def key(lat, lon, bits):
        top = (1 << bits) - 1
        y = min(top, max(0, int((lat + 90) / 180 * (1 << bits) // 1)))
        x = min(top, max(0, int((lon + 180) / 360 * (1 << bits) // 1)))
        return sum((y >> b & 1) << 2 * b + 1 | (x >> b & 1) << 2 * b for b in range(bits))

    df = spark.createDataFrame([(*p, i) for i, p in enumerate(points)], "lat double, lon double, i int")
    for bits in (1, 7, 14, 16):
        got = [r.k for r in df.select("i", layout.curve_key(bits=bits).alias("k")).orderBy("i").collect()]
        assert got == [key(*p, bits) for p in points]
    nothing = spark.createDataFrame([(None, 1.0), (1.0, None)], "lat double, lon double")
    assert [r.k for r in nothing.select(layout.curve_key().alias("k")).collect()] == [None, None]


def test_box_skips_row_groups(spark, tmp_path):
    field = globe(spark)
    total = field.count()
    plain, placed = str(tmp_path / "plain"), str(tmp_path / "placed")
    field.repartition(8).write.option("parquet.block.size", 64 * 1024).parquet(plain)
    layout.write_by_place(field, placed, row_group_bytes=64 * 1024)
    for name in ("natlantic", "europe"):
        inside = fields.read_field(spark, placed, name)
        share = field.where(REGIONS[name].contains()).count() / total
        assert sorted(inside.collect()) == sorted(field.where(REGIONS[name].contains()).collect())
        assert rows_read(fields.read_field(spark, plain, name)) == total
        assert rows_read(inside) < (share + 0.15) * total


def test_no_rows_and_no_coordinates(spark, tmp_path):
    path = str(tmp_path / "f")
    rows = [(1, None, 5.0, DAY0, 1.0), (2, 40.0, -10.0, DAY0, 2.0), (2, 40.0, -10.0, DAY0, 2.0)]
    schema = "cell int, lat double, lon double, time date, value double"
    layout.write_by_place(spark.createDataFrame(rows, schema), path)
    assert fields.read_field(spark, path).count() == 3
    assert [r.cell for r in fields.read_field(spark, path, "natlantic").collect()] == [2, 2]
    layout.write_by_place(spark.createDataFrame([], schema), path)
    assert fields.read_field(spark, path, "natlantic").count() == 0
