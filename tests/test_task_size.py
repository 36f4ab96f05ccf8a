"""Tasks become more with the rows, not larger."""

import datetime as dt

from pyspark.sql import functions as F

from fieldcast import session
from fieldcast.operators import association, climate
from fieldcast.sources import adapters


def days(spark, cells, n):
    time = F.date_add(F.lit(dt.date(1999, 5, 1)), (F.col("id") % n).cast("int"))
    return spark.range(cells * n).select((F.col("id") / n).cast("int").alias("cell"), time.alias("time"), ((F.col("id") * 37) % 101).alias("value"))


def parts(df):
    return df.groupBy(F.spark_partition_id()).count().count()


def test_anomalies_and_pairs_are_dealt_by_size(spark, monkeypatch):
    field = days(spark, 60, 200)
    monkeypatch.setattr(session, "ROWS", 1 << 30)
    usual = sorted(tuple(r) for r in climate.daily_anomaly(field, min_obs=1).collect())
    monkeypatch.setattr(session, "ROWS", 300)
    found = climate.daily_anomaly(field, min_obs=1)
    assert parts(found) > 16  # the session has 8
    assert sorted(tuple(r) for r in found.collect()) == usual
    target = days(spark, 1, 200).select("time", F.col("value").alias("y"))
    pairs = association.lag_pairs(field, association.prepare_response(target), [-7, -15])
    assert parts(pairs) > 16
    assert parts(association.spearman(pairs)) > 16


def test_supplier_field_is_dealt_by_size(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    usual = sorted(tuple(r) for r in adapters.supplier_field(spark, folder).collect())
    monkeypatch.setattr(session, "ROWS", 200)
    found = adapters.supplier_field(spark, folder)
    assert parts(found) > 16
    assert sorted(tuple(r) for r in found.collect()) == usual
