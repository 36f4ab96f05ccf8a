"""From raw sub-daily values to daily fields, and what still has to be fetched."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcast.catalog import ARCHIVE, NEXT_DAY_VARIABLES, Region

DAILY = {"mean": lambda c: F.sum(c) / F.count(c), "min": F.min, "max": F.max}


def hours_seen(ts: str) -> Column:
    """Number of different hours of the day, as the bits of one combining integer."""
    return F.bit_count(F.bit_or(F.expr(f"shiftleft(1, hour({ts}))")))


def to_daily(hourly: DataFrame, operation: str = "mean", value: str = "value") -> DataFrame:
    """Daily field from ``(cell, ts, value)`` by ``mean``, ``min``, ``max`` or ``hhUTC``.

    Missing hours are skipped.  A slice at 24UTC is the 00 hour of the next day stamped on
    the day before.
    """
    if operation.endswith("UTC"):
        hour = int(operation[:2])
        day = F.to_date("ts") if hour < 24 else F.date_sub(F.to_date("ts"), 1)
        rows = hourly.where(F.hour("ts") == hour % 24)
        return rows.groupBy("cell", day.alias("time")).agg(DAILY["mean"](value).alias(value))
    return (
        hourly.groupBy("cell", F.to_date("ts").alias("time"))
        .agg(DAILY[operation](value).alias(value), hours_seen("ts").alias("_hours"))
        .select("cell", "time", value, (F.col("_hours") == 24).alias("complete"))
    )


def merge_weighted(layers: DataFrame, weights: dict, layer: str = "layer", value: str = "value") -> DataFrame:
    """Weighted mean over layers per (cell, day), skipping the layers that are missing there.

    The weights are a literal map, so merging is one combining aggregation.
    """
    pairs = [F.lit(x) for item in weights.items() for x in item]
    weighted = layers.withColumn("_w", F.element_at(F.create_map(*pairs), F.col(layer)))
    valid = weighted.where(F.col(value).isNotNull() & F.col("_w").isNotNull())
    return valid.groupBy("cell", "time").agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias(value))


def days_between(field: DataFrame) -> DataFrame:
    """Every day from the first to the last of the field."""
    span = field.agg(F.min("time").alias("_a"), F.max("time").alias("_b"))
    return span.select(F.explode(F.sequence("_a", "_b")).alias("time"))


def missing_days(desired: DataFrame, field: DataFrame) -> DataFrame:
    """Desired days without any value."""
    return desired.join(field.select("time").distinct(), "time", "left_anti")


def requests(days: DataFrame, region: Region, varnames: Sequence[str] | None = None) -> DataFrame:
    """One archive request per variable and missing day.

    Variables accumulated or snapshotted at midnight ask for 00:00 of the next day.  The
    catalogue is a literal array, so pairing it with the days is a narrow explode.
    """
    wanted = [row for row in ARCHIVE if varnames is None or row[0] in varnames]
    fields = ("varname", "variable", "pressure_level", "setname")
    types = ("string", "string", "int", "string")
    catalogue = F.array(
        *[F.struct(*[F.lit(v).cast(t).alias(n) for n, t, v in zip(fields, types, row)]) for row in wanted]
    )
    paired = days.select("time", F.explode(catalogue).alias("c")).select("time", "c.*")
    next_day = F.col("varname").isin(*NEXT_DAY_VARIABLES)
    return paired.select(
        "varname",
        "time",
        "setname",
        "variable",
        F.when(next_day, F.date_add("time", 1)).otherwise(F.col("time")).alias("requested"),
        F.when(next_day, 1).otherwise(24).alias("nhours"),
        "pressure_level",
        F.when(~F.col("setname").contains("land"), "reanalysis").alias("product_type"),
        F.lit(",".join(str(b) for b in region[1:])).alias("area"),
        F.concat_ws("_", "varname", F.lit(region.name), F.date_format("time", "yyyy-MM-dd")).alias("rawname"),
    )


def raw_day(name: Column) -> Column:
    """Date at the end of a raw file name, NULL when there is none."""
    found = F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})\.\w+$", 1)
    return F.try_to_date(F.nullif(found, F.lit("")))


def present_raw_days(files: DataFrame, wanted: DataFrame, region: str) -> DataFrame:
    """Raw files of a region, listed as ``path``, that hold a wanted day, in day order."""
    named = files.where(F.lower("path").contains(region.lower())).withColumn("time", raw_day(F.col("path")))
    return named.join(wanted, "time", "left_semi").select("time", "path").orderBy("time", "path")


def list_raw_files(spark, folder: str, pattern: str = "*.grib") -> DataFrame:
    """Names of raw files, without reading their content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path")
