"""Time operators on fields: aggregation windows, lags, seasons, detrending.

Windows are partitioned by cell.  A field holds one row per cell and day, so the longest
partition is the length of the record in days, whatever the size of the grid.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcast.functions.dates import day_number, in_season, lagged

# Aggregators a window may use, by the name an array library would give them.
METHODS = {
    "mean": F.avg,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_pop,
    "var": F.var_pop,
    "prod": F.product,
    "ptp": lambda c: F.max(c) - F.min(c),
}


def _aggregate(method: str, value: str, window=None) -> Column:
    if method not in METHODS:
        raise ValueError(f"unknown aggregation {method}; choose from {sorted(METHODS)}")

    def over(c: Column) -> Column:
        return c if window is None else c.over(window)

    if method == "mean":  # one division of an exact sum, also for integer values
        return over(F.sum(value)) / over(F.count(value))
    if method == "ptp":
        return over(F.max(value)) - over(F.min(value))
    return over(METHODS[method](F.col(value)))


def from_day(df: DataFrame, firstday: dt.date | None) -> DataFrame:
    return df if firstday is None else df.where(F.col("time") >= F.lit(firstday))


def rolling(
    field: DataFrame,
    ndayagg: int,
    method: str = "mean",
    firstday: dt.date | None = None,
    keys: Sequence[str] = ("cell",),
    value: str = "value",
) -> DataFrame:
    """Left-stamped moving aggregate: the row of day t covers [t, t + n - 1].

    Only windows with a value on every day are kept; that drops the incomplete tail and
    windows touching a missing day alike.
    """
    window = Window.partitionBy(*keys).orderBy("_day").rangeBetween(0, ndayagg - 1)
    rows = from_day(field, firstday).withColumn("_day", day_number("time"))
    return (
        rows.withColumns({"_n": F.count(value).over(window), "_v": _aggregate(method, value, window)})
        .where(F.col("_n") == ndayagg)
        .select(*keys, "time", F.col("_v").alias(value))
    )


def rolling_many(
    field: DataFrame,
    ndayaggs: Sequence[int],
    method: str = "mean",
    firstday: dt.date | None = None,
    keys: Sequence[str] = ("cell",),
    value: str = "value",
) -> DataFrame:
    """Several window lengths from one shuffle and one sort; adds ``timeagg``."""
    rows = from_day(field, firstday).withColumn("_day", day_number("time"))
    base = Window.partitionBy(*keys).orderBy("_day")
    columns = {}
    for n in ndayaggs:
        frame = base.rangeBetween(0, n - 1)
        complete = F.count(value).over(frame) == n
        columns[f"_w{n}"] = F.when(complete, _aggregate(method, value, frame))
    rows = rows.withColumns(columns)
    stacked = F.array(*[F.struct(F.lit(n).alias("timeagg"), F.col(f"_w{n}").alias("v")) for n in ndayaggs])
    exploded = rows.select(*keys, "time", F.explode(stacked).alias("w"))
    return exploded.where(F.col("w.v").isNotNull()).select(
        *keys, "time", F.col("w.timeagg").alias("timeagg"), F.col("w.v").alias(value)
    )


def blocks(
    field: DataFrame,
    ndayagg: int,
    method: str = "mean",
    firstday: dt.date | None = None,
    keys: Sequence[str] = ("cell",),
    value: str = "value",
) -> DataFrame:
    """Left-stamped non-overlapping aggregates counted from ``firstday``, full blocks only.

    Without a first day the record's own first day starts the blocks (one scalar subquery).
    """
    rows = from_day(field, firstday)
    start = F.lit(firstday).cast("date") if firstday else field.agg(F.min("time")).scalar()
    rows = rows.withColumn("_start", start)
    block = F.floor(F.datediff("time", "_start") / ndayagg).cast("int")
    stamp = F.date_add(F.col("_start"), block * ndayagg)
    return (
        rows.groupBy(*keys, stamp.alias("time"))
        .agg(F.count(value).alias("_n"), _aggregate(method, value).alias(value))
        .where(F.col("_n") == ndayagg)
        .drop("_n")
    )


def agg_time(field: DataFrame, ndayagg: int = 1, method: str = "mean", firstday: dt.date | None = None,
             rolling_window: bool = False, **kw) -> DataFrame:
    """Rolling or block aggregation behind one signature."""
    return (rolling if rolling_window else blocks)(field, ndayagg, method, firstday, **kw)


def lag_field(field: DataFrame, lags: Sequence[int], keys: Sequence[str] = ("cell",), value: str = "value") -> DataFrame:
    """One copy per lag with its calendar-shifted stamp; lag -10 moves a value 10 days ahead.

    The lag list is a literal array, so this is a narrow explode, not a join.
    """
    fanned = field.select(*keys, "time", value, F.explode(F.array(*[F.lit(int(x)) for x in lags])).alias("lag"))
    return fanned.withColumn("time", lagged("time", F.col("lag")))


def lag_stack(field: DataFrame, lags: Sequence[int], keys: Sequence[str] = ("cell",)) -> DataFrame:
    """Lagged copies on the original (cell, time) axis; NULL where no value moves in."""
    if lags[0] != -lags[-1]:
        raise ValueError("lags should be symmetric around zero")
    axis = field.select(*keys, "time", F.explode(F.array(*[F.lit(int(x)) for x in lags])).alias("lag"))
    return axis.join(lag_field(field, lags, keys), [*keys, "lag", "time"], "left")


def lag_align(field: DataFrame, series: DataFrame, lags: Sequence[int], how: str = "inner") -> DataFrame:
    """Match lagged field values with a daily series on the calendar day.

    ``inner`` keeps matched days; ``right`` keeps every day of the series.
    """
    return lag_field(field, lags).join(series, "time", how)


def past_value(field: DataFrame, ndays: int, out: str, keys: Sequence[str] = ("cell",), value: str = "value") -> DataFrame:
    """Value of the same cell exactly ``ndays`` earlier, by a one-day calendar frame."""
    frame = Window.partitionBy(*keys).orderBy("_day").rangeBetween(-ndays, -ndays)
    return (
        field.withColumn("_day", day_number("time")).withColumn(out, F.max(value).over(frame)).drop("_day")
    )


def season_filter(field: DataFrame, *seasons: str) -> DataFrame:
    return field.where(in_season("time", *seasons))


def month_filter(field: DataFrame, months: Sequence[int]) -> DataFrame:
    return field.where(F.month("time").isin(*months))


def densify(field: DataFrame, keys: Sequence[str] = ("cell",), value: str = "value") -> DataFrame:
    """A row for every cell and day of the cell's record; NULL marks the missing days."""
    span = field.groupBy(*keys).agg(F.min("time").alias("_a"), F.max("time").alias("_b"))
    axis = span.select(*keys, F.explode(F.sequence("_a", "_b")).alias("time"))
    return axis.join(field, [*keys, "time"], "left").select(*keys, "time", value)


def gaps(field: DataFrame, keys: Sequence[str] = ("cell",)) -> DataFrame:
    """Days whose predecessor is not the day before: empty for a contiguous daily axis."""
    previous = F.lag("time").over(Window.partitionBy(*keys).orderBy("time"))
    return (
        field.withColumn("previous", previous)
        .withColumn("step", F.datediff("time", "previous"))
        .where(F.col("step") != 1)
        .select(*keys, "previous", "time", "step")
    )


def assert_contiguous(field: DataFrame, keys: Sequence[str] = ("cell",)) -> DataFrame:
    """The same rows, failing at run time when a daily axis has a hole."""
    previous = F.lag("time").over(Window.partitionBy(*keys).orderBy("time"))
    step = F.datediff("time", previous)
    checked = F.assert_true(step.isNull() | (step == 1), "time axis should be contiguous and daily")
    return field.withColumn("_ok", checked).where(F.col("_ok").isNull()).drop("_ok")


def yearly(df: DataFrame, value: str, keys: Sequence[str] = (), how: str = "mean", out: str | None = None) -> DataFrame:
    """Aggregate per calendar year."""
    agg = _aggregate(how, value).alias(out or value)
    return df.groupBy(*keys, F.year("time").alias("year")).agg(agg)


def standardised_date(df: DataFrame) -> DataFrame:
    """Julian date and its z-score over the distinct days of the record (population scale)."""
    from fieldcast.functions.dates import julian_date

    days = df.select("time").distinct().withColumn("julian", julian_date("time"))
    mean = days.agg(F.avg("julian")).scalar()
    spread = days.agg(F.stddev_pop("julian")).scalar()
    return days.withColumn("z", (F.col("julian") - mean) / spread)
