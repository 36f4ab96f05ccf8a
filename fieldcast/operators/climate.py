"""Day-of-year climatology and anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcast.functions.dates import doy_targets
from fieldcast.session import cut, dealt_by_size


def climatology(
    field: DataFrame, before: int = 5, after: int = 4, min_obs: int = 10, strict: bool = False, value: str = "value"
) -> DataFrame:
    """Mean of all days whose day of year lies in ``[doy - before, doy + after]``, circular.

    Rows shrink to one (sum, count) per cell and day of year before they are fanned out to
    the window's targets, so the fan-out is 366 x 10 per cell and not the whole record.
    ``strict`` makes any NULL row of a densified field void its target, otherwise missing
    values are skipped; fewer than ``min_obs`` values always leave the target out.
    """
    daily = field.groupBy("cell", F.dayofyear("time").alias("_src")).agg(
        F.sum(value).alias("_s"), F.count(value).alias("_n"), F.count(F.lit(1)).alias("_rows")
    )
    spread = daily.withColumn("doy", F.explode(doy_targets("_src", before, after)))
    pooled = spread.groupBy("cell", "doy").agg(
        F.sum("_s").alias("_s"), F.sum("_n").alias("_n"), F.sum("_rows").alias("_rows")
    )
    keep = F.col("_n") >= min_obs
    if strict:
        keep = keep & (F.col("_n") == F.col("_rows"))
    return pooled.where(keep).select("cell", "doy", (F.col("_s") / F.col("_n")).alias("clim"))


def anomaly(field: DataFrame, clim: DataFrame, value: str = "value") -> DataFrame:
    """Departure from the climatology of the day; days without one are missing."""
    keyed = field.withColumn("doy", F.dayofyear("time"))
    return keyed.join(clim, ["cell", "doy"]).select("cell", "time", (F.col(value) - F.col("clim")).alias(value))


def daily_anomaly(field: DataFrame, **kw) -> DataFrame:
    """Climatology of the field itself and the anomalies from it.

    The field is written once, so its rows are known before they are shuffled: tasks become more with them, not larger.
    """
    field = cut(field)
    rows = field.count()
    clim = climatology(dealt_by_size(field, 2 * rows, "cell"), **kw)
    value = kw.get("value", "value")
    keyed = dealt_by_size(field.withColumn("doy", F.dayofyear("time")), rows, "cell", "doy")
    joined = keyed.join(dealt_by_size(clim, rows, "cell", "doy"), ["cell", "doy"])
    return joined.select("cell", "time", (F.col(value) - F.col("clim")).alias(value))
