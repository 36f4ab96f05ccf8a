"""From fields and clusters to one-dimensional feature series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcast.functions.dates import lagged


def on_axis(series: DataFrame, axis: DataFrame) -> DataFrame:
    """Only rows stamped on a day of ``axis`` (one row per calendar day)."""
    return series.join(axis.select("time").distinct(), "time", "left_semi")


def cluster_means(field: DataFrame, clusters: DataFrame, keys: Sequence[str] = ("clustid",)) -> DataFrame:
    """Mean over the cells of each cluster per day; missing cells are skipped.

    Grouping by (cluster, day) combines on the map side, so a cluster that covers most of
    the grid shuffles one partial row per day and task.
    """
    members = clusters.where(F.col("clustid").isNotNull()).select(*keys, "cell")
    joined = field.join(members, "cell")
    return joined.groupBy(*keys, "time").agg((F.sum("value") / F.count("value")).alias("value"))


def mean_at_lag(field: DataFrame, lag: int) -> DataFrame:
    """Spatial mean of the whole field, lagged and kept on the field's own days."""
    means = field.groupBy("time").agg((F.sum("value") / F.count("value")).alias("value"))
    return on_axis(means.withColumn("time", lagged("time", lag)), means)


def spatial_covariance(pattern: DataFrame, field: DataFrame, keys: Sequence[str] = ("lag",), corr: str = "corr",
                       mean_over: str = "pattern") -> DataFrame:
    """Unlagged covariance of each day's field with each pattern, divided by the pattern size.

    ``sum (p - p_mean)(x - x_mean) = sum p' x - x_mean sum p'`` needs one join and one
    combining aggregation.  ``x_mean`` is over the pattern's cells, or over ``all`` cells.
    """
    keys = list(keys)
    valid = pattern.where(F.col(corr).isNotNull())
    stats = valid.groupBy(*keys).agg(F.avg(corr).alias("_pm"), F.count(corr).alias("_np"))
    centred = valid.join(stats, keys).select(*keys, "cell", (F.col(corr) - F.col("_pm")).alias("_p"), "_np")
    cells = field.where(F.col("value").isNotNull())
    sums = cells.join(centred, "cell").groupBy(*keys, "time").agg(
        F.sum(F.col("_p") * F.col("value")).alias("_px"),
        F.sum("_p").alias("_sp"),
        F.avg("value").alias("_xm"),
        F.max("_np").alias("_np"),
    )
    if mean_over == "all":
        daily = cells.groupBy("time").agg(F.avg("value").alias("_xm"))
        sums = sums.drop("_xm").join(daily, "time")
    value = (F.col("_px") - F.col("_xm") * F.col("_sp")) / F.col("_np")
    return sums.select(*keys, "time", value.alias("value"))


def spatial_covariance_lagged(pattern: DataFrame, field: DataFrame, keys: Sequence[str] = ("lag",), **kw) -> DataFrame:
    """Covariance series moved to the response day by each pattern's lag."""
    series = spatial_covariance(pattern, field, keys, **kw)
    return on_axis(series.withColumn("time", lagged("time", F.col("lag"))), field)


def features(field: DataFrame, clusters: DataFrame, variable: str, timeagg: int,
             metrics: Sequence[str] = ("mean", "spatcov")) -> DataFrame:
    """Long feature table of one aggregated variable.

    ``clusters`` holds ``(fold, lag, cell, corr, clustid)``.  Both metrics of all folds,
    lags and clusters come from one join with the field; lag 0 is left out because it is
    not known ahead of the target.
    """
    members = clusters.where(F.col("clustid").isNotNull() & (F.col("lag") != 0))
    keys = ["fold", "lag", "clustid"]
    stats = members.groupBy(*keys).agg(F.avg("corr").alias("_pm"), F.count("corr").alias("_np"))
    centred = members.join(stats, keys).withColumn("_p", F.col("corr") - F.col("_pm"))
    sums = (
        field.where(F.col("value").isNotNull())
        .join(centred.select(*keys, "cell", "_p", "_np"), "cell")
        .groupBy(*keys, "time")
        .agg(
            F.avg("value").alias("mean"),
            F.sum(F.col("_p") * F.col("value")).alias("_px"),
            F.sum("_p").alias("_sp"),
            F.max("_np").alias("_np"),
        )
    )
    sums = sums.withColumn("spatcov", (F.col("_px") - F.col("mean") * F.col("_sp")) / F.col("_np"))
    stacked = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics]))
    long = sums.select(*keys, lagged("time", F.col("lag")).alias("time"), stacked.alias("m"))
    return on_axis(long, field).select(
        "time",
        "fold",
        F.lit(variable).alias("variable"),
        F.lit(timeagg).alias("timeagg"),
        "lag",
        (F.col("lag") + timeagg).alias("separation"),
        "clustid",
        F.col("m.metric").alias("metric"),
        F.col("m.value").alias("value"),
    )


def cluster_counts(clusters: DataFrame, keys: Sequence[str] = ("lag", "fold")) -> DataFrame:
    """Number of distinct clusters per field; noise (NULL) does not count."""
    return clusters.groupBy(*keys).agg(F.count_distinct("clustid").alias("nclusters"))


def complete_rows(features_long: DataFrame, n_features: int | None = None, keys: Sequence[str] = ("time",),
                  feature: str = "feature") -> DataFrame:
    """Days on which every feature has a value (drop-any over the long table)."""
    present = features_long.where(F.col("value").isNotNull())
    counts = present.groupBy(*keys).agg(F.count_distinct(feature).alias("_k"))
    if n_features is None:
        counts = counts.withColumn("_all", features_long.agg(F.count_distinct(feature)).scalar())
    else:
        counts = counts.withColumn("_all", F.lit(n_features))
    return present.join(counts.where(F.col("_k") == F.col("_all")).select(*keys), list(keys), "left_semi")


def numbered(features_long: DataFrame, feature: str = "feature") -> DataFrame:
    """``(feature, index)``: features with a value, numbered from 0 by name.

    A table of one row per feature.  A day's vector has as many entries, so what one row can hold one task can sort.
    """
    names = features_long.where(F.col("value").isNotNull()).select(feature).distinct()
    return names.withColumn("index", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(feature)) - 1)


def feature_arrays(features_long: DataFrame, numbers: DataFrame, complete: bool = True, keys: Sequence[str] = ("time",),
                   feature: str = "feature", alias: str = "values") -> DataFrame:
    """One array of values per day, the value of feature ``index`` at that place; no column per feature.

    ``complete`` keeps the days on which all features have a value, else missing ones are NULL.  Rows of features that
    are not numbered only keep their day; of repeated values of a feature and day the least counts.  One shuffle by
    ``keys``, whatever the number of features.
    """
    kind = dict(features_long.dtypes)["value"]
    n = numbers.agg(F.count(F.lit(1)).cast("int")).scalar()
    entry = F.when(F.col("index").isNotNull() & F.col("value").isNotNull(), F.struct("index", "value"))
    days = features_long.join(numbers, feature, "left").groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("_e"))

    def before(k: Column) -> Column:
        return F.coalesce(F.get("_e", k - 1)["index"], F.lit(-1))

    days = days.withColumn("_e", F.filter("_e", lambda e, k: e["index"] > before(k))).withColumn("_n", n)
    if complete:
        return days.where(F.size("_e") == F.col("_n")).select(*keys, F.col("_e.value").alias(alias))
    nothing = F.lit(None).cast(kind)
    filled = F.flatten(
        F.transform("_e", lambda e, k: F.concat(F.array_repeat(nothing, e["index"] - before(k) - 1), F.array(e["value"])))
    )
    last = before(F.size("_e"))
    return days.select(*keys, F.concat(filled, F.array_repeat(nothing, F.col("_n") - last - 1)).alias(alias))


def listed(features_long: DataFrame, names: Sequence[str], feature: str = "feature") -> DataFrame:
    """``(feature, index)`` of a given list of names."""
    kind = dict(features_long.dtypes)[feature]
    rows = [(name, i) for i, name in enumerate(names)]
    return features_long.sparkSession.createDataFrame(rows, f"{feature} {kind}, index int")


def wide(features_long: DataFrame, names: Sequence[str], feature: str = "feature") -> DataFrame:
    """One column per feature, for a few given names; many features go into :func:`feature_arrays`."""
    arrays = feature_arrays(features_long, listed(features_long, names, feature), complete=False, feature=feature, alias="_v")
    return arrays.select("time", *[F.get("_v", F.lit(i)).alias(str(name)) for i, name in enumerate(names)])
