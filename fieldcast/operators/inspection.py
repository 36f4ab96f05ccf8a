"""Importance frames: scaling, reduction, ranking, and mapping back to the grid.

An importance frame is long: key columns from ``functions.keys`` plus ``respagg``, and one
column per measure (``score``, ``rank``, ``shap`` ...).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcast.functions.dates import in_season, input_window
from fieldcast.functions.keys import collapse

FIT_KEYS = ("respagg", "separation", "fold")
FIELD_KEYS = ("fold", "variable", "timeagg", "separation")


def _scaled(c: str, lo: Column, hi: Column, fill: bool) -> Column:
    span = hi - lo
    raw = (hi - F.col(c)) if "rank" in c else (F.col(c) - lo)
    out = F.when(span != 0, raw / span)
    return F.coalesce(out, F.lit(0.0)) if fill else out


def scale_within(imp: DataFrame, columns: Sequence[str], within: Sequence[str] = FIT_KEYS, fill_na: bool = False) -> DataFrame:
    """Min-max scaling of each column inside one model fit; ranks turn so that best is one.

    Limits come from a combining aggregate joined back, so one fit with a third of all rows
    never sits in a single task.
    """
    limits = imp.groupBy(*within).agg(
        *[F.min(c).alias(f"_lo_{c}") for c in columns], *[F.max(c).alias(f"_hi_{c}") for c in columns]
    )
    joined = imp.join(limits, list(within))
    out = {c: _scaled(c, F.col(f"_lo_{c}"), F.col(f"_hi_{c}"), fill_na) for c in columns}
    return joined.withColumns(out).drop(*[f"_lo_{c}" for c in columns], *[f"_hi_{c}" for c in columns])


REDUCERS = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "median": F.median, "count": F.count}


def reduce_over(imp: DataFrame, keys: Sequence[str], what: str | Sequence[str], columns: Sequence[str], how: str = "mean") -> DataFrame:
    """Aggregate one or more keys away: group by all the others."""
    gone = {what} if isinstance(what, str) else set(what)
    if not gone <= set(keys):
        raise KeyError(f"{sorted(gone - set(keys))} not among the keys {list(keys)}")
    kept = [k for k in keys if k not in gone]
    return imp.groupBy(*kept).agg(*[REDUCERS[how](c).alias(c) for c in columns])


def importance_rollup(imp: DataFrame, keys: Sequence[str], column: str, how: str = "mean") -> DataFrame:
    """All levels of detail at once, from the full key down to the grand total."""
    return imp.rollup(*keys).agg(REDUCERS[how](column).alias(column), F.count(F.lit(1)).alias("n"))


def global_shap(shap: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean absolute contribution over time per feature and fit."""
    values = shap.where(F.col("variable") != "expected_value")
    return values.groupBy(*keys).agg(F.avg(F.abs("shap")).alias("avgabsshap"))


def split_expected(shap: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feature contributions and the expected-value rows stored beside them."""
    is_expected = F.col("variable") == "expected_value"
    expected = shap.where(is_expected).select("respagg", "separation", "fold", "time", F.col("shap").alias("expected"))
    return shap.where(~is_expected), expected


def matching(values: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``target`` with the values found on the keys both frames have."""
    shared = [k for k in keys if k in values.columns and k in target.columns]
    clashes = [c for c in values.columns if c in target.columns and c not in shared]
    return target.join(values.drop(*clashes), shared, "left")


def top_features(imp: DataFrame, column: str, n: int = 10, per: Sequence[str] = FIT_KEYS,
                 ignore: Sequence[str] = ("respagg", "lag", "metric"), keys: Sequence[str] = ()) -> DataFrame:
    """The n largest per group by a two-stage top-k.

    Salted sub-groups keep their own n best first, so the final ranking of a group sorts
    at most ``n x 64`` rows, however large the group is.
    """
    name = collapse([k for k in keys if k not in per], ignore=tuple(ignore)).alias("feature")
    named = imp.select(*per, name, column)
    order = [F.col(column).desc_nulls_last(), F.col("feature")]
    salted = named.withColumn("_salt", F.pmod(F.xxhash64("feature"), F.lit(64)))
    first = salted.withColumn("_r", F.row_number().over(Window.partitionBy(*per, "_salt").orderBy(*order)))
    first = first.where(F.col("_r") <= n).drop("_salt", "_r")
    place = F.row_number().over(Window.partitionBy(*per).orderBy(*order))
    return first.withColumn("place", place).where(F.col("place") <= n)


def in_out_kept(base: DataFrame, other: DataFrame, column: str, n_most_important: int = 10, per: Sequence[str] = ("fold",),
                keys: Sequence[str] = (), ignore: Sequence[str] = ("respagg", "lag")) -> DataFrame:
    """Which features enter, leave or stay among the top of ``other`` against ``base``.

    The compared top holds ``n_most_important - 1`` features.  ``place`` counts from zero,
    by importance in base for kept and out, and in other for in.
    """
    n = n_most_important - 1
    b = top_features(base, column, n, per, ignore, keys).select(*per, "feature", (F.col("place") - 1).alias("_b"))
    o = top_features(other, column, n, per, ignore, keys).select(*per, "feature", (F.col("place") - 1).alias("_o"))
    both = b.join(o, [*per, "feature"], "full_outer")
    status = F.when(F.col("_b").isNull(), "in").when(F.col("_o").isNull(), "out").otherwise("kept")
    return both.select(*per, "feature", status.alias("status"), F.coalesce("_b", "_o").alias("place"))


def fraction_significant(fields: DataFrame, keys: Sequence[str] = ("variable", "timeagg", "separation"),
                         fold: int | None = None) -> DataFrame:
    """Share of cells that carry a correlation, per fold or averaged over folds."""
    per_fold = fields.groupBy(*keys, "fold").agg(F.count("corr").alias("n_signif"), F.count(F.lit(1)).alias("n"))
    per_fold = per_fold.withColumn("fraction", F.col("n_signif") / F.col("n"))
    if fold is not None:
        return per_fold.where(F.col("fold") == fold)
    return per_fold.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ("n_signif", "n", "fraction")])


def by_separation(associations: DataFrame, timeagg: int) -> DataFrame:
    """Relabel lags as gaps between windows, comparable across aggregations; drop lag 0."""
    return associations.where(F.col("lag") != 0).withColumns(
        {"timeagg": F.lit(timeagg), "separation": F.col("lag") + timeagg}
    )


def map_to_fields(imp: DataFrame, column: str, clusters: DataFrame, lookup: DataFrame | None = None,
                  remove_unused: bool = True) -> DataFrame:
    """Importance painted on the cells of its cluster: ``(keys, cell, value)``.

    ``lookup`` translates the model fold into the fold number of the stored fields.
    Clusters without an importance become NULL, or keep their id if not ``remove_unused``.
    Only fields that occur in the importance frame are drawn.
    """
    imp = imp.join(lookup.select("fold", "fieldfold"), "fold") if lookup is not None else imp.withColumn("fieldfold", F.col("fold"))
    drawn = imp.select(*FIELD_KEYS, "fieldfold").distinct()
    renamed = clusters.withColumnRenamed("fold", "fieldfold")
    cells = renamed.join(drawn, ["fieldfold", "variable", "timeagg", "separation"])
    values = imp.select(*FIELD_KEYS, "clustid", F.col(column).cast("double").alias("_imp"))
    painted = cells.join(values, [*FIELD_KEYS, "clustid"], "left")
    value = F.col("_imp") if remove_unused else F.coalesce("_imp", F.col("clustid").cast("double"))
    return painted.select(*FIELD_KEYS, "cell", "clustid", value.alias("value"))


def field_limits(painted: DataFrame) -> DataFrame:
    return painted.groupBy(*FIELD_KEYS).agg(F.min("value").alias("minimum"), F.max("value").alias("maximum"))


def anomaly_maps(imp: DataFrame, anomalies: DataFrame, clusters: DataFrame, timestamp, lookup: DataFrame | None = None,
                 mask: str | None = "loose") -> DataFrame:
    """Mean anomaly of the days that feed one forecast, beside correlation and cluster.

    ``anomalies`` is ``(variable, cell, time, value)`` and the response day is fixed, so
    every (variable, timeagg, separation) reads one date range.  ``mask`` is ``loose``
    (any cluster), ``strict`` (clusters in ``imp``) or None.
    """
    fields = imp.join(lookup.select("fold", "fieldfold"), "fold") if lookup is not None else imp.withColumn("fieldfold", F.col("fold"))
    wanted = fields.select(*FIELD_KEYS, "fieldfold").distinct()
    start, end = input_window(F.lit(timestamp).cast("date"), F.col("separation"), F.col("timeagg"))
    ranges = wanted.select("variable", "timeagg", "separation").distinct().withColumns(
        {"time": F.explode(F.sequence(start, end))}
    )
    means = (
        anomalies.join(ranges, ["variable", "time"])
        .groupBy("variable", "timeagg", "separation", "cell")
        .agg((F.sum("value") / F.count("value")).alias("anom"), F.count("value").alias("_n"))
        .where(F.col("_n") == F.col("timeagg"))
        .drop("_n")
    )
    maps = (
        clusters.withColumnRenamed("fold", "fieldfold")
        .join(wanted, ["fieldfold", "variable", "timeagg", "separation"])
        .join(means, ["variable", "timeagg", "separation", "cell"], "left")
    )
    if mask == "strict":
        present = fields.select(*FIELD_KEYS, "clustid").distinct().withColumn("_keep", F.lit(True))
        maps = maps.join(present, [*FIELD_KEYS, "clustid"], "left")
    else:
        maps = maps.withColumn("_keep", F.col("clustid").isNotNull() if mask == "loose" else F.lit(True))
    return maps.select(
        *FIELD_KEYS, "cell", "clustid", *[F.when(F.col("_keep"), F.col(c)).alias(c) for c in ("anom", "corr")]
    )


def accumulate_folds(painted: DataFrame, how: str = "max", min_folds: int | None = None,
                     keys: Sequence[str] = ("variable", "timeagg", "separation")) -> DataFrame:
    """In how many folds a cell carries a value, and its statistic if in enough of them."""
    out = painted.groupBy(*keys, "cell").agg(F.count("value").alias("count"), REDUCERS[how]("value").alias(how))
    enough = F.col("count") >= min_folds if min_folds is not None else F.lit(True)
    return out.withColumns(
        {"count": F.when(F.col("count") != 0, F.col("count")), how: F.when(enough, F.col(how))}
    )


def feature_counts(features: DataFrame, keys: Sequence[str] = ("variable", "timeagg", "separation")) -> DataFrame:
    """Mean number of clusters over folds: distinct clusters per fold, then averaged."""
    per_fold = features.groupBy(*keys, "fold").agg(F.count_distinct("clustid").alias("_n"))
    return per_fold.groupBy(*keys).agg(F.avg("_n").alias("mean_clusters"))


def dot_data(imp: DataFrame, column: str) -> DataFrame:
    """Dot-plot rows: panel per variable, input timescale against lead time, and the size of the dot."""
    return imp.select("variable", "respagg", "separation", F.col("timeagg").alias("y"), F.col(column).alias("size"))


def heat_data(scores: DataFrame, row: str, column: str, columns: Sequence, value: str) -> DataFrame:
    """Two-dimensional table of a mean score, one column per given label."""
    return scores.groupBy(row).pivot(column, list(columns)).agg(F.avg(value))


def scatter_data(features: DataFrame, response: DataFrame, bounds: DataFrame) -> DataFrame:
    """Feature against target with a flag for the feature's own validation period."""
    joined = features.join(response, "time").join(bounds.select("fold", "valstart", "valend"), "fold")
    return joined.withColumn("validation", F.col("time").between(F.col("valstart"), F.col("valend"))).drop("valstart", "valend")


def forecast_lines(predictions: DataFrame, outcomes: DataFrame, seasons: Sequence[str] = ("JJA",)) -> DataFrame:
    """Predicted probability per day with the observed event, season days only."""
    return predictions.join(outcomes, [c for c in ("respagg", "time") if c in predictions.columns and c in outcomes.columns]).where(
        in_season("time", *seasons)
    )


def shap_data(shap: DataFrame, features: DataFrame, keys: Sequence[str], ignore: Sequence[str] = ("lag",),
              base: DataFrame | None = None) -> DataFrame:
    """Contribution, feature value and base value per day with a readable feature name."""
    shared = [k for k in keys if k in features.columns]
    joined = shap.join(features.select(*shared, "time", F.col("value").alias("feature_value")), [*shared, "time"], "left")
    if base is not None:
        on = [c for c in ("respagg", "separation", "fold", "time") if c in base.columns and c in shap.columns]
        joined = joined.join(base, on, "left")
    return joined.withColumn("feature", collapse(list(keys), ignore=tuple(ignore)))


def base_rate(series: DataFrame, quantile: float) -> DataFrame:
    """Event probability of a stationary target: the share above its quantile."""
    return series.select("time", F.lit(1 - quantile).alias("baserate"))


def grid_edges(points: DataFrame, spacing: float) -> DataFrame:
    """Cell corners for drawing: midpoints are taken as north-west corners."""
    return points.withColumns(
        {"south": F.col("lat") - spacing, "north": F.col("lat"), "west": F.col("lon"), "east": F.col("lon") + spacing}
    )
