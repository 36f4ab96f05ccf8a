"""End-to-end flows: raw field to anomalies, to precursors, to features, to forecasts."""

from __future__ import annotations

import datetime as dt
import functools
import itertools
from collections.abc import Callable, Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcast.catalog import TIMEAGGS
from fieldcast.functions.keys import FEATURE_KEYS, collapse, restore
from fieldcast.operators import association as assoc
from fieldcast.operators import folds, hierarchy, models, reduction, temporal, verification
from fieldcast.operators.climate import daily_anomaly
from fieldcast.session import cut

# Density-clustering settings per variable (samples, cluster size, radians).
DENSITY = {
    "t850": (1000, 3000, 0.17),
    "z300": (2000, 6000, 0.17),
    "tcc": (200, 400, 0.09),
    "sst": (300, 1000, 0.20),
    "standard": (200, 450, 0.08),
    "transp": (200, 600, 0.08),
    "snowc": (1000, 3000, 0.11),
    "siconc": (200, 400, 0.1),
}
MIN_POINTS = 700  # Fixed value: the customary ``min_points``, for those who ask for it.


def target_series(anomalies: DataFrame, clusters: DataFrame, clustid: int) -> DataFrame:
    """Daily mean ``(time, y)`` of one cluster of the response field."""
    means = reduction.cluster_means(anomalies, clusters.where(F.col("clustid") == clustid))
    return means.select("time", F.col("value").alias("y"))


def aggregated_target(series: DataFrame, timeagg: int, firstday: dt.date | None = None) -> DataFrame:
    one = series.select(F.lit(0).alias("cell"), "time", F.col("y").alias("value"))
    return temporal.rolling(one, timeagg, firstday=firstday).select("time", F.col("value").alias("y"))


def response_table(series: DataFrame, timeaggs: Sequence[int] = TIMEAGGS, detrended: bool = False,
                   seasons: Sequence[str] = ("JJA",)) -> DataFrame:
    """``(time, timeagg, y)``: the season's target at all aggregations, trended or not."""
    parts = [
        assoc.prepare_response(aggregated_target(series, n), seasons, trend_removed=detrended).withColumn("timeagg", F.lit(n))
        for n in timeaggs
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def find_precursors(anomalies: DataFrame, series: DataFrame, timeaggs: Sequence[int] = TIMEAGGS, n_folds: int = 5,
                    separations: Sequence[int] = (0, 1, 3, 5, 7, 11, 15, 21, 31), partial: bool = False,
                    firstday: dt.date | None = None, alpha: float | None = None) -> DataFrame:
    """Masked correlation fields ``(timeagg, lag, fold, cell, corr, ...)`` of one variable.

    Anomalies and target are written once; every window length reads them.
    """
    anomalies, series = cut(anomalies), cut(series)
    parts = []
    for n in timeaggs:
        target = assoc.prepare_response(aggregated_target(series, n, firstday), past=n if partial else None)
        field = temporal.rolling(anomalies, n, firstday=firstday)
        found = assoc.associate(
            field, target, assoc.precursor_lags(n, separations), "partial_spearman" if partial else "spearman",
            n_folds, timeagg=n,
        )
        level = alpha if alpha is not None else assoc.varying_alpha(n)
        parts.append(assoc.masked(found, level).withColumn("timeagg", F.lit(n)))
    return functools.reduce(DataFrame.unionByName, parts)


def cluster_precursors(found: DataFrame, points: DataFrame, variable: str = "standard",
                       settings: Mapping[str, tuple] = DENSITY, min_points: int | None = None) -> DataFrame:
    """Add ``clustid`` to significant cells, clustering every (timeagg, lag, fold) field at once.

    ``status`` tells per field whether it was ``clustered`` or has ``too few cells``: less than a cluster needs, or less
    than ``min_points`` where that is given.
    """
    samples, size, epsilon = settings.get(variable.split("_")[0], settings["standard"])
    keys = ["timeagg", "lag", "fold"]
    located = found.where(F.col("corr").isNotNull()).select(*keys, "cell").join(points.select("cell", "lat", "lon"), "cell")
    labels = hierarchy.hdbscan(located, samples, size, keys, epsilon, min_points=min_points or 0)
    enough = F.count("corr") >= max(size, min_points or 0)
    status = found.groupBy(*keys).agg(F.when(enough, "clustered").otherwise("too few cells").alias("status"))
    return found.join(labels, [*keys, "cell"], "left").join(status, keys)


def extract_features(anomalies: DataFrame, clusters: DataFrame, variable: str, timeaggs: Sequence[int],
                     firstday: dt.date | None = None) -> DataFrame:
    """Long feature table of one variable.

    Only cells that belong to a cluster are aggregated, and only the target's season and
    the one before it are kept, after the windows and before the join.
    """
    parts = []
    for n in timeaggs:
        mine = clusters.where(F.col("timeagg") == n)
        used = mine.where(F.col("clustid").isNotNull()).select("cell").distinct()
        field = temporal.rolling(anomalies.join(used, "cell", "left_semi"), n, firstday=firstday)
        parts.append(reduction.features(temporal.season_filter(field, "MAM", "JJA"), mine, variable, n))
    return functools.reduce(DataFrame.unionByName, parts)


def model_events(features: DataFrame, response: DataFrame, timeagg: int, separation: int, quantile: float) -> DataFrame:
    """``(time, y)`` of the complete days of one target aggregation and lead time, ``y`` being 1 above the threshold.

    A day counts if every feature of every fold has a value.  The threshold is the quantile of the target over those
    days only, so events are as frequent among the modelled days as the quantile says.
    """
    mine = features.where((F.col("separation") == separation) & F.col("value").isNotNull())
    total = F.broadcast(mine.select(*FEATURE_KEYS).distinct().agg(F.count(F.lit(1)).alias("_all")))  # one row
    per_day = mine.groupBy("time").agg(F.count(F.lit(1)).alias("_here"))
    series = response.where(F.col("timeagg") == timeagg).select("time", F.col("y").alias("value")).where("value is not null")
    counted = series.join(per_day, "time", "left").crossJoin(total)
    complete = counted.where(F.coalesce("_here", F.lit(0)) == F.col("_all")).select("time", "value")
    return verification.exceedance(complete, quantile, bounded=True).select("time", F.col("y").cast("int").alias("y"))


def fold_training_years(events: DataFrame, n_folds: int) -> DataFrame:
    """``(fold, fieldfold, valstart, valend, train_rows, val_rows)``: the one lookup between fold numberings.

    Features with the number ``fieldfold`` were selected without the years from ``valstart`` to ``valend``, and the model
    ``fold`` validates on just these years.
    """
    bounds = folds.fold_bounds(events, n_folds)
    rows = folds.with_year_fold(events, n_folds).groupBy("fold").agg(F.count(F.lit(1)).alias("val_rows"))
    total = F.broadcast(events.agg(F.count(F.lit(1)).alias("_all")))  # one row
    out = bounds.join(rows, "fold").crossJoin(total).withColumn("train_rows", F.col("_all") - F.col("val_rows"))
    return out.select("fold", "fieldfold", "valstart", "valend", "train_rows", "val_rows")


def fold_frames(features: DataFrame, response: DataFrame, timeagg: int, separation: int, quantile: float, n_folds: int,
                work: Callable[[int, DataFrame, list[str]], DataFrame | None]) -> DataFrame | None:
    """Union of ``work(fold, rows, numbered features)`` over the models of one target aggregation and lead time.

    Features of a fold were selected on that fold's training rows, so the model of a fold
    sees its own features only.  One table of folds, made from the days that are modelled,
    serves the lookup of features and the split of every frame.  Events and features are
    written once: every fold reads them, and their lineage holds the whole search.
    """
    events = cut(model_events(features, response, timeagg, separation, quantile))
    lookup = folds.fold_bounds(events, n_folds)
    chosen = features.where(F.col("separation") == separation).join(
        lookup.select(F.col("fieldfold").alias("fold"), F.col("fold").alias("_model")), "fold"
    )
    named = chosen.withColumn("feature", collapse([k for k in FEATURE_KEYS if k != "fold"], "|"))
    named = cut(named.select("_model", "time", "feature", "value"))

    def one(k: int) -> DataFrame | None:
        mine = named.where(F.col("_model") == k)
        if not mine.isEmpty():
            numbers = cut(reduction.numbered(mine))
            return work(k, models.cached(models.training_frame(mine, events, numbers, n_folds, events)), numbers)
        return work(k, models.cached(folds.with_year_fold(events.withColumn("y", F.col("y").cast("double")), n_folds)), None)

    with ThreadPool(min(4, n_folds)) as pool:  # threads submit jobs only
        parts = pool.map(inheritable_thread_target(features.sparkSession)(one), range(n_folds))
    found = [p for p in parts if p is not None]
    return functools.reduce(DataFrame.unionByName, found) if found else None


def forecast(features: DataFrame, response: DataFrame, timeagg: int, separation: int, quantile: float, n_folds: int,
             model=None) -> DataFrame:
    """Out-of-fold probabilities of exceedance for one target aggregation and lead time.

    Where nothing is significant in a fold, the base rate is the forecast.
    """
    model = model or models.Hybrid(greedy_base=True)

    def work(k: int, rows: DataFrame, numbers: DataFrame | None) -> DataFrame:
        return models.one_fold(model if numbers is not None else models.Hybrid(greedy_base=True, base_only=True), rows, k)

    return fold_frames(features, response, timeagg, separation, quantile, n_folds, work)


def _grid(timeaggs: Sequence[int], separations: Sequence[int], quantiles: Sequence[float], one: Callable) -> DataFrame:
    """Union of ``one(timeagg, separation, quantile)`` with the three keys ``respagg, separation, threshold``."""
    parts = []
    for n, s, q in itertools.product(timeaggs, separations, quantiles):
        part = one(n, s, q)
        if part is not None:
            keys = {"respagg": F.lit(n), "separation": F.lit(s), "threshold": F.lit(float(q))}
            parts.append(cut(part.withColumns(keys)))
    return functools.reduce(DataFrame.unionByName, parts)


def forecast_grid(features: DataFrame, response: DataFrame, timeaggs: Sequence[int], separations: Sequence[int],
                  quantiles: Sequence[float], n_folds: int, model=None) -> DataFrame:
    """Forecasts of all target aggregations, lead times and thresholds, each combination written before the next."""
    return _grid(timeaggs, separations, quantiles, lambda n, s, q: forecast(features, response, n, s, q, n_folds, model))


def skill_grid(forecasts: DataFrame) -> DataFrame:
    """Brier skill over the base rate per ``respagg, separation, threshold``, in one aggregation."""
    return verification.brier_skill(forecasts, ["respagg", "separation", "threshold"], reference="base")


def importance_grid(features: DataFrame, response: DataFrame, timeaggs: Sequence[int], separations: Sequence[int],
                    quantile: float, n_folds: int, model=None, path: str | None = None, **kw) -> DataFrame:
    """Permutation importance of every fold's features with their seven keys, ``respagg``, pass, rank and score.

    With ``path`` the frames are stored under ``respagg=/separation=``, where
    :func:`fieldcast.sources.fields.read_importances` finds them.
    """
    model = model or models.Hybrid(greedy_base=True)

    def work(k: int, rows: DataFrame, numbers: DataFrame | None) -> DataFrame | None:
        if numbers is None:
            return None
        names = [r.feature for r in numbers.orderBy("index").collect()]  # candidates of the selection, one fit each
        train, val = rows.where(F.col("fold") != k), rows.where(F.col("fold") == k)
        found = models.fold_importance(model, train, val, names, k, **kw)
        return restore(found, "feature", [key for key in FEATURE_KEYS if key != "fold"], "|")

    out = _grid(timeaggs, separations, [quantile], lambda n, s, q: fold_frames(features, response, n, s, q, n_folds, work))
    if path:
        writer = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("respagg", "separation").parquet(path)
    return out


def anomalies(field: DataFrame) -> DataFrame:
    return daily_anomaly(field)
