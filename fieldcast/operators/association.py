"""Association of a gridded field with one daily target series, per cell, lag and fold."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcast.functions.dates import day_number, in_season
from fieldcast.functions.ranks import average_rank, ordinal_rank, rank_counts, scan
from fieldcast.functions.stats import (
    correlation_pvalue,
    detrend,
    direction_rank,
    finite,
    residual_through_origin,
    weighted_tau,
)
from fieldcast.operators.folds import training_copies, with_year_fold
from fieldcast.operators.temporal import lag_field, past_value
from fieldcast.session import cut, dealt_by_size

GROUP = ["cell", "lag", "fold"]


def prepare_response(series: DataFrame, seasons: Sequence[str] = ("JJA",), past: int | None = None,
                     trend_removed: bool = True) -> DataFrame:
    """Season subset of an aggregated daily series ``(time, y)``, detrended over position.

    ``past`` adds ``y_past``, the value that many days earlier, for partial measures.
    The series holds one row per day, so its windows are calendar-bounded.
    """
    columns = ["y"]
    if past:
        frame = Window.partitionBy(F.lit(0)).orderBy("_day").rangeBetween(-past, -past)
        series = series.withColumn("_day", day_number("time")).withColumn("y_past", F.max("y").over(frame))
        series = series.drop("_day").where(F.col("y_past").isNotNull())
        columns.append("y_past")
    series = series.where(in_season("time", *seasons))
    series = series.withColumns({c: F.col(c).cast("double") for c in columns})
    return detrend(series.withColumn("_one", F.lit(0)), ["_one"], *columns).drop("_one") if trend_removed else series


def one_row_per_day(series: DataFrame) -> DataFrame:
    """Check the size bound of a daily series, and mark it for broadcast.

    With one row a day there are at most as many rows as the calendar has days (a century is
    36,525), whatever the volume the series was computed from.  A day with several rows fails
    at run time: which of them is meant cannot be told.
    """
    names = [c for c in series.columns if c != "time"]
    daily = series.groupBy("time").agg(F.count(F.lit(1)).alias("_rows"), *[F.first(c).alias(c) for c in names])
    single = F.assert_true(F.col("_rows") == 1, F.concat(F.lit("several rows on "), F.col("time").cast("string")))
    return F.broadcast(daily.withColumn("_ok", single).where(F.col("_ok").isNull()).select(*series.columns))


def lag_pairs(field: DataFrame, response: DataFrame, lags: Sequence[int], n_folds: int | None = None,
              partial: int | None = None) -> DataFrame:
    """Detrended training pairs ``(cell, lag, fold, time, x, y)``: the input of any measure.

    The field is written and shuffled once, by cell, into tasks that become more with its rows, lags and folds; fanning out lags and folds and all later windows
    and aggregations keyed by cell reuse that partitioning.  Folds are numbered along time
    (``fieldfold``), which :func:`fieldcast.plans.flows.forecast` maps to those of the models.
    """
    known = cut(field.where(F.col("value").isNotNull()))  # its rows are known before the shuffle
    rows = dealt_by_size(known, known.count() * len(lags) * max(1, (n_folds or 1) - 1), "cell")
    # A constant cell has no correlation; without values its result is NULL, not noise.
    whole = Window.partitionBy("cell")
    varies = F.min("value").over(whole) < F.max("value").over(whole)
    rows = rows.withColumn("value", F.when(varies, F.col("value").cast("double")))
    values = ["x"]
    if partial:
        rows = past_value(rows, partial, "past").where(F.col("past").isNotNull())
        rows = rows.select("cell", "time", F.struct("value", "past").alias("value"))
        values.append("x_past")
    series = with_year_fold(response, n_folds, number="fieldfold") if n_folds else response.withColumn("fold", F.lit(0))
    pairs = lag_field(rows, lags).join(one_row_per_day(series), "time")
    if partial:
        pairs = pairs.withColumns({"x": F.col("value.value"), "x_past": F.col("value.past")})
    else:
        pairs = pairs.withColumn("x", F.col("value"))
    pairs = detrend(pairs.drop("value"), ["cell", "lag"], *values)
    return training_copies(pairs, n_folds) if n_folds else pairs


def _correlate(pairs: DataFrame, x: str, y: str, keys: Sequence[str]) -> DataFrame:
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    out = pairs.groupBy(*keys).agg(r.alias("corr"), F.count(F.lit(1)).alias("n"))
    bounded = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("corr")))  # both skip NULL, hence the guard
    return out.withColumn("corr", F.when(F.col("corr").isNotNull(), bounded))


def pearson(pairs: DataFrame, keys: Sequence[str] = tuple(GROUP)) -> DataFrame:
    return _correlate(pairs, "x", "y", keys)


def spearman(pairs: DataFrame, keys: Sequence[str] = tuple(GROUP)) -> DataFrame:
    """Correlation of tie-averaged ranks; one sort per ranked column."""
    keys = list(keys)
    ranked = pairs.withColumns({"_rx": average_rank(keys, "x"), "_ry": average_rank(keys, "y")})
    return _correlate(ranked, "_rx", "_ry", keys)


def partial_spearman(pairs: DataFrame, keys: Sequence[str] = tuple(GROUP)) -> DataFrame:
    """Spearman of the parts of x and y that their own past values leave unexplained."""
    keys = list(keys)
    residuals = residual_through_origin(pairs, keys, "x", "x_past", "x")
    residuals = residual_through_origin(residuals, keys, "y", "y_past", "y")
    return spearman(residuals, keys)


def _per_series(pairs: DataFrame, keys: Sequence[str], measure: Callable[[np.ndarray, np.ndarray], float]) -> DataFrame:
    """Measure that needs whole series: one Arrow group per (cell, lag, fold), calendar-bounded."""
    keys = list(keys)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(*keys).schema)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("time")
        return pd.DataFrame([[*key, measure(frame["x"].to_numpy(), frame["y"].to_numpy()), len(frame)]])

    out = pairs.select(*keys, "time", "x", "y").groupBy(*keys).applyInPandas(run, f"{schema}, corr double, n bigint")
    return out.withColumn("corr", finite(F.col("corr")))


def kendall_predictand(pairs: DataFrame, keys: Sequence[str] = tuple(GROUP)) -> DataFrame:
    """Weighted tau with the largest target values weighing most."""
    return _per_series(pairs, keys, lambda x, y: weighted_tau(y, x))


def kendall_choice(pairs: DataFrame, keys: Sequence[str] = tuple(GROUP)) -> DataFrame:
    """Weighted tau with weights by x, in the direction given by the sign of Pearson's r."""
    return _per_series(pairs, keys, lambda x, y: weighted_tau(x, y, direction_rank(x, y)))


def composite(pairs: DataFrame, quantile: float, keys: Sequence[str] = tuple(GROUP), given: str = "y", of: str = "x") -> DataFrame:
    """Mean of one series on the days the other exceeds its own quantile."""
    keys = list(keys)
    threshold = F.percentile(F.col(given), F.lit(quantile)).over(Window.partitionBy(*keys))
    exceeding = pairs.withColumn("_q", threshold).where(F.col(given) > F.col("_q"))
    return exceeding.groupBy(*keys).agg(F.avg(of).alias("corr"), F.count(F.lit(1)).alias("n"))


def dependence_curve(pairs: DataFrame, keys: Sequence[str] = tuple(GROUP), quantiles: Sequence[float] | None = None,
                     nq: int = 100) -> DataFrame:
    """chi(q) and chibar(q) of extremal dependence on a quantile grid.

    Without explicit quantiles the grid spans what the pairs can estimate: from just above
    the smallest joint maximum to just below the largest joint minimum.
    """
    keys = list(keys)
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys)) + 1
    u = ordinal_rank(keys, "x", "time") / size
    v = ordinal_rank(keys, "y", "time") / size
    data = pairs.withColumns({"_u": u, "_v": v}).select(
        *keys, F.greatest("_u", "_v").alias("_hi"), F.least("_u", "_v").alias("_lo")
    )
    if quantiles is not None:
        data = data.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
    else:
        eps = 2.0**-52
        whole = Window.partitionBy(*keys)
        start, stop = F.min("_hi").over(whole) + eps, F.max("_lo").over(whole) - eps
        step = (F.col("_stop") - F.col("_start")) / (nq - 1)
        data = data.withColumns({"_start": start, "_stop": stop})
        grid = F.transform(F.sequence(F.lit(0), F.lit(nq - 1)), lambda i: F.col("_start") + i * step)
        data = data.withColumn("q", F.explode(grid))
    curve = data.groupBy(*keys, "q").agg(
        F.avg((F.col("_hi") < F.col("q")).cast("int")).alias("_below"),
        F.avg((F.col("_lo") > F.col("q")).cast("int")).alias("_above"),
    )
    chi = F.when(F.col("_below") > 0, 2 - F.ln("_below") / F.ln("q"))
    chibar = F.when(F.col("_above") > 0, 2 * F.ln(1 - F.col("q")) / F.ln("_above") - 1)
    return curve.select(*keys, "q", chi.alias("chi"), chibar.alias("chibar"))


def chi(pairs: DataFrame, keys: Sequence[str] = tuple(GROUP), quantiles: Sequence[float] | None = None,
        nq: int = 100, dependent_above: float = 0.6) -> DataFrame:
    """chi at the last quantile for asymptotically dependent pairs, else missing."""
    keys = list(keys)
    last = F.max_by(F.struct("chi", "chibar"), "q")
    out = dependence_curve(pairs, keys, quantiles, nq).groupBy(*keys).agg(last.alias("_l"))
    return out.select(*keys, F.when(F.col("_l.chibar") > dependent_above, F.col("_l.chi")).alias("corr"))


# Measures by name; add an entry to plug in another (pairs, keys) -> (keys, corr, n).
MEASURES: dict[str, Callable[..., DataFrame]] = {
    "pearson": pearson,
    "spearman": spearman,
    "partial_spearman": partial_spearman,
    "kendall_predictand": kendall_predictand,
    "kendall_choice": kendall_choice,
    "composite": composite,
    "chi": chi,
}
TESTED = ("pearson", "spearman", "partial_spearman")
FIXED_PVALUE = 1e-9  # Fixed value: stands in where a measure has no significance test.


def associate(field: DataFrame, response: DataFrame, lags: Sequence[int], measure: str | Callable = "spearman",
              n_folds: int | None = None, timeagg: int | None = None, **kw) -> DataFrame:
    """``(cell, lag, fold, corr, n, pvalue)`` of every cell with the target.

    ``response`` comes from :func:`prepare_response`.  Partial measures need ``timeagg``,
    the number of days between a value and its own past.  Constant cells give NULL.
    """
    partial = timeagg if measure == "partial_spearman" else None
    pairs = lag_pairs(field, response, lags, n_folds, partial)
    func = MEASURES[measure] if isinstance(measure, str) else measure
    out = func(pairs, GROUP, **kw)
    if "pvalue" in out.columns:
        return out
    if measure in TESTED:
        return out.withColumn("pvalue", correlation_pvalue(F.col("corr"), F.col("n")))
    return out.withColumn("pvalue", F.when(F.col("corr").isNotNull(), F.lit(FIXED_PVALUE)))


def adjusted_pvalues(tests: DataFrame, keys: Sequence[str], pvalue: str = "pvalue", out: str = "p_adj") -> DataFrame:
    """Benjamini-Hochberg adjusted p-value of each distinct p-value, and its count ``n``.

    It is the smallest ``p m / rank`` among equal or larger p-values, by the two-level scans
    of :mod:`fieldcast.functions.ranks`; no group is sorted in one task, whatever its size.
    """
    keys = list(keys)
    ranked = rank_counts(tests, keys, pvalue, keep_slices=True, even=True)
    ranked = ranked.withColumn("_raw", F.col(pvalue) * F.col("n_total") / F.col("n_upto"))
    table = scan(ranked, keys, pvalue, "_raw", out, how="min", descending=True)
    return table.select(*keys, pvalue, "n", F.least(F.lit(1.0), out).alias(out))


def fdr_threshold(tests: DataFrame, keys: Sequence[str], alpha: float, pvalue: str = "pvalue") -> DataFrame:
    """Largest p-value still rejected per group (NULL when none is), and the group size."""
    ranked = rank_counts(tests, list(keys), pvalue, even=True)
    passed = F.col(pvalue) <= F.col("n_upto") / F.col("n_total") * alpha
    return ranked.groupBy(*keys).agg(
        F.max("n_total").alias("n_tests"), F.max(F.when(passed, F.col(pvalue))).alias("p_cut")
    )


def fdr_mask(tests: DataFrame, keys: Sequence[str], alpha: float, pvalue: str = "pvalue") -> DataFrame:
    """Add ``reject``; tests without a p-value are never rejected and never counted.

    The tests are written once.  The threshold is one of their own p-values, so it must
    meet exactly the number it was taken from, and the association behind them is costly.
    """
    tests = cut(tests)
    limits = fdr_threshold(tests, keys, alpha, pvalue).select(*keys, "p_cut")
    joined = tests.join(limits, list(keys), "left")
    return joined.withColumn("reject", F.coalesce(F.col(pvalue) <= F.col("p_cut"), F.lit(False))).drop("p_cut")


def significant_fractions(tests: DataFrame, keys: Sequence[str], alpha: float, pvalue: str = "pvalue") -> DataFrame:
    """Share of tests below ``alpha`` before and after correction per group."""
    table = adjusted_pvalues(tests, keys, pvalue)

    def share(c: str) -> Column:
        return F.round(F.sum(F.when(F.col(c) < alpha, F.col("n")).otherwise(0)) / F.sum("n"), 5)

    return table.groupBy(*keys).agg(share(pvalue).alias("before"), share("p_adj").alias("after"))


def varying_alpha(timeagg: int) -> float:
    """Significance level that tightens with the aggregation length; its numbers are fixed values."""
    return 5 * 10 ** (-4 - 0.3 * (timeagg - 1))


def precursor_lags(timeagg: int, separations: Sequence[int] = (0, 1, 3, 5, 7, 11, 15, 21, 31)) -> list[int]:
    """Lag 0 plus the lags that leave the given gaps between input and target windows.

    Fixed values: the default separations.
    """
    return [0, *[-timeagg - s for s in separations]]


def masked(associations: DataFrame, alpha: float) -> DataFrame:
    """Correlation field with everything not significant set to NULL."""
    tested = fdr_mask(associations, ["lag", "fold"], alpha)
    return tested.withColumn("corr", F.when(F.col("reject"), F.col("corr")))
