"""Forecast verification: scores, economic value, reliability, skill and its uncertainty."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcast.functions.dates import day_number
from fieldcast.functions.ranks import bounded_quantile, exact_quantile, rank_counts
from fieldcast.functions.stats import t_two_sided
from fieldcast.operators import resampling
from fieldcast.operators.resampling import Statistic


def _y() -> Column:
    return F.col("y").cast("double")


def scores() -> dict[str, Column]:
    """Scores of outcomes ``y`` (0/1 or real) and predictions ``p``, each one combining aggregate."""
    y, p = _y(), F.col("p")
    clipped = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), p))
    return {
        "brier": F.avg((p - y) * (p - y)),
        "mse": F.avg((p - y) * (p - y)),
        "mae": F.avg(F.abs(p - y)),
        "r2": 1 - F.try_divide(F.sum((p - y) * (p - y)), F.var_pop(y) * F.count(y)),
        "logloss": -F.avg(y * F.ln(clipped) + (1 - y) * F.ln(1 - clipped)),
        "bias": F.avg(p - y),
    }


def evaluate(predictions: DataFrame, chosen: Sequence[str] | dict[str, Column] = ("r2", "mse", "mae"),
             keys: Sequence[str] = ()) -> DataFrame:
    """Named scores per group; pass name -> aggregate Column for others."""
    known = scores()
    chosen = chosen if isinstance(chosen, dict) else {s: known[s] for s in chosen}
    return predictions.groupBy(*keys).agg(*[c.alias(n) for n, c in chosen.items()])


def brier_climatology(p: Column | float) -> Column:
    """Brier score of always forecasting the event frequency p."""
    p = F.lit(p) if isinstance(p, float) else p
    return p * (p - 1) * (p - 1) + (1 - p) * p * p


def skill(reference: Column, model: Column, perfect: float = 0.0) -> Column:
    return F.try_divide(reference - model, reference - F.lit(perfect))


def brier_skill(predictions: DataFrame, keys: Sequence[str] = (), reference: str | None = None) -> DataFrame:
    """Brier score and its skill over climatology, or over a reference forecast column."""
    y, p = _y(), F.col("p")
    out = predictions.groupBy(*keys).agg(
        F.avg((p - y) * (p - y)).alias("bs"),
        F.avg(y).alias("clim"),
        (F.avg((F.col(reference) - y) * (F.col(reference) - y)) if reference else F.lit(None).cast("double")).alias("_r"),
    )
    out = out.withColumn("bs_ref", F.col("_r") if reference else brier_climatology(F.col("clim")))
    return out.withColumn("bss", skill(F.col("bs_ref"), F.col("bs"))).drop("_r")


def auc(predictions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve as a rank sum; works on groups of any size."""
    keys = list(keys)
    ranked = rank_counts(predictions, keys, "p", positives=F.sum(F.col("y").cast("bigint")))
    average = F.col("n_upto") - (F.col("n") - 1) / 2
    sums = ranked.groupBy(*keys).agg(
        F.sum(average * F.col("positives")).alias("_r"),
        F.sum("positives").alias("_p"),
        F.sum("n").alias("_n"),
    )
    negatives = F.col("_n") - F.col("_p")
    area = F.try_divide(F.col("_r") - F.col("_p") * (F.col("_p") + 1) / 2, F.col("_p") * negatives)
    return sums.select(*keys, area.alias("auc"))


def contingency(predictions: DataFrame, threshold: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Hits, misses, false alarms and correct rejections of ``p > threshold``."""
    yes, event = F.col("p") > threshold, F.col("y").cast("int") == 1
    return predictions.groupBy(*keys).agg(
        F.count_if(yes & event).alias("tp"),
        F.count_if(~yes & event).alias("fn"),
        F.count_if(yes & ~event).alias("fp"),
        F.count_if(~yes & ~event).alias("tn"),
    )


def _with_frequency(predictions: DataFrame, keys: Sequence[str], clim: float | None) -> DataFrame:
    if clim is not None:
        return predictions.withColumn("clim", F.lit(clim))
    freq = predictions.groupBy(*keys).agg(F.avg(_y()).alias("clim"))
    if keys:
        return predictions.join(freq, list(keys))
    return predictions.withColumn("clim", freq.scalar())


def kuipers(predictions: DataFrame, keys: Sequence[str] = (), clim: float | None = None) -> DataFrame:
    """Largest attainable economic value: hit rate minus false-alarm rate at the base rate."""
    table = contingency(_with_frequency(predictions, keys, clim), F.col("clim"), keys)
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    return table.select(*keys, F.try_divide(tp * tn - fp * fn, (fn + tp) * (fp + tn)).alias("kuipers"))


def _literal(values: Sequence[float]) -> Column:
    """A constant array from one literal; folded once by the optimizer, cheap to build."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def economic_value(predictions: DataFrame, thresholds: Sequence[float], cost_loss: Sequence[float],
                   keys: Sequence[str] = (), clim: float | None = None, cap_negative: bool = False) -> DataFrame:
    """Potential economic value for every probability threshold and cost/loss ratio.

    Forecasts are first counted per (group, number of thresholds exceeded): a single
    combining pass whatever the size of the grid.  Thresholds and ratios only fan out the
    resulting few counts.
    """
    if max(*thresholds, *cost_loss) >= 1:
        raise ValueError("thresholds and cost/loss ratios should be below one")
    keys = list(keys)
    grid = _literal(sorted(thresholds))
    exceeded = functools.reduce(Column.__add__, [(F.col("p") > float(t)).cast("int") for t in sorted(thresholds)])
    counted = predictions.groupBy(*keys, exceeded.alias("_k")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col("y").cast("bigint")).alias("_e")
    )
    fanned = counted.select(*keys, "_k", "_n", "_e", F.posexplode(grid).alias("_i", "p_thresh"))
    yes = F.col("_k") > F.col("_i")
    table = fanned.groupBy(*keys, "p_thresh").agg(
        F.sum(F.when(yes, F.col("_e")).otherwise(0)).alias("tp"),
        F.sum(F.when(yes, F.col("_n") - F.col("_e")).otherwise(0)).alias("fp"),
        F.sum("_e").alias("_pos"),
        F.sum("_n").alias("_all"),
    )
    table = table.withColumn("cl", F.explode(_literal(cost_loss)))
    base = F.lit(clim) if clim is not None else F.col("_pos") / F.col("_all")
    table = table.withColumns(
        {
            "_c": base,
            "_h": F.try_divide("tp", "_pos"),
            "_f": F.try_divide(F.col("fp"), F.col("_all") - F.col("_pos")),
        }
    )
    fixed = F.least("cl", "_c")
    gain = fixed - F.col("_f") * F.col("cl") * (1 - F.col("_c")) + F.col("_h") * F.col("_c") * (1 - F.col("cl")) - F.col("_c")
    value = F.try_divide(gain, fixed - F.col("_c") * F.col("cl"))
    return table.select(*keys, "p_thresh", "cl", (F.when(value < 0, F.lit(0.0)).otherwise(value) if cap_negative else value).alias("pev"))


def best_value(predictions: DataFrame, thresholds: Sequence[float], cost_loss: Sequence[float],
               keys: Sequence[str] = (), **kw) -> DataFrame:
    """Value over thresholds at its best for each user, i.e. the envelope of the curves."""
    values = economic_value(predictions, thresholds, cost_loss, keys, **kw)
    return values.groupBy(*keys, "cl").agg(F.max("pev").alias("pev"))


def reliability(predictions: DataFrame, nbins: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Mean forecast, observed frequency and count per probability bin; empty bins absent."""
    edge = F.least(F.floor(F.col("p") * nbins), F.lit(nbins - 1)).cast("int")
    return predictions.groupBy(*keys, edge.alias("bin")).agg(
        F.avg("p").alias("mean_predicted"), F.avg(_y()).alias("frequency"), F.count(F.lit(1)).alias("n")
    )


def exceedance(series: DataFrame, q: float, value: str = "value", keys: Sequence[str] = (),
               reference: DataFrame | None = None, bounded: bool = False) -> DataFrame:
    """Add ``y``: whether the value lies above the exact quantile of its group.

    The threshold may come from another period's ``reference`` rows.  ``bounded`` groups,
    such as the series of one cell, are small enough for a plain percentile aggregate.
    """
    keys = list(keys)
    quantile = bounded_quantile if bounded else exact_quantile
    cut = quantile(reference if reference is not None else series, keys, value, q)
    if keys:
        joined = series.join(cut, keys)
    else:
        joined = series.withColumn("threshold", cut.scalar())
    return joined.withColumn("y", F.coalesce(F.col(value) > F.col("threshold"), F.lit(False))).drop("threshold")


def val_train_ratio(validation: DataFrame, training: DataFrame, scores: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Score on unseen data over score on seen data."""
    seen = training.select(*keys, *[F.col(s).alias(f"_{s}") for s in scores])
    joined = validation.join(seen, list(keys))
    return joined.select(*keys, *[F.try_divide(s, f"_{s}").alias(f"{s}_val/train") for s in scores])


def _packed(series: DataFrame, columns: Sequence[str], keys: Sequence[str], order: str = "time") -> DataFrame:
    """One row per group holding its daily series in order.

    Only for series with one row per day, which bounds a group by the calendar; a day with
    several rows fails the query.
    """
    rows = F.sort_array(F.collect_list(F.struct(order, *[F.col(c).cast("double").alias(c) for c in columns])))
    packed = series.groupBy(*keys).agg(rows.alias("_rows"))
    days = F.array_distinct(F.transform("_rows", lambda r: r[order]))
    ok = F.assert_true(F.size("_rows") == F.size(days), "bootstrap needs a daily series, one row per day")
    return packed.withColumn("_ok", ok).where(F.col("_ok").isNull()).drop("_ok")


def bootstrap(series: DataFrame, columns: Sequence[str], statistic: Statistic | Callable[[np.ndarray], float], n_draws: int,
              blocksize: int | None = None, keys: Sequence[str] = (), seed: int = 7, draws_per_task: int = 250) -> DataFrame:
    """``(keys, draw, stat)``: the statistic of resampled daily series.

    Rows, or non-overlapping blocks of consecutive rows, are drawn with replacement.  A
    :class:`~fieldcast.operators.resampling.Statistic` is computed from sums of blocks.  A
    function of the resampled rows is for what sums do not determine: there draws spread
    over tasks in chunks, each with the whole series of a group.
    """
    keys, columns = list(keys), list(columns)
    if isinstance(statistic, Statistic):
        return resampling.bootstrap(series, columns, statistic, n_draws, (blocksize,), keys, seed).drop("blocksize")
    packed = _packed(series, columns, keys)
    chunks = F.sequence(F.lit(0), F.lit((n_draws - 1) // draws_per_task))
    tasks = packed.withColumn("_chunk", F.explode(chunks)).repartition(*keys, "_chunk")
    key_ddl = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in series.select(*keys).schema)

    def run(frames):
        for frame in frames:
            for row in frame.to_dict("records"):
                data = np.array([[r[c] for c in columns] for r in row["_rows"]], float)
                starts = np.arange(0, len(data), blocksize or 1)
                lo = row["_chunk"] * draws_per_task
                out = []
                for draw in range(lo, min(lo + draws_per_task, n_draws)):
                    picked = np.random.default_rng([seed, draw]).integers(0, len(starts), len(starts))
                    if blocksize:
                        index = np.concatenate([np.arange(s, min(s + blocksize, len(data))) for s in starts[picked]])
                    else:
                        index = picked
                    out.append([*[row[k] for k in keys], draw, float(statistic(data[index]))])
                yield pd.DataFrame(out, columns=[*keys, "draw", "stat"])

    return tasks.mapInPandas(run, f"{key_ddl}draw int, stat double")


def bootstrap_quantiles(draws: DataFrame, quantiles: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Quantiles of the bootstrap distribution; draws without a value are left out."""
    valid = draws.where(F.col("stat").isNotNull() & ~F.isnan("stat"))
    columns = [F.percentile("stat", F.lit(float(q))).alias("q" + f"{q:.2f}"[2:]) for q in quantiles]
    return valid.groupBy(*keys).agg(*columns)


def bootstrap_pvalue(draws: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of the draws and the two-sided p-value of zero under a t distribution.

    Scale is the spread of the draws; degrees of freedom are the number of draws less two.
    """
    out = draws.groupBy(*keys).agg(
        F.avg("stat").alias("estimate"), F.stddev_pop("stat").alias("_s"), F.count("stat").alias("_n")
    )
    p = t_two_sided(F.col("estimate") / F.col("_s"), (F.col("_n") - 2).cast("double"))
    return out.select(*keys, "estimate", p.alias("pvalue"))


#: Skill of column 2 over the reference forecast in column 1 against outcomes in column 0.
brier_skill_statistic = resampling.BRIER_SKILL
pearson_statistic = resampling.PEARSON


def bootstrapped_skill(predictions: DataFrame, blocksizes: Sequence[int | None] = (None, 5, 15, 30, 60),
                       quantiles: Sequence[float] = (0.05, 0.5, 0.95), n_draws: int = 5000,
                       keys: Sequence[str] = ()) -> DataFrame:
    """Skill-score intervals per block size from columns ``y``, ``base`` and ``p``; all block sizes in one pass."""
    draws = resampling.bootstrap(predictions, ["y", "base", "p"], brier_skill_statistic, n_draws, blocksizes, keys)
    return bootstrap_quantiles(draws, quantiles, [*keys, "blocksize"])


def _correlation(x: Column, y: Column) -> Column:
    """Pearson correlation, NULL for a constant series; both columns NULL on the same rows."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def series_properties(series: DataFrame, keys: Sequence[str] = ("cell",), months: Sequence[int] | None = None,
                      auto_corr_at: Sequence[int] = (1, 5), scale: bool = False, value: str = "value") -> DataFrame:
    """Mean, spread, length, missing count, yearly trend and autocorrelation at day lags.

    The value k days later is read by a one-day calendar frame, so every autocorrelation
    uses exactly the pairs of days that both exist, without a self-join.
    """
    keys = list(keys)
    rows = series if months is None else series.where(F.month("time").isin(*months))
    counted = rows.groupBy(*keys).agg(
        F.stddev_samp(value).alias("std"),
        F.avg(value).alias("mean"),
        F.count(F.lit(1)).alias("length"),
        F.count_if(F.col(value).isNull()).alias("n_nan"),
        F.stddev_pop(value).alias("_sp"),
    )
    valid = rows.where(F.col(value).isNotNull()).withColumns(
        {"_day": day_number("time"), "_year": F.year("time").cast("double"), "_v": F.col(value).cast("double")}
    )
    base = Window.partitionBy(*keys).orderBy("_day")
    valid = valid.withColumns({f"_a{k}": F.max("_v").over(base.rangeBetween(k, k)) for k in auto_corr_at})
    fits = valid.groupBy(*keys).agg(
        F.regr_slope("_v", "_year").alias("trend"),
        F.regr_intercept("_v", "_year").alias("intercept"),
        *[
            _correlation(F.when(F.col(f"_a{k}").isNotNull(), F.col("_v")), F.col(f"_a{k}")).alias(f"auto{k}")
            for k in auto_corr_at
        ],
    )
    out = counted.join(fits, keys)
    if scale:
        out = out.withColumns(
            {"trend": F.col("trend") / F.col("_sp"), "intercept": (F.col("intercept") - F.col("mean")) / F.col("_sp")}
        )
    return out.drop("_sp")
