"""Registered queries: every operator run over the whole test tables."""

from __future__ import annotations

import datetime as dt
import functools
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcast import session
from fieldcast.catalog import REGIONS, SOIL_LAYER_WEIGHTS, TIMEAGGS
from fieldcast.functions.dates import in_season, input_window, season
from fieldcast.functions.keys import collapse, restore
from fieldcast.functions.ranks import exact_quantile
from fieldcast.functions.stats import detrend
from fieldcast.operators import association as assoc
from fieldcast.operators import climate, clustering, distances, folds, hierarchy, inspection, models, owen, reduction, shapley, temporal, trends, verification
from fieldcast.plans import flows
from fieldcast.sources import adapters as src
from fieldcast.session import dealt_by_size, more_than_usual, shared_folder
from fieldcast.sources import fields, ingest, layout, store
from fieldcast.streaming import ingest as streams
from fieldcast.streaming import ordering

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(func: Query) -> Query:
    REGISTRY[func.__name__] = func
    return func


# --- sources and sinks ---------------------------------------------------------------


@query
def region_scan(spark, d):
    """The field written along the curve and read back inside a box."""
    path = shared_folder(spark, "field")
    layout.write_by_place(src.supplier_field(spark, d).join(src.supplier_points(spark, d), "cell"), path)
    inside = fields.read_field(spark, path, "natlantic", ["cell", "value", "lat", "lon"])
    return inside.groupBy("cell").agg(F.sum("value").alias("total"), F.count("value").alias("ndays"))


@query
def region_cells(spark, d):
    """The same box by a semi join on its cells, for fields without coordinates."""
    inside = fields.region_subset(src.supplier_field(spark, d), src.supplier_points(spark, d), "natlantic")
    return inside.groupBy("cell").agg(F.sum("value").alias("total"), F.count("value").alias("ndays"))


@query
def field_info(spark, d):
    return fields.field_info(src.supplier_field(spark, d))


@query
def drop_empty_cells(spark, d):
    kept = fields.drop_empty_cells(src.supplier_field(spark, d), 500)
    return kept.groupBy("cell").agg(F.count("value").alias("n"))


@query
def one_day(spark, d):
    return fields.one_day(src.flag_field(spark, d), 100)


@query
def mask_cells(spark, d):
    masked_out = src.supplier_points(spark, d).where(F.col("lat") < 40)
    field = temporal.season_filter(src.supplier_field(spark, d), "JJA")
    kept = fields.mask_cells(field, masked_out, keep=False, min_cells=2)
    return kept.groupBy("cell").agg(F.sum("value").alias("total"))


@query
def restore_grid(spark, d):
    points = src.supplier_points(spark, d)
    keys = ["variable", "timeagg", "lag", "fold"]
    labels = src.cluster_fields(spark, d).select(*keys, "cell", F.coalesce("clustid", F.lit(-1)).alias("clustid"))
    return fields.restore_grid(labels.distinct(), points, keys)


@query
def new_feature_keys(spark, d):
    keys = ["fold", "variable", "timeagg", "lag", "separation", "clustid", "metric"]
    imp = src.importances(spark, d)
    stored = imp.where("respagg = 7 and metric = 'mean'")
    return fields.new_keys(imp.select(*keys).distinct(), stored, keys)


@query
def appended_days(spark, d):
    """Cells of a day added by two appends, a third that corrects some, and one that takes a year of a few cells back."""
    path = shared_folder(spark, "store")
    field = src.supplier_field(spark, d)
    store.append_days(field.where("cell % 2 = 0"), path)
    store.append_days(field.where("cell % 2 = 1"), path)
    store.append_days(field.where("cell % 3 = 0 and month(time) = 6").withColumn("value", F.col("value") + 1), path)
    store.append_days(field.where("cell % 7 = 0 and year(time) = 1995").withColumn("value", F.lit(None).cast("bigint")), path)
    store.append_new(field.where("cell % 7 <> 0"), path)  # all there
    return store.read_days(spark, path)


@query
def compacted_days(spark, d):
    path = shared_folder(spark, "store")
    field = src.region_field(spark, d)
    store.append_days(field.where("cell < 3"), path)
    store.append_days(field.where("cell >= 2").withColumn("value", F.col("value") * 2), path)
    store.compact(spark, path)
    store.append_new(field.withColumn("value", F.lit(-1).cast("bigint")), path)
    store.append_days(field.where("cell = 4 and month(time) = 1").withColumn("value", F.lit(0).cast("bigint")), path)
    return store.read_days(spark, path)


@query
def append_manifest(spark, d):
    """Committed parts of a store after appends of cells below and above a limit."""
    path = shared_folder(spark, "store")
    field = src.supplier_field(spark, d)
    for part in ("cell <= 40", "cell > 40", "cell % 10 = 0"):
        store.append_days(field.where(part), path)
    marked = store.clashes(store.manifest(spark, path))
    return marked.select(F.substring("commit", 1, 10).cast("int").alias("number"), "time", "first", "last", "n", "clash")


@query
def common_columns_union(spark, d):
    a = src.flag_field(spark, d).withColumn("only_here", F.lit(1))
    b = src.region_field(spark, d).withColumn("cell", F.col("cell").cast("string"))
    return fields.common_union([a, b]).groupBy("cell").agg(F.sum("value").alias("total"), F.count("value").alias("n"))


@query
def daily_mean(spark, d):
    return ingest.to_daily(src.hourly_events(spark, d), "mean")


@query
def daily_extremes(spark, d):
    hourly = src.hourly_events(spark, d)
    low = ingest.to_daily(hourly, "min").select("cell", "time", F.col("value").alias("low"))
    high = ingest.to_daily(hourly, "max").select("cell", "time", F.col("value").alias("high"))
    return low.join(high, ["cell", "time"])


@query
def hour_slice(spark, d):
    return ingest.to_daily(src.hourly_events(spark, d), "12UTC")


@query
def hour_slice_midnight(spark, d):
    return ingest.to_daily(src.hourly_events(spark, d), "24UTC")


@query
def merge_weighted(spark, d):
    items = src.table(spark, d, "lineitem", "l_suppkey", "l_shipdate", "l_linenumber", "l_extendedprice")
    layer = F.concat(F.lit("swvl"), F.col("l_linenumber").cast("string"))
    layers = items.groupBy(
        F.col("l_suppkey").alias("cell"), F.to_date("l_shipdate").alias("time"), layer.alias("layer")
    ).agg(F.sum(src.cents("l_extendedprice")).alias("value"))
    return ingest.merge_weighted(layers, SOIL_LAYER_WEIGHTS)


@query
def missing_days(spark, d):
    sparse = src.region_field(spark, d)
    return ingest.missing_days(ingest.days_between(sparse), sparse)


@query
def archive_requests(spark, d):
    sparse = src.region_field(spark, d)
    days = ingest.missing_days(ingest.days_between(sparse), sparse)
    return ingest.requests(days, REGIONS["europe"])


@query
def raw_file_days(spark, d):
    events = src.table(spark, d, "events", "event_type", "ts")
    region = F.when(F.col("event_type") == "click", "europe").otherwise("nhmin")
    day = F.date_format("ts", "yyyy-MM-dd")
    name = F.concat_ws("_", F.lit("raw/sst"), region, F.when(F.hour("ts") == 3, F.lit("broken")).otherwise(day))
    files = events.select(F.concat(name, F.lit(".grib")).alias("path")).distinct()
    wanted = ingest.days_between(events.select(F.to_date("ts").alias("time")))
    return ingest.present_raw_days(files, wanted, "europe")


# --- temporal operators --------------------------------------------------------------


@query
def climatology(spark, d):
    return climate.climatology(src.region_field(spark, d))


@query
def climatology_strict(spark, d):
    return climate.climatology(temporal.densify(src.flag_field(spark, d)), strict=True)


@query
def anomaly(spark, d):
    return climate.daily_anomaly(src.supplier_field(spark, d))


@query
def roll5_mean(spark, d):
    return temporal.rolling(src.flag_field(spark, d), 5)


@query
def roll_all_windows(spark, d):
    return temporal.rolling_many(src.flag_field(spark, d), (1, 3, 5, 7, 11, 15, 21, 31))


@query
def roll7_spread(spark, d):
    field = src.region_field(spark, d)
    parts = [temporal.rolling(field, 7, m).withColumnRenamed("value", m) for m in ("min", "max", "sum", "std")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, ["cell", "time"])
    return out.withColumn("std", F.round("std", 4))


@query
def block5_mean(spark, d):
    return temporal.blocks(src.flag_field(spark, d), 5)


@query
def block7_from_day(spark, d):
    return temporal.blocks(src.flag_field(spark, d), 7, "max", dt.date(1996, 3, 1))


@query
def lag_join(spark, d):
    aligned = temporal.lag_align(src.supplier_field(spark, d), src.response(spark, d), [0, -7, -15])
    return aligned.groupBy("cell", "lag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("x"), F.sum("y").alias("y"), F.max("time").alias("last")
    )


@query
def lag_stack(spark, d):
    return temporal.lag_stack(src.region_field(spark, d), [-5, 0, 5])


@query
def past_value(spark, d):
    return temporal.past_value(src.region_field(spark, d), 7, "past")


@query
def season_totals(spark, d):
    field = src.supplier_field(spark, d)
    return field.groupBy("cell", season("time").alias("season"), F.year("time").alias("year")).agg(
        F.sum("value").alias("value")
    )


@query
def season_jja(spark, d):
    return temporal.season_filter(src.region_field(spark, d), "MAM", "JJA")


@query
def month_subset(spark, d):
    kept = temporal.month_filter(src.supplier_field(spark, d), [1, 7])
    return kept.groupBy("cell", F.month("time").alias("month")).agg(F.sum("value").alias("value"))


@query
def detrend_season(spark, d):
    field = temporal.season_filter(src.flag_field(spark, d), "JJA")
    out = detrend(field.withColumn("value", F.col("value").cast("double")), ["cell"], "value")
    return out.withColumn("value", F.round("value", 3))


@query
def axis_gaps(spark, d):
    return temporal.gaps(src.region_field(spark, d))


@query
def yearly_mean(spark, d):
    return temporal.yearly(src.supplier_field(spark, d), "value", ["cell"])


@query
def standardised_date(spark, d):
    out = temporal.standardised_date(src.region_field(spark, d))
    return out.withColumn("z", F.round("z", 8))


@query
def input_windows(spark, d):
    keys = src.importances(spark, d).select("timeagg", "separation").distinct()
    days = src.region_field(spark, d).select("time").distinct()
    windows = keys.agg(F.collect_set(F.struct("timeagg", "separation"))).scalar()  # 8 x 9 given windows
    stamped = days.select("time", F.explode(windows).alias("_w")).select("time", "_w.timeagg", "_w.separation")
    start, end = input_window("time", F.col("separation"), F.col("timeagg"))
    return stamped.select("time", "timeagg", "separation", start.alias("start"), end.alias("end"))


@query
def densified(spark, d):
    return temporal.densify(src.region_field(spark, d))


# --- predicates ----------------------------------------------------------------------


@query
def exceedance_per_cell(spark, d):
    marked = verification.exceedance(src.supplier_field(spark, d), 0.75, keys=["cell"], bounded=True)
    return marked.groupBy("cell").agg(F.count_if("y").alias("n_above"), F.count(F.lit(1)).alias("n"))


@query
def exceedance_other_period(spark, d):
    field = src.flag_field(spark, d)
    early, late = field.where(F.year("time") < 1999), field.where(F.year("time") >= 1999)
    return verification.exceedance(late, 0.666, keys=["cell"], reference=early, bounded=True)


@query
def exceedance_frequency(spark, d):
    items = src.table(spark, d, "lineitem", "l_shipdate", "l_extendedprice")
    rows = items.select(F.to_date("l_shipdate").alias("time"), src.cents("l_extendedprice").alias("value"))
    marked = verification.exceedance(rows, 0.8).withColumn("y", F.col("y").cast("int"))
    return temporal.yearly(marked, "y", out="frequency")


@query
def quantile_cell(spark, d):
    rows = src.table(spark, d, "lineitem", "l_returnflag", "l_extendedprice").select(
        F.col("l_returnflag").alias("cell"), src.cents("l_extendedprice").alias("value")
    )
    return exact_quantile(rows, ["cell"], "value", 0.9)


@query
def complete_rows(spark, d):
    field = src.region_field(spark, d).withColumnRenamed("cell", "feature")
    return reduction.complete_rows(field)


@query
def wide_features(spark, d):
    field = src.flag_field(spark, d).withColumnRenamed("cell", "feature")
    return reduction.wide(field, ["A", "N", "R"])


@query
def feature_vectors(spark, d):
    """Every supplier is a feature; a day's values in one array, printed with gaps."""
    field = src.supplier_field(spark, d).withColumnRenamed("cell", "feature")
    arrays = reduction.feature_arrays(field, reduction.numbered(field), complete=False)
    return arrays.select("time", F.size("values").alias("n"), F.array_join("values", ",", "-").alias("vector"))


@query
def complete_vectors(spark, d):
    field = src.region_field(spark, d).withColumnRenamed("cell", "feature")
    arrays = reduction.feature_arrays(field, reduction.numbered(field))
    return arrays.select("time", F.array_join("values", ",").alias("vector"))


@query
def collapsed_keys(spark, d):
    imp = src.importances(spark, d)
    named = imp.select(collapse(src.IMPORTANCE_KEYS).alias("feature"), "rank")
    back = restore(named, "feature", src.IMPORTANCE_KEYS)
    return back.withColumn("name", collapse(src.IMPORTANCE_KEYS, ignore=("respagg", "lag", "metric")))


# --- reduction -----------------------------------------------------------------------


def _clusters(spark, d):
    points = src.supplier_points(spark, d)
    return points.select("cell", F.when(F.col("cell") % 5 < 4, (F.col("cell") % 5).cast("int")).alias("clustid"))


@query
def cluster_mean(spark, d):
    return reduction.cluster_means(src.supplier_field(spark, d), _clusters(spark, d))


@query
def mean_at_lag(spark, d):
    return reduction.mean_at_lag(src.supplier_field(spark, d), -10)


GRID = 1000 / math.pi


def _on_grid(df: DataFrame, column: str) -> DataFrame:
    """Rounded to multiples of pi / 1000: sums of doubles in another order agree there, as no fraction is halfway between two
    of them, which many are on a decimal or binary grid."""
    return df.withColumn(column, F.floor(F.col(column) * GRID + 0.5) / GRID)


def _patterns(spark, d, *more: str) -> DataFrame:
    """The strongest correlation of each cell, lag and fold over all variables and windows."""
    return src.cluster_fields(spark, d).groupBy("lag", "fold", *more, "cell").agg(F.max("corr").alias("corr"))


@query
def spatial_covariance(spark, d):
    out = reduction.spatial_covariance_lagged(_patterns(spark, d), src.supplier_field(spark, d), ["lag", "fold"])
    return _on_grid(out, "value")


@query
def spatial_covariance_whole_field(spark, d):
    out = reduction.spatial_covariance(_patterns(spark, d), src.supplier_field(spark, d), ["lag", "fold"], mean_over="all")
    return _on_grid(out, "value")


@query
def cluster_features(spark, d):
    clusters = _patterns(spark, d, "clustid").where("corr is not null")
    field = temporal.season_filter(src.supplier_field(spark, d), "MAM", "JJA")
    return _on_grid(reduction.features(field, clusters, "A", 7), "value")


@query
def cluster_counts(spark, d):
    return reduction.cluster_counts(src.cluster_fields(spark, d), ["variable", "timeagg", "lag", "fold"])


@query
def response_aggregates(spark, d):
    series = src.response(spark, d).select(F.lit(0).alias("cell"), "time", F.col("y").alias("value"))
    rolled = temporal.rolling_many(series, (1, 3, 7)).where(in_season("time", "JJA"))
    return rolled.groupBy("time").pivot("timeagg", [1, 3, 7]).agg(F.first("value")).select(
        "time", *[F.col(str(n)).alias(f"y{n}") for n in (1, 3, 7)]
    )


# --- association ---------------------------------------------------------------------


def _pairs(spark, d, lags=(-7, -15), n_folds=None, partial=None, field=None):
    target = assoc.prepare_response(src.response(spark, d), past=partial)
    return assoc.lag_pairs(field if field is not None else src.supplier_field(spark, d), target, lags, n_folds, partial)


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query
def pearson_lag(spark, d):
    return _rounded(assoc.pearson(_pairs(spark, d)), "corr")


@query
def spearman_lag(spark, d):
    target = assoc.prepare_response(src.response(spark, d))
    out = assoc.associate(src.supplier_field(spark, d), target, [-7, -15])
    return _rounded(out, "corr", "pvalue")


@query
def spearman_folds(spark, d):
    return _rounded(assoc.spearman(_pairs(spark, d, (-7,), n_folds=7)), "corr")


@query
def partial_spearman(spark, d):
    pairs = _pairs(spark, d, partial=3, field=temporal.rolling(src.flag_field(spark, d), 3))
    return _rounded(assoc.partial_spearman(pairs), "corr")


@query
def kendall_predictand(spark, d):
    return _rounded(assoc.kendall_predictand(_pairs(spark, d, (-7,))), "corr")


@query
def kendall_choice(spark, d):
    return _rounded(assoc.kendall_choice(_pairs(spark, d, (-7,))), "corr")


@query
def composite(spark, d):
    return _rounded(assoc.composite(_pairs(spark, d), 0.9), "corr", digits=3)


@query
def composite_swapped(spark, d):
    return _rounded(assoc.composite(_pairs(spark, d), 0.9, given="x", of="y"), "corr", digits=3)


@query
def dependence_curve(spark, d):
    pairs = _pairs(spark, d, field=src.flag_field(spark, d))
    return _rounded(assoc.dependence_curve(pairs, quantiles=[0.5, 0.7, 0.8, 0.9]), "chi", "chibar")


@query
def chi(spark, d):
    return _rounded(assoc.chi(_pairs(spark, d, field=src.flag_field(spark, d)), quantiles=[0.9], dependent_above=0.0), "corr")


def _tests(spark, d):
    """Tests with given p-values: a fixed expression of supplier turnover per fold."""
    items = src.table(spark, d, "lineitem", "l_suppkey", "l_linenumber", "l_extendedprice")
    sums = items.groupBy(F.col("l_suppkey").alias("cell"), F.col("l_linenumber").alias("fold")).agg(
        F.sum(src.cents("l_extendedprice")).alias("_s")
    )
    p = F.pow((F.col("_s") % 1000) / 1000.0, F.lit(4.0))
    return sums.select("cell", "fold", (F.col("cell") % 3).alias("lag"), F.round(p, 9).alias("pvalue"))


@query
def fdr_mask(spark, d):
    return assoc.fdr_mask(_tests(spark, d), ["lag", "fold"], 0.05)


@query
def fdr_adjusted(spark, d):
    return assoc.adjusted_pvalues(_tests(spark, d), ["lag", "fold"])


@query
def significant_fractions(spark, d):
    return assoc.significant_fractions(_tests(spark, d), ["lag", "fold"], 0.05)


@query
def masked_association(spark, d):
    target = assoc.prepare_response(src.response(spark, d))
    found = assoc.associate(src.supplier_field(spark, d), target, [-7, -15])
    return _rounded(assoc.masked(found, 0.2), "corr", "pvalue")


@query
def series_properties(spark, d):
    out = verification.series_properties(src.supplier_field(spark, d), months=[6, 7, 8])
    return out.select(
        "cell", "length", "n_nan", *[F.round(c, 3).alias(c) for c in ("std", "mean", "trend")],
        *[F.round(c, 6).alias(c) for c in ("auto1", "auto5")],
    )


# --- folds ---------------------------------------------------------------------------


@query
def year_folds(spark, d):
    return folds.fold_table(src.response(spark, d), 7)


@query
def fold_bounds(spark, d):
    return folds.fold_bounds(temporal.season_filter(src.response(spark, d), "JJA"), 4)


@query
def fold_training_years(spark, d):
    """Years on which the features of a fold are selected, beside those on which the model that takes them validates."""
    target = assoc.prepare_response(src.response(spark, d))
    bounds = flows.fold_training_years(target, 4).select("fold", "fieldfold", "valstart", "valend")
    pairs = assoc.lag_pairs(src.supplier_field(spark, d), target, [-7], 4).withColumnRenamed("fold", "fieldfold")
    leaked = F.col("time").between(F.col("valstart"), F.col("valend"))
    return pairs.join(F.broadcast(bounds), "fieldfold").groupBy("fieldfold", "fold").agg(  # one row a fold
        F.year(F.min("time")).alias("first_selected"), F.year(F.max("time")).alias("last_selected"),
        F.year(F.min("valstart")).alias("first_validated"), F.year(F.max("valend")).alias("last_validated"),
        F.count(F.lit(1)).alias("n_pairs"), F.count_if(leaked).alias("n_leaked"),
    )


@query
def contiguous_folds(spark, d):
    return folds.with_contiguous_fold(src.response(spark, d), 10)


@query
def training_rows(spark, d):
    rows = folds.with_year_fold(src.response(spark, d), 7)
    copies = folds.training_copies(rows, 7)
    return copies.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("total"))


# --- verification --------------------------------------------------------------------


@query
def brier_skill(spark, d):
    return _rounded(verification.brier_skill(src.forecasts(spark, d), ["model"]), "bs", "clim", "bs_ref", "bss")


@query
def brier_skill_reference(spark, d):
    out = verification.brier_skill(src.daily_forecasts(spark, d), reference="base")
    return _rounded(out, "bs", "clim", "bs_ref", "bss")


@query
def regression_scores(spark, d):
    out = verification.evaluate(src.forecasts(spark, d), ("r2", "mse", "mae", "logloss"), ["model"])
    return _rounded(out, "r2", "mse", "mae", "logloss")


@query
def auc(spark, d):
    return _rounded(verification.auc(src.forecasts(spark, d), ["model"]), "auc")


@query
def auc_all(spark, d):
    return _rounded(verification.auc(src.forecasts(spark, d)), "auc")


@query
def kuipers(spark, d):
    return _rounded(verification.kuipers(src.forecasts(spark, d), ["model"]), "kuipers", digits=9)


@query
def pev_grid(spark, d):
    cost_loss = [i / 100 for i in range(1, 100)]
    out = verification.economic_value(src.forecasts(spark, d), [0.1, 0.3, 0.5, 0.7, 0.9], cost_loss)
    return _rounded(out, "pev")


@query
def pev_envelope(spark, d):
    cost_loss = [i / 100 for i in range(1, 100)]
    out = verification.best_value(
        src.forecasts(spark, d), [0.1, 0.3, 0.5, 0.7, 0.9], cost_loss, ["model"], cap_negative=True
    )
    return _rounded(out, "pev")


@query
def reliability(spark, d):
    out = verification.reliability(src.forecasts(spark, d), 10, ["model"])
    return _rounded(out, "mean_predicted", "frequency")


@query
def val_train_ratio(spark, d):
    rows = src.forecasts(spark, d).withColumn("fold", (F.col("id") % 5).cast("int"))
    unseen = verification.evaluate(rows.where("fold = 0"), ("mse", "mae"), ["model"])
    seen = verification.evaluate(rows.where("fold <> 0"), ("mse", "mae"), ["model"])
    return _rounded(verification.val_train_ratio(unseen, seen, ("mse", "mae"), ["model"]), "mse_val/train", "mae_val/train")


@query
def skill_intervals(spark, d):
    return _rounded(verification.bootstrapped_skill(src.daily_forecasts(spark, d)), "q05", "q50", "q95")


@query
def bootstrap_correlation(spark, d):
    draws = verification.bootstrap(src.daily_forecasts(spark, d), ["y", "p"], verification.pearson_statistic, 5000, 15)
    return _rounded(verification.bootstrap_pvalue(draws), "estimate", "pvalue")


# --- inspection ----------------------------------------------------------------------


@query
def scale_within(spark, d):
    out = inspection.scale_within(src.importances(spark, d), ["score", "rank"], fill_na=True)
    return _rounded(out, "score", "rank", digits=9)


@query
def reduce_over(spark, d):
    imp = src.importances(spark, d)
    best = inspection.reduce_over(imp, src.IMPORTANCE_KEYS, ["metric", "clustid"], ["rank"], "max")
    kept = [k for k in src.IMPORTANCE_KEYS if k not in ("metric", "clustid")]
    return inspection.reduce_over(best, kept, "fold", ["rank"], "mean")


@query
def importance_rollup(spark, d):
    return inspection.importance_rollup(src.importances(spark, d), ["respagg", "variable", "timeagg"], "rank", "sum")


@query
def top_features(spark, d):
    return inspection.top_features(src.importances(spark, d), "rank", 10, keys=src.IMPORTANCE_KEYS)


@query
def in_out_kept(spark, d):
    imp = src.importances(spark, d)
    base, other = imp.where("respagg = 7"), imp.where("respagg = 31")
    return inspection.in_out_kept(base, other, "rank", 10, keys=src.IMPORTANCE_KEYS)


@query
def fraction_significant(spark, d):
    return _rounded(inspection.fraction_significant(src.cluster_fields(spark, d)), "fraction", "n_signif", "n", digits=9)


@query
def map_to_fields(spark, d):
    imp = src.importances(spark, d).where("respagg = 7 and metric = 'spatcov'")
    lookup = folds.fold_bounds(src.response(spark, d).where(F.year("time") < 2000), 5)
    return inspection.map_to_fields(imp, "rank", src.cluster_fields(spark, d), lookup)


@query
def accumulate_folds(spark, d):
    imp = src.importances(spark, d).where("respagg = 7 and metric = 'spatcov'")
    painted = inspection.map_to_fields(imp, "rank", src.cluster_fields(spark, d))
    return inspection.accumulate_folds(painted, "mean", 3).withColumn("mean", F.round("mean", 6))


@query
def anomaly_maps(spark, d):
    imp = src.importances(spark, d).where("respagg = 7 and metric = 'mean' and timeagg = 1")
    anoms = src.supplier_field(spark, d).withColumn("variable", F.lit("A"))
    out = inspection.anomaly_maps(imp, anoms, src.cluster_fields(spark, d), dt.date(1998, 7, 14), mask="strict")
    return _rounded(out, "corr")


@query
def feature_counts(spark, d):
    return inspection.feature_counts(src.importances(spark, d))


@query
def global_shap(spark, d):
    imp = src.importances(spark, d)
    shap = imp.select(
        *src.IMPORTANCE_KEYS, F.explode(F.array(F.col("rank") - 300, F.col("rank") % 7)).alias("shap")
    )
    return inspection.global_shap(shap, src.IMPORTANCE_KEYS)


@query
def matching_values(spark, d):
    imp = src.importances(spark, d)
    values = imp.groupBy("variable", "timeagg", "separation").agg(F.sum("rank").alias("x"))
    return inspection.matching(values, imp.select(*src.IMPORTANCE_KEYS), src.IMPORTANCE_KEYS)


@query
def heat_data(spark, d):
    return inspection.heat_data(src.importances(spark, d), "variable", "timeagg", [1, 7, 31], "rank").select(
        "variable", *[F.col(str(n)).alias(f"t{n}") for n in (1, 7, 31)]
    )


@query
def by_separation(spark, d):
    assocs = src.cluster_fields(spark, d)
    parts = [inspection.by_separation(assocs.where(F.col("timeagg") == n).drop("separation", "timeagg"), n) for n in TIMEAGGS]
    return _rounded(functools.reduce(DataFrame.unionByName, parts), "corr")


# --- models --------------------------------------------------------------------------

FEATURE_NAMES = [f"{cell}_{sep}" for cell in ("A", "N", "R") for sep in (0, 7, 15)]
FOREST = dict(n_estimators=10, max_depth=4, min_samples_split=30, max_features=4)


def model_rows(spark, d, n_folds: int = 4) -> DataFrame:
    """Seven-day means of the flag field at three separations against a weekly exceedance."""
    inputs = temporal.rolling(src.flag_field(spark, d), 7)
    lagged = temporal.lag_field(inputs, [-7, -14, -22])
    named = F.concat_ws("_", "cell", (-(F.col("lag") + 7)).cast("string"))
    features = lagged.select("time", named.alias("feature"), "value")
    target = src.response(spark, d).select(F.lit(0).alias("cell"), "time", F.col("y").alias("value"))
    weekly = temporal.season_filter(temporal.rolling(target, 7), "JJA").drop("cell")
    events = verification.exceedance(weekly, 0.666, bounded=True).select("time", F.col("y").cast("int").alias("y"))
    return models.training_frame(features, events, FEATURE_NAMES, n_folds)


@query
def base_rate_forecast(spark, d):
    model = models.Hybrid(base_only=True, greedy_base=True)
    out = models.fit_predict(model, model_rows(spark, d), 4)
    return out.select("fold", "time", F.col("y").cast("int").alias("y"), F.round("p", 4).alias("p"))


@query
def base_rate_folds(spark, d):
    out = models.fit_predict(models.Hybrid(base_only=True), model_rows(spark, d), 4)
    return out.select("fold", "time", F.col("y").cast("int").alias("y"), F.round("p", 6).alias("p"))


@query
def hybrid_forecast(spark, d):
    return models.fit_predict(models.Hybrid(greedy_base=True, **FOREST), model_rows(spark, d), 4)


@query
def classifier_forecast(spark, d):
    return models.fit_predict(models.Classifier(**FOREST), model_rows(spark, d), 4, balance_training="oversample")


@query
def hybrid_scores(spark, d):
    model = models.Hybrid(**FOREST)
    return models.fit_predict_evaluate(model, model_rows(spark, d), 4, ("brier", "mae"), properties_too=True)


@query
def hyperparameters(spark, d):
    grid = {"max_depth": [2, 4], "min_samples_split": [30, 100]}
    small = models.Hybrid(n_estimators=5, max_features=4)
    return models.hyperparam_evaluation(small, model_rows(spark, d, 2), grid, 2, compare_val_train=False)


@query
def permutation_importance(spark, d):
    return models.permutation_importance(
        models.Hybrid(**FOREST), model_rows(spark, d, 2), FEATURE_NAMES, 2, n_important=3, draws=5
    )


@query
def shap_values(spark, d):
    return shapley.compute_shaps(models.Hybrid(**FOREST), model_rows(spark, d, 2), FEATURE_NAMES, 2)


#: Two given trees over quantity, price in cents, discount and tax in percent, and line number: (feature, threshold, left, right).
GIVEN_TREES = (
    (0, 20, (2, 4, 1.0, 3.0), (1, 4_000_000, (0, 35, 2.0, 5.0), 8.0)),
    (3, 3, (1, 2_500_000, 0.0, 4.0), (4, 2, 6.0, (2, 7, 1.0, 9.0))),
)
LINE_NAMES = ["quantity", "price", "discount", "tax", "line"]
LINE_TREE = (((0, 1), 4), (2, 3))


def _given_leaves(tree, path=()):
    if not isinstance(tree, tuple):
        return [shapley.leaf_of(path, tree)]
    feature, threshold, left, right = tree
    return _given_leaves(left, (*path, (feature, True, threshold))) + _given_leaves(right, (*path, (feature, False, threshold)))


def _lines(spark, d):
    """Features of order lines, rows of the same line summed, and those of all rows as the background."""
    percent = {c: F.round(F.col(f"l_{c}") * 100).cast("int") for c in ("discount", "tax")}
    items = src.table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("q"), src.cents("l_extendedprice").alias("c"),
        percent["discount"].alias("d"), percent["tax"].alias("t"),
    )
    lines = items.groupBy("l_orderkey", "l_linenumber").agg(
        F.sum("q").alias("q"), F.sum("c").alias("c"), F.max("d").alias("d"), F.max("t").alias("t")
    )
    x = F.array(*[F.col(c).cast("double") for c in ("q", "c", "d", "t", "l_linenumber")]).alias("x")
    return lines.select("l_orderkey", "l_linenumber", x), items.select(x)


@query
def owen_values(spark, d):
    rows, background = _lines(spark, d)
    leaves = owen.leaf_table(spark, [leaf for tree in GIVEN_TREES for leaf in _given_leaves(tree)])
    return _rounded(owen.owen_values(rows, ["l_orderkey", "l_linenumber"], background, leaves, LINE_TREE, LINE_NAMES), "shap", digits=8)


# --- distances and clustering --------------------------------------------------------


def _marked(spark, d):
    field = temporal.season_filter(src.nation_field(spark, d), "JJA")
    return verification.exceedance(field, 0.75, keys=["cell"], bounded=True)


@query
def jaccard(spark, d):
    return _rounded(distances.jaccard_distances(_marked(spark, d)), "dist", digits=9)


#: Cells of one block of the smooth field, as a power of two.
SMOOTH_BITS = 6


def _smooth_field(spark, d):
    """Sums over eight suppliers in a row, so that neighbours have most of their value in common.

    Rows are dealt by blocks of cells, those of a supplier that counts in the block before to that one too, and summed there: each
    is shuffled about once, not once for each of the eight cells it counts in.
    """
    own, before = F.shiftright("cell", SMOOTH_BITS), F.shiftright(F.col("cell") - 7, SMOOTH_BITS)
    field = src.supplier_rows(spark, d)
    rows = field.count()  # from the files' footers
    if more_than_usual(spark, rows):
        crowd = field.groupBy(own.alias("_block")).count().agg(F.max("count")).first()[0]
        if crowd > session.ROWS:  # a crowded block would keep one task busy, so its days are summed before
            field = src.supplier_field(spark, d)
    placed = field.withColumn("_block", F.explode(F.sequence(before, own)))
    # A task fans its rows out to eight, sums and may pack them; blocks are few, so some tasks get twice the usual number.
    summed = dealt_by_size(placed, 16 * rows, "_block").groupBy("_block", "cell", "time").agg(F.sum("value").alias("value"))
    low = F.shiftleft("_block", SMOOTH_BITS)
    cells = F.sequence(F.greatest(F.col("cell") - 7, low), F.least(F.col("cell"), low + ((1 << SMOOTH_BITS) - 1)))
    spread = summed.select("_block", F.explode(cells).alias("cell"), "time", "value")
    return spread.groupBy("_block", "cell", "time").agg(F.sum("value").alias("value")).drop("_block")


@query
def jaccard_near(spark, d):
    marked = verification.exceedance(temporal.season_filter(_smooth_field(spark, d), "JJA"), 0.75, keys=["cell"], bounded=True)
    return _rounded(distances.jaccard_distances(marked, max_dist=0.65), "dist", digits=9)


@query
def correlation_near(spark, d):
    return _rounded(distances.max_correlation_distances(_smooth_field(spark, d), [-5, 0, 5], max_dist=0.4), "dist")


@query
def max_correlation(spark, d):
    return _rounded(distances.max_correlation_distances(src.nation_field(spark, d), [-5, 0, 5]), "dist")


@query
def haversine_neighbours(spark, d):
    return _rounded(distances.neighbours(src.supplier_points(spark, d), 700.0), "km", digits=3)


@query
def haversine_matrix(spark, d):
    return _rounded(distances.haversine_matrix(src.supplier_points(spark, d), 500.0), "dist", digits=3)


@query
def dbscan(spark, d):
    return clustering.dbscan(src.supplier_points(spark, d), 260.0, 4)


@query
def linkage_merges(spark, d):
    return _rounded(clustering.average_linkage(distances.jaccard_distances(_marked(spark, d))), "height", digits=9)


@query
def linkage_clusters(spark, d):
    marked = _marked(spark, d)
    merges = clustering.average_linkage(distances.jaccard_distances(marked))
    return clustering.cut_tree(merges, marked.select("cell").distinct(), n_clusters=8)


# --- streaming -----------------------------------------------------------------------

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _event_stream(spark, d):
    raw = streams.raw_stream(spark, d, EVENT_SCHEMA, "events.parquet")
    rows = raw.select(F.col("event_type").alias("cell"), "ts", src.cents("value").alias("value"))
    return streams.event_time(rows)


@query
def stream_daily_mean(spark, d):
    return streams.materialise(streams.daily_stream(_event_stream(spark, d)), "complete").drop("complete")


@query
def stream_closed_days(spark, d):
    """Days that end before the last event less the watermark's delay; of later ones some may stay open in state."""
    closed = streams.materialise(streams.daily_stream(_event_stream(spark, d), "max")).drop("complete")
    behind = src.table(spark, d, "events", "ts").agg(F.max("ts") - F.expr("INTERVAL 1 DAY")).scalar()
    return closed.where(F.col("time") + F.expr("INTERVAL 1 DAY") <= behind)


@query
def stream_hour_slice(spark, d):
    return streams.materialise(streams.slice_stream(_event_stream(spark, d), 12)).select("cell", "time", "value")


@query
def stream_midnight_slice(spark, d):
    return streams.materialise(streams.slice_stream(_event_stream(spark, d), 24)).select("cell", "time", "value")


@query
def stream_days_with_gaps(spark, d):
    """Every user's days in order; a gap is given up when the watermark is five days past it."""
    raw = streams.raw_stream(spark, d, EVENT_SCHEMA, "events.parquet")
    rows = streams.event_time(raw.select(F.col("user_id").alias("cell"), "ts", src.cents("value").alias("value")))
    start = src.table(spark, d, "events", "ts").agg(F.to_date(F.min("ts"))).first()[0]
    folder = streams.working_folder(spark)
    ordering.run_ordered(ordering.ordered_days(rows, start, max_wait=5), folder)
    return ordering.results(spark, folder)


@query
def stream_ordered_days(spark, d):
    days = streams.unique_days(_event_stream(spark, d)).withColumn("value", F.lit(1))
    start = src.table(spark, d, "events", "ts").agg(F.to_date(F.min("ts"))).first()[0]
    return streams.materialise(streams.consecutive_days(days, start))


@query
def hdbscan(spark, d):
    keys = ["variable", "timeagg", "lag", "fold"]
    found = src.cluster_fields(spark, d).where("corr is not null").select(*keys, "cell")
    cells = found.join(src.supplier_points(spark, d), "cell")
    return hierarchy.hdbscan(cells, 4, 6, keys, epsilon_rad=0.06, min_points=20)


# --- plot data and alternatives ------------------------------------------------------


@query
def scatter_data(spark, d):
    features = src.region_field(spark, d).withColumn("fold", (F.col("cell") % 4).cast("int"))
    target = temporal.season_filter(src.response(spark, d), "JJA")
    return inspection.scatter_data(features, target, folds.fold_bounds(target, 4))


@query
def forecast_lines(spark, d):
    daily = src.daily_forecasts(spark, d)
    out = inspection.forecast_lines(daily.select("time", "p"), daily.select("time", "y"))
    return _rounded(out, "p")


@query
def shap_data(spark, d):
    field = src.flag_field(spark, d).withColumnsRenamed({"cell": "variable"})
    shap = field.select("variable", F.lit(-7).alias("lag"), "time", (F.col("value") % 100 - 50).alias("shap"))
    inputs = temporal.rolling(field, 7, keys=["variable"])
    return inspection.shap_data(shap, inputs, ["variable", "lag"])


@query
def dot_data(spark, d):
    imp = src.importances(spark, d)
    kept = [k for k in src.IMPORTANCE_KEYS if k not in ("metric", "clustid", "lag", "fold")]
    reduced = inspection.reduce_over(imp, src.IMPORTANCE_KEYS, ["metric", "clustid", "lag", "fold"], ["rank"], "max")
    return inspection.dot_data(reduced.select(*kept, "rank"), "rank")


@query
def grid_edges(spark, d):
    return inspection.grid_edges(src.supplier_points(spark, d), 0.25)


@query
def stationary_base_rate(spark, d):
    return inspection.base_rate(src.response(spark, d), 0.75)


@query
def series_trend(spark, d):
    out = verification.series_properties(src.supplier_field(spark, d), scale=True, auto_corr_at=[])
    return out.select("cell", F.round("trend", 6).alias("trend"), F.round("intercept", 3).alias("intercept"))


@query
def centroid_clusters(spark, d):
    return clustering.centroid_clusters(src.supplier_points(spark, d), [3, 5])


@query
def loess_detrend(spark, d):
    return trends.loess_detrend(temporal.season_filter(src.flag_field(spark, d), "JJA"))


@query
def quantile_detrend(spark, d):
    return trends.quantile_detrend(temporal.season_filter(src.flag_field(spark, d), "JJA"))
