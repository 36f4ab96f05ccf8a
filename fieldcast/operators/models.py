"""Two-stage probabilistic model of exceedances: trend base rate plus random forest.

Training frames hold ``time``, a 0/1 ``y``, a validation ``fold`` and a ``features`` vector.
Fits run on ``pyspark.ml``; predictions stay lazy DataFrames.  The driver only loops over
folds and parameter combinations, both given lists.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from fieldcast.functions.dates import julian_date
from fieldcast.operators.folds import with_year_fold
from fieldcast.operators.reduction import feature_arrays, listed
from fieldcast.operators.verification import evaluate, val_train_ratio
from fieldcast.session import cut

MAX_STEPS = 100  # of Newton's method; a handful is usual.
EPOCH = 2451545.0  # Days are counted from here while they are squared.
MAX_DEPTH = 30  # Spark's limit on tree depth.


def allowed_depth(depth: int) -> int:
    if depth > MAX_DEPTH:
        raise ValueError(f"trees are at most {MAX_DEPTH} deep in pyspark.ml, {depth} was asked for")
    return depth


def training_frame(features_long: DataFrame, response: DataFrame, names: Sequence[str] | DataFrame, n_folds: int,
                   days: DataFrame | None = None) -> DataFrame:
    """Complete feature vectors joined with the 0/1 response and their validation fold.

    ``names`` are the features in the order of the vector: a list, or the table of
    :func:`fieldcast.operators.reduction.numbered`, which takes any number of them.  ``days`` are the days whose years
    make the folds, by default the rows' own.  Frames of one forecast share them, so that a fold means the same years
    whichever features a frame has.
    """
    numbers = names if isinstance(names, DataFrame) else listed(features_long, names)
    arrays = feature_arrays(features_long, numbers)
    vector = array_to_vector(F.col("values").cast("array<double>"))
    rows = arrays.join(response, "time").select("time", F.col("y").cast("double").alias("y"), vector.alias("features"))
    return with_year_fold(rows, n_folds, days)


@dataclass(frozen=True)
class BaseRate:
    """Logistic regression of the event on the standardised date: the trend in base rate.

    A unit L2 penalty on the slope against ``C`` times the summed loss, with a free intercept, solved by Newton's method.
    """

    C: float = 1.0
    mean: float = 0.0
    scale: float = 1.0
    slope: float = 0.0
    intercept: float = 0.0

    def fit(self, rows: DataFrame) -> BaseRate:
        return _newton(self, _by_day(rows.withColumn("fold", F.lit(0))), [-1])[-1]

    def predict(self, time: str = "time") -> Column:
        return 1 / (1 + F.exp(-self.log_odds(time)))

    def log_odds(self, time: str = "time") -> Column:
        return F.lit(self.intercept) + F.lit(self.slope) * (julian_date(time) - F.lit(self.mean)) / F.lit(self.scale)

    @property
    def negative_trend(self) -> bool:
        """A falling base rate is unexpected for a warming target."""
        return self.slope < 0

    def shap(self, rows: DataFrame, background: DataFrame) -> DataFrame:
        """Linear contribution of the date in log odds, and the expectation it departs from."""
        centre = background.agg(F.avg(self.log_odds())).scalar()
        return rows.select("time", (self.log_odds() - centre).alias("shap"), centre.alias("expected"))


def _by_day(rows: DataFrame) -> DataFrame:
    """Rows and events per fold and day: as many rows as the calendar has days."""
    days = rows.where(F.col("y").isNotNull()).groupBy("fold", (julian_date("time") - EPOCH).alias("j"))
    return cut(days.agg(F.count("y").alias("n"), F.sum(F.col("y").cast("double")).alias("events")))


def _newton(base: BaseRate, days: DataFrame, left_out: Sequence[int]) -> dict[int, BaseRate]:
    """The base rate without each of the folds ``left_out``; a step of all of them is one aggregation with a row a fold."""

    def moments(fits: Column, *sums: Column) -> dict[int, tuple]:
        spread = days.select("*", F.explode(fits).alias("m")).where(F.col("fold") != F.col("m.k"))
        spread = spread.withColumn("z", (F.col("j") - F.col("m.mean")) / F.col("m.scale"))
        spread = spread.withColumn("p", 1 / (1 + F.exp(-(F.col("m.b0") + F.col("m.b1") * F.col("z")))))
        return {r[0]: tuple(r)[1:] for r in spread.groupBy("m.k").agg(*sums).collect()}

    def told(state: dict[int, tuple]) -> Column:
        names = ("mean", "scale", "b0", "b1")
        return F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(float(v)).alias(c) for c, v in zip(names, row)]) for k, row in state.items()])

    n, j = F.col("n"), F.col("j")
    found = moments(told({k: (0, 1, 0, 0) for k in left_out}), F.sum(n), F.sum(n * j), F.sum(n * j * j), F.sum("events"))
    if set(found) != set(left_out):
        raise ValueError("a base rate needs rows to be fitted to")
    state, open_fits, done = {}, set(left_out), {}
    for k, (rows, first, second, events) in found.items():
        mean = first / rows
        state[k] = (mean, math.sqrt(max(second / rows - mean * mean, 0.0)) or 1.0, 0.0, 0.0)
        if events in (0, rows):  # nothing to weigh: the chance is 0 or 1 on all days
            done[k] = (*state[k][:2], math.inf if events else -math.inf, 0.0)
            open_fits.discard(k)
    off, w = n * F.col("p") - F.col("events"), n * F.col("p") * (1 - F.col("p"))
    z = F.col("z")
    sums = (F.sum(off), F.sum(off * z), F.sum(w), F.sum(w * z), F.sum(w * z * z))
    for _ in range(MAX_STEPS):
        if not open_fits:
            break
        for k, (g0, g1, h00, h01, h11) in moments(told({k: state[k] for k in sorted(open_fits)}), *sums).items():
            mean, scale, b0, b1 = state[k]
            g1, h11 = g1 + b1 / base.C, h11 + 1 / base.C
            det = h00 * h11 - h01 * h01
            d0, d1 = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
            short = min(1.0, 4 / max(abs(d0), abs(d1), 1e-300))  # steps from a flat part would overshoot
            state[k] = (mean, scale, b0 - short * d0, b1 - short * d1)
            if max(abs(d0), abs(d1)) < 1e-10:
                done[k] = state[k]
                open_fits.discard(k)
    if open_fits:
        raise RuntimeError(f"the base rate has not converged after {MAX_STEPS} steps")
    return {k: replace(base, mean=m + EPOCH, scale=s, intercept=b0, slope=b1) for k, (m, s, b0, b1) in done.items()}


def fold_bases(model, data: DataFrame, n_folds: int, balance_training: str | None = None) -> dict[int, BaseRate]:
    """The base of a hybrid model per validation fold, all fitted together; empty where each fold has to fit its own.

    A greedy base is fitted to all rows, so the folds share it.  Balanced rows differ from fold to fold.
    """
    if not isinstance(model, Hybrid) or (balance_training and not model.greedy_base):
        return {}
    if model.greedy_base:
        return dict.fromkeys(range(n_folds), model.base.fit(data))
    return _newton(model.base, _by_day(data), list(range(n_folds)))


@dataclass(frozen=True)
class Hybrid:
    """Base rate, plus a forest on what it leaves: ``clip(base + forest(features), 0, 1)``."""

    greedy_base: bool = False
    base_only: bool = False
    cap: bool = True
    n_estimators: int = 50
    max_depth: int = 5
    min_samples_split: int = 30
    max_features: int | str = 35
    seed: int = 7
    base: BaseRate = field(default_factory=BaseRate)
    forest: object = None

    def fit(self, train: DataFrame, everything: DataFrame | None = None, base: BaseRate | None = None) -> Hybrid:
        """``everything`` (training plus validation rows) feeds the base only when greedy; a fitted ``base`` stays as it is."""
        if base is None:
            if self.greedy_base and everything is None:
                raise ValueError("a greedy base needs the full data")
            base = self.base.fit(everything if self.greedy_base else train)
        if self.base_only:
            return replace(self, base=base)
        residual = train.withColumn("_target", F.col("y") - base.predict())
        forest = RandomForestRegressor(
            labelCol="_target",
            predictionCol="_anom",
            numTrees=self.n_estimators,
            maxDepth=allowed_depth(self.max_depth),
            minInstancesPerNode=max(1, math.ceil(self.min_samples_split / 2)),
            featureSubsetStrategy=str(self.max_features),
            seed=self.seed,
        ).fit(residual)
        return replace(self, base=base, forest=forest)

    def predict(self, rows: DataFrame) -> DataFrame:
        """Add ``base`` and ``p``."""
        out = rows.withColumn("base", self.base.predict())
        if self.base_only:
            return out.withColumn("p", F.col("base"))
        out = self.forest.transform(out)
        p = F.col("base") + F.col("_anom")
        return out.withColumn("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)) if self.cap else p).drop("_anom")


@dataclass(frozen=True)
class Classifier:
    """Random-forest classifier for a stationary (detrended) response."""

    n_estimators: int = 50
    max_depth: int = 5
    min_samples_split: int = 30
    max_features: int | str = 35
    seed: int = 7
    forest: object = None
    greedy_base: bool = False

    def fit(self, train: DataFrame, everything: DataFrame | None = None) -> Classifier:
        forest = RandomForestClassifier(
            labelCol="y",
            probabilityCol="_prob",
            rawPredictionCol="_raw",
            predictionCol="_class",
            numTrees=self.n_estimators,
            maxDepth=allowed_depth(self.max_depth),
            minInstancesPerNode=max(1, math.ceil(self.min_samples_split / 2)),
            featureSubsetStrategy=str(self.max_features),
            seed=self.seed,
        ).fit(train)
        return replace(self, forest=forest)

    def predict(self, rows: DataFrame) -> DataFrame:
        out = self.forest.transform(rows)
        return out.withColumn("p", vector_to_array("_prob")[1]).drop("_prob", "_raw", "_class")


def balance(train: DataFrame, how: str, seed: int = 7) -> DataFrame:
    """50/50 classes by repeating positives or thinning negatives, positives being fewer.

    A row's number of copies (or its survival) is drawn from a hash of the row, so the
    expected ratio is met without collecting or sorting a class.
    """
    counts = train.agg(F.count_if(F.col("y") > 0).alias("_pos"), F.count_if(F.col("y") == 0).alias("_neg"))
    ratio = counts.select(F.col("_neg") / F.col("_pos")).scalar()
    u = F.pmod(F.xxhash64(F.lit(seed), "time"), F.lit(1_000_000)) / 1_000_000.0
    if how == "oversample":
        whole = F.floor("_ratio")
        copies = F.when(F.col("y") > 0, whole + (u < F.col("_ratio") - whole).cast("int")).otherwise(1)
        return (
            train.withColumn("_ratio", ratio)
            .withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int"))))
            .drop("_copy", "_ratio")
        )
    if how == "undersample":
        return train.withColumn("_ratio", ratio).where((F.col("y") > 0) | (u < 1 / F.col("_ratio"))).drop("_ratio")
    raise ValueError("how should be oversample or undersample")


def _fit(model, train: DataFrame, val: DataFrame, how: str | None, base: BaseRate | None = None):
    rows = balance(train, how) if how else train
    if base is not None:
        return model.fit(rows, base=base)
    return model.fit(rows, train.unionByName(val)) if model.greedy_base else model.fit(rows)


def each_fold(data: DataFrame, n_folds: int, work: Callable[[int, DataFrame, DataFrame], DataFrame],
              parallelism: int = 4) -> DataFrame:
    """Union of ``work(fold, training rows, validation rows)``; fits of different folds overlap.

    The driver's threads only submit jobs, as cross-validation in ``pyspark.ml`` does.
    """
    data = cached(data)

    def one(k: int) -> DataFrame:
        return work(k, data.where(F.col("fold") != k), data.where(F.col("fold") == k))

    with ThreadPool(min(parallelism, n_folds)) as pool:
        parts = pool.map(inheritable_thread_target(data.sparkSession)(one), range(n_folds))
    return functools.reduce(DataFrame.unionByName, parts)


def cached(data: DataFrame) -> DataFrame:
    """Training data read many times by iterative fits, spilling to disk when large."""
    return data.persist(StorageLevel.MEMORY_AND_DISK)


def fit_predict(model, data: DataFrame, n_folds: int, balance_training: str | None = None) -> DataFrame:
    """Out-of-fold predictions ``(fold, time, y, base, p)`` of every row; sort by ``time`` where order matters."""

    data = cached(data)
    bases = fold_bases(model, data, n_folds, balance_training)

    def work(k: int, train: DataFrame, val: DataFrame) -> DataFrame:
        out = _fit(model, train, val, balance_training, bases.get(k)).predict(val)
        return out.select(*[c for c in ("fold", "time", "y", "base", "p") if c in out.columns])

    return each_fold(data, n_folds, work)


def one_fold(model, data: DataFrame, k: int) -> DataFrame:
    """Predictions of a single validation fold."""
    train, val = data.where(F.col("fold") != k), data.where(F.col("fold") == k)
    return _fit(model, train, val, None).predict(val).select("fold", "time", "y", "base", "p")


def fit_predict_holdout(model, train: DataFrame, holdout: DataFrame) -> DataFrame:
    """Fit on one period, predict another."""
    return _fit(model, train, holdout, None).predict(holdout)


def fit_predict_evaluate(model, data: DataFrame, n_folds: int, scores: Sequence[str] = ("brier",),
                         compare_val_train: bool = True, properties_too: bool = False,
                         balance_training: str | None = None) -> DataFrame:
    """Scores per fold on unseen rows, optionally with their ratio to scores on seen rows."""

    data = cached(data)
    bases = fold_bases(model, data, n_folds, balance_training)

    def work(k: int, train: DataFrame, val: DataFrame) -> DataFrame:
        fitted = _fit(model, train, val, balance_training, bases.get(k))
        unseen = evaluate(fitted.predict(val), scores, ["fold"])
        if compare_val_train:
            seen = evaluate(fitted.predict(train).withColumn("fold", F.lit(k)), scores, ["fold"])
            ratios = val_train_ratio(unseen, seen, scores, ["fold"])
            unseen = unseen.join(ratios, "fold")
        if properties_too:
            depth, nodes, leaves = forest_properties(fitted.forest)
            unseen = unseen.withColumns(
                {"max_depth": F.lit(depth), "node_count": F.lit(nodes), "n_leaves": F.lit(leaves)}
            )
        return unseen

    return each_fold(data, n_folds, work)


def hyperparam_evaluation(model, data: DataFrame, grid: dict[str, Sequence], n_folds: int,
                          scores: Sequence[str] = ("brier",), **kw) -> DataFrame:
    """Cross-validated scores of every parameter combination, in long form."""
    data, out = cached(data), []
    for values in itertools.product(*grid.values()):
        params = dict(zip(grid, values))
        part = fit_predict_evaluate(replace(model, **params), data, n_folds, scores, **kw)
        out.append(part.withColumns({k: F.lit(v) for k, v in params.items()}))
    return functools.reduce(DataFrame.unionByName, out)


def forest_properties(forest) -> tuple[float, float, float]:
    """Average depth, number of nodes and number of leaves over the trees."""
    trees = forest.trees
    nodes = [t.numNodes for t in trees]
    n = len(trees)
    return sum(t.depth for t in trees) / n, sum(nodes) / n, sum((k + 1) // 2 for k in nodes) / n


def permuted_scores(model, rows: DataFrame, candidates: Sequence[int], fixed: Sequence[int] = (), draws: int = 10,
                    seed: int = 7) -> DataFrame:
    """Mean Brier score per feature index after permuting that feature's column.

    All features and draws are scored in one job.  A permutation orders the day positions
    by a hash of (seed, draw, feature, position); the permuted value is fetched by an
    equi-join on position, so no column travels through the driver.  ``fixed`` features
    are permuted in every draw (earlier winners of a multi-pass).
    """
    numbered = rows.select(
        (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("time")) - 1).alias("pos"),
        "time", "y", vector_to_array("features").alias("x"),
    )
    draw_ids = F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))
    touched = sorted({*candidates, *fixed})
    cells = numbered.select("pos", F.posexplode("x").alias("j", "v"))
    keyed = cells.where(F.col("j").isin(touched)).select("pos", "j", "v", draw_ids.alias("draw"))
    shuffled = F.row_number().over(
        Window.partitionBy("draw", "j").orderBy(F.xxhash64(F.lit(seed), "draw", "j", "pos"), "pos")
    ) - 1
    # The permutation of feature j under one draw, one entry per day of the series.
    swapped = keyed.select(shuffled.alias("pos"), "draw", "j", "v")
    per_day = swapped.groupBy("pos", "draw").agg(F.map_from_entries(F.collect_list(F.struct("j", "v"))).alias("new"))
    joined = numbered.join(per_day, "pos")
    joined = joined.withColumn("j", F.explode(F.array(*[F.lit(int(c)) for c in candidates])))
    always = F.array(*[F.lit(int(c)) for c in fixed]) if fixed else F.array().cast("array<int>")
    replaced = F.transform(
        "x", lambda v, i: F.when((i == F.col("j")) | F.array_contains(always, i), F.element_at("new", i)).otherwise(v)
    )
    scored = model.predict(joined.select("time", "y", "draw", "j", array_to_vector(replaced).alias("features")))
    per_draw = evaluate(scored, ("brier",), ["j", "draw"])
    return per_draw.groupBy("j").agg(F.avg("brier").alias("score"))


def permutation_importance(model, data: DataFrame, names: Sequence[str], n_folds: int, n_important: int = 8,
                           draws: int = 10, on_validation: bool = True, single_only: bool = False) -> DataFrame:
    """Single-pass and multi-pass ranks and scores ``(fold, feature, pass, rank, score)``.

    Rank 0 is the feature whose permutation costs most.  The multi-pass keeps every winner
    permuted while it searches the next; the driver sees one feature number per step.
    """

    def work(k: int, train: DataFrame, val: DataFrame) -> DataFrame:
        return fold_importance(model, train, val, names, k, n_important, draws, on_validation, single_only)

    return each_fold(data, n_folds, work)


def fold_importance(model, train: DataFrame, val: DataFrame, names: Sequence[str], k: int, n_important: int = 8,
                    draws: int = 10, on_validation: bool = True, single_only: bool = False) -> DataFrame:
    """The importance of one fold, whose features may differ from those of other folds."""
    indices = list(range(len(names)))
    named = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("j") + 1)
    order = Window.partitionBy("fold").orderBy(F.col("score").desc(), "j")
    fitted = _fit(model, train, val, None)
    rows = cached(val if on_validation else train)
    single = permuted_scores(fitted, rows, indices, draws=draws).withColumn("fold", F.lit(k))
    parts = [single.withColumns({"rank": F.row_number().over(order) - 1, "pass": F.lit("singlepass")})]
    fixed: list[int] = []
    while not single_only and len(fixed) < min(n_important, len(names)):
        left = [i for i in indices if i not in fixed]
        best = permuted_scores(fitted, rows, left, fixed, draws).orderBy(F.col("score").desc(), "j").first()
        step = (int(best["j"]), float(best["score"]), k, len(fixed), "multipass")
        parts.append(train.sparkSession.createDataFrame([step], "j int, score double, fold int, rank int, pass string"))
        fixed.append(int(best["j"]))
    steps = [p.select("fold", named.alias("feature"), "pass", "rank", "score") for p in parts]
    return functools.reduce(DataFrame.unionByName, steps)
