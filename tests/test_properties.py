"""Known answers and invariants on small seeded fixtures."""

import datetime as dt
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldcast.catalog import REGIONS, grid
from fieldcast.functions import ranks, stats
from fieldcast.functions.geo import EARTH_RADIUS_KM
from fieldcast.operators import association as assoc
from fieldcast.operators import climate, clustering, distances, folds, hierarchy, temporal, verification
from fieldcast.sources import fields
from fieldcast.streaming import ingest as streams

DAY0 = dt.date(2000, 1, 1)


def days(n, start=DAY0):
    return [start + dt.timedelta(days=i) for i in range(n)]


def field(spark, columns, start=DAY0, dtype="double"):
    rows = [(c, d, v) for c, vs in columns.items() for d, v in zip(days(len(vs), start), vs)]
    return spark.createDataFrame(rows, f"cell int, time date, value {dtype}")


def test_blocks_and_rolling_of_eleven_days(spark):
    f = field(spark, {0: [float(i) for i in range(11)]})
    blocks = {r.time: r.value for r in temporal.blocks(f, 3).collect()}
    assert blocks == {DAY0: 1.0, dt.date(2000, 1, 4): 4.0, dt.date(2000, 1, 7): 7.0}
    rolled = {r.time: r.value for r in temporal.rolling(f, 3).collect()}
    assert rolled == {d: i + 1.0 for i, d in enumerate(days(9))}
    assert temporal.blocks(f, 3, firstday=dt.date(2000, 1, 4)).count() == 2
    many = temporal.rolling_many(f, (1, 3)).where("timeagg = 3")
    assert {r.time: r.value for r in many.collect()} == rolled


def test_lag_moves_values_ahead(spark):
    f = field(spark, {0: [1.0]})
    moved = temporal.lag_field(f, [-10]).first()
    assert moved.time == dt.date(2000, 1, 11)


def test_contiguity_is_checked(spark):
    f = field(spark, {0: [1.0, 2.0, 3.0]})
    assert temporal.assert_contiguous(f).count() == 3
    with pytest.raises(Exception, match="contiguous"):
        temporal.assert_contiguous(f.where(F.col("value") != 2)).collect()


def test_climatology_window_is_ten_days(spark):
    n = 366 * 12
    f = field(spark, {0: [1] * n}, dtype="bigint").withColumn("value", F.dayofyear("time").cast("bigint"))
    clim = {r.doy: r.clim for r in climate.climatology(f).collect()}
    assert clim[100] == pytest.approx(np.mean(np.arange(95, 105)))
    assert len(clim) == 366


def test_all_missing_quantile_is_absent(spark):
    f = field(spark, {0: [None] * 5, 1: [1.0] * 5})
    out = {r.cell: r.threshold for r in ranks.exact_quantile(f, ["cell"], "value", 0.5).collect()}
    assert out == {1: 1.0}


@pytest.mark.parametrize("q", [0.0, 0.31, 0.5, 0.9, 1.0])
def test_exact_quantile_on_skewed_groups(spark, q):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=500), np.full(300, 0.25), rng.lognormal(8, 3, size=100), [1e12]])
    rows = [(0, float(v)) for v in values] + [(1, 3.0)]
    df = spark.createDataFrame(rows, "g int, v double")
    out = {r.g: r.threshold for r in ranks.exact_quantile(df, ["g"], "v", q).collect()}
    assert out[0] == pytest.approx(np.quantile(values, q), rel=1e-12)
    assert out[1] == 3.0
    assert ranks.exact_quantile(df.where("g = 0"), [], "v", q).first().threshold == pytest.approx(out[0])


def test_rank_counts_match_numpy(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(0, 50, 400)
    df = spark.createDataFrame([(0, int(x)) for x in v], "g int, v int")
    for r in ranks.rank_counts(df, ["g"], "v").collect():
        assert (r.n, r.n_upto, r.n_total) == ((v == r.v).sum(), (v <= r.v).sum(), 400)


def test_fdr_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    p = np.round(np.concatenate([rng.random(300), rng.random(40) ** 6, np.full(100, 1e-9)]), 12)
    df = spark.createDataFrame([(i, 0, float(x)) for i, x in enumerate(p)], "cell int, fold int, pvalue double")
    order = np.sort(p)
    m = len(p)
    passed = np.nonzero(order <= 0.05 * np.arange(1, m + 1) / m)[0]
    cut = order[passed.max()]
    got = {r.cell: r.reject for r in assoc.fdr_mask(df, ["fold"], 0.05).collect()}
    assert got == {i: bool(x <= cut) for i, x in enumerate(p)}
    adjusted = np.minimum.accumulate((order * m / np.arange(1, m + 1))[::-1])[::-1]
    table = {r.pvalue: r.p_adj for r in assoc.adjusted_pvalues(df, ["fold"]).collect()}
    for x, a in zip(order, adjusted):
        assert table[x] <= a + 1e-15
    assert table[order[-1]] == pytest.approx(min(1, adjusted[-1]))


def test_student_tail_known_values(spark):
    t = [2.0, 0.0, 12.706204736, 2.228138852, 40.0]
    dof = [98.0, 5.0, 1.0, 10.0, 30.0]
    df = spark.createDataFrame(list(zip(t, dof)), "t double, d double")
    got = [r[0] for r in df.select(stats.t_two_sided("t", "d")).collect()]
    assert got[:4] == pytest.approx([0.0482678, 1.0, 0.05, 0.05], rel=1e-5)
    assert 0 < got[4] < 1e-25


def test_weighted_tau_perfect_and_reverse():
    x = np.arange(20.0)
    assert stats.weighted_tau(x, x) == pytest.approx(1)
    assert stats.weighted_tau(x, -x) == pytest.approx(-1)


def test_trend_is_removed_before_association(spark):
    rng = np.random.default_rng(4)
    n = 1000
    y = rng.random(n)
    start = dt.date(1990, 1, 1)
    # A little noise on the pure trend keeps its correlation defined after detrending.
    trend = [float(i + e) for i, e in enumerate(rng.normal(size=n))]
    f = field(spark, {0: trend, 1: [float(i + 1000 * v) for i, v in enumerate(y)]}, start)
    target = spark.createDataFrame([(d, float(v)) for d, v in zip(days(n, start), y)], "time date, y double")
    target = assoc.prepare_response(target, seasons=("DJF", "MAM", "JJA", "SON"), trend_removed=False)
    out = {r.cell: r for r in assoc.associate(f, target, [0], "pearson").collect()}
    assert abs(out[0].corr) < 0.1 and out[0].pvalue > 0.05
    assert out[1].corr > 0.9 and out[1].pvalue < 1e-9


def test_constant_cell_has_no_association(spark):
    f = field(spark, {0: [5.0] * 200}, dt.date(2000, 6, 1))
    y = spark.createDataFrame([(d, float(i % 7)) for i, d in enumerate(days(200, dt.date(2000, 6, 1)))], "time date, y double")
    out = assoc.associate(f, assoc.prepare_response(y), [0]).first()
    assert out.corr is None and out.pvalue is None


def test_fold_training_rows_partition_the_data(spark):
    s = spark.createDataFrame([(d, i) for i, d in enumerate(days(100))], "time date, y int")
    s = folds.with_contiguous_fold(s, 10)
    total = sum(range(100))
    train = {r.fold: r.t for r in folds.training_copies(s, 10).groupBy("fold").agg(F.sum("y").alias("t")).collect()}
    val = {r.fold: r.t for r in s.groupBy("fold").agg(F.sum("y").alias("t")).collect()}
    assert all(train[k] + val[k] == total for k in range(10))
    assert len(set(val.values())) == 10


def test_year_groups_must_make_the_folds(spark):
    s = spark.createDataFrame([(dt.date(1995 + y, 7, 1), 1) for y in range(7)], "time date, y int")
    assert folds.fold_table(s, 4).select("fold").distinct().count() == 4
    with pytest.raises(Exception, match="folds"):
        folds.fold_table(s, 5).collect()


def test_bootstrap_draws_and_block_width(spark):
    rng = np.random.default_rng(5)
    x = [0.0]
    for _ in range(80):
        x.append(0.7 * x[-1] + rng.normal(0, 0.7))
    s = spark.createDataFrame(list(zip(days(81), x)), "time date, x double")
    width = {}
    for size in (None, 5):
        draws = verification.bootstrap(s, ["x"], lambda a: float(a.mean()), 1000, size)
        assert draws.count() == 1000
        q = verification.bootstrap_quantiles(draws, [0.1, 0.9]).first()
        width[size] = q.q90 - q.q10
    assert width[5] > width[None]
    again = verification.bootstrap(s, ["x"], lambda a: float(a.mean()), 10)
    assert again.collect() == again.collect()


def test_bootstrap_pvalue_is_close_to_parametric(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=500), rng.normal(size=500)
    s = spark.createDataFrame([(d, float(x), float(y)) for d, x, y in zip(days(500), a, b)], "time date, x double, y double")
    draws = verification.bootstrap(s, ["x", "y"], verification.pearson_statistic, 2000)
    out = verification.bootstrap_pvalue(draws).first()
    r = np.corrcoef(a, b)[0, 1]
    assert out.estimate == pytest.approx(r, abs=0.005)
    assert 0 <= out.pvalue <= 1


def test_normal_series_properties(spark):
    rng = np.random.default_rng(7)
    f = field(spark, {0: [float(v) for v in rng.normal(size=10000)]})
    out = verification.series_properties(f).first()
    assert (out["std"], out["mean"], out.auto1, out.trend) == pytest.approx((1, 0, 0, 0), abs=0.05)
    assert out.length == 10000


def test_perfect_and_useless_forecasts(spark):
    rows = [(i, i % 2, float(i % 2), 0.5) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, y int, p double, base double")
    assert verification.auc(df).first().auc == 1.0
    assert verification.kuipers(df).first().kuipers == 1.0
    assert verification.brier_skill(df).first().bss == 1.0
    flat = df.withColumn("p", F.lit(0.5))
    assert verification.brier_skill(flat).first().bss == pytest.approx(0.0)


def _haversine(a, b):
    p, q = np.radians(a), np.radians(b)
    h = np.sin((p[0] - q[0]) / 2) ** 2 + np.cos(p[0]) * np.cos(q[0]) * np.sin((p[1] - q[1]) / 2) ** 2
    return 2 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(min(1, h)))


def _blobs():
    rng = np.random.default_rng(8)
    blobs = [rng.normal(c, s, size=(n, 2)) for c, s, n in (((50, 179.9), 0.8, 40), ((10, 0), 0.8, 30), ((88, 40), 0.4, 25))]
    stray = np.column_stack([rng.uniform(-60, 60, 15), rng.uniform(-180, 180, 15)])
    return np.clip(np.concatenate([*blobs, stray]), [-90, -360], [89.9, 360])


def _points(spark, xy):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "cell int, lat double, lon double")


def test_neighbours_across_date_line_and_pole(spark):
    xy = _blobs()
    want = {(i, j) for i, j in itertools.combinations(range(len(xy)), 2) if _haversine(xy[i], xy[j]) <= 150}
    got = {(r.i, r.j) for r in distances.neighbours(_points(spark, xy), 150.0).collect()}
    assert got == want


def _partition(labels):
    groups = {}
    for cell, c in labels.items():
        groups.setdefault(c, set()).add(cell)
    noise = groups.pop(None, set())
    return sorted(map(frozenset, groups.values()), key=min), noise


def test_dbscan_matches_brute_force(spark):
    xy = _blobs()
    xy = np.concatenate([xy, xy[:5]])  # shared coordinates
    eps, k = 120.0, 6
    n = len(xy)
    near = [[j for j in range(n) if _haversine(xy[i], xy[j]) <= eps] for i in range(n)]
    core = [len(x) >= k for x in near]
    labels, nxt = {i: None for i in range(n)}, 0
    for i in range(n):
        if core[i] and labels[i] is None:
            stack = [i]
            while stack:
                p = stack.pop()
                if labels[p] is None:
                    labels[p] = nxt
                    if core[p]:
                        stack.extend(near[p])
            nxt += 1
    got = {r.cell: r.clustid for r in clustering.dbscan(_points(spark, xy), eps, k).collect()}
    assert got == labels


def test_connected_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (0, 0), (200, 200)]
    df = spark.createDataFrame(edges, "a int, b int")
    got = {r.node: r.root for r in clustering.connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 200: 200}


def _naive_linkage(dist):
    clusters = {i: [i] for i in range(len(dist))}
    out = []
    while len(clusters) > 1:
        pair = min(itertools.combinations(sorted(clusters), 2),
                   key=lambda p: np.mean([dist[a, b] for a in clusters[p[0]] for b in clusters[p[1]]]))
        h = np.mean([dist[a, b] for a in clusters[pair[0]] for b in clusters[pair[1]]])
        clusters[pair[0]] = clusters[pair[0]] + clusters.pop(pair[1])
        out.append((pair[0], pair[1], h))
    return out


def test_average_linkage_matches_pairwise_merging(spark):
    rng = np.random.default_rng(9)
    xy = rng.random((18, 3))
    dist = np.linalg.norm(xy[:, None] - xy[None], axis=2)
    pairs = [(i, j, float(dist[i, j])) for i, j in itertools.combinations(range(18), 2)]
    merges = clustering.average_linkage(spark.createDataFrame(pairs, "i int, j int, dist double")).cache()
    got = sorted((round(r.height, 9), r.a, r.b) for r in merges.collect())
    want = sorted((round(h, 9), a, b) for a, b, h in _naive_linkage(dist))
    assert got == want
    cells = spark.createDataFrame([(i,) for i in range(18)], "cell int")
    four = clustering.cut_tree(merges, cells, n_clusters=4)
    assert four.select("clustid").distinct().count() == 4
    h = sorted(m[0] for m in want)[9]
    low = clustering.cut_tree(merges, cells, height=h)
    assert low.select("clustid").distinct().count() == 18 - 10


def test_jaccard_and_max_correlation_match_numpy(spark):
    rng = np.random.default_rng(10)
    flags = rng.random((6, 90)) < 0.3
    rows = [(c, d, bool(flags[c, i])) for c in range(6) for i, d in enumerate(days(90))]
    marked = spark.createDataFrame(rows, "cell int, time date, y boolean")
    got = {(r.i, r.j): r.dist for r in distances.jaccard_distances(marked).collect()}
    for (i, j), v in got.items():
        assert v == pytest.approx(1 - (flags[i] & flags[j]).sum() / (flags[i] | flags[j]).sum())
    assert len(got) == 15
    base = rng.normal(size=100)
    f = field(spark, {0: list(map(float, base)), 1: [float(x) for x in np.roll(base, 3)]})
    out = distances.max_correlation_distances(f, [-3, 0, 3]).first()
    assert out.dist < 0.1


def _mutual_tree(xy, k):
    n = len(xy)
    d = np.array([[_haversine(a, b) for b in xy] for a in xy])
    core = np.sort(d, axis=1)[:, k]
    mr = np.maximum(d, np.maximum(core[:, None], core[None]))
    inside, edges = {0}, []
    while len(inside) < n:
        w, a, b = min((mr[a, b], a, b) for a in inside for b in range(n) if b not in inside)
        edges.append((min(a, b), max(a, b), w))
        inside.add(b)
    return core, sorted(edges, key=lambda e: e[2])


def test_hdbscan_matches_dense_computation(spark):
    xy = _blobs()
    pts = _points(spark, xy).withColumn("fold", F.lit(3))
    core, edges = _mutual_tree(xy, 5)
    got_core = {r.cell: r.core for r in hierarchy.core_distances(pts, 5, ["fold"]).collect()}
    assert [got_core[i] for i in range(len(xy))] == pytest.approx(core, rel=1e-9)
    tree = hierarchy.spanning_tree(pts, hierarchy.core_distances(pts, 5, ["fold"]), ["fold"]).collect()
    assert sorted(r.w for r in tree) == pytest.approx([e[2] for e in edges], rel=1e-9)
    want = hierarchy.tree_labels(len(xy), edges, 10)
    got = {r.cell: r.clustid for r in hierarchy.hdbscan(pts, 5, 10, ["fold"], min_points=20).collect()}
    a, noise = _partition(got)
    b, wanted_noise = _partition({i: (None if c < 0 else int(c)) for i, c in enumerate(want)})
    assert a == b and noise == wanted_noise
    assert {frozenset(x) & frozenset(range(95)) for x in a} and len(a) == 3
    for members, core_range in zip(a, (range(0, 40), range(40, 70), range(70, 95))):
        assert len(set(core_range) & members) > 0.7 * len(core_range)


def _naive_condensed(n, edges, size):
    """Top-down textbook construction, recursing over the single-linkage tree."""
    def components(nodes, upto):
        up = {x: x for x in nodes}
        def find(x):
            while up[x] != x:
                x = up[x]
            return x
        for a, b, w in edges[:upto]:
            if a in up and b in up:
                up[find(a)] = find(b)
        groups = {}
        for x in nodes:
            groups.setdefault(find(x), set()).add(x)
        return list(groups.values())
    best = {}
    def walk(nodes, upto, birth):
        """Stability and chosen clusters of the cluster holding ``nodes``."""
        stability, current = 0.0, set(nodes)
        while True:
            while upto and not (edges[upto - 1][0] in current and edges[upto - 1][1] in current):
                upto -= 1
            if not upto:
                return stability, [set(nodes)], stability
            w = edges[upto - 1][2]
            while upto and edges[upto - 1][2] == w:
                upto -= 1
            lam = 1 / w
            parts = components(current, upto)
            big = [p for p in parts if len(p) >= size]
            if len(big) > 1:
                stability += len(current) * (lam - birth)
                kids = [walk(p, upto, lam) for p in big]
                inner = sum(k[2] for k in kids)
                if inner > stability:
                    return stability, [c for k in kids for c in k[1]], inner
                return stability, [set(nodes)], stability
            gone = sum(len(p) for p in parts if len(p) < size)
            stability += gone * (lam - birth)
            if not big:
                return stability, [set(nodes)], stability
            current = big[0]
    return walk(set(range(n)), len(edges), 0.0)[1]


def test_condensed_tree_matches_top_down_construction():
    for seed in range(6):
        rng = np.random.default_rng(seed)
        xy = np.concatenate([rng.normal(c, 1.0, size=(25, 2)) for c in ((0, 0), (6, 0), (0, 9), (14, 14))])
        _, edges = _mutual_tree(xy, 4)
        got = hierarchy.tree_labels(len(xy), edges, 8, single=True)
        want = _naive_condensed(len(xy), edges, 8)
        groups, _ = _partition({i: (None if c < 0 else int(c)) for i, c in enumerate(got)})
        if len(want) == 1:
            assert len(groups) == 1
        else:
            assert groups == sorted(map(frozenset, want), key=min)


def test_epsilon_joins_late_splits():
    rng = np.random.default_rng(11)
    xy = np.concatenate([rng.normal(c, 0.5, size=(30, 2)) for c in ((0, 0), (0, 5), (0, 60))])
    _, edges = _mutual_tree(xy, 4)
    apart = hierarchy.tree_labels(90, edges, 10)
    joined = hierarchy.tree_labels(90, edges, 10, epsilon=1000.0)
    assert len(set(apart) - {-1}) == 3 and len(set(joined) - {-1}) == 2


def test_ordered_days_wait_for_the_gap(spark, tmp_path):
    landing, work = str(tmp_path / "in"), str(tmp_path / "work")
    order = [1, 0, 4, 3, 2, 6]
    released = []
    for step, day in enumerate(order):
        batch = spark.createDataFrame([("a", DAY0 + dt.timedelta(days=day), float(day))], "cell string, time date, value double")
        batch.coalesce(1).write.mode("append").parquet(landing)
        stream = streams.raw_stream(spark, landing, "cell string, time date, value double")
        streams.run_available(streams.consecutive_days(stream, start=DAY0), work)
        out = sorted(r.value for r in streams.result(spark, work).collect()) if step else []
        released.append(out)
    assert released[1] == [0.0, 1.0]
    assert released[3] == [0.0, 1.0]
    assert released[-1] == [0.0, 1.0, 2.0, 3.0, 4.0]


def test_feature_sink_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "features")
    rows = [(DAY0, 0, "sst", 7, -7, 0, c, "mean", float(c)) for c in range(3)]
    schema = "time date, fold int, variable string, timeagg int, lag int, separation int, clustid int, metric string, value double"
    keys = ["fold", "variable", "timeagg", "lag", "separation", "clustid", "metric"]
    first = spark.createDataFrame(rows[:2], schema)
    fields.append_features(first, path, keys)
    fields.append_features(spark.createDataFrame(rows, schema), path, keys)
    fields.append_features(spark.createDataFrame(rows, schema), path, keys)
    stored = spark.read.parquet(path)
    assert sorted(r.clustid for r in stored.collect()) == [0, 1, 2]
    assert not fields.write_if_absent(first, path)


def test_field_round_trip_with_region_and_attrs(spark, tmp_path):
    path = str(tmp_path / "field")
    g = grid(spark, REGIONS["natlantic"], 5.0).withColumns({"time": F.lit(DAY0), "value": F.col("lat") * 1.0})
    g = g.withColumn("value", F.when(F.col("lat") == 30, F.lit(float("nan"))).otherwise(F.col("value")))
    fields.write_field(g, path, attrs={"units": "K"})
    back = fields.read_field(spark, path, "europe")
    assert back.agg(F.min("lat"), F.max("lat"), F.min("lon")).first() == (35.0, 60.0, -30.0)
    assert "PushedFilters" in back._jdf.queryExecution().executedPlan().toString()
    assert spark.read.parquet(path).schema["value"].metadata == {"units": "K"}
    assert grid(spark, REGIONS["nhplus"], 30.0).agg(F.max("lon")).first()[0] == 150.0


def test_importances_are_pruned_by_directory(spark, tmp_path):
    path = str(tmp_path / "imp")
    df = spark.createDataFrame([(7, -5, 0, 1.0), (31, -5, 0, 2.0), (31, 0, 0, 3.0)], "respagg int, separation int, fold int, score double")
    df.write.partitionBy("respagg", "separation").parquet(path)
    got = fields.read_importances(spark, path, [31, 99], -5)
    assert [r.score for r in got.collect()] == [2.0]
    assert "PartitionFilters: [" in got._jdf.queryExecution().executedPlan().toString()


def test_packed_values_unpack(spark):
    df = spark.createDataFrame([(100,), (-32767,), (None,)], "value int")
    assert [r.value for r in fields.unpack(df, 0.02, -32767).collect()] == [2.0, None, None]


def test_math_of_skill():
    assert math.isclose(1e-4 * 5, assoc.varying_alpha(1))
    assert assoc.precursor_lags(7)[:3] == [0, -7, -8]


def test_hdbscan_writes_no_pairs_of_a_crowd(spark, monkeypatch):
    rng = np.random.default_rng(8)
    crowd = [(40 + a, 10 + b) for a, b in rng.normal(0, 0.8, (250, 2))]
    xy = [*crowd, *crowd[:30], *crowd[:5], *crowd[:5], *crowd[:5], *crowd[:5], (46.0, 10.0), (46.1, 10.0)]
    pts = _points(spark, xy).withColumn("fold", F.lit(1))
    core, edges = _mutual_tree(xy, 4)
    written, plain = [], hierarchy.cut

    def counted(df):
        out = plain(df)
        written.append(out.count())
        return out

    for module in (hierarchy, distances):
        monkeypatch.setattr(module, "cut", counted, raising=False)
    cores = hierarchy.core_distances(pts, 4, ["fold"])
    got = {r.cell: r.core for r in cores.collect()}
    assert [got[i] for i in range(len(xy))] == pytest.approx(core, rel=1e-9, abs=1e-9)
    tree = hierarchy.spanning_tree(pts, plain(cores), ["fold"]).collect()
    assert sorted(r.w for r in tree) == pytest.approx([e[2] for e in edges], rel=1e-9, abs=1e-9)
    assert max(written) < 40 * len(xy)
