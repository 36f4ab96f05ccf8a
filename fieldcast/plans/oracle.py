"""The registered queries in ANSI SQL, to be run by DuckDB on the same tables."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

CENTS_PRICE = "CAST(ROUND(l_extendedprice * 100) AS BIGINT)"

VIEWS = {
    "flag_field": f"""SELECT l_returnflag AS cell, CAST(l_shipdate AS DATE) AS time,
        CAST(SUM({CENTS_PRICE}) AS BIGINT) AS value FROM lineitem GROUP BY 1, 2""",
    "supplier_field": f"""SELECT l_suppkey AS cell, CAST(l_shipdate AS DATE) AS time,
        CAST(SUM({CENTS_PRICE}) AS BIGINT) AS value FROM lineitem GROUP BY 1, 2""",
    "region_field": """SELECT c_nationkey % 5 AS cell, CAST(o_orderdate AS DATE) AS time,
        CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS value
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
    "nation_field": """SELECT c_nationkey AS cell, CAST(o_orderdate AS DATE) AS time,
        CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS value
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
    "response": """SELECT CAST(o_orderdate AS DATE) AS time,
        CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS y FROM orders GROUP BY 1""",
    "supplier_points": """SELECT s_suppkey AS cell, 30.0::DOUBLE + ((s_suppkey // 20) % 24) * 2.5::DOUBLE AS lat,
        -30.0::DOUBLE + (s_suppkey % 20) * 2.5::DOUBLE + ((s_suppkey // 20) // 24) * 0.25::DOUBLE AS lon FROM supplier""",
    "hourly": """SELECT event_type AS cell, ts, CAST(ROUND(value * 100) AS BIGINT) AS value FROM events""",
    "forecasts": """SELECT l_orderkey * 8 + l_linenumber AS id, CAST(l_shipdate AS DATE) AS time,
        CAST(ROUND(l_discount * 100) AS INT) AS model, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
        ((CAST(l_quantity AS INT) * 7 + CAST(ROUND(l_discount * 100) AS INT) * 11) % 101) / 100.0::DOUBLE AS p
        FROM lineitem""",
    "daily_forecasts": f"""SELECT time, CASE WHEN c > (SELECT SUM(c) / COUNT(c) FROM daily_sums) THEN 1 ELSE 0 END AS y,
        0.4::DOUBLE + (year(time) - 1995) / 40::DOUBLE AS base,
        1 / (1 + exp(-3 * (q / (SELECT SUM(q)::DOUBLE / COUNT(q) FROM daily_sums) - 1))) AS p FROM daily_sums""",
    "daily_sums": f"""SELECT CAST(l_shipdate AS DATE) AS time, SUM({CENTS_PRICE})::BIGINT AS c,
        SUM(CAST(l_quantity AS BIGINT))::BIGINT AS q FROM lineitem GROUP BY 1""",
    "keyed_items": """SELECT CASE WHEN l_linenumber % 2 = 0 THEN 7 ELSE 31 END AS respagg,
        [0, -5, -15][CAST(ROUND(l_discount * 100) AS INT) % 3 + 1] AS separation,
        CAST(l_partkey % 5 AS INT) AS fold, l_returnflag AS variable,
        [1, 7, 31][CAST(ROUND(l_tax * 100) AS INT) % 3 + 1] AS timeagg,
        [0, -5, -15][CAST(ROUND(l_discount * 100) AS INT) % 3 + 1] - [1, 7, 31][CAST(ROUND(l_tax * 100) AS INT) % 3 + 1] AS lag,
        CAST(l_suppkey % 4 AS INT) AS clustid, CASE WHEN l_linestatus = 'F' THEN 'mean' ELSE 'spatcov' END AS metric,
        l_suppkey, CAST(l_quantity AS BIGINT) AS q, CAST(ROUND(l_discount * 100) AS BIGINT) AS d,
        CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem""",
    "importances": """SELECT respagg, separation, fold, variable, timeagg, lag, clustid, metric,
        SUM(c) / COUNT(c) AS score, CAST(SUM(q) AS BIGINT) AS rank FROM keyed_items GROUP BY ALL""",
    "cluster_fields": """SELECT fold, variable, timeagg, lag, separation, l_suppkey AS cell,
        CASE WHEN l_suppkey % 5 < 4 THEN CAST(l_suppkey % 5 AS INT) END AS clustid,
        CASE WHEN SUM(q) % 3 <> 0 THEN SUM(d)::DOUBLE / (COUNT(*) * 10) - 0.5::DOUBLE END AS corr
        FROM keyed_items GROUP BY fold, variable, timeagg, lag, separation, l_suppkey""",
    "tests": f"""SELECT l_suppkey AS cell, l_linenumber AS fold, l_suppkey % 3 AS lag,
        ROUND(POW((SUM({CENTS_PRICE}) % 1000) / 1000.0::DOUBLE, 4), 9) AS pvalue FROM lineitem GROUP BY 1, 2, 3""",
}
NEEDS = {
    "daily_forecasts": ["daily_sums"],
    "importances": ["keyed_items"],
    "cluster_fields": ["keyed_items"],
}


def using(names: str, body: str, **ctes: str) -> str:
    """A statement with the named views, then its own CTEs, then the body."""
    chosen: list[str] = []
    for name in names.split():
        for part in [*NEEDS.get(name, []), name]:
            if part not in chosen:
                chosen.append(part)
    parts = [f"{n} AS ({VIEWS[n]})" for n in chosen] + [f"{n} AS ({sql})" for n, sql in ctes.items()]
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body


def register(name: str, names: str, body: str, **ctes: str) -> None:
    ORACLE[name] = using(names, body, **ctes)


BOX = "lat BETWEEN 30 AND 60 AND lon BETWEEN -60 AND 0"
JJA = "month(time) IN (6, 7, 8)"

# --- sources and sinks ---------------------------------------------------------------
register(
    "region_scan", "supplier_field supplier_points",
    f"""SELECT cell, SUM(value)::BIGINT AS total, COUNT(value) AS ndays FROM supplier_field
        WHERE cell IN (SELECT cell FROM supplier_points WHERE {BOX}) GROUP BY cell""",
)
ORACLE["region_cells"] = ORACLE["region_scan"]
register(
    "appended_days", "supplier_field",
    """SELECT cell, time, value + CASE WHEN cell % 3 = 0 AND month(time) = 6 THEN 1 ELSE 0 END AS value
        FROM supplier_field WHERE NOT (cell % 7 = 0 AND year(time) = 1995)""",
)
register(
    "compacted_days", "region_field",
    """SELECT cell, time, CASE WHEN cell = 4 AND month(time) = 1 THEN 0 WHEN cell >= 2 THEN value * 2 ELSE value END AS value
        FROM region_field""",
)
register(
    "append_manifest", "",
    """SELECT a.number, a.time, a.first, a.last, a.n, COUNT(b.number) > 0 AS clash FROM parts a LEFT JOIN parts b
        ON b.time = a.time AND b.number <> a.number AND b.first <= a.last AND b.last >= a.first GROUP BY ALL""",
    supplier_field=VIEWS["supplier_field"],
    appends="""SELECT CAST(0 AS INT) AS number, * FROM supplier_field WHERE cell <= 40 UNION ALL SELECT 1, * FROM supplier_field
        WHERE cell > 40 UNION ALL SELECT 2, * FROM supplier_field WHERE cell % 10 = 0""",
    parts="""SELECT CAST(dense_rank() OVER (ORDER BY number) - 1 AS INT) AS number, time, MIN(cell) AS first, MAX(cell) AS last,
        COUNT(*) AS n FROM appends GROUP BY appends.number, time""",  # an append without rows takes no number
)
register(
    "field_info", "supplier_field",
    """SELECT COUNT(DISTINCT cell) AS ncells, COUNT(value) AS nvalues, MIN(time) AS first, MAX(time) AS last,
        CAST(MAX(time) - MIN(time) + 1 AS INT) AS ndays FROM supplier_field""",
)
register(
    "drop_empty_cells", "supplier_field",
    "SELECT cell, COUNT(value) AS n FROM supplier_field GROUP BY cell HAVING COUNT(value) >= 500",
)
register(
    "one_day", "flag_field",
    """SELECT cell, time, value FROM (SELECT *, dense_rank() OVER (ORDER BY time) - 1 AS i FROM flag_field) WHERE i = 100""",
)
register(
    "mask_cells", "supplier_field supplier_points",
    f"""SELECT cell, SUM(value)::BIGINT AS total FROM supplier_field WHERE {JJA}
        AND cell NOT IN (SELECT cell FROM supplier_points WHERE lat < 40) GROUP BY cell""",
)
register(
    "restore_grid", "supplier_points cluster_fields",
    """SELECT k.variable, k.timeagg, k.lag, k.fold, p.cell, l.clustid FROM supplier_points p
        CROSS JOIN (SELECT DISTINCT variable, timeagg, lag, fold FROM l) k LEFT JOIN l ON l.cell = p.cell
        AND l.variable = k.variable AND l.timeagg = k.timeagg AND l.lag = k.lag AND l.fold = k.fold""",
    l="SELECT DISTINCT variable, timeagg, lag, fold, cell, clustid FROM cluster_fields",
)
register(
    "new_feature_keys", "importances",
    """SELECT DISTINCT fold, variable, timeagg, lag, separation, clustid, metric FROM importances
        EXCEPT SELECT fold, variable, timeagg, lag, separation, clustid, metric FROM importances
        WHERE respagg = 7 AND metric = 'mean'""",
)
register(
    "common_columns_union", "flag_field region_field",
    """SELECT cell, SUM(value)::BIGINT AS total, COUNT(value) AS n FROM (SELECT cell, time, value FROM flag_field
        UNION ALL SELECT CAST(cell AS VARCHAR), time, value FROM region_field) GROUP BY cell""",
)
register(
    "daily_mean", "hourly",
    """SELECT cell, CAST(ts AS DATE) AS time, SUM(value) / COUNT(value) AS value,
        COUNT(DISTINCT hour(ts)) = 24 AS complete FROM hourly GROUP BY 1, 2""",
)
register(
    "daily_extremes", "hourly",
    "SELECT cell, CAST(ts AS DATE) AS time, MIN(value) AS low, MAX(value) AS high FROM hourly GROUP BY 1, 2",
)
register(
    "hour_slice", "hourly",
    """SELECT cell, CAST(ts AS DATE) AS time, SUM(value) / COUNT(value) AS value FROM hourly
        WHERE hour(ts) = 12 GROUP BY 1, 2""",
)
register(
    "hour_slice_midnight", "hourly",
    """SELECT cell, CAST(ts AS DATE) - 1 AS time, SUM(value) / COUNT(value) AS value FROM hourly
        WHERE hour(ts) = 0 GROUP BY 1, 2""",
)
register(
    "merge_weighted", "",
    """SELECT cell, time, SUM(w * v)::DOUBLE / SUM(w) AS value FROM layers GROUP BY 1, 2""",
    layers=f"""SELECT l_suppkey AS cell, CAST(l_shipdate AS DATE) AS time,
        CASE l_linenumber WHEN 1 THEN 7 WHEN 2 THEN 21 ELSE 72 END AS w, SUM({CENTS_PRICE}) AS v
        FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2, 3""",
)
DAYS = "SELECT CAST(unnest(generate_series(MIN(time), MAX(time), INTERVAL 1 DAY)) AS DATE) AS time FROM {}"
register(
    "missing_days", "region_field",
    "SELECT time FROM days WHERE time NOT IN (SELECT time FROM region_field)",
    days=DAYS.format("region_field"),
)
CATALOGUE = """SELECT * FROM (VALUES
    ('z500', 'geopotential', 500, 'reanalysis-era5-pressure-levels'),
    ('z300', 'geopotential', 300, 'reanalysis-era5-pressure-levels'),
    ('u300', 'u_component_of_wind', 300, 'reanalysis-era5-pressure-levels'),
    ('v300', 'v_component_of_wind', 300, 'reanalysis-era5-pressure-levels'),
    ('t850', 'temperature', 850, 'reanalysis-era5-pressure-levels'),
    ('siconc', 'sea_ice_cover', NULL, 'reanalysis-era5-single-levels'),
    ('sst', 'sea_surface_temperature', NULL, 'reanalysis-era5-single-levels'),
    ('t2m', '2m_temperature', NULL, 'reanalysis-era5-single-levels'),
    ('transp', 'evaporation_from_bare_soil', NULL, 'reanalysis-era5-land'),
    ('snowc', 'snow_cover', NULL, 'reanalysis-era5-land'),
    ('swvl1', 'volumetric_soil_water_layer_1', NULL, 'reanalysis-era5-land'),
    ('swvl2', 'volumetric_soil_water_layer_2', NULL, 'reanalysis-era5-land'),
    ('swvl3', 'volumetric_soil_water_layer_3', NULL, 'reanalysis-era5-land'),
    ('swvl4', 'volumetric_soil_water_layer_4', NULL, 'reanalysis-era5-land'),
    ('tcc', 'total_cloud_cover', NULL, 'reanalysis-era5-single-levels')) t(varname, variable, pressure_level, setname)"""
register(
    "archive_requests", "region_field",
    """SELECT varname, time, setname, variable,
        CASE WHEN varname IN ('transp', 'snowc') THEN time + 1 ELSE time END AS requested,
        CASE WHEN varname IN ('transp', 'snowc') THEN 1 ELSE 24 END AS nhours, pressure_level,
        CASE WHEN setname LIKE '%land%' THEN NULL ELSE 'reanalysis' END AS product_type,
        '75,-30,30,40' AS area, varname || '_europe_' || strftime(time, '%Y-%m-%d') AS rawname
        FROM days CROSS JOIN catalogue WHERE time NOT IN (SELECT time FROM region_field)""",
    days=DAYS.format("region_field"), catalogue=CATALOGUE,
)
register(
    "raw_file_days", "",
    """SELECT DISTINCT CAST(ts AS DATE) AS time, 'raw/sst_europe_' || strftime(ts, '%Y-%m-%d') || '.grib' AS path
        FROM events WHERE event_type = 'click' AND hour(ts) <> 3""",
)

# --- temporal operators --------------------------------------------------------------
CLIM = """SELECT cell, doy, SUM(s)::DOUBLE / SUM(n) AS clim FROM (
        SELECT cell, s, n, rows, (src - 1 + k.k + 366) % 366 + 1 AS doy FROM (
            SELECT cell, dayofyear(time) AS src, SUM(value) AS s, COUNT(value) AS n, COUNT(*) AS rows
            FROM {field} GROUP BY 1, 2) CROSS JOIN (SELECT unnest(generate_series(-4, 5)) AS k) k)
        GROUP BY cell, doy HAVING SUM(n) >= 10 {strict}"""
register(
    "climatology", "region_field", "SELECT cell, CAST(doy AS INT) AS doy, clim FROM c",
    c=CLIM.format(field="region_field", strict=""),
)
DENSE = """SELECT a.cell, a.time, f.value FROM (SELECT cell,
        CAST(unnest(generate_series(MIN(time), MAX(time), INTERVAL 1 DAY)) AS DATE) AS time FROM {f} GROUP BY cell) a
        LEFT JOIN {f} f ON f.cell = a.cell AND f.time = a.time"""
register(
    "climatology_strict", "flag_field", "SELECT cell, CAST(doy AS INT) AS doy, clim FROM c",
    dense=DENSE.format(f="flag_field"), c=CLIM.format(field="dense", strict="AND SUM(n) = SUM(rows)"),
)
register(
    "anomaly", "supplier_field",
    """SELECT f.cell, f.time, f.value - c.clim AS value FROM supplier_field f
        JOIN c ON c.cell = f.cell AND c.doy = dayofyear(f.time)""",
    c=CLIM.format(field="supplier_field", strict=""),
)
FRAME = "OVER (PARTITION BY cell ORDER BY time RANGE BETWEEN CURRENT ROW AND INTERVAL {} DAY FOLLOWING)"


def rolled(field: str, n: int, agg: str = "SUM(value) {w} / COUNT(value) {w}") -> str:
    w = FRAME.format(n - 1)
    return f"""SELECT cell, time, v AS value FROM (SELECT cell, time, {agg.format(w=w)} AS v,
        COUNT(value) {w} AS n FROM {field}) WHERE n = {n}"""


register("roll5_mean", "flag_field", rolled("flag_field", 5))
register(
    "roll_all_windows", "flag_field",
    " UNION ALL ".join(
        f"SELECT cell, time, {n} AS timeagg, value FROM ({rolled('flag_field', n)})" for n in (1, 3, 5, 7, 11, 15, 21, 31)
    ),
)
W7 = FRAME.format(6)
register(
    "roll7_spread", "region_field",
    f"""SELECT cell, time, "min", "max", "sum", ROUND("std", 4) AS "std" FROM (SELECT cell, time, MIN(value) {W7} AS "min",
        MAX(value) {W7} AS "max", (SUM(value) {W7})::BIGINT AS "sum", STDDEV_POP(value) {W7} AS "std",
        COUNT(value) {W7} AS n FROM region_field) WHERE n = 7""",
)
register(
    "block5_mean", "flag_field",
    """SELECT cell, CAST((SELECT MIN(time) FROM flag_field) + CAST(b * 5 AS INT) AS DATE) AS time,
        SUM(value) / COUNT(value) AS value
        FROM (SELECT *, (time - (SELECT MIN(time) FROM flag_field)) // 5 AS b FROM flag_field)
        GROUP BY cell, b HAVING COUNT(value) = 5""",
)
register(
    "block7_from_day", "flag_field",
    """SELECT cell, DATE '1996-03-01' + CAST(b * 7 AS INT) AS time, MAX(value) AS value
        FROM (SELECT *, (time - DATE '1996-03-01') // 7 AS b FROM flag_field WHERE time >= DATE '1996-03-01')
        GROUP BY cell, b HAVING COUNT(value) = 7""",
)
register(
    "lag_join", "supplier_field response",
    """SELECT cell, lag, COUNT(*) AS n, SUM(value)::BIGINT AS x, SUM(y)::BIGINT AS y, MAX(r.time) AS last
        FROM supplier_field f CROSS JOIN (SELECT unnest([0, -7, -15]) AS lag) JOIN response r ON r.time = f.time - lag
        GROUP BY 1, 2""",
)
register(
    "lag_stack", "region_field",
    """SELECT a.cell, a.lag, a.time, f.value FROM (SELECT cell, time, lag FROM region_field
        CROSS JOIN (SELECT unnest([-5, 0, 5]) AS lag)) a
        LEFT JOIN region_field f ON f.cell = a.cell AND f.time = a.time + a.lag""",
)
register(
    "past_value", "region_field",
    """SELECT a.cell, a.time, a.value, b.value AS past FROM region_field a
        LEFT JOIN region_field b ON b.cell = a.cell AND b.time = a.time - 7""",
)
register(
    "season_totals", "supplier_field",
    """SELECT cell, CASE WHEN month(time) IN (12, 1, 2) THEN 'DJF' WHEN month(time) <= 5 THEN 'MAM'
        WHEN month(time) <= 8 THEN 'JJA' ELSE 'SON' END AS season, CAST(year(time) AS INT) AS year,
        SUM(value)::BIGINT AS value FROM supplier_field GROUP BY 1, 2, 3""",
)
register("season_jja", "region_field", "SELECT * FROM region_field WHERE month(time) BETWEEN 3 AND 8")
register(
    "month_subset", "supplier_field",
    """SELECT cell, CAST(month(time) AS INT) AS month, SUM(value)::BIGINT AS value FROM supplier_field
        WHERE month(time) IN (1, 7) GROUP BY 1, 2""",
)


def detrended(source: str, keys: str, *values: str) -> str:
    """Residuals from a line over ordinal position, for each value column of a source CTE."""
    by = f"PARTITION BY {keys}" if keys else ""
    fits = ", ".join(
        f"{v} - (regr_slope({v}, pos) OVER ({by}) * pos + regr_intercept({v}, pos) OVER ({by})) AS {v}" for v in values
    )
    return f"""SELECT * EXCLUDE ({', '.join(values)}, pos), {fits} FROM (SELECT *,
        CAST(row_number() OVER ({by} ORDER BY time) - 1 AS DOUBLE) AS pos FROM {source})"""


register(
    "detrend_season", "flag_field", "SELECT cell, time, ROUND(value, 3) AS value FROM d",
    s=f"SELECT cell, time, CAST(value AS DOUBLE) AS value FROM flag_field WHERE {JJA}", d=detrended("s", "cell", "value"),
)
register(
    "axis_gaps", "region_field",
    """SELECT cell, previous, time, CAST(time - previous AS INT) AS step FROM (SELECT cell, time,
        lag(time) OVER (PARTITION BY cell ORDER BY time) AS previous FROM region_field) WHERE time - previous <> 1""",
)
register(
    "yearly_mean", "supplier_field",
    """SELECT cell, CAST(year(time) AS INT) AS year, SUM(value) / COUNT(value) AS value FROM supplier_field GROUP BY 1, 2""",
)
register(
    "standardised_date", "region_field",
    """SELECT time, julian, ROUND((julian - (SELECT AVG(julian) FROM j)) / (SELECT STDDEV_POP(julian) FROM j), 8) AS z FROM j""",
    j="""SELECT DISTINCT time, (time - DATE '1970-01-01') + 2440587.5::DOUBLE AS julian FROM region_field""",
)
register(
    "input_windows", "importances region_field",
    """SELECT d.time, timeagg, separation, d.time + separation - 1 - (timeagg - 1) AS start, d.time + separation - 1 AS "end"
        FROM (SELECT DISTINCT time FROM region_field) d
        CROSS JOIN (SELECT DISTINCT timeagg, separation FROM importances) k""",
)
register("densified", "region_field", DENSE.format(f="region_field"))

# --- predicates ----------------------------------------------------------------------
register(
    "exceedance_per_cell", "supplier_field",
    """SELECT cell, COUNT(*) FILTER (value > q) AS n_above, COUNT(*) AS n FROM (SELECT *,
        quantile_cont(value, 0.75) OVER (PARTITION BY cell) AS q FROM supplier_field) GROUP BY cell""",
)
register(
    "exceedance_other_period", "flag_field",
    """SELECT f.cell, f.time, f.value, f.value > q AS y FROM flag_field f JOIN (SELECT cell, quantile_cont(value, 0.666) AS q
        FROM flag_field WHERE year(time) < 1999 GROUP BY cell) t ON t.cell = f.cell WHERE year(f.time) >= 1999""",
)
register(
    "exceedance_frequency", "",
    f"""SELECT CAST(year(l_shipdate) AS INT) AS year,
        SUM(CASE WHEN {CENTS_PRICE} > (SELECT quantile_cont({CENTS_PRICE}, 0.8) FROM lineitem) THEN 1 ELSE 0 END) / COUNT(*)
        AS frequency FROM lineitem GROUP BY 1""",
)
register(
    "quantile_cell", "",
    f"""SELECT l_returnflag AS cell, quantile_cont({CENTS_PRICE}, 0.9)::DOUBLE AS threshold FROM lineitem GROUP BY 1""",
)
register(
    "complete_rows", "region_field",
    """SELECT cell AS feature, time, value FROM region_field WHERE time IN (SELECT time FROM region_field GROUP BY time
        HAVING COUNT(DISTINCT cell) = (SELECT COUNT(DISTINCT cell) FROM region_field))""",
)
register(
    "wide_features", "flag_field",
    """SELECT time, MAX(value) FILTER (cell = 'A') AS "A", MAX(value) FILTER (cell = 'N') AS "N",
        MAX(value) FILTER (cell = 'R') AS "R" FROM flag_field GROUP BY time""",
)
register(
    "feature_vectors", "supplier_field",
    """SELECT t.time, CAST(COUNT(*) AS INT) AS n, string_agg(COALESCE(CAST(value AS VARCHAR), '-'), ',' ORDER BY c.cell) AS vector
        FROM (SELECT DISTINCT time FROM supplier_field) t CROSS JOIN (SELECT DISTINCT cell FROM supplier_field) c
        LEFT JOIN supplier_field f ON f.time = t.time AND f.cell = c.cell GROUP BY t.time""",
)
register(
    "complete_vectors", "region_field",
    """SELECT time, string_agg(CAST(value AS VARCHAR), ',' ORDER BY cell) AS vector FROM region_field GROUP BY time
        HAVING COUNT(*) = (SELECT COUNT(DISTINCT cell) FROM region_field)""",
)
register(
    "collapsed_keys", "importances",
    """SELECT respagg, separation, fold, variable, timeagg, lag, clustid, metric, rank,
        concat_ws('.', separation, fold, variable, timeagg, clustid) AS name FROM importances""",
)

# --- reduction -----------------------------------------------------------------------
register(
    "cluster_mean", "supplier_field",
    """SELECT CAST(cell % 5 AS INT) AS clustid, time, SUM(value) / COUNT(value) AS value FROM supplier_field
        WHERE cell % 5 < 4 GROUP BY 1, 2""",
)
register(
    "mean_at_lag", "supplier_field",
    """SELECT time + 10 AS time, SUM(value) / COUNT(value) AS value FROM supplier_field GROUP BY supplier_field.time
        HAVING time + 10 IN (SELECT time FROM supplier_field)""",
)
COV = """SELECT {k}, f.time, SUM((p.corr - p.pm) * (f.value - {xm})) / MAX(p.np) AS value FROM centred p
    JOIN f ON f.cell = p.cell {more} GROUP BY {k}, f.time"""
register(
    "spatial_covariance", "supplier_field cluster_fields",
    """SELECT lag, fold, CAST(time - lag AS DATE) AS time, floor((value) * (1000 / pi()) + 0.5::DOUBLE) / (1000 / pi()) AS value FROM cov
        WHERE time - lag IN (SELECT time FROM supplier_field)""",
    centred="""SELECT lag, fold, cell, corr, AVG(corr) OVER (PARTITION BY lag, fold) AS pm,
        COUNT(corr) OVER (PARTITION BY lag, fold) AS np
        FROM (SELECT lag, fold, cell, MAX(corr) AS corr FROM cluster_fields GROUP BY ALL) WHERE corr IS NOT NULL""",
    joined="""SELECT p.lag, p.fold, f.time, p.corr - p.pm AS dp, p.np, f.value,
        AVG(f.value) OVER (PARTITION BY p.lag, p.fold, f.time) AS xm
        FROM centred p JOIN supplier_field f ON f.cell = p.cell""",
    cov="SELECT lag, fold, time, SUM(dp * (value - xm)) / MAX(np) AS value FROM joined GROUP BY 1, 2, 3",
)
register(
    "spatial_covariance_whole_field", "supplier_field cluster_fields",
    "SELECT lag, fold, time, floor((SUM(dp * (value - xm)) / MAX(np)) * (1000 / pi()) + 0.5::DOUBLE) / (1000 / pi()) AS value FROM joined GROUP BY 1, 2, 3",
    centred="""SELECT lag, fold, cell, corr, AVG(corr) OVER (PARTITION BY lag, fold) AS pm,
        COUNT(corr) OVER (PARTITION BY lag, fold) AS np
        FROM (SELECT lag, fold, cell, MAX(corr) AS corr FROM cluster_fields GROUP BY ALL) WHERE corr IS NOT NULL""",
    f="SELECT *, AVG(value) OVER (PARTITION BY time) AS xm FROM supplier_field",
    joined="SELECT p.lag, p.fold, f.time, p.corr - p.pm AS dp, p.np, f.value, f.xm FROM centred p JOIN f ON f.cell = p.cell",
)
register(
    "cluster_features", "supplier_field cluster_fields",
    """SELECT CAST(time - lag AS DATE) AS time, fold, 'A' AS variable, 7 AS timeagg, lag, lag + 7 AS separation, clustid, metric,
        floor((CASE metric WHEN 'mean' THEN m ELSE c END) * (1000 / pi()) + 0.5::DOUBLE) / (1000 / pi()) AS value FROM sums
        CROSS JOIN (SELECT unnest(['mean', 'spatcov']) AS metric) WHERE time - lag IN (SELECT time FROM f)""",
    f="SELECT * FROM supplier_field WHERE month(time) BETWEEN 3 AND 8",
    centred="""SELECT lag, fold, clustid, cell, corr - AVG(corr) OVER (PARTITION BY lag, fold, clustid) AS dp,
        COUNT(corr) OVER (PARTITION BY lag, fold, clustid) AS np FROM (
        SELECT lag, fold, clustid, cell, MAX(corr) AS corr FROM cluster_fields GROUP BY ALL) WHERE corr IS NOT NULL AND clustid IS NOT NULL AND lag <> 0""",
    joined="""SELECT p.*, f.time, f.value, AVG(f.value) OVER (PARTITION BY lag, fold, clustid, f.time) AS xm
        FROM centred p JOIN f ON f.cell = p.cell""",
    sums="""SELECT lag, fold, clustid, time, AVG(value) AS m, SUM(dp * (value - xm)) / MAX(np) AS c FROM joined GROUP BY 1, 2, 3, 4""",
)
register(
    "cluster_counts", "cluster_fields",
    """SELECT variable, timeagg, lag, fold, COUNT(DISTINCT clustid) AS nclusters FROM cluster_fields GROUP BY 1, 2, 3, 4""",
)
register(
    "response_aggregates", "response",
    f"""SELECT time, MAX(value) FILTER (n = 1) AS y1, MAX(value) FILTER (n = 3) AS y3, MAX(value) FILTER (n = 7) AS y7 FROM ("""
    + " UNION ALL ".join(f"SELECT time, value, {n} AS n FROM ({rolled('f', n)})" for n in (1, 3, 7))
    + f") WHERE {JJA} GROUP BY time",
    f="SELECT 0 AS cell, time, y AS value FROM response",
)

# --- association ---------------------------------------------------------------------
TARGET = {
    "season": f"SELECT time, CAST(y AS DOUBLE) AS y FROM response WHERE {JJA}",
    "target": detrended("season", "", "y"),
}


def pairs_ctes(field: str, lags: str) -> dict[str, str]:
    return {
        **TARGET,
        "matched": f"""SELECT f.cell, l.lag, t.time, CAST(f.value AS DOUBLE) AS x, t.y FROM {field} f
            CROSS JOIN (SELECT unnest([{lags}]) AS lag) l JOIN target t ON t.time = f.time - l.lag""",
        "pairs": detrended("matched", "cell, lag", "x"),
    }


def ranked(source: str, keys: str, x: str = "x", y: str = "y") -> str:
    out = []
    for c, name in ((x, "rx"), (y, "ry")):
        out.append(
            f"""rank() OVER (PARTITION BY {keys} ORDER BY {c}) + (COUNT(*) OVER (PARTITION BY {keys}, {c}) - 1) / 2.0::DOUBLE AS {name}"""
        )
    return f"SELECT *, {', '.join(out)} FROM {source}"


register(
    "pearson_lag", "supplier_field response",
    "SELECT cell, lag, 0 AS fold, ROUND(corr(x, y), 6) AS corr, COUNT(*) AS n FROM pairs GROUP BY cell, lag",
    **pairs_ctes("supplier_field", "-7, -15"),
)
# Two-sided Student tail from the finite series for integer degrees of freedom.
TAIL = """CASE WHEN df % 2 = 0 THEN 1 - abs(sin(th)) * (SELECT SUM(exp(lgamma(k + 0.5) - lgamma(k + 1) - lgamma(0.5)) * POW(cos(th), 2 * k))
        FROM (SELECT unnest(range(0, CAST(df // 2 AS BIGINT))) AS k))
    ELSE 1 - 2 / pi() * (abs(th) + abs(sin(th)) * cos(th) * COALESCE((SELECT SUM(exp(2 * k * ln(2) + 2 * lgamma(k + 1) - lgamma(2 * k + 2))
        * POW(cos(th), 2 * k)) FROM (SELECT unnest(range(0, CAST((df - 1) // 2 AS BIGINT))) AS k)), 0)) END"""
RHO = {
    "ranked": ranked("pairs", "cell, lag"),
    "rho": "SELECT cell, lag, corr(rx, ry) AS r, COUNT(*) AS n FROM ranked GROUP BY cell, lag",
    "angle": "SELECT *, n - 2 AS df, atan(r * sqrt((n - 2) / ((1 - r) * (1 + r))) / sqrt(n - 2)) AS th FROM rho",
    "tested": f"SELECT cell, lag, r, n, {TAIL} AS p FROM angle",
}
register(
    "spearman_lag", "supplier_field response",
    "SELECT cell, lag, 0 AS fold, ROUND(r, 6) AS corr, n, ROUND(p, 6) AS pvalue FROM tested",
    **pairs_ctes("supplier_field", "-7, -15"), **RHO,
)
register(
    "masked_association", "supplier_field response",
    """SELECT cell, lag, 0 AS fold, CASE WHEN p <= cut THEN ROUND(r, 6) END AS corr, n, ROUND(p, 6) AS pvalue,
        COALESCE(p <= cut, FALSE) AS reject FROM tested LEFT JOIN cuts USING (lag)""",
    **pairs_ctes("supplier_field", "-7, -15"), **RHO,
    ordered="""SELECT lag, p, COUNT(*) OVER (PARTITION BY lag ORDER BY p) AS k, COUNT(*) OVER (PARTITION BY lag) AS m FROM tested""",
    cuts="SELECT lag, MAX(p) AS cut FROM ordered WHERE p <= k::DOUBLE / m * 0.2::DOUBLE GROUP BY lag",
)
YEAR_GROUPS = {
    "years": "SELECT year(time) AS year, COUNT(*) AS rows, MIN(time) AS a, MAX(time) AS b FROM {source} GROUP BY 1",
    "numbered": "SELECT *, CAST((year - MIN(year) OVER ()) // CAST(ceil(COUNT(*) OVER () / {n}) AS BIGINT) AS INT) AS grp FROM years",
    "groups": """SELECT grp, SUM(rows) AS rows, MIN(a) AS valstart, MAX(b) AS valend,
        CAST(row_number() OVER (ORDER BY SUM(rows) DESC, grp DESC) - 1 AS INT) AS fold,
        CAST(row_number() OVER (ORDER BY grp) - 1 AS INT) AS fieldfold FROM numbered GROUP BY grp""",
}


def year_groups(source: str, n: int) -> dict[str, str]:
    return {k: v.format(source=source, n=n) for k, v in YEAR_GROUPS.items()}


register(
    "spearman_folds", "supplier_field response",
    "SELECT cell, lag, fold, ROUND(corr(rx, ry), 6) AS corr, COUNT(*) AS n FROM ranked GROUP BY cell, lag, fold",
    **pairs_ctes("supplier_field", "-7"), **year_groups("target", 7),
    folded="""SELECT p.*, k.fieldfold AS fold FROM pairs p JOIN numbered y ON y.year = year(p.time) JOIN groups g ON g.grp = y.grp
        JOIN groups k ON k.fieldfold <> g.fieldfold""",
    ranked=ranked("folded", "cell, lag, fold"),
)
register(
    "partial_spearman", "flag_field response",
    "SELECT cell, lag, 0 AS fold, ROUND(corr(rx, ry), 6) AS corr, COUNT(*) AS n FROM ranked GROUP BY cell, lag",
    f=rolled("flag_field", 3),
    season=f"""SELECT a.time, CAST(a.y AS DOUBLE) AS y, CAST(b.y AS DOUBLE) AS y_past FROM response a
        JOIN response b ON b.time = a.time - 3 WHERE {JJA.replace('time', 'a.time')}""",
    target=detrended("season", "", "y", "y_past"),
    two="SELECT a.cell, a.time, a.value AS x, b.value AS x_past FROM f a JOIN f b ON b.cell = a.cell AND b.time = a.time - 3",
    matched="""SELECT f.cell, l.lag, t.time, f.x, f.x_past, t.y, t.y_past FROM two f
        CROSS JOIN (SELECT unnest([-7, -15]) AS lag) l JOIN target t ON t.time = f.time - l.lag""",
    pairs=detrended("matched", "cell, lag", "x", "x_past"),
    resid="""SELECT cell, lag, x - SUM(x * x_past) OVER (PARTITION BY cell, lag) / SUM(x_past * x_past) OVER (PARTITION BY cell, lag) * x_past AS x,
        y - SUM(y * y_past) OVER (PARTITION BY cell, lag) / SUM(y_past * y_past) OVER (PARTITION BY cell, lag) * y_past AS y FROM pairs""",
    ranked=ranked("resid", "cell, lag"),
)
TAU = """SELECT a.cell, a.lag, 0 AS fold, ROUND(SUM(sign(a.x - b.x) * sign(a.y - b.y) * (a.w + b.w))
    / sqrt(SUM(abs(sign(a.x - b.x)) * (a.w + b.w)) * SUM(abs(sign(a.y - b.y)) * (a.w + b.w))), 6) AS corr, MAX(a.n) AS n
    FROM weighted a JOIN weighted b ON b.cell = a.cell AND b.lag = a.lag AND b.i > a.i GROUP BY a.cell, a.lag"""
register(
    "kendall_predictand", "supplier_field response", TAU,
    **pairs_ctes("supplier_field", "-7"),
    weighted="""SELECT *, row_number() OVER (PARTITION BY cell, lag ORDER BY time) AS i, COUNT(*) OVER (PARTITION BY cell, lag) AS n,
        1.0::DOUBLE / row_number() OVER (PARTITION BY cell, lag ORDER BY y DESC, x DESC) AS w FROM pairs""",
)
register(
    "kendall_choice", "supplier_field response", TAU,
    **pairs_ctes("supplier_field", "-7"),
    sided="SELECT *, corr(x, y) OVER (PARTITION BY cell, lag) AS r, COUNT(*) OVER (PARTITION BY cell, lag) AS n FROM pairs",
    placed="SELECT *, row_number() OVER (PARTITION BY cell, lag ORDER BY x, time) AS o FROM sided",
    weighted="""SELECT *, row_number() OVER (PARTITION BY cell, lag ORDER BY time) AS i,
        1.0::DOUBLE / (1 + CASE WHEN r < 0 THEN o ELSE n - o END) AS w FROM placed""",
)
for name, given, of in (("composite", "y", "x"), ("composite_swapped", "x", "y")):
    register(
        name, "supplier_field response",
        f"""SELECT cell, lag, 0 AS fold, ROUND(AVG({of}), 3) AS corr, COUNT(*) AS n FROM (SELECT *,
            quantile_cont({given}, 0.9) OVER (PARTITION BY cell, lag) AS q FROM pairs) WHERE {given} > q GROUP BY cell, lag""",
        **pairs_ctes("supplier_field", "-7, -15"),
    )
CURVE = {
    "uv": """SELECT cell, lag, row_number() OVER (PARTITION BY cell, lag ORDER BY x, time)::DOUBLE / (COUNT(*) OVER (PARTITION BY cell, lag) + 1) AS u,
        row_number() OVER (PARTITION BY cell, lag ORDER BY y, time)::DOUBLE / (COUNT(*) OVER (PARTITION BY cell, lag) + 1) AS v FROM pairs""",
    "prob": """SELECT cell, lag, q, AVG(CASE WHEN greatest(u, v) < q THEN 1 ELSE 0 END) AS below,
        AVG(CASE WHEN least(u, v) > q THEN 1 ELSE 0 END) AS above FROM uv CROSS JOIN (SELECT unnest([0.5, 0.7, 0.8, 0.9]::DOUBLE[]) AS q)
        GROUP BY 1, 2, 3""",
    "curve": """SELECT cell, lag, q, CASE WHEN below > 0 THEN 2 - ln(below) / ln(q) END AS chi,
        CASE WHEN above > 0 THEN 2 * ln(1 - q) / ln(above) - 1 END AS chibar FROM prob""",
}
register(
    "dependence_curve", "flag_field response",
    "SELECT cell, lag, 0 AS fold, q, ROUND(chi, 6) AS chi, ROUND(chibar, 6) AS chibar FROM curve",
    **pairs_ctes("flag_field", "-7, -15"), **CURVE,
)
register(
    "chi", "flag_field response",
    "SELECT cell, lag, 0 AS fold, CASE WHEN chibar > 0 THEN ROUND(chi, 6) END AS corr FROM curve WHERE q = 0.9::DOUBLE",
    **pairs_ctes("flag_field", "-7, -15"), **CURVE,
)
ORDERED = """SELECT *, COUNT(*) OVER (PARTITION BY lag, fold ORDER BY pvalue) AS k,
    COUNT(*) OVER (PARTITION BY lag, fold) AS m FROM tests"""
register(
    "fdr_mask", "tests",
    """SELECT t.cell, t.fold, t.lag, t.pvalue, COALESCE(t.pvalue <= c.cut, FALSE) AS reject FROM tests t LEFT JOIN
        (SELECT lag, fold, MAX(pvalue) AS cut FROM o WHERE pvalue <= k::DOUBLE / m * 0.05::DOUBLE GROUP BY 1, 2) c
        ON c.lag = t.lag AND c.fold = t.fold""",
    o=ORDERED,
)
ADJUSTED = """SELECT lag, fold, pvalue, n, least(1.0::DOUBLE, MIN(pvalue * m / k) OVER (PARTITION BY lag, fold ORDER BY pvalue DESC)) AS p_adj
    FROM (SELECT lag, fold, pvalue, k, m, COUNT(*) AS n FROM o GROUP BY ALL)"""
register("fdr_adjusted", "tests", "SELECT lag, fold, pvalue, n, p_adj FROM a", o=ORDERED, a=ADJUSTED)
register(
    "significant_fractions", "tests",
    """SELECT lag, fold, ROUND(SUM(CASE WHEN pvalue < 0.05 THEN n ELSE 0 END) / SUM(n), 5) AS before,
        ROUND(SUM(CASE WHEN p_adj < 0.05 THEN n ELSE 0 END) / SUM(n), 5) AS after FROM a GROUP BY lag, fold""",
    o=ORDERED, a=ADJUSTED,
)
register(
    "series_properties", "supplier_field",
    """SELECT b.*, a1.auto1, a5.auto5 FROM b LEFT JOIN a1 USING (cell) LEFT JOIN a5 USING (cell)""",
    s=f"SELECT * FROM supplier_field WHERE {JJA}",
    b="""SELECT cell, COUNT(*) AS length, COUNT(*) FILTER (value IS NULL) AS n_nan, ROUND(STDDEV_SAMP(value), 3) AS std,
        ROUND(AVG(value), 3) AS mean, ROUND(regr_slope(value, year(time)), 3) AS trend FROM s GROUP BY cell""",
    a1="SELECT a.cell, ROUND(corr(a.value, b.value), 6) AS auto1 FROM s a JOIN s b ON b.cell = a.cell AND b.time = a.time + 1 GROUP BY a.cell",
    a5="SELECT a.cell, ROUND(corr(a.value, b.value), 6) AS auto5 FROM s a JOIN s b ON b.cell = a.cell AND b.time = a.time + 5 GROUP BY a.cell",
)

# --- folds ---------------------------------------------------------------------------
register(
    "year_folds", "response",
    """SELECT CAST(year AS INT) AS year, n.grp, fold, fieldfold, valstart, valend FROM numbered n JOIN groups g ON g.grp = n.grp""",
    **year_groups("response", 7),
)
register(
    "fold_bounds", "response", "SELECT fold, fieldfold, valstart, valend FROM groups",
    s=f"SELECT * FROM response WHERE {JJA}", **year_groups("s", 4),
)
register(
    "fold_training_years", "supplier_field response",
    """SELECT k.fieldfold, k.fold, year(MIN(p.time)) AS first_selected, year(MAX(p.time)) AS last_selected,
        year(k.valstart) AS first_validated, year(k.valend) AS last_validated, COUNT(*) AS n_pairs,
        CAST(COUNT(*) FILTER (WHERE p.time BETWEEN k.valstart AND k.valend) AS BIGINT) AS n_leaked
        FROM pairs p JOIN numbered y ON y.year = year(p.time) JOIN groups g ON g.grp = y.grp JOIN groups k ON k.grp <> g.grp
        GROUP BY k.fieldfold, k.fold, k.valstart, k.valend""",
    **pairs_ctes("supplier_field", "-7"), **year_groups("target", 4),
)
register("contiguous_folds", "response", "SELECT time, y, CAST(ntile(10) OVER (ORDER BY time) - 1 AS INT) AS fold FROM response")
register(
    "training_rows", "response",
    """SELECT k.fold, COUNT(*) AS n, SUM(y)::BIGINT AS total FROM response r JOIN numbered n ON n.year = year(r.time)
        JOIN groups g ON g.grp = n.grp JOIN groups k ON k.fold <> g.fold GROUP BY k.fold""",
    **year_groups("response", 7),
)

# --- verification --------------------------------------------------------------------
BSS = """SELECT {k} ROUND(bs, 6) AS bs, ROUND(clim, 6) AS clim, ROUND(ref, 6) AS bs_ref, ROUND((ref - bs) / ref, 6) AS bss FROM s"""
register(
    "brier_skill", "forecasts", BSS.format(k="model,"),
    s="""SELECT model, AVG((p - y) * (p - y)) AS bs, AVG(y) AS clim,
        AVG(y) * (AVG(y) - 1) * (AVG(y) - 1) + (1 - AVG(y)) * AVG(y) * AVG(y) AS ref FROM forecasts GROUP BY model""",
)
register(
    "brier_skill_reference", "daily_forecasts", BSS.format(k=""),
    s="SELECT AVG((p - y) * (p - y)) AS bs, AVG(y) AS clim, AVG((base - y) * (base - y)) AS ref FROM daily_forecasts",
)
register(
    "regression_scores", "forecasts",
    """SELECT model, ROUND(1 - SUM((p - y) * (p - y)) / (VAR_POP(y) * COUNT(y)), 6) AS r2, ROUND(AVG((p - y) * (p - y)), 6) AS mse,
        ROUND(AVG(abs(p - y)), 6) AS mae, ROUND(-AVG(y * ln(greatest(1e-15, least(1 - 1e-15, p)))
        + (1 - y) * ln(1 - greatest(1e-15, least(1 - 1e-15, p)))), 6) AS logloss FROM forecasts GROUP BY model""",
)
AUC = """SELECT {k} ROUND((SUM(r * y) - SUM(y) * (SUM(y) + 1) / 2) / (SUM(y) * (COUNT(*) - SUM(y))), 6) AS auc FROM r {g}"""
for name, k, g, by in (("auc", "model,", "GROUP BY model", "PARTITION BY model"), ("auc_all", "", "", "")):
    register(
        name, "forecasts", AUC.format(k=k, g=g),
        r=f"""SELECT model, CAST(y AS DOUBLE) AS y, rank() OVER ({by} ORDER BY p)
            + (COUNT(*) OVER (PARTITION BY {k} p) - 1) / 2.0::DOUBLE AS r FROM forecasts""",
    )
register(
    "kuipers", "forecasts",
    """SELECT model, ROUND((tp * tn - fp * fn)::DOUBLE / ((fn + tp) * (fp + tn)), 9) AS kuipers FROM (SELECT model,
        COUNT(*) FILTER (p > c AND y = 1) AS tp, COUNT(*) FILTER (p <= c AND y = 1) AS fn,
        COUNT(*) FILTER (p > c AND y = 0) AS fp, COUNT(*) FILTER (p <= c AND y = 0) AS tn
        FROM (SELECT *, AVG(y) OVER (PARTITION BY model) AS c FROM forecasts) GROUP BY model)""",
)
PEV = {
    "grid": "SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9]::DOUBLE[]) AS t",
    "rates": """SELECT {k} t, AVG(y) AS s, COUNT(*) FILTER (p > t AND y = 1)::DOUBLE / SUM(y) AS h,
        COUNT(*) FILTER (p > t AND y = 0)::DOUBLE / SUM(1 - y) AS f FROM forecasts CROSS JOIN grid GROUP BY {k} t""",
    "value": """SELECT {k} t, cl, (least(cl, s) - f * cl * (1 - s) + h * s * (1 - cl) - s) / (least(cl, s) - s * cl) AS v
        FROM rates CROSS JOIN (SELECT unnest(range(1, 100)) / 100.0::DOUBLE AS cl)""",
}
register(
    "pev_grid", "forecasts", "SELECT t AS p_thresh, cl, ROUND(v, 6) AS pev FROM value",
    **{n: s.format(k="") for n, s in PEV.items()},
)
register(
    "pev_envelope", "forecasts", "SELECT model, cl, ROUND(MAX(greatest(v, 0)), 6) AS pev FROM value GROUP BY model, cl",
    **{n: s.format(k="model,") for n, s in PEV.items()},
)
register(
    "reliability", "forecasts",
    """SELECT model, CAST(least(floor(p * 10), 9) AS INT) AS bin, ROUND(AVG(p), 6) AS mean_predicted,
        ROUND(AVG(y), 6) AS frequency, COUNT(*) AS n FROM forecasts GROUP BY 1, 2""",
)
register(
    "val_train_ratio", "forecasts",
    """SELECT model, ROUND(AVG((p - y) * (p - y)) FILTER (id % 5 = 0) / AVG((p - y) * (p - y)) FILTER (id % 5 <> 0), 6) AS "mse_val/train",
        ROUND(AVG(abs(p - y)) FILTER (id % 5 = 0) / AVG(abs(p - y)) FILTER (id % 5 <> 0), 6) AS "mae_val/train"
        FROM forecasts GROUP BY model""",
)

# --- inspection ----------------------------------------------------------------------
KEYS = "respagg, separation, fold, variable, timeagg, lag, clustid, metric"
FIT = "OVER (PARTITION BY respagg, separation, fold)"
register(
    "scale_within", "importances",
    f"""SELECT {KEYS}, COALESCE(ROUND((score - MIN(score) {FIT}) / nullif(MAX(score) {FIT} - MIN(score) {FIT}, 0), 9), 0) AS score,
        COALESCE(ROUND((MAX(rank) {FIT} - rank)::DOUBLE / nullif(MAX(rank) {FIT} - MIN(rank) {FIT}, 0), 9), 0) AS rank FROM importances""",
)
register(
    "reduce_over", "importances",
    """SELECT respagg, separation, variable, timeagg, lag, AVG(rank) AS rank FROM (SELECT respagg, separation, fold, variable,
        timeagg, lag, MAX(rank) AS rank FROM importances GROUP BY ALL) GROUP BY ALL""",
)
register(
    "importance_rollup", "importances",
    """SELECT respagg, variable, timeagg, SUM(rank)::BIGINT AS rank, COUNT(*) AS n FROM importances
        GROUP BY ROLLUP (respagg, variable, timeagg)""",
)
register(
    "top_features", "importances",
    """SELECT respagg, separation, fold, feature, rank, CAST(place AS INT) AS place FROM (SELECT respagg, separation, fold, feature, rank,
        row_number() OVER (PARTITION BY respagg, separation, fold ORDER BY rank DESC, feature) AS place
        FROM (SELECT *, concat_ws('.', variable, timeagg, clustid) AS feature FROM importances)) WHERE place <= 10""",
)
TOP = """SELECT fold, feature, row_number() OVER (PARTITION BY fold ORDER BY rank DESC, feature) - 1 AS place
    FROM (SELECT *, concat_ws('.', separation, variable, timeagg, clustid, metric) AS feature FROM importances
    WHERE respagg = {}) QUALIFY place < 9"""
register(
    "in_out_kept", "importances",
    """SELECT COALESCE(b.fold, o.fold) AS fold, COALESCE(b.feature, o.feature) AS feature,
        CASE WHEN b.feature IS NULL THEN 'in' WHEN o.feature IS NULL THEN 'out' ELSE 'kept' END AS status,
        CAST(COALESCE(b.place, o.place) AS INT) AS place FROM b FULL OUTER JOIN o ON o.fold = b.fold AND o.feature = b.feature""",
    b=TOP.format(7), o=TOP.format(31),
)
register(
    "fraction_significant", "cluster_fields",
    """SELECT variable, timeagg, separation, ROUND(AVG(s), 9) AS n_signif, ROUND(AVG(n), 9) AS n, ROUND(AVG(s::DOUBLE / n), 9) AS fraction
        FROM (SELECT variable, timeagg, separation, fold, COUNT(corr) AS s, COUNT(*) AS n FROM cluster_fields GROUP BY ALL) GROUP BY ALL""",
)
PAINT = """SELECT d.fold, d.variable, d.timeagg, d.separation, c.cell, c.clustid, CAST(i.rank AS DOUBLE) AS value
    FROM (SELECT DISTINCT fold, fieldfold, variable, timeagg, separation FROM i) d
    JOIN cluster_fields c ON c.fold = d.fieldfold AND c.variable = d.variable AND c.timeagg = d.timeagg AND c.separation = d.separation
    LEFT JOIN i ON i.fold = d.fold AND i.variable = d.variable AND i.timeagg = d.timeagg AND i.separation = d.separation
        AND i.clustid = c.clustid"""
register(
    "map_to_fields", "importances cluster_fields response", PAINT,
    r="SELECT * FROM response WHERE year(time) < 2000", **year_groups("r", 5),
    i="""SELECT m.*, g.fieldfold FROM importances m JOIN groups g ON g.fold = m.fold
        WHERE respagg = 7 AND metric = 'spatcov'""",
)
register(
    "accumulate_folds", "importances cluster_fields",
    """SELECT variable, timeagg, separation, cell, nullif(COUNT(value), 0) AS count,
        CASE WHEN COUNT(value) >= 3 THEN ROUND(AVG(value), 6) END AS mean FROM painted GROUP BY 1, 2, 3, 4""",
    i="SELECT *, fold AS fieldfold FROM importances WHERE respagg = 7 AND metric = 'spatcov'", painted=PAINT,
)
register(
    "anomaly_maps", "importances cluster_fields supplier_field",
    """SELECT d.fold, d.variable, d.timeagg, d.separation, c.cell, c.clustid, CASE WHEN k.keep THEN f.value::DOUBLE END AS anom,
        CASE WHEN k.keep THEN ROUND(c.corr, 6) END AS corr
        FROM (SELECT DISTINCT fold, variable, timeagg, separation FROM i) d
        JOIN cluster_fields c ON c.fold = d.fold AND c.variable = d.variable AND c.timeagg = d.timeagg AND c.separation = d.separation
        LEFT JOIN supplier_field f ON f.cell = c.cell AND d.variable = 'A' AND f.time = DATE '1998-07-14' + d.separation - 1
        LEFT JOIN (SELECT DISTINCT fold, variable, timeagg, separation, clustid, TRUE AS keep FROM i) k
        ON k.fold = d.fold AND k.variable = d.variable AND k.timeagg = d.timeagg AND k.separation = d.separation
        AND k.clustid = c.clustid""",
    i="SELECT * FROM importances WHERE respagg = 7 AND metric = 'mean' AND timeagg = 1",
)
register(
    "feature_counts", "importances",
    """SELECT variable, timeagg, separation, AVG(n) AS mean_clusters FROM (SELECT variable, timeagg, separation, fold,
        COUNT(DISTINCT clustid) AS n FROM importances GROUP BY ALL) GROUP BY ALL""",
)
register(
    "global_shap", "importances",
    f"SELECT {KEYS}, (abs(rank - 300) + abs(rank % 7)) / 2 AS avgabsshap FROM importances",
)
register(
    "matching_values", "importances",
    f"""SELECT {', '.join('i.' + k.strip() for k in KEYS.split(','))}, v.x FROM importances i LEFT JOIN (SELECT variable, timeagg, separation,
        SUM(rank)::BIGINT AS x FROM importances GROUP BY ALL) v
        ON v.variable = i.variable AND v.timeagg = i.timeagg AND v.separation = i.separation""",
)
register(
    "heat_data", "importances",
    """SELECT variable, AVG(rank) FILTER (timeagg = 1) AS t1, AVG(rank) FILTER (timeagg = 7) AS t7,
        AVG(rank) FILTER (timeagg = 31) AS t31 FROM importances GROUP BY variable""",
)
register(
    "by_separation", "cluster_fields",
    """SELECT fold, variable, cell, clustid, ROUND(corr, 6) AS corr, timeagg, lag, lag + timeagg AS separation
        FROM cluster_fields WHERE lag <> 0""",
)

# --- values of grouped features ------------------------------------------------------
# From the definition: the mean gain of a feature over all orders of the five in which (quantity, price) stand side by side, so do
# these two and the line number, and so do discount and tax.  A set of features is the sum of their powers of two.
TURNS = [
    [*first, *second] if forth else [*second, *first]
    for first in ([0, 1, 4], [1, 0, 4], [4, 0, 1], [4, 1, 0]) for second in ([2, 3], [3, 2]) for forth in (True, False)
]
STEPS = ", ".join(f"({f}, {sum(1 << g for g in turn[:at])})" for turn in TURNS for at, f in enumerate(turn))
SPLITS = {"a": ("q <= 20", 0), "b": ("d <= 4", 2), "c": ("c <= 4000000", 1), "e": ("q <= 35", 0), "f": ("t <= 3", 3),
          "g": ("c <= 2500000", 1), "h": ("l_linenumber <= 2", 4), "k": ("d <= 7", 2)}
SHOWS = ", ".join(f"{cond} AS s{name}" for name, (cond, _) in SPLITS.items())
NAMED = ", ".join(f"s{name}" for name in SPLITS)
MIXED = {name: f"(CASE WHEN (s >> {f}) & 1 = 1 THEN x.s{name} ELSE o.s{name} END)" for name, (_, f) in SPLITS.items()}
register(
    "owen_values", "",
    """SELECT l_orderkey, l_linenumber, feature, ROUND(shap, 8) AS shap FROM l JOIN shaps USING (%s)
        UNION ALL SELECT l_orderkey, l_linenumber, 'expected_value', ROUND(v, 8) FROM l JOIN v USING (%s) WHERE s = 0""" % (NAMED, NAMED),
    items="""SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS c,
        CAST(ROUND(l_discount * 100) AS INT) AS d, CAST(ROUND(l_tax * 100) AS INT) AS t FROM lineitem""",
    l=f"""SELECT l_orderkey, l_linenumber, {SHOWS} FROM (SELECT l_orderkey, l_linenumber, SUM(q) AS q, SUM(c) AS c, MAX(d) AS d, MAX(t) AS t
        FROM items GROUP BY 1, 2)""",
    x=f"SELECT DISTINCT {NAMED} FROM l",
    o=f"SELECT {NAMED}, COUNT(*) AS n FROM (SELECT {SHOWS} FROM items) GROUP BY ALL",
    v=f"""SELECT {", ".join("x.s" + name for name in SPLITS)}, s, SUM(n *
        (CASE WHEN {MIXED["a"]} THEN CASE WHEN {MIXED["b"]} THEN 1 ELSE 3 END
            WHEN {MIXED["c"]} THEN CASE WHEN {MIXED["e"]} THEN 2 ELSE 5 END ELSE 8 END
        + CASE WHEN {MIXED["f"]} THEN CASE WHEN {MIXED["g"]} THEN 0 ELSE 4 END
            WHEN {MIXED["h"]} THEN 6 WHEN {MIXED["k"]} THEN 1 ELSE 9 END)) / SUM(n)::DOUBLE AS v
        FROM x CROSS JOIN o CROSS JOIN (SELECT unnest(range(32)) AS s) GROUP BY ALL""",
    shaps=f"""SELECT {NAMED}, ['quantity', 'price', 'discount', 'tax', 'line'][f + 1] AS feature, SUM(w.v - b.v) / {len(TURNS)}.0::DOUBLE AS shap
        FROM (VALUES {STEPS}) steps(f, before) JOIN v b ON b.s = before JOIN v w USING ({NAMED}) WHERE w.s = before + (1 << f) GROUP BY ALL""",
)

# --- distances and clustering --------------------------------------------------------
# Every pair of cells is in the matrix, also one without a day in common.
register(
    "jaccard", "nation_field",
    """SELECT i, j, ROUND(CASE WHEN ni + nj - n > 0 THEN 1 - n::DOUBLE / (ni + nj - n) ELSE 0 END, 9) AS dist
        FROM (SELECT a.cell AS i, b.cell AS j, a.k AS ni, b.k AS nj, COALESCE(n, 0) AS n FROM c a JOIN c b ON a.cell < b.cell
        LEFT JOIN together t ON t.i = a.cell AND t.j = b.cell)""",
    m=f"SELECT *, value > quantile_cont(value, 0.75) OVER (PARTITION BY cell) AS y FROM nation_field WHERE {JJA}",
    c="SELECT cell, COUNT(*) FILTER (y) AS k FROM m GROUP BY cell",
    together="""SELECT a.cell AS i, b.cell AS j, COUNT(*) AS n FROM m a JOIN m b ON a.time = b.time AND a.y AND b.y AND a.cell < b.cell
        GROUP BY 1, 2""",
)
SMOOTH = "SELECT cell - k AS cell, time, SUM(value)::BIGINT AS value FROM supplier_field CROSS JOIN (SELECT unnest(range(8)) AS k) GROUP BY 1, 2"
register(
    "jaccard_near", "supplier_field",
    """SELECT a.cell AS i, b.cell AS j, ROUND(1 - n::DOUBLE / (a.k + b.k - n), 9) AS dist FROM together t
        JOIN c a ON a.cell = t.i JOIN c b ON b.cell = t.j WHERE 1 - n::DOUBLE / (a.k + b.k - n) <= 0.65::DOUBLE
        UNION ALL SELECT a.cell, b.cell, 0.0::DOUBLE FROM c a JOIN c b ON a.k = 0 AND b.k = 0 AND a.cell < b.cell""",
    sums=SMOOTH,
    m=f"SELECT *, value > quantile_cont(value, 0.75) OVER (PARTITION BY cell) AS y FROM sums WHERE {JJA}",
    c="SELECT cell, COUNT(*) FILTER (y) AS k FROM m GROUP BY cell",
    together="""SELECT a.cell AS i, b.cell AS j, COUNT(*) AS n FROM m a JOIN m b ON a.time = b.time AND a.y AND b.y AND a.cell < b.cell
        GROUP BY 1, 2""",
)
register(
    "max_correlation", "nation_field",
    """SELECT a.cell AS i, b.cell AS j, ROUND(1 - MAX(COALESCE(num, 0) / sqrt(a.ss * b.ss)), 6) AS dist FROM norms a
        JOIN norms b ON a.lag = 0 AND a.cell < b.cell
        LEFT JOIN r ON r.i = a.cell AND r.j = b.cell AND r.lag = b.lag GROUP BY 1, 2""",
    moved="""SELECT cell, lag, CAST(time - lag AS DATE) AS time, value FROM nation_field CROSS JOIN (SELECT unnest([-5, 0, 5]) AS lag)
        WHERE time - lag IN (SELECT time FROM nation_field)""",
    dev="SELECT *, value - AVG(value) OVER (PARTITION BY cell, lag) AS d FROM moved",
    norms="SELECT cell, lag, SUM(d * d) AS ss FROM dev GROUP BY 1, 2",
    r="""SELECT a.cell AS i, b.cell AS j, b.lag, SUM(a.d * b.d) AS num FROM dev a JOIN dev b
        ON b.time = a.time AND a.lag = 0 AND a.cell < b.cell GROUP BY 1, 2, 3""",
)
register(
    "correlation_near", "supplier_field",
    """SELECT i, j, dist FROM (SELECT r.i, r.j, ROUND(1 - MAX(num / sqrt(a.ss * b.ss)), 6) AS dist, MAX(num / sqrt(a.ss * b.ss)) AS best FROM r
        JOIN norms a ON a.cell = r.i AND a.lag = 0 JOIN norms b ON b.cell = r.j AND b.lag = r.lag GROUP BY 1, 2)
        WHERE 1 - best <= 0.4::DOUBLE""",
    sums=SMOOTH,
    moved="""SELECT cell, lag, CAST(time - lag AS DATE) AS time, value FROM sums CROSS JOIN (SELECT unnest([-5, 0, 5]) AS lag)
        WHERE time - lag IN (SELECT time FROM sums)""",
    dev="SELECT *, value - AVG(value) OVER (PARTITION BY cell, lag) AS d FROM moved",
    norms="SELECT cell, lag, SUM(d * d) AS ss FROM dev GROUP BY 1, 2",
    r="""SELECT a.cell AS i, b.cell AS j, b.lag, SUM(a.d * b.d) AS num FROM dev a JOIN dev b
        ON b.time = a.time AND a.lag = 0 AND a.cell < b.cell GROUP BY 1, 2, 3""",
)
HAVERSINE = """2 * 6371.0088::DOUBLE * asin(sqrt(pow(sin((radians(a.lat) - radians(b.lat)) / 2), 2)
    + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(a.lon) - radians(b.lon)) / 2), 2)))"""
for name, column, limit in (("haversine_neighbours", "km", 700), ("haversine_matrix", "dist", 500)):
    register(
        name, "supplier_points",
        f"""SELECT i, j, ROUND(km, 3) AS {column} FROM (SELECT a.cell AS i, b.cell AS j, {HAVERSINE} AS km
            FROM supplier_points a JOIN supplier_points b ON a.cell < b.cell) WHERE km <= {limit}""",
    )
ORACLE["dbscan"] = (
    "WITH RECURSIVE " + using(
        "supplier_points", "",
        pts="SELECT * FROM supplier_points",
        near=f"SELECT a.cell AS i, b.cell AS j FROM pts a JOIN pts b ON {HAVERSINE} <= 260",
        core="SELECT i AS cell FROM near GROUP BY i HAVING COUNT(*) >= 4",
        links="SELECT i, j FROM near WHERE i IN (FROM core) AND j IN (FROM core)",
        reach="SELECT cell AS i, cell AS j FROM core UNION SELECT r.i, l.j FROM reach r JOIN links l ON l.i = r.j",
        rooted="SELECT i AS cell, MIN(j) AS root FROM reach GROUP BY i",
        numbered="SELECT cell, CAST(dense_rank() OVER (ORDER BY root) - 1 AS INT) AS clustid FROM rooted",
    )[5:]
    + """SELECT p.cell, COALESCE(n.clustid, (SELECT MIN(m.clustid) FROM near JOIN numbered m ON m.cell = near.j WHERE near.i = p.cell)) AS clustid
        FROM pts p LEFT JOIN numbered n ON n.cell = p.cell"""
)

# --- streaming -----------------------------------------------------------------------
register(
    "stream_daily_mean", "hourly",
    "SELECT cell, CAST(ts AS DATE) AS time, SUM(value) / COUNT(value) AS value FROM hourly GROUP BY 1, 2",
)
register(
    "stream_closed_days", "hourly",
    """SELECT cell, CAST(ts AS DATE) AS time, MAX(value) AS value FROM hourly
    GROUP BY 1, 2 HAVING CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT MAX(ts) - INTERVAL 1 DAY FROM hourly)""",
)
register("stream_hour_slice", "hourly", "SELECT cell, CAST(ts AS DATE) AS time, value FROM hourly WHERE hour(ts) = 12")
register("stream_midnight_slice", "hourly", "SELECT cell, CAST(ts AS DATE) - 1 AS time, value FROM hourly WHERE hour(ts) = 0")
register(
    "stream_days_with_gaps", "",
    """SELECT cell, time, value FROM islands WHERE island = 0
        OR first + INTERVAL 5 DAY <= (SELECT MAX(ts) - INTERVAL 1 DAY FROM events)""",
    days="""SELECT user_id AS cell, CAST(ts AS DATE) AS time, CAST(MIN(CAST(ROUND(value * 100) AS BIGINT)) AS DOUBLE) AS value
        FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2""",
    numbered="""SELECT *, time - (SELECT CAST(MIN(ts) AS DATE) FROM events)
        - (row_number() OVER (PARTITION BY cell ORDER BY time) - 1) AS island FROM days""",
    islands="SELECT *, MIN(time) OVER (PARTITION BY cell, island) AS first FROM numbered",
)
register(
    "stream_ordered_days", "hourly",
    """SELECT cell, time, 1.0::DOUBLE AS value FROM (SELECT DISTINCT cell, CAST(ts AS DATE) AS time FROM hourly)
        QUALIFY time - MIN(time) OVER (PARTITION BY cell) = row_number() OVER (PARTITION BY cell ORDER BY time) - 1""",
)

# --- bootstrap -------------------------------------------------------------------------


def _mixing(start: str, name: str) -> str:
    """Columns ``name0`` to ``name2``: the same mixing of a number below 2^31 as in ``operators.resampling``."""
    mask = 2147483647
    return f"""({start}) & {mask} AS {name}_, (xor({name}_, {name}_ >> 15) * 739982445) & {mask} AS {name}0,
        (xor({name}0, {name}0 >> 12) * 695872825) & {mask} AS {name}1, xor({name}1, {name}1 >> 15) AS {name}2"""


def bootstrap_ctes(source: str, sums: str, n_draws: int, sizes: str, seed: int = 7) -> dict[str, str]:
    """CTEs up to ``totals``: per block size and draw the sums of the drawn blocks."""
    names = [part.rsplit(" AS ", 1)[1] for part in sums.split("; ")]
    added = ", ".join(f"SUM({part.rsplit(' AS ', 1)[0]}) AS {name}" for part, name in zip(sums.split("; "), names))
    again = ", ".join(f"SUM({name}) AS {name}" for name in names)
    return {
        "placed": f"SELECT *, row_number() OVER (ORDER BY time) - 1 AS i FROM {source}",
        "blocks": f"""SELECT blocksize, i // coalesce(blocksize, 1) AS block, {added}
            FROM placed CROSS JOIN (SELECT unnest({sizes}::INT[]) AS blocksize) GROUP BY 1, 2""",
        "sizes": "SELECT blocksize, COUNT(*) AS n_blocks FROM blocks GROUP BY 1",
        "draws": f"""SELECT draw, {_mixing(f"draw * 40503 + {seed}", "a")},
            {_mixing("xor(a_, 1013904223)", "b")} FROM (SELECT unnest(range({n_draws})) AS draw)""",
        "taken": f"""SELECT blocksize, draw, {_mixing("a2 + position * 2654435761", "p")}, {_mixing("xor(p2, b2)", "q")}, (q2 * n_blocks) >> 31 AS block
            FROM draws CROSS JOIN (SELECT blocksize, n_blocks, unnest(range(n_blocks)) AS position FROM sizes)""",
        "totals": f"""SELECT t.blocksize, t.draw, {again} FROM taken t
            JOIN blocks b ON b.block = t.block AND b.blocksize IS NOT DISTINCT FROM t.blocksize GROUP BY 1, 2""",
    }


register(
    "skill_intervals", "daily_forecasts",
    """SELECT blocksize, ROUND(quantile_cont((reference - model) / reference, 0.05), 6) AS q05,
        ROUND(quantile_cont((reference - model) / reference, 0.5), 6) AS q50, ROUND(quantile_cont((reference - model) / reference, 0.95), 6) AS q95
        FROM totals GROUP BY 1""",
    **bootstrap_ctes("daily_forecasts", "(base - y) * (base - y) AS reference; (p - y) * (p - y) AS model", 5000, "[NULL, 5, 15, 30, 60]"),
)
#: The two-sided tail of Student's t with an even number of degrees of freedom is a finite sum.
register(
    "bootstrap_correlation", "daily_forecasts",
    """SELECT ROUND(estimate, 6) AS estimate, ROUND(1 - tail, 6) AS pvalue FROM (
        SELECT MAX(m) AS estimate, MAX(abs(t) / sqrt(4998 + t * t)) * SUM(exp(lgamma(2.0::DOUBLE * k + 1) - 2 * lgamma(k + 1.0::DOUBLE) - 2 * k * ln(2.0::DOUBLE)
            + k * ln(4998 / (4998 + t * t)))) AS tail
        FROM (SELECT AVG(stat) AS m, AVG(stat) / stddev_pop(stat) AS t FROM correlations) CROSS JOIN (SELECT unnest(range(2499)) AS k))""",
    **bootstrap_ctes("daily_forecasts", "1.0::DOUBLE AS n; y AS sx; p AS sy; y * y AS sxx; p * p AS syy; y * p AS sxy", 5000, "[15]"),
    correlations="SELECT (n * sxy - sx * sy) / (sqrt(n * sxx - sx * sx) * sqrt(n * syy - sy * sy)) AS stat FROM totals",
)

# --- models --------------------------------------------------------------------------
WEEK = "cell, time, value FROM (SELECT cell, time, SUM(value) {w} / COUNT(value) {w} AS value, COUNT(value) {w} AS n FROM {f}) WHERE n = 7"
W7_FLAG, W7_ALL = (f"SELECT {WEEK.format(w=FRAME.format(6), f=f)}" for f in ("flag_field", "target"))
STEP = """SELECT k + 1, b0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
    FROM (SELECT MAX(k) AS k, MAX(b0) AS b0, MAX(b1) AS b1, SUM(q - y) AS g0, SUM((q - y) * z) + MAX(b1) AS g1,
        SUM(q * (1 - q)) AS h00, SUM(q * (1 - q) * z) AS h01, SUM(q * (1 - q) * z * z) + 1 AS h11
        FROM (SELECT i.k, i.b0, i.b1, s.z, s.y, 1 / (1 + exp(-(i.b0 + i.b1 * s.z))) AS q FROM newton i CROSS JOIN scaled s)) WHERE k < 25"""
MODELLED = dict(
    target="SELECT 0 AS cell, time, y AS value FROM response",
    inputs=W7_FLAG,
    complete="""SELECT i.time - l.lag AS time FROM inputs i CROSS JOIN (SELECT unnest([-7, -14, -22]) AS lag) l
        GROUP BY 1 HAVING COUNT(*) = 9""",
    weekly=f"SELECT * FROM ({W7_ALL}) WHERE {JJA}",
    events="SELECT time, CASE WHEN value > (SELECT quantile_cont(value, 0.666) FROM weekly) THEN 1 ELSE 0 END AS y FROM weekly",
    rows_in="SELECT * FROM events WHERE time IN (SELECT time FROM complete)",
    **year_groups("rows_in", 4),
)
ORACLE["base_rate_forecast"] = (
    "WITH RECURSIVE " + using(
        "flag_field response", "",
        **MODELLED,
        dated="SELECT time, y, (time - DATE '1970-01-01') + 2440587.5::DOUBLE AS j FROM rows_in",
        scaled="SELECT time, y, (j - AVG(j) OVER ()) / STDDEV_POP(j) OVER () AS z FROM dated",
        newton=f"SELECT 0 AS k, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1 UNION ALL {STEP}",
    )[5:]
    + """SELECT g.fold, s.time, s.y, ROUND(1 / (1 + exp(-(n.b0 + n.b1 * s.z))), 4) AS p FROM scaled s
        CROSS JOIN (SELECT * FROM newton ORDER BY k DESC LIMIT 1) n
        JOIN numbered y ON y.year = year(s.time) JOIN groups g ON g.grp = y.grp"""
)

#: The same steps for every fold, on the rows outside it.
FOLD_STEP = """SELECT k + 1, fold, b0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
    FROM (SELECT k, fold, MAX(b0) AS b0, MAX(b1) AS b1, SUM(q - y) AS g0, SUM((q - y) * z) + MAX(b1) AS g1,
        SUM(q * (1 - q)) AS h00, SUM(q * (1 - q) * z) AS h01, SUM(q * (1 - q) * z * z) + 1 AS h11
        FROM (SELECT i.k, i.fold, i.b0, i.b1, s.y, (s.j - m.mean) / m.sd AS z, 1 / (1 + exp(-(i.b0 + i.b1 * (s.j - m.mean) / m.sd))) AS q
            FROM newton i JOIN folded s ON s.fold <> i.fold JOIN moments m ON m.fold = i.fold) GROUP BY k, fold) WHERE k < 25"""
ORACLE["base_rate_folds"] = (
    "WITH RECURSIVE " + using(
        "flag_field response", "", **MODELLED,
        folded="""SELECT r.time, r.y, (r.time - DATE '1970-01-01') + 2440587.5::DOUBLE AS j, g.fold FROM rows_in r
            JOIN numbered y ON y.year = year(r.time) JOIN groups g ON g.grp = y.grp""",
        moments="""SELECT k.fold, AVG(j) AS mean, STDDEV_POP(j) AS sd FROM folded f JOIN (SELECT DISTINCT fold FROM folded) k ON k.fold <> f.fold
            GROUP BY 1""",
        newton=f"SELECT 0 AS k, fold, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1 FROM moments UNION ALL {FOLD_STEP}",
    )[5:]
    + """SELECT s.fold, s.time, s.y, ROUND(1 / (1 + exp(-(n.b0 + n.b1 * (s.j - m.mean) / m.sd))), 6) AS p FROM folded s
        JOIN moments m ON m.fold = s.fold JOIN newton n ON n.fold = s.fold AND n.k = 25"""
)

# --- plot data -----------------------------------------------------------------------
register(
    "scatter_data", "region_field response",
    """SELECT f.cell, f.time, f.value, CAST(f.cell % 4 AS INT) AS fold, s.y, f.time BETWEEN g.valstart AND g.valend AS validation
        FROM region_field f JOIN s ON s.time = f.time JOIN groups g ON g.fold = f.cell % 4""",
    s=f"SELECT * FROM response WHERE {JJA}", **year_groups("s", 4),
)
register("forecast_lines", "daily_forecasts", f"SELECT time, ROUND(p, 6) AS p, y FROM daily_forecasts WHERE {JJA}")
register(
    "shap_data", "flag_field",
    """SELECT f.cell AS variable, -7 AS lag, f.time, f.value % 100 - 50 AS shap, r.value AS feature_value, f.cell AS feature
        FROM flag_field f LEFT JOIN r ON r.cell = f.cell AND r.time = f.time""",
    r=rolled("flag_field", 7),
)
register(
    "dot_data", "importances",
    """SELECT variable, respagg, separation, timeagg AS y, MAX(rank) AS size FROM importances GROUP BY 1, 2, 3, 4""",
)
register(
    "grid_edges", "supplier_points",
    "SELECT *, lat - 0.25::DOUBLE AS south, lat AS north, lon AS west, lon + 0.25::DOUBLE AS east FROM supplier_points",
)
register("stationary_base_rate", "response", "SELECT time, 0.25::DOUBLE AS baserate FROM response")
register(
    "series_trend", "supplier_field",
    """SELECT cell, ROUND(regr_slope(value, year(time)) / STDDEV_POP(value), 6) AS trend,
        ROUND((regr_intercept(value, year(time)) - AVG(value)) / STDDEV_POP(value), 3) AS intercept FROM supplier_field GROUP BY cell""",
)

# --- average linkage, one merge per step ---------------------------------------------
MERGE = """SELECT k + 1, [CASE WHEN x = b THEN a ELSE x END for x in labels], a, b, h,
        len([x for x in labels if x = a OR x = b]) FROM (
        SELECT s.k, s.labels, least(s.labels[p.i], s.labels[p.j]) AS a, greatest(s.labels[p.i], s.labels[p.j]) AS b, AVG(p.dist) AS h
        FROM merging s JOIN placed p ON s.labels[p.i] <> s.labels[p.j] GROUP BY 1, 2, 3, 4 ORDER BY h, a, b LIMIT 1)"""
LINKAGE = {
    "m": f"SELECT *, value > quantile_cont(value, 0.75) OVER (PARTITION BY cell) AS y FROM nation_field WHERE {JJA}",
    "c": "SELECT cell, COUNT(*) FILTER (y) AS k, row_number() OVER (ORDER BY cell) AS pos FROM m GROUP BY cell",
    "together": """SELECT a.cell AS i, b.cell AS j, COUNT(*) AS n FROM m a JOIN m b ON a.time = b.time AND a.y AND b.y AND a.cell < b.cell
        GROUP BY 1, 2""",
    "placed": """SELECT a.pos AS i, b.pos AS j, CASE WHEN a.k + b.k > COALESCE(n, 0) THEN 1 - COALESCE(n, 0)::DOUBLE / (a.k + b.k - COALESCE(n, 0))
        ELSE 0 END AS dist FROM c a JOIN c b ON a.cell < b.cell LEFT JOIN together t ON t.i = a.cell AND t.j = b.cell""",
    "merging": f"""SELECT 0 AS k, (SELECT list(cell ORDER BY cell) FROM c) AS labels, CAST(NULL AS INT) AS a, CAST(NULL AS INT) AS b,
        CAST(NULL AS DOUBLE) AS h, CAST(0 AS BIGINT) AS size UNION ALL {MERGE}""",
}
ORACLE["linkage_merges"] = (
    "WITH RECURSIVE " + using("nation_field", "", **LINKAGE)[5:]
    + "SELECT a, b, ROUND(h, 9) AS height, size FROM merging WHERE k > 0"
)
ORACLE["linkage_clusters"] = (
    "WITH RECURSIVE " + using("nation_field", "", **LINKAGE)[5:]
    + """SELECT cell, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INT) AS clustid FROM (SELECT c.cell, g.labels[c.pos] AS label
        FROM merging g JOIN c ON g.k = (SELECT COUNT(*) FROM c) - 8)"""
)
