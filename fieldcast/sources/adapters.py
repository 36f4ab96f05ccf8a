"""Views that turn the relational test tables into fields.

Money becomes integer cents before it is summed: integer sums do not depend on the order
of partial aggregation, so results are identical whatever the partitioning.  Every view
aggregates per (cell, day) with a map-side combine before its shuffle, so a hot key
reaches the reducers as at most one row per day and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcast.session import dealt_by_size, more_than_usual


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


def flag_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearly gap-free: one cell per return flag, daily shipped cents."""
    items = table(spark, sf_dir, "lineitem", "l_returnflag", "l_shipdate", "l_extendedprice")
    return items.groupBy(
        F.col("l_returnflag").alias("cell"), F.to_date("l_shipdate").alias("time")
    ).agg(F.sum(cents("l_extendedprice")).alias("value"))


def supplier_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(cell, time, value)``: the cents of every line item, by its supplier; several rows a cell and day."""
    return table(spark, sf_dir, "lineitem", "l_suppkey", "l_shipdate", "l_extendedprice").select(
        F.col("l_suppkey").alias("cell"), F.to_date("l_shipdate").alias("time"), cents("l_extendedprice").alias("value")
    )


def supplier_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many gappy cells, growing with the data: one per supplier.

    Nearly every row is a cell and day of its own, so a large table is dealt over tasks by its rows before it is summed.
    """
    items = supplier_rows(spark, sf_dir)
    rows = items.count()  # from the files' footers
    if more_than_usual(spark, rows):
        items = dealt_by_size(items, rows, "cell", "time")
    return items.groupBy("cell", "time").agg(F.sum("value").alias("value"))


def region_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five gappy cells from orders; pre-aggregated per customer before the join."""
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_totalprice")
    daily = orders.groupBy("o_custkey", F.to_date("o_orderdate").alias("time")).agg(
        F.sum(cents("o_totalprice")).alias("value")
    )
    customers = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    joined = daily.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy((F.col("c_nationkey") % 5).alias("cell"), "time").agg(F.sum("value").alias("value"))


def response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target series ``(time, y)``: daily ordered cents of all customers."""
    orders = table(spark, sf_dir, "orders", "o_orderdate", "o_totalprice")
    return orders.groupBy(F.to_date("o_orderdate").alias("time")).agg(F.sum(cents("o_totalprice")).alias("y"))


def supplier_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates of the supplier cells: a 2.5 by 2.5 degree grid, filled row by row."""
    row, column = F.floor(F.col("s_suppkey") / 20), F.col("s_suppkey") % 20
    return table(spark, sf_dir, "supplier", "s_suppkey").select(
        F.col("s_suppkey").alias("cell"),
        (F.lit(30.0) + (row % 24) * 2.5).alias("lat"),
        (F.lit(-30.0) + column * 2.5 + F.floor(row / 24) * 0.25).alias("lon"),
    )


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw sub-daily values ``(cell, ts, value)`` in cents, one cell per event type."""
    return table(spark, sf_dir, "events", "event_type", "ts", "value").select(
        F.col("event_type").alias("cell"), "ts", cents("value").alias("value")
    )


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One probability forecast and outcome per line item: ``(id, time, model, y, p)``.

    The probability is a fixed expression of quantity and discount; the event is a return.
    """
    items = table(
        spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_discount", "l_returnflag"
    )
    percent = F.round(F.col("l_discount") * 100).cast("int")
    return items.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        F.to_date("l_shipdate").alias("time"),
        percent.alias("model"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
        ((F.col("l_quantity").cast("int") * 7 + percent * 11) % 101 / F.lit(100.0)).alias("p"),
    )


IMPORTANCE_KEYS = ("respagg", "separation", "fold", "variable", "timeagg", "lag", "clustid", "metric")


def _feature_columns() -> dict[str, Column]:
    percent_discount = F.round(F.col("l_discount") * 100).cast("int")
    percent_tax = F.round(F.col("l_tax") * 100).cast("int")
    timeagg = F.element_at(F.array(F.lit(1), F.lit(7), F.lit(31)), percent_tax % 3 + 1)
    separation = F.element_at(F.array(F.lit(0), F.lit(-5), F.lit(-15)), percent_discount % 3 + 1)
    return {
        "separation": separation,
        "fold": (F.col("l_partkey") % 5).cast("int"),
        "variable": F.col("l_returnflag"),
        "timeagg": timeagg,
        "lag": separation - timeagg,
    }


def importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An importance frame whose keys and measures come from line items."""
    items = table(
        spark, sf_dir, "lineitem", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    )
    keyed = items.select(
        F.when(F.col("l_linenumber") % 2 == 0, 7).otherwise(31).alias("respagg"),
        *[c.alias(k) for k, c in _feature_columns().items()],
        (F.col("l_suppkey") % 4).cast("int").alias("clustid"),
        F.when(F.col("l_linestatus") == "F", "mean").otherwise("spatcov").alias("metric"),
        cents("l_extendedprice").alias("_c"),
        F.col("l_quantity").cast("bigint").alias("_q"),
    )
    return keyed.groupBy(*IMPORTANCE_KEYS).agg(
        (F.sum("_c") / F.count("_c")).alias("score"), F.sum("_q").alias("rank")
    )


def cluster_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation and cluster per supplier cell, fold, variable and window; some noise, some gaps."""
    items = table(
        spark, sf_dir, "lineitem", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag",
    )
    keyed = items.select(
        *[c.alias(k) for k, c in _feature_columns().items()],
        F.col("l_suppkey").alias("cell"),
        F.col("l_quantity").cast("bigint").alias("_q"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("_d"),
    )
    sums = keyed.groupBy("fold", "variable", "timeagg", "lag", "separation", "cell").agg(
        F.sum("_q").alias("_q"), F.sum("_d").alias("_d"), F.count(F.lit(1)).alias("_n")
    )
    clustid = F.when(F.col("cell") % 5 < 4, (F.col("cell") % 5).cast("int"))
    corr = F.when(F.col("_q") % 3 != 0, F.col("_d") / (F.col("_n") * 10) - 0.5)
    return sums.select(
        "fold", "variable", "timeagg", "lag", "separation", "cell", clustid.alias("clustid"), corr.alias("corr")
    )


def nation_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty-five cells from orders, daily cents per customer nation."""
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_totalprice")
    daily = orders.groupBy("o_custkey", F.to_date("o_orderdate").alias("time")).agg(
        F.sum(cents("o_totalprice")).alias("value")
    )
    customers = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    joined = daily.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_nationkey").alias("cell"), "time").agg(F.sum("value").alias("value"))


def daily_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two competing daily probability forecasts of a high-turnover day ``(time, y, base, p)``.

    The event compares a day's cents with those of the average order times a fixed factor;
    both forecasts are fixed functions of the number of items shipped that day.
    """
    items = table(spark, sf_dir, "lineitem", "l_shipdate", "l_extendedprice", "l_quantity")
    daily = items.groupBy(F.to_date("l_shipdate").alias("time")).agg(
        F.sum(cents("l_extendedprice")).alias("_c"), F.sum(F.col("l_quantity").cast("bigint")).alias("_q")
    )
    level = daily.agg(F.sum("_c") / F.count("_c")).scalar()
    usual = daily.agg(F.sum("_q") / F.count("_q")).scalar()
    logit = 3 * (F.col("_q") / usual - 1)
    return daily.select(
        "time",
        (F.col("_c") > level).cast("int").alias("y"),
        (F.lit(0.4) + (F.year("time") - 1995) / 40).alias("base"),
        (1 / (1 + F.exp(-logit))).alias("p"),
    )
