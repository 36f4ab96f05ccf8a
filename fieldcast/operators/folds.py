"""Cross-validation folds: by year groups or contiguous, as columns and small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fold_table(days: DataFrame, n_folds: int) -> DataFrame:
    """``(year, grp, fold, fieldfold, valstart, valend)``: one row per year of the record.

    Years are grouped in runs of ``ceil(n_years / n_folds)`` counted from the first year.
    ``fieldfold`` is the chronological number of a group.  ``fold`` is the order in which
    grouped k-fold hands them out: largest group first, the later of equal ones first.
    Fails at run time when rounding leaves a number of groups other than ``n_folds``.
    Everything after the first aggregation has at most one row per calendar year.
    """
    years = days.groupBy(F.year("time").alias("year")).agg(
        F.count(F.lit(1)).alias("_rows"), F.min("time").alias("_a"), F.max("time").alias("_b")
    )
    everything = Window.partitionBy(F.lit(0))
    size = F.ceil(F.count(F.lit(1)).over(everything) / n_folds)
    first = F.min("year").over(everything)
    years = years.withColumn("grp", F.floor((F.col("year") - first) / size).cast("int"))
    group = Window.partitionBy("grp")
    years = years.withColumns(
        {
            "_rows": F.sum("_rows").over(group),
            "valstart": F.min("_a").over(group),
            "valend": F.max("_b").over(group),
        }
    )
    by_size = everything.orderBy(F.col("_rows").desc(), F.col("grp").desc())
    years = years.withColumns(
        {
            "fold": F.dense_rank().over(by_size) - 1,
            "fieldfold": F.dense_rank().over(everything.orderBy("grp")) - 1,
        }
    )
    found = F.max("fieldfold").over(everything) + 1
    ok = F.assert_true(found == n_folds, f"year groups do not make {n_folds} folds; choose another number")
    years = years.withColumn("_ok", ok).where(F.col("_ok").isNull())
    return years.select("year", "grp", "fold", "fieldfold", "valstart", "valend")


def with_year_fold(df: DataFrame, n_folds: int, days: DataFrame | None = None, number: str = "fold") -> DataFrame:
    """Add the validation ``fold`` of each row's year; ``days`` defaults to the rows' own.

    ``number`` picks the numbering: ``fold`` as grouped k-fold hands the groups out, as models use it, or ``fieldfold``
    along time, as fields and features carry it.
    """
    table = fold_table(days if days is not None else df, n_folds).select(F.col("year").alias("_year"), F.col(number).alias("fold"))
    return df.withColumn("_year", F.year("time")).join(table, "_year").drop("_year")


def fold_bounds(days: DataFrame, n_folds: int) -> DataFrame:
    """First and last validation day per fold, with the chronological field fold."""
    return fold_table(days, n_folds).select("fold", "fieldfold", "valstart", "valend").distinct()


def with_contiguous_fold(series: DataFrame, n_folds: int) -> DataFrame:
    """Plain k-fold of a daily series: n_folds runs in time, the first ones one longer.

    One row per day makes the single ordered window calendar-bounded.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("time")
    return series.withColumn("fold", F.ntile(n_folds).over(order) - 1)


def training_copies(df: DataFrame, n_folds: int, fold: str = "fold") -> DataFrame:
    """Every row once for each fold it trains, i.e. all folds but its own (narrow explode)."""
    others = F.filter(F.sequence(F.lit(0), F.lit(n_folds - 1)), lambda k: k != F.col("_val"))
    return df.withColumnRenamed(fold, "_val").withColumn(fold, F.explode(others)).drop("_val")
