"""A field that grows by appends, with a manifest of the (day, cell range) parts that are committed.

A store is a folder with ``data/commit=…`` and ``manifest``.  An append writes its rows under a commit of its own
and then one manifest file with the days, the least and the largest cell and the row count of what it wrote.  That file
appears as a whole, and rows without a line in it are not part of the field: an append that fails halfway changes
nothing and can be run again.  Appends of different cells of a day add up.  Where two appends hold the same cell and day
the later one counts, and a NULL value takes an earlier one back.  One writer at a time; readers need no lock.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldcast.sources.fields import stored


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """Committed parts ``(commit, base, time, first, last, n)`` that still count; nothing where there is no store.

    Commits before the last compaction are left out.
    """
    parts = stored(spark, f"{path}/manifest")
    if parts is None:
        return None
    base = parts.where("base").agg(F.max("commit")).scalar()
    return parts.where(F.col("commit") >= F.coalesce(base, F.lit("")))


def _next_commit(spark: SparkSession, path: str) -> str:
    """Commits sort as text in the order of their numbers."""
    parts = stored(spark, f"{path}/manifest")
    last = parts.agg(F.max("commit")).first()[0] if parts is not None else None
    return f"{int(last.split('-')[0]) + 1 if last else 0:010d}-{uuid.uuid4().hex}"


def _commit(rows: DataFrame, path: str, base: bool) -> str:
    spark = rows.sparkSession
    name = _next_commit(spark, path)
    # By ranges of (day, cell) and not in a folder a day: a first append holds decades, a later one a day.
    ordered = rows.repartitionByRange("time", "cell").sortWithinPartitions("time", "cell")
    ordered.write.parquet(f"{path}/data/commit={name}")
    lines = spark.read.parquet(f"{path}/data/commit={name}").groupBy("time").agg(
        F.min("cell").alias("first"), F.max("cell").alias("last"), F.count(F.lit(1)).alias("n")
    )
    lines = lines.select(F.lit(name).alias("commit"), F.lit(base).alias("base"), "time", "first", "last", "n")
    lines.coalesce(1).write.mode("append").parquet(f"{path}/manifest")  # one line a day
    return name


def append_days(days: DataFrame, path: str) -> str:
    """Add ``(cell, time, value, …)`` as one commit and return its name.

    A row without a cell or a day is an error.  Of repeated rows of a cell and day within one append the greatest counts.
    An append without rows commits nothing and takes no number.
    """
    missing = F.raise_error(F.lit("an append has rows without a cell or a day"))
    known = days.where(F.when(F.col("cell").isNull() | F.col("time").isNull(), missing.cast("boolean")).otherwise(True))
    rest = F.struct(*[c for c in days.columns if c not in ("cell", "time")])
    return _commit(known.groupBy("cell", "time").agg(F.max(rest).alias("_r")).select("cell", "time", "_r.*"), path, base=False)


def clashes(parts: DataFrame) -> DataFrame:
    """The parts with ``clash``: whether another part of the day overlaps its range of cells.

    A sweep over the parts of a day by their first cell, as many as there were appends to it.
    """
    order = Window.partitionBy("time").orderBy("first", "commit")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min("first").over(order.rowsBetween(1, Window.unboundedFollowing))
    hit = F.coalesce(before >= F.col("first"), F.lit(False)) | F.coalesce(after <= F.col("last"), F.lit(False))
    return parts.withColumn("clash", hit)


def read_days(spark: SparkSession, path: str) -> DataFrame:
    """The field as of the last commit, without NULL values.

    Parts that overlap no other are read as they are; only the others are shuffled, for the latest row of a cell and day.
    A filter on ``time`` skips row groups, as the rows of a commit are sorted by day.
    """
    parts = manifest(spark, path)
    if parts is None:
        raise FileNotFoundError(f"{path} holds no committed days")
    data = spark.read.parquet(f"{path}/data")
    others = [c for c in data.columns if c not in ("commit", "cell", "time")]
    marked = data.join(clashes(parts).select("commit", "time", "clash"), ["commit", "time"])
    alone = marked.where(~F.col("clash")).select("cell", "time", *others)
    rest = F.struct(*others)
    latest = marked.where("clash").groupBy("cell", "time").agg(F.max_by(rest, "commit").alias("_r"))
    return alone.unionByName(latest.select("cell", "time", "_r.*")).where(F.col("value").isNotNull())


def append_new(days: DataFrame, path: str) -> str | None:
    """Add only the cells and days that the store does not hold yet; nothing where all are there."""
    spark = days.sparkSession
    if manifest(spark, path) is not None:
        days = days.join(read_days(spark, path).select("cell", "time"), ["cell", "time"], "left_anti")
    if days.isEmpty():
        return None
    return append_days(days, path)


def compact(spark: SparkSession, path: str) -> str:
    """Write the field anew as one commit that stands for all before it; their files are left for a later clean-up."""
    return _commit(read_days(spark, path), path, base=True)
