"""Reading and writing fields, and sinks that can be run twice without harm."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldcast.catalog import REGIONS, Region
from fieldcast.session import cut


def read_field(spark: SparkSession, path: str, region: Region | str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet field; the region box is part of the scan's pushed filters.

    NaN becomes an absent row, so later counts see only real values.
    """
    df = spark.read.parquet(path)
    if columns:
        df = df.select(*columns)
    if region is not None:
        df = df.where((REGIONS[region] if isinstance(region, str) else region).contains())
    if "value" in df.columns and dict(df.dtypes)["value"] in ("float", "double"):
        df = df.where(~F.isnan("value"))
    return df


def unpack(df: DataFrame, scale_factor: float | None, fill_value: int | None = None, value: str = "value") -> DataFrame:
    """Packed integers to values: fill becomes NULL, then the scale applies."""
    raw = F.col(value)
    out = F.when(raw != fill_value, raw) if fill_value is not None else raw
    return df.withColumn(value, out * scale_factor if scale_factor else out)


def region_subset(df: DataFrame, points: DataFrame, region: Region | str) -> DataFrame:
    """Rows of a cell-keyed field inside a region, by a semi join on its cells."""
    box = REGIONS[region] if isinstance(region, str) else region
    return df.join(points.where(box.contains()), "cell", "left_semi")


def field_info(field: DataFrame) -> DataFrame:
    """Size and extent of a field without moving its values."""
    per_cell = field.groupBy("cell").agg(F.count("value").alias("_n"), F.min("time").alias("_a"), F.max("time").alias("_b"))
    return per_cell.agg(
        F.count(F.lit(1)).alias("ncells"),
        F.sum("_n").alias("nvalues"),
        F.min("_a").alias("first"),
        F.max("_b").alias("last"),
        (F.datediff(F.max("_b"), F.min("_a")) + 1).alias("ndays"),
    )


class TooFewCells(ValueError):
    """A mask leaves fewer cells than asked for."""


def drop_empty_cells(field: DataFrame, min_values: int = 1) -> DataFrame:
    """Only cells with enough values in the whole record, by a semi join on counted cells."""
    counted = field.groupBy("cell").agg(F.count("value").alias("_n")).where(F.col("_n") >= min_values)
    return field.join(counted, "cell", "left_semi")


def one_day(field: DataFrame, index: int) -> DataFrame:
    """All cells at a position on the time axis; empty beyond its end.

    Only the distinct days are numbered, one row per calendar day.
    """
    days = field.select("time").distinct()
    numbered = days.withColumn("_i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("time")) - 1)
    return field.join(numbered.where(F.col("_i") == index), "time", "left_semi")


def mask_cells(field: DataFrame, mask: DataFrame, keep: bool = True, min_cells: int | None = None) -> DataFrame:
    """Semi (or anti) join with the cells of another field.

    With ``min_cells`` it is an error when fewer cells are left; a flow that goes on without
    them catches :class:`TooFewCells`.
    """
    out = field.join(mask.select("cell").distinct(), "cell", "left_semi" if keep else "left_anti")
    if min_cells is not None:
        left = out.select("cell").distinct().limit(min_cells).count()  # stops at the bound
        if left < min_cells:
            raise TooFewCells(f"{left} cells are left by the mask, {min_cells} are needed")
    return out


def restore_grid(labels: DataFrame, grid: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Cluster ids on every grid cell; noise and unclustered cells are NULL."""
    clean = labels.withColumn("clustid", F.when(F.col("clustid") >= 0, F.col("clustid")))
    if not keys:
        return grid.select("cell").join(clean.select("cell", "clustid"), "cell", "left")
    stacked = clean.agg(F.array_sort(F.collect_set(F.struct(*keys)))).scalar()  # one entry per (lag, fold) field
    axis = grid.select("cell", F.explode(stacked).alias("_k")).select("cell", *[F.col(f"_k.{k}") for k in keys])
    return axis.join(clean.select(*keys, "cell", "clustid"), [*keys, "cell"], "left")


def write_field(df: DataFrame, path: str, mode: str = "overwrite", attrs: dict | None = None, partition_by: Sequence[str] = ()) -> None:
    """Parquet sink.  Attributes travel as column metadata; those already set are kept."""
    if attrs:
        present = df.schema["value"].metadata
        df = df.withMetadata("value", {**attrs, **present})
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or nothing where no write has published a file yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_if_absent(df: DataFrame, path: str) -> bool:
    """Skip a result that is already there; the committer publishes the files of a finished write only."""
    if stored(df.sparkSession, path) is not None:
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def new_keys(candidates: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not stored yet."""
    return candidates.join(stored.select(*keys).distinct(), list(keys), "left_anti")


def append_features(features: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Add only features whose key combination is not in the store yet.

    The store is laid out by variable and timeagg.  The touched partitions are written anew as
    a whole, with what they held, and replace the old ones when the write is committed: a
    failed write changes nothing, and a repeated one adds nothing.
    """
    spark = features.sparkSession
    layout = ["variable", "timeagg"]
    old = stored(spark, path)
    if old is not None:
        old = old.select(*features.columns).join(features.select(*layout).distinct(), layout, "left_semi")
        features = cut(old.unionByName(new_keys(features, old, keys)))
    features.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*layout).parquet(path)


def read_importances(spark: SparkSession, path: str, respagg: Sequence[int] | int, separation: Sequence[int] | int) -> DataFrame:
    """Importance frames stored under ``respagg=/separation=``; missing combinations are skipped.

    Both keys are directories, so the selection prunes files before anything is read.
    """
    aggs = [respagg] if isinstance(respagg, int) else list(respagg)
    seps = [separation] if isinstance(separation, int) else list(separation)
    return spark.read.parquet(path).where(F.col("respagg").isin(*aggs) & F.col("separation").isin(*seps))


def common_union(frames: Sequence[DataFrame]) -> DataFrame:
    """Union on the columns all frames share."""
    shared = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    out = frames[0].select(*shared)
    for f in frames[1:]:
        out = out.unionByName(f.select(*shared))
    return out
