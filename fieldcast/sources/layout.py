"""Fields laid out along a space-filling curve, so that the scan of a box skips row groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits a coordinate has on the curve: 2^14 steps of 0.02 degrees around the globe, finer than any grid of the catalogue.
CURVE_BITS = 14

#: Size of a row group.  Small ones have narrow boxes of their own, large ones cost fewer seeks.
ROW_GROUP_BYTES = 8 * 1024 * 1024


def _spread(number: Column) -> Column:
    """The bits of a 16-bit number with a zero before each."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        number = number.bitwiseOR(F.shiftleft(number, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
    return number


def curve_key(lat: str = "lat", lon: str = "lon", bits: int = CURVE_BITS) -> Column:
    """Place of a point on the Z-curve: the bits of its row and column in turn.

    Near places on the curve are near on the globe.  NULL where a coordinate is NULL; points beyond the poles or the
    date line count as on them.
    """
    if not 1 <= bits <= 16:
        raise ValueError("a coordinate has 1 to 16 bits")

    def step(c: str, low: float, width: float) -> Column:
        at = F.floor((F.col(c).cast("double") - low) / width * float(1 << bits)).cast("bigint")
        inside = F.greatest(F.lit(0).cast("bigint"), F.least(F.lit((1 << bits) - 1).cast("bigint"), at))
        return F.when(at.isNotNull(), inside)

    return F.shiftleft(_spread(step(lat, -90.0, 180.0)), 1).bitwiseOR(_spread(step(lon, -180.0, 360.0)))


def write_by_place(field: DataFrame, path: str, mode: str = "overwrite", row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Write ``(cell, lat, lon, time, value, …)`` sorted along the curve, then by time.

    One shuffle by ranges of (place, day); a cell with a long record can be cut between tasks.  Every row group covers a
    short stretch of the curve, so its least and largest ``lat`` and ``lon`` rule it out for most boxes, and the page
    index does the same within a row group.  :func:`fieldcast.sources.fields.read_field` reads it back.
    """
    placed = field.withColumn("_place", curve_key())
    ordered = placed.repartitionByRange("_place", "time").sortWithinPartitions("_place", "time").drop("_place")
    ordered.write.mode(mode).option("parquet.block.size", row_group_bytes).parquet(path)
