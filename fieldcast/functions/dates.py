"""Calendar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Months of each meteorological season.
SEASON_MONTHS = {"DJF": (12, 1, 2), "MAM": (3, 4, 5), "JJA": (6, 7, 8), "SON": (9, 10, 11)}
LAST_DOY = 366


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def in_season(time: Column | str, *seasons: str) -> Column:
    return F.month(col(time)).isin([m for s in seasons for m in SEASON_MONTHS[s]])


def season(time: Column | str) -> Column:
    month = F.month(col(time))
    expr = None
    for name, months in SEASON_MONTHS.items():
        expr = F.when(month.isin(*months), name) if expr is None else expr.when(month.isin(*months), name)
    return expr


def day_number(time: Column | str) -> Column:
    """Days since the epoch; the ordering column of calendar range frames."""
    return F.datediff(col(time), F.lit("1970-01-01").cast("date"))


def julian_date(time: Column | str) -> Column:
    return day_number(time) + F.lit(2440587.5)


def lagged(time: Column | str, lag: Column | int) -> Column:
    """The response day a value is matched with: lag -10 moves a value ten days ahead."""
    shift = F.lit(-lag) if isinstance(lag, int) else (-lag)
    return F.date_add(col(time), shift.cast("int"))


def input_window(time: Column | str, separation: Column | int, timeagg: Column | int) -> tuple[Column, Column]:
    """First and last daily value that feed a response stamped ``time``.

    A separation of 0 ends the window on the day before the response starts.
    """
    sep = F.lit(separation) if isinstance(separation, int) else separation
    agg = F.lit(timeagg) if isinstance(timeagg, int) else timeagg
    end = F.date_add(col(time), (sep - 1).cast("int"))
    return F.date_add(end, (F.lit(1) - agg).cast("int")), end


def doy_targets(doy: Column | str, before: int, after: int) -> Column:
    """Days of year whose ``[-before, +after]`` circular window holds ``doy``."""
    offsets = F.sequence(F.lit(-after), F.lit(before))
    base = col(doy)
    return F.transform(offsets, lambda k: F.pmod(base - 1 + k, F.lit(LAST_DOY)) + 1)
