"""Feature keys <-> dotted names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURE_KEYS = ("fold", "variable", "timeagg", "lag", "separation", "clustid", "metric")
FEATURE_TYPES = {
    "fold": "int",
    "variable": "string",
    "timeagg": "int",
    "lag": "int",
    "separation": "int",
    "clustid": "int",
    "metric": "string",
    "respagg": "int",
}


def collapse(keys: tuple[str, ...] | list[str], separator: str = ".", ignore: tuple[str, ...] = ()) -> Column:
    """One readable name from several key columns."""
    return F.concat_ws(separator, *[F.col(k).cast("string") for k in keys if k not in ignore])


def restore(df: DataFrame, name: str, keys: tuple[str, ...] | list[str], separator: str = ".") -> DataFrame:
    """Split a collapsed name into typed key columns again."""
    parts = F.split(F.col(name), "\\" + separator)
    typed = {k: parts.getItem(i).cast(FEATURE_TYPES.get(k, "string")) for i, k in enumerate(keys)}
    return df.withColumns(typed).drop(name)
