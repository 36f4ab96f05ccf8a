"""Ranks, prefix scans and exact quantiles over groups of any size.

A plain ``Window.partitionBy(group)`` sorts one group in one task.  That is fine for the
series of one cell, which the calendar bounds, and fatal for a group that spans cells or
forecasts.  Here a group is cut twice into at most ``FANOUT + 1`` value slices by its own
minimum and maximum, so one task sorts only a slice of a slice; slice totals are then
scanned on tables of at most ``FANOUT + 1`` rows per parent.  Equal values are counted
before anything is shuffled by group, so a value held by a third of all rows is one row.

Values that span many powers of ten, such as p-values, would all fall in one slice of equal width.  ``even`` slices are
cut by counts instead: distinct values are counted on a logarithmic scale, and neighbouring steps of it are put together
until a slice has its share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcast.session import cut

FANOUT = 512
#: Steps a power of two of the scale on which even slices are counted.
STEPS = 32


def average_rank(keys: list[str], value: str) -> Column:
    """Tie-averaged rank inside a calendar-bounded group, from one sorted window."""
    ordered = Window.partitionBy(*keys).orderBy(value)
    return (F.rank().over(ordered) + F.count(F.lit(1)).over(ordered)) / 2


def ordinal_rank(keys: list[str], value: str, *ties: str) -> Column:
    """1..n in order of value, ties resolved by the given columns (series order)."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(value, *ties))


def _slice(df: DataFrame, keys: list[str], value: str, out: str, total: str | None = None) -> DataFrame:
    stats = {"_lo": F.min(value), "_hi": F.max(value)}
    if total:
        stats["n_total"] = F.sum(total)
    if keys:
        df = df.join(df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()]), keys)
    else:
        limits = df.agg(F.struct(*[c.alias(n) for n, c in stats.items()])).scalar()
        df = df.withColumn("_limits", limits).select("*", "_limits.*").drop("_limits")
    share = (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    bucket = F.when(F.col("_hi") > F.col("_lo"), F.floor(share * FANOUT)).otherwise(0)
    return df.withColumn(out, bucket.cast("int")).drop("_lo", "_hi")


def _step(value: str) -> Column:
    """Step of a scale with ``STEPS`` per power of two, in the order of the values; at most some 70,000 of them exist."""
    size = F.floor(F.log2(F.abs(value)) * STEPS).cast("int") + 1100 * STEPS  # the least double is 2^-1074
    return F.when(F.col(value) > 0, size).when(F.col(value) < 0, -size).otherwise(0)


def _even_slice(counted: DataFrame, keys: list[str], value: str, out: str, total: str) -> DataFrame:
    """Slices of about the same number of distinct values; one step of the scale is never cut."""
    stepped = counted.withColumn("_step", _step(value))
    steps = stepped.groupBy(*keys, "_step").agg(F.count(F.lit(1)).alias("_k"), F.sum(total).alias("_n"))
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    before = F.coalesce(F.sum("_k").over(group.orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    middle = (before + F.col("_k") / 2) / F.sum("_k").over(group)
    cuts = steps.select(
        *keys, "_step", F.least(F.floor(middle * FANOUT), F.lit(FANOUT - 1)).cast("int").alias(out), F.sum("_n").over(group).alias("n_total")
    )
    return stepped.join(cuts, [*keys, "_step"]).drop("_step")


def sliced(counted: DataFrame, keys: list[str], value: str, even: bool = False) -> DataFrame:
    """Distinct values with count ``n``, cut into slices, with the group's ``n_total``."""
    first = _even_slice(counted, keys, value, "_b1", "n") if even else _slice(counted, keys, value, "_b1", "n")
    return _slice(first, [*keys, "_b1"], value, "_b2")


def scan(rows: DataFrame, keys: list[str], value: str, amount: str, out: str, how: str = "sum",
         descending: bool = False) -> DataFrame:
    """Inclusive running ``how`` of ``amount`` in order of ``value`` over :func:`sliced` rows.

    ``how`` is ``sum`` or ``min``; the order is total because values are unique per group.
    """
    agg = {"sum": F.sum, "min": F.min}[how]

    def ordered(parts: list[str], by: str):
        window = Window.partitionBy(*parts) if parts else Window.partitionBy(F.lit(0))
        return window.orderBy(F.col(by).desc() if descending else F.col(by).asc())

    before = (Window.unboundedPreceding, -1)
    leaf = rows.groupBy(*keys, "_b1", "_b2").agg(agg(amount).alias("_a2"))
    branch = leaf.groupBy(*keys, "_b1").agg(agg("_a2").alias("_a1"))
    branch = branch.withColumn("_o1", agg("_a1").over(ordered(keys, "_b1").rowsBetween(*before))).drop("_a1")
    leaf = leaf.withColumn("_o2", agg("_a2").over(ordered([*keys, "_b1"], "_b2").rowsBetween(*before)))
    offsets = leaf.drop("_a2").join(branch, [*keys, "_b1"])
    own = ordered([*keys, "_b1", "_b2"], value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(offsets, [*keys, "_b1", "_b2"]).withColumn("_own", agg(amount).over(own))
    if how == "sum":
        total = F.coalesce("_o1", F.lit(0)) + F.coalesce("_o2", F.lit(0)) + F.col("_own")
    else:
        total = F.least("_o1", "_o2", "_own")
    return rows.withColumn(out, total).drop("_o1", "_o2", "_own")


def rank_counts(df: DataFrame, keys: list[str], value: str, keep_slices: bool = False, even: bool = False,
                **totals: Column) -> DataFrame:
    """Per distinct value: its count ``n``, how many rows lie up to it, and the group's size.

    Lowest, average and highest rank of a value are ``n_upto - n + 1``,
    ``n_upto - (n - 1) / 2`` and ``n_upto``.  Extra ``totals`` are aggregated per value.

    The distinct values are written once: the scans read them several times, and a value
    that was itself computed from floating-point sums must not differ between readings.
    """
    counted = cut(
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in totals.items()])
    )
    ranked = scan(sliced(counted, keys, value, even), keys, value, "n", "n_upto")
    return ranked if keep_slices else ranked.drop("_b1", "_b2")


def exact_quantile(df: DataFrame, keys: list[str], value: str, q: float, out: str = "threshold") -> DataFrame:
    """Linear-interpolated quantile at ``(n - 1) q`` per group, exact for groups of any size."""
    ranked = rank_counts(df, keys, value)
    below = F.col("n_upto") - F.col("n")

    def at(index: Column) -> Column:
        return F.max(F.when((below <= index) & (index < F.col("n_upto")), F.col(value)))

    ranked = ranked.withColumn("_h", (F.col("n_total") - 1) * F.lit(float(q)))
    picked = ranked.groupBy(*keys).agg(
        at(F.floor("_h")).alias("_l"), at(F.ceil("_h")).alias("_u"), F.max("_h").alias("_h")
    )
    interpolated = F.col("_l") + (F.col("_u") - F.col("_l")) * (F.col("_h") - F.floor("_h"))
    return picked.select(*keys, interpolated.alias(out))


def bounded_quantile(df: DataFrame, keys: list[str], value: str, q: float, out: str = "threshold") -> DataFrame:
    """The same quantile for groups the calendar bounds, in one combining aggregation."""
    return df.groupBy(*keys).agg(F.percentile(F.col(value), F.lit(float(q))).alias(out))
