"""Statistical expressions: detrending, residuals, p-values, weighted rank correlation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def detrend(df: DataFrame, keys: list[str], *values: str, order: str = "time") -> DataFrame:
    """Replace each value by its residual from a line over the ordinal position 0..n-1.

    Position counts the rows that are left in the group, not days, so gaps between
    seasons do not stretch the line.  One sort per group serves the numbering and all fits.
    """
    group = Window.partitionBy(*keys)
    df = df.withColumn("_pos", (F.row_number().over(group.orderBy(order)) - 1).cast("double"))
    fits = {}
    for v in values:
        fits[f"_s_{v}"] = F.regr_slope(F.col(v), F.col("_pos")).over(group)
        fits[f"_i_{v}"] = F.regr_intercept(F.col(v), F.col("_pos")).over(group)
    df = df.withColumns(fits)
    out = {v: F.col(v) - (F.col(f"_s_{v}") * F.col("_pos") + F.col(f"_i_{v}")) for v in values}
    return df.withColumns(out).drop("_pos", *fits)


def residual_through_origin(df: DataFrame, keys: list[str], value: str, past: str, out: str) -> DataFrame:
    """Part of ``value`` not explained by its own past, by least squares without intercept."""
    group = Window.partitionBy(*keys)
    beta = F.try_divide(
        F.sum(F.col(value) * F.col(past)).over(group), F.sum(F.col(past) * F.col(past)).over(group)
    )
    return df.withColumn(out, F.col(value) - beta * F.col(past))


def finite(c: Column) -> Column:
    """NaN to NULL: missing is NULL everywhere in this package."""
    return F.when(F.isnan(c), None).otherwise(c)


def regularised_beta(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """I_x(a, b) by the continued fraction with modified Lentz steps; NaN where it has not converged."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    c = np.ones_like(z)
    d = 1 / np.where(np.abs(1 - (p + q) * z / (p + 1)) < tiny, tiny, 1 - (p + q) * z / (p + 1))
    h = d.copy()
    for m in range(1, 500):
        for term in (
            m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
            -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1)),
        ):
            d = 1 + term * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
        settled = np.abs(step - 1) < 1e-15
        if np.all(settled):
            break
    with np.errstate(divide="ignore"):
        lgamma = np.frompyfunc(math.lgamma, 1, 1)
        lead = (lgamma(p + q) - lgamma(p) - lgamma(q)).astype(float) + p * np.log(z) + q * np.log1p(-z)
    part = np.exp(lead) * h / p
    near = settled | (np.abs(step - 1) < 1e-12)  # the last bits may alternate for ever
    return np.where(near, np.where(swap, 1 - part, part), np.nan)


@F.pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided Student-t tail probability; one row per tested pair, so never the hot path."""
    tv, dv = t.to_numpy(float), dof.to_numpy(float)
    ok = np.isfinite(dv) & (dv > 0) & ~np.isnan(tv)
    out = np.full(len(tv), np.nan)
    x = dv[ok] / (dv[ok] + np.square(tv[ok]))
    out[ok] = np.where(np.isinf(tv[ok]), 0.0, regularised_beta(dv[ok] / 2, 0.5, np.where(np.isinf(tv[ok]), 0.5, x)))
    return pd.Series(out)


def correlation_pvalue(r: Column, n: Column) -> Column:
    """p-value of a correlation from ``n`` pairs with n - 2 degrees of freedom."""
    dof = (n - 2).cast("double")
    t = F.when(F.abs(r) >= 1, F.lit(float("inf"))).otherwise(r * F.sqrt(dof / ((1 - r) * (1 + r))))
    return finite(t_two_sided(t, dof))


def counted_below(values: np.ndarray, upto: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Per query how many of the first ``upto`` values are less than ``below``; all are numbers from 0.

    The values are parted stably by one bit after the other, from the highest.  A query follows its own bits through the
    parts and adds the zeros it leaves behind, so all queries take one pass over the values a bit.
    """
    low, high, out = np.zeros_like(upto), upto.copy(), np.zeros(len(upto), np.int64)
    for bit in range(int(max(values.max(initial=0), below.max(initial=0))).bit_length() - 1, -1, -1):
        one = (values >> bit & 1).astype(bool)
        zeros = np.concatenate(([0], np.cumsum(~one)))
        from_, to = zeros[low], zeros[high]
        right = (below >> bit & 1).astype(bool)
        out += np.where(right, to - from_, 0)
        low, high = (np.where(right, zeros[-1] + at - z, z) for at, z in ((low, from_), (high, to)))
        values = np.concatenate((values[~one], values[one]))
    return out


def concordance(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per element the others in concordance with it less those in discordance, and the others that differ in x and in y."""
    order = np.argsort(x, kind="stable")
    sx, sy = x[order], y[order]
    _, place = np.unique(sy, return_inverse=True)
    x_low, x_high = np.searchsorted(sx, sx, "left"), np.searchsorted(sx, sx, "right")
    rising = np.sort(sy)
    y_low, y_high = np.searchsorted(rising, sy, "left"), np.searchsorted(rising, sy, "right")
    less_less, less_upto = counted_below(place, x_low, place), counted_below(place, x_low, place + 1)
    upto_less, upto_upto = counted_below(place, x_high, place), counted_below(place, x_high, place + 1)
    n = len(x)
    agree = less_less + (n - x_high) - (y_high - upto_upto)
    differ = (x_low - less_upto) + (y_low - upto_less)
    out = [np.empty(n, np.int64) for _ in range(3)]
    for to, found in zip(out, (agree - differ, n - (x_high - x_low), n - (y_high - y_low))):
        to[order] = found
    return tuple(out)


def weighted_tau(x: np.ndarray, y: np.ndarray, rank: np.ndarray | None = None) -> float:
    """Kendall tau with additive hyperbolic weights 1/(r+1); ``rank`` 0 weighs most.

    Without ranks, elements are ranked by decreasing x with decreasing y breaking ties.  A pair's weight is the sum of
    its elements', so the sum over pairs is a sum over elements of weight times concordance: O(n log n).
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    if rank is None:
        rank = np.empty(len(x))
        rank[np.lexsort((y, x))[::-1]] = np.arange(len(x))
    w = 1 / (np.asarray(rank, float) + 1)
    both, in_x, in_y = (float(w @ found) for found in concordance(x, y))
    return both / math.sqrt(in_x * in_y) if in_x > 0 and in_y > 0 else math.nan


def direction_rank(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ordinal ranks of x: small x first under a negative relation, large x first otherwise."""
    rising = np.argsort(x, kind="stable")
    order = rising if np.corrcoef(x, y)[0, 1] < 0 else rising[::-1]
    first = 1 if order is rising else 0  # ranks from 1 upwards, or from 0 downwards
    ranks = np.empty(len(x))
    ranks[order] = np.arange(first, len(x) + first)
    return ranks
