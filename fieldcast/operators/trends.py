"""Non-linear trends of daily series, one calendar-bounded Arrow group per series."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def local_regression(x: np.ndarray, y: np.ndarray, share: float = 0.5, robust_steps: int = 10) -> np.ndarray:
    """Locally weighted straight lines (tricube weights), reweighted against outliers (bisquare)."""
    n = len(x)
    k = max(2, int(np.ceil(share * n)))
    trust, fitted = np.ones(n), np.zeros(n)
    for _ in range(robust_steps + 1):
        for at in np.unique(x):
            far = np.abs(x - at)
            reach = np.partition(far, k - 1)[k - 1] or 1.0
            w = trust * np.clip(1 - (far / reach) ** 3, 0, None) ** 3
            if w.sum() <= 0:
                w = (far == 0).astype(float)
            mean_x, mean_y = np.average(x, weights=w), np.average(y, weights=w)
            spread = (w * (x - mean_x) ** 2).sum()
            slope = (w * (x - mean_x) * (y - mean_y)).sum() / spread if spread > 1e-12 else 0.0
            fitted[x == at] = mean_y + slope * (at - mean_x)
        residual = y - fitted
        scale = 6 * np.median(np.abs(residual))
        if scale <= 0:
            break
        trust = np.clip(1 - (residual / scale) ** 2, 0, None) ** 2
    return fitted


def quantile_line(x: np.ndarray, y: np.ndarray, q: float = 0.8, steps: int = 200) -> np.ndarray:
    """Straight line through a quantile, by iteratively reweighted least squares; NaN if not settled after ``steps``."""
    z = (x - x.mean()) / (x.std() or 1.0)
    design = np.column_stack([np.ones_like(z), z])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    for _ in range(steps):
        r = y - design @ beta
        w = np.where(r >= 0, q, 1 - q) / np.maximum(np.abs(r), 1e-6 * (np.abs(y).max() or 1.0))
        moved = np.linalg.solve(design.T @ (design * w[:, None]), design.T @ (w * y))
        if np.allclose(moved, beta, rtol=1e-9, atol=1e-9):
            return design @ moved
        beta = moved
    return np.full(len(y), np.nan)


def _per_series(field: DataFrame, keys: Sequence[str], trend: Callable[[pd.DataFrame], np.ndarray]) -> DataFrame:
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in field.select(*keys).schema)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("time").reset_index(drop=True)
        out = pd.DataFrame({k: v for k, v in zip(keys, key)}, index=frame.index)
        fitted = trend(frame)
        return out.assign(time=frame["time"], trend=fitted, value=frame["value"].astype(float) - fitted)

    rows = field.select(*keys, "time", "value")
    return rows.groupBy(*keys).applyInPandas(run, f"{ddl}, time date, trend double, value double")


def loess_detrend(field: DataFrame, keys: Sequence[str] = ("cell",), share: float = 0.5, robust_steps: int = 10) -> DataFrame:
    """Residual from a robust local regression on the calendar year."""

    def trend(frame: pd.DataFrame) -> np.ndarray:
        years = pd.to_datetime(frame["time"]).dt.year.to_numpy(float)
        return local_regression(years, frame["value"].to_numpy(float), share, robust_steps)

    return _per_series(field, keys, trend)


def quantile_detrend(field: DataFrame, q: float = 0.8, keys: Sequence[str] = ("cell",)) -> DataFrame:
    """Departure from a straight line in time through the given quantile; positive is an exceedance."""

    def trend(frame: pd.DataFrame) -> np.ndarray:
        days = pd.to_datetime(frame["time"]).astype("int64").to_numpy(float) / 8.64e13
        return quantile_line(days, frame["value"].to_numpy(float), q)

    return _per_series(field, keys, trend)
