"""Spark-native analytics for empirical long-range forecasting on gridded daily fields.

A *field* is a DataFrame ``(cell, time, value)`` with at most one row per cell and
calendar day and missing values simply absent.  Every operator takes DataFrames and
returns a DataFrame, so they chain with ``DataFrame.transform`` and are planned as one
query by Catalyst.
"""

__version__ = "0.1.0"
