"""Calendar order on a stream with bounded state: event-time timers close gaps, late days have an output of their own."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fieldcast.streaming import ingest

EPOCH = dt.date(1970, 1, 1)
DAY_MS = 86_400_000

#: The state store that list state and timers need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class CalendarOrder(StatefulProcessor):
    """Per cell the number of the last released day, and the days that wait behind a gap as a list.

    One timer a cell stands at the first waiting day plus ``max_wait`` days: when the watermark gets there, the gap
    before that day is given up.
    """

    def __init__(self, start: dt.date, max_wait: int):
        self.first = (start - EPOCH).days
        self.max_wait = max_wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "day int")
        self.waiting = handle.getListState("waiting", "day int, value double")

    def _release(self, key: tuple, last: int, pending: dict[int, float], late: list, watermark: int) -> pd.DataFrame:
        """Rows of all days that follow the last one, over gaps whose time is up; the rest and the timer go to the state."""
        rows = []
        for day in sorted(pending):
            if day > last + 1 and (day + self.max_wait) * DAY_MS > watermark:
                break
            last = day
            rows.append((key[0], EPOCH + dt.timedelta(days=last), pending.pop(last), False))
        rows += [(key[0], EPOCH + dt.timedelta(days=day), value, True) for day, value in late]
        self.last.update((last,))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.waiting.clear()
        if pending:
            self.waiting.put(sorted(pending.items()))
            self.handle.registerTimer((min(pending) + self.max_wait) * DAY_MS)
        return pd.DataFrame(rows, columns=["cell", "time", "value", "late"])

    def _state(self) -> tuple[int, dict[int, float]]:
        last = self.last.get()[0] if self.last.exists() else self.first - 1
        return last, dict(self.waiting.get()) if self.waiting.exists() else {}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, pending = self._state()
        late: dict[int, float] = {}
        for frame in rows:
            for day, value in zip(frame["day"].to_numpy().tolist(), frame["value"].to_numpy().tolist()):
                into = pending if day > last else late
                into[day] = min(value, into.get(day, value))
        yield self._release(key, last, pending, sorted(late.items()), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, pending = self._state()
        yield self._release(key, last, pending, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def ordered_days(values: DataFrame, start: dt.date, max_wait: int) -> DataFrame:
    """``(cell, time, value, late)``: each cell's days in calendar order, none twice, and those that came too late.

    ``values`` is a stream ``(cell, ts, value)`` with a watermark on ``ts``.  ``start`` is the first day of the sequence.
    A day behind a gap waits until the gap is filled, or until the watermark is ``max_wait`` days past the beginning of
    the waiting day; then the missing days are given up.  Days at or before the last released one come out marked
    ``late``, also those that the watermark has passed, so no row disappears.  Of several values of a day in one batch
    or waiting, the least counts.  No cell holds more waiting days than the watermark's delay and ``max_wait`` span.
    Rows without a cell, time or value are ignored.  Needs the RocksDB state store (``run_ordered`` sets it).
    """
    kind = values.schema["cell"].dataType.simpleString()
    day = F.datediff(F.to_date("ts"), F.lit(EPOCH)).cast("int")
    # Without the time column Spark does not drop late rows; timers still follow the stream's watermark.
    known = values.select("cell", day.alias("day"), F.col("value").cast("double").alias("value")).na.drop("any")
    return known.groupBy("cell").transformWithStateInPandas(
        CalendarOrder(start, max_wait), f"cell {kind}, time date, value double, late boolean", "append", "eventTime"
    )


def run_ordered(ordered: DataFrame, folder: str) -> None:
    """Process what has arrived; ordered and late days go to folders of their own under each batch."""
    ingest.run_available(ordered, folder, partition_by=("late",), state_store=ROCKSDB)


def results(spark: SparkSession, folder: str, late: bool = False) -> DataFrame:
    """The days in order, or those that came too late; either may be empty."""
    rows = spark.read.parquet(f"{folder}/data")
    return rows.where(F.col("late").cast("string") == str(late).lower()).select("cell", "time", "value")
