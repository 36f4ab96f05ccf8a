"""Incremental ingest: raw sub-daily values arriving as files become ordered daily fields."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fieldcast.session import ensure_checkpoint_dir
from fieldcast.sources.ingest import hours_seen

EPOCH = dt.date(1970, 1, 1)


def raw_stream(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Files landing in a folder, each read once; a bounded number per trigger if asked."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def event_time(df: DataFrame, ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Zoned event time with a watermark; zone-less timestamps cannot carry one."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def daily_stream(hourly: DataFrame, operation: str = "mean", value: str = "value") -> DataFrame:
    """Tumbling one-day aggregate per cell, dropped from state once the watermark passes."""
    sums = {
        "mean": F.sum(value) / F.count(value),
        "min": F.min(value),
        "max": F.max(value),
    }[operation]
    return (
        hourly.groupBy("cell", F.window("ts", "1 day").alias("w"))
        .agg(sums.alias(value), hours_seen("ts").alias("_hours"))
        .select("cell", F.to_date("w.start").alias("time"), value, (F.col("_hours") == 24).alias("complete"))
    )


def slice_stream(hourly: DataFrame, hour: int) -> DataFrame:
    """The values of one hour of the day; needs no state.  Hour 24 is midnight and belongs to the day that it ends."""
    day = F.to_date("ts")
    return hourly.where(F.hour("ts") == hour % 24).withColumn("time", F.date_sub(day, 1) if hour == 24 else day)


def unique_days(days: DataFrame, ts: str = "ts") -> DataFrame:
    """First arrival of each (cell, day) within the watermark."""
    return days.withColumn("time", F.to_date(ts)).dropDuplicatesWithinWatermark(["cell", "time"])


def consecutive_days(days: DataFrame, start: dt.date, max_wait_ms: int | None = None) -> DataFrame:
    """Release each cell's days strictly in calendar order, holding back days after a gap.

    State per cell is the last released day and the days waiting behind a gap.  ``start`` is the
    first day of the sequence, whichever day happens to arrive first; earlier days and days
    released before are dropped.  With ``max_wait_ms`` a gap that stays open that long is skipped.
    """
    schema = days.select("cell", "time", "value").schema
    cell_type = schema["cell"].dataType.simpleString()

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting, values = (state.get if state.exists else (None, [], []))
        pending = dict(zip(waiting, values))
        if state.hasTimedOut:
            if pending:
                last = min(pending) - 1
        else:
            for frame in frames:
                for day, value in zip(frame["time"], frame["value"]):
                    pending[(pd.Timestamp(day).date() - EPOCH).days] = float(value)
        if last is None and pending:
            last = (start - EPOCH).days - 1
        pending = {d: v for d, v in pending.items() if d > last} if pending else {}
        out = []
        while last is not None and last + 1 in pending:
            last += 1
            out.append((key[0], EPOCH + dt.timedelta(days=last), pending.pop(last)))
        state.update((last, sorted(pending), [pending[d] for d in sorted(pending)]))
        if max_wait_ms and pending:
            state.setTimeoutDuration(max_wait_ms)
        yield pd.DataFrame(out, columns=["cell", "time", "value"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if max_wait_ms else GroupStateTimeout.NoTimeout
    return (
        days.select("cell", "time", F.col("value").cast("double").alias("value"))
        .groupBy("cell")
        .applyInPandasWithState(
            run,
            f"cell {cell_type}, time date, value double",
            "last int, waiting array<int>, waiting_values array<double>",
            "append",
            timeout,
        )
    )


@contextmanager
def _setting(spark: SparkSession, key: str, value: str | None) -> Iterator[None]:
    """A setting that only what starts inside takes over; a started stream keeps its own copy of the session."""
    before = spark.conf.get(key, None)
    if value:
        spark.conf.set(key, value)
    try:
        yield
    finally:
        if value and before is None:
            spark.conf.unset(key)
        elif value:
            spark.conf.set(key, before)


def run_available(stream: DataFrame, folder: str, mode: str = "append", partition_by: tuple[str, ...] = (),
                  state_store: str | None = None) -> None:
    """Process everything that has arrived, then stop.

    Each micro-batch overwrites its own ``batch=`` directory, so a batch that is replayed
    after a failure replaces its own files.  In complete mode the last batch is the result.
    """

    def write(batch: DataFrame, number: int) -> None:
        name = f"{folder}/data/batch={number if mode != 'complete' else 0}"
        batch.write.mode("overwrite").partitionBy(*partition_by).parquet(name)

    writer = (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
    )
    with _setting(stream.sparkSession, "spark.sql.streaming.stateStore.providerClass", state_store):
        query = writer.start()
    query.awaitTermination()


def result(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/data").drop("batch")


def working_folder(spark: SparkSession) -> str:
    """A fresh folder for one stream inside the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4()}"


def materialise(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all available input and read its output back as a table."""
    folder = working_folder(stream.sparkSession)
    run_available(stream, folder, mode)
    return result(stream.sparkSession, folder)
