"""What several corpus operators share: Arrow columns added to rows, lineage cuts, ranks without a large sort."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcast.session import cut, ensure_checkpoint_dir

__all__ = ["add_columns", "arrow", "cut", "fresh", "lists", "pieces", "ranked", "shared_folder", "spread", "table"]

#: Text handled at once inside a task; a longer single text is handled alone.
SLICE_BYTES = 4 << 20
#: Bytes of an Arrow batch on its way to Python.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow(df: DataFrame) -> DataFrame:
    """``df`` for ``mapInArrow``: batches hold a few MB at most, whatever the rows, so neither side of a task buffers more."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors see alike."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names close to ``names`` that ``df`` does not use, compared without case as Spark does."""
    used, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def pieces(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` with about ``limit`` bytes of ``column`` each, one row at least."""
    values = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray(values.cast(pa.large_binary()).fill_null(b"").cast(pa.large_binary()).to_numpy(zero_copy_only=False), object)
    ends = np.cumsum([len(x) for x in sizes]) if len(sizes) else np.zeros(0, np.int64)
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def lists(rows: Sequence[bytes], kind: pa.DataType) -> pa.ListArray:
    """A list column from the little-endian bytes of each row's values."""
    width = kind.bit_width // 8
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) // width for r in rows], out=offsets[1:])
    data = pa.py_buffer(b"".join(rows))
    values = pa.Array.from_buffers(kind, int(offsets[-1]), [None, data])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def add_columns(
    df: DataFrame, column: str, fields: Sequence[T.StructField], make: Callable[[], Callable[[pa.Array], Sequence]]
) -> DataFrame:
    """``df`` with further columns computed from ``column`` in Arrow batches; the row order of a partition is kept.

    ``make`` is called once in each task and returns the function from a slice of the column to the new arrays, so
    tokenizers and tables are built once.  Rows are streamed: a task holds one batch and one slice of results.
    """
    schema = T.StructType([*df.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in pieces(batch, column):
                new = work(part.column(part.schema.get_field_index(column)))
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *(f.name for f in fields)])

    return arrow(df).mapInArrow(run, schema)


def spread(rows: int, each: int, most: int = 20_000) -> int:
    """Partitions for ``rows`` at ``each`` rows; beyond ``most`` partitions they get longer instead of more."""
    return max(1, min(most, -(-rows // each)))


def ranked(df: DataFrame, keys: Sequence[str], row: str, name: str, buckets: int) -> DataFrame:
    """Adds ``name``: the rank (from 0, gapless) of each row among those with equal ``keys``.

    ``row`` is a unique number of the row.  Rows are hashed to ``buckets``; the counts of buckets are summed up first, so
    no task sorts a whole group however large it is: a window holds about 1 / ``buckets`` of a group.
    """
    bucket, inside, count, before = fresh(df, "bucket", "inside", "rows_here", "rows_before")
    mixed = F.pmod(F.xxhash64(row), F.lit(buckets)).cast("int")
    dealt = df.withColumn(bucket, mixed)
    dealt = dealt.repartition(*keys, bucket)  # else a join on the keys before leaves a large group in one task
    counts = dealt.groupBy(*keys, bucket).agg(F.count("*").alias(count))
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, bucket, F.coalesce(F.sum(count).over(earlier), F.lit(0)).alias(before))
    own = Window.partitionBy(*keys, bucket).orderBy(row)
    placed = dealt.withColumn(inside, F.row_number().over(own) - 1)
    at: Column = (F.col(before) + F.col(inside)).cast("long")
    return placed.join(offsets, [*keys, bucket]).withColumn(name, at).drop(bucket, inside, before)
