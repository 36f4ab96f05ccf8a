"""Operator 5: token ids as Parquet list columns with chosen encodings, row groups and page indexes.

A corpus is a folder of Parquet files in ascending document order: ``doc_id``, ``n_tokens`` and the list ``ids``.  Ids are
dictionary-encoded (a row group uses few distinct ids, so an index of some 13 bits stands for each), numbers are
delta-encoded, row groups and pages hold a set number of bytes and rows, and the writer leaves a page index.  A reader of a
span of documents touches the pages of that span only, a reader of ``n_tokens`` alone no ids at all.

Nulls and odd input: a null text is empty and yields the end id alone; a null doc_id sorts first; repeated rows stand side
by side, each with its own tokens; an empty table yields an empty folder with the schema; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcast.llm.common import arrow, shared_folder, spread, table
from fieldcast.llm.tokens import encode_column, vocabulary_path

END_ID = 2
ROWS_PER_FILE = 8192
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "v2",  # delta encodings for columns without a dictionary
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "256",
    "parquet.columnindex.truncate.length": "64",
}


def write_token_files(
    docs: DataFrame, path: str, *, tokenizer: str, end_id: int = END_ID, rows_per_file: int = ROWS_PER_FILE, layout: dict | None = None
) -> None:
    """Writes ``docs`` (doc_id, text) to ``path``.

    The texts are sorted before they are encoded, since the boundaries of the sort come from a sample that scans its
    input twice.  Spark's committer publishes only the files of finished tasks.
    """
    texts = docs.select("doc_id", "text")
    parts = spread(texts.count(), rows_per_file)
    mixed = F.xxhash64("text")  # parts the rows of a doc_id that occurs very often
    dealt = texts.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), mixed)
    rows = encode_column(dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), mixed), "text", "ids", end_id, tokenizer)
    rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids").write.options(**(LAYOUT | (layout or {}))).parquet(path)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, columns: tuple[str, ...] = ("doc_id", "n_tokens", "ids")) -> DataFrame:
    """Documents from ``first`` to ``last`` inclusive.

    The bounds reach the Parquet reader, which skips row groups by their statistics and pages by the page index; columns
    that are not asked for are never read.
    """
    rows = spark.read.parquet(path)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    return rows.select(*columns)


def digests(files: DataFrame) -> DataFrame:
    """Per row of ``files`` (file_no, row_no, doc_id, ids): the length and the unsigned CRC-32 of its ids as 32-bit words."""
    schema = T.StructType([*(f for f in files.schema.fields if f.name != "ids"), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            ids = batch.column(at)
            offsets = np.asarray(ids.offsets)
            words = np.asarray(ids.flatten()).astype("<u4")
            offsets = offsets - offsets[0]
            crc = [zlib.crc32(words[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            kept = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], schema.names)

    return arrow(files).mapInArrow(run, schema)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document, read from the files: ``doc_id, start`` (ids of all documents before it), ``n_tokens, ids_crc32``.

    Running sums go by file first and inside a file second; a file holds a set number of rows, and only one number a file
    meets in one task.
    """
    file_no = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long")
    rows = spark.read.parquet(path).select(file_no.alias("file_no"), F.col("_metadata.row_index").alias("row_no"), "doc_id", "ids")
    told = digests(rows)
    inside = Window.partitionBy("file_no").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    lengths = spark.read.parquet(path).select(file_no.alias("file_no"), "n_tokens").groupBy("file_no").agg(F.sum("n_tokens").alias("in_file"))
    ahead = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = lengths.select("file_no", F.coalesce(F.sum("in_file").over(ahead), F.lit(0)).alias("ahead"))
    start = F.col("ahead") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    return told.join(files, "file_no").select("doc_id", start.cast("long").alias("start"), "n_tokens", "ids_crc32")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back."""
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4()}"
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer=vocabulary_path())
    return token_index(spark, path)
