"""Operator 7: passages that repeat across documents, by content-defined chunks of a gear rolling hash.

A chunk may end where the gear hash of the last ``REACH`` bytes falls into one of ``RATE`` parts of its range, and does end there unless
such a place lies in the ``LEAST`` bytes before; a chunk of over ``MOST`` bytes is cut.  So ends depend on the ``REACH + LEAST`` bytes
before them alone: an insertion shifts chunks but changes only those it touches, and a passage is cut alike wherever it stands.  Chunks are compared by a 64-bit digest.  A digest is *repeated* if it occurs in more
than one document; its home is the first document in the table's order.  Neighbouring repeated chunks make a run.

A passage loses at its ends the parts of the chunks that reach out of it, and at its start the bytes on which the first ends still
depend.  So a run of ``n`` words between chunks of ``a`` and ``b`` words is a passage of at least ``n`` and at most ``n + a + b + STARTING``
words.  Reported are the runs that can have over ``WORDS`` words; runs of less than ``FLOOR`` words, equal by chance, are not.

Each chunk is one narrow row; its occurrences are combined in tasks before they are shuffled, and the join back has one row a digest
on one side, so a chunk that stands in a third of all documents can be split over tasks.

Nulls and odd input: a null or empty text has no chunks; repeated rows with one doc_id are documents of their own and repeat one
another; a null doc_id is kept as null; an empty table has no passages; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldcast.llm.common import arrow, cut, pieces, table

REACH = 16
RATE = 24
LEAST, MOST = 8, 1024
WORDS, FLOOR = 50, 8
#: Words that begin in ``REACH + LEAST`` bytes at most, as each has a letter and a space.
STARTING = (REACH + LEAST) // 2
#: Random numbers of the gear, one a byte value, from a fixed seed.
GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 16, 256, dtype=np.uint16)
CHUNKS = "digest long, row long, doc_id long, k int, begin int, stop int, words int, around int"


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The 16-bit gear hash behind each byte: h = 2 h + GEAR[byte], by doubling the reach."""
    h, reach = GEAR[data], 1
    while reach < REACH:
        wider = h.copy()
        wider[reach:] += h[:-reach] << np.uint16(reach)
        h, reach = wider, reach * 2
    return h


def chunk_ends(data: np.ndarray) -> list[int]:
    """Ends of the chunks of one text."""
    size = len(data)
    if not size:
        return []
    places = np.flatnonzero(gear_hashes(data) < (1 << 16) // RATE) + 1
    alone = np.diff(places, prepend=-LEAST - 1) > LEAST
    ends, last = [], 0
    for m in [*places[alone].tolist(), size]:
        while m - last > MOST:
            last += MOST
            ends.append(last)
        if m > last:
            ends.append(m)
            last = m
    return ends


def word_starts(data: np.ndarray) -> np.ndarray:
    """How many words begin before each byte, with the total at the end."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    begins = ~space
    begins[1:] &= space[:-1]
    return np.concatenate(([0], np.cumsum(begins)))


def chunks(docs: DataFrame) -> DataFrame:
    """One row a chunk; positions are bytes of the text in UTF-8.

    ``around`` holds the words of the chunk before (low 16 bits, 32,767 at most) and of the one behind.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") > 0)
    names = [f.split()[0] for f in CHUNKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for part in pieces(batch, "text"):
                found, counts, bounds, words, around = [], [], [], [], []
                for text in part.column(2).cast(pa.binary()).to_pylist():
                    data = np.frombuffer(text, np.uint8)
                    ends = np.array([0, *chunk_ends(data)])
                    found += [digest(text[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                    own = np.diff(word_starts(data)[ends])
                    near = np.minimum(np.concatenate(([0], own, [0])), 32767)
                    counts.append(len(own))
                    bounds.append(ends)
                    words.append(own)
                    around.append(near[:-2] + (near[2:] << 16))
                counts = np.array(counts)
                total = int(counts.sum())
                ids = part.column(1)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.array(found, np.uint64).view(np.int64)),
                    pa.array(np.repeat(np.asarray(part.column(0)), counts)),
                    ids.take(pa.array(np.repeat(np.arange(len(counts)), counts))),
                    pa.array((np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)),
                    pa.array(np.concatenate([b[:-1] for b in bounds]).astype(np.int32)),
                    pa.array(np.concatenate([b[1:] for b in bounds]).astype(np.int32)),
                    pa.array(np.concatenate(words).astype(np.int32)),
                    pa.array(np.concatenate(around).astype(np.int32)),
                ], names)

    return arrow(rows).mapInArrow(run, CHUNKS)


def repeated_passages(docs: DataFrame, words: int = WORDS, floor: int = FLOOR) -> DataFrame:
    """``doc_id, begin, stop, words, most_words, home_doc_id, first`` of every passage that occurs in several documents.

    ``home_doc_id`` is the document where most of the passage's words are at home.  ``first`` tells that all its chunks are at home
    here, so this is the occurrence to keep.
    """
    every = chunks(docs)
    homes = every.groupBy("digest").agg(F.min("row").alias("home"), F.max("row").alias("last")).where("home < last").select("digest", "home")
    homes = cut(homes)  # a join with the table, not with the aggregate, can split a digest that is very frequent
    repeated = cut(every.join(homes, "digest").drop("digest"))
    island = repeated.withColumn("island", F.col("k") - F.row_number().over(Window.partitionBy("row").orderBy("k")))
    ends = [F.min(F.struct("k", "begin", F.col("around").bitwiseAND(32767).alias("beside"))).alias("head"),
            F.max(F.struct("k", "stop", F.shiftright("around", 16).alias("beside"))).alias("tail")]
    voted = island.groupBy("row", "island", "home").agg(
        F.first("doc_id").alias("doc_id"), *ends, F.sum("words").alias("words"), F.min(F.col("home") == F.col("row")).alias("first"))
    runs = voted.groupBy("row", "island").agg(
        F.first("doc_id").alias("doc_id"), F.min("head").alias("head"), F.max("tail").alias("tail"), F.sum("words").alias("words"),
        F.max(F.struct("words", (-F.col("home")).alias("home"))).alias("best"), F.min("first").alias("first"))
    most = F.col("words") + F.col("head.beside") + F.col("tail.beside") + STARTING
    found = runs.where((most > words) & (F.col("words") >= floor)).select(
        "doc_id", F.col("head.begin").alias("begin"), F.col("tail.stop").alias("stop"), F.col("words").cast("int").alias("words"),
        most.cast("int").alias("most_words"), (-F.col("best.home")).alias("home"), "first")
    names = repeated.select(F.col("row").alias("home"), F.col("doc_id").alias("home_doc_id")).distinct()
    return found.join(names, "home", "left").select("doc_id", "begin", "stop", "words", "most_words", "home_doc_id", "first")


def op7_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of all documents that repeat; ``begin`` and ``stop`` are bytes of the text in UTF-8."""
    return repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
