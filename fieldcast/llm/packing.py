"""Operator 10: order-preserving packing by dynamic programming over document and sentence boundaries.

Documents in ascending doc_id order form one stream of ids.  A sequence is a stretch of it with at most ``width`` ids; what
it lacks to ``width`` is padding.  Cuts behind a document are free, behind a sentence they cost ``SENTENCE`` and inside a
long sentence, where a cut may stand every ``STEP`` ids, ``INSIDE``.  The cheapest set of cuts is found by

    cost(j) = penalty(j) + width - p(j) + min over i with p(j) - p(i) <= width of (cost(i) + p(i))

whose minimum over a sliding window a monotone queue keeps in constant time a position.  The stream is dealt out in ranges of
doc_id, each planned alone, so a range wastes at most one short sequence at its end.

Nulls and odd input: a null or empty text is the end id alone; a null doc_id sorts first; rows with the same doc_id are packed
one after the other as documents of their own; an empty table has no pieces; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcast.llm.common import arrow, cut, pieces, spread, table
from fieldcast.llm.tokens import WordCache, vocabulary_path

WIDTH = 2048
END_ID = 1
SENTENCE, INSIDE, STEP = 4, 32, 64
ROWS_PER_RANGE = 8192
#: Ids planned at once; a longer range is planned in several stretches that end with a document.
STRETCH = 3_000_000

SCHEMA = T.StructType(
    [T.StructField("part", T.IntegerType()), T.StructField("doc_id", T.LongType())]
    + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "local_sequence", "offset", "sequence_length")]
)


def sentence_ends(path: str) -> np.ndarray:
    """For each id whether it ends a sentence: its entry is closed by a full stop, exclamation or question mark."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    flags = np.zeros(max(vocabulary.values()) + 3, bool)
    for entry, i in vocabulary.items():
        word = entry.removesuffix("</w>")
        flags[i] = entry != word and word.rstrip("\")'")[-1:] in (".", "!", "?")
    return flags


def candidates(ids: np.ndarray, ends: np.ndarray, closes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which the stream may be cut, ascending from 0, and the penalty of each."""
    documents = np.concatenate(([0], ends))
    found = np.flatnonzero(closes[np.minimum(ids, len(closes) - 1)]) + 1
    at = np.union1d(found, documents)
    gaps = np.flatnonzero(np.diff(at) > 2 * STEP)
    inner = [np.arange(at[g] + STEP, at[g + 1] - STEP // 2, STEP) for g in gaps]
    every = np.union1d(at, np.concatenate(inner)) if inner else at
    penalty = np.full(len(every), INSIDE, np.int64)
    penalty[np.searchsorted(every, found)] = SENTENCE
    penalty[np.searchsorted(every, documents)] = 0
    return every, penalty


def best_cuts(at: np.ndarray, penalty: np.ndarray, width: int) -> np.ndarray:
    """Ends of the cheapest sequences; among equal costs the longer last sequence wins.  Gaps are at most ``width``."""
    places, fines = at.tolist(), penalty.tolist()
    came = [0] * len(places)
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # cost + place ascending, place, index
    for j in range(1, len(places)):
        p = places[j]
        while queue[0][1] < p - width:
            queue.popleft()
        value, _, came[j] = queue[0]
        value += fines[j] + width
        while queue and queue[-1][0] > value:
            queue.pop()
        queue.append((value, p, j))
    cuts, j = [], len(places) - 1
    while j > 0:
        cuts.append(places[j])
        j = came[j]
    return np.array(cuts[::-1], np.int64)


def pack_stretch(doc_ids: list, ids: np.ndarray, ends: np.ndarray, closes: np.ndarray, width: int) -> dict[str, list]:
    """Pieces of one stretch of documents; ``ends`` are the documents' ends in ``ids``."""
    if not len(ends):
        return {}
    cuts = best_cuts(*candidates(ids, ends, closes), width)
    stops = np.union1d(cuts, ends)
    begins = np.concatenate(([0], stops[:-1]))
    doc, sequence = np.searchsorted(ends, begins, "right"), np.searchsorted(cuts, begins, "right")
    firsts, opens = np.concatenate(([0], ends[:-1])), np.concatenate(([0], cuts[:-1]))
    words = np.ascontiguousarray(ids, "<u4")
    return {
        "doc_id": [doc_ids[d] for d in doc],
        "start": begins - firsts[doc],
        "length": stops - begins,
        "ids_crc32": [zlib.crc32(words[a:b]) for a, b in zip(begins, stops)],
        "doc_tokens": (ends - firsts)[doc],
        "local_sequence": sequence,
        "offset": begins - opens[sequence],
        "sequence_length": (cuts - opens)[sequence],
    }


def pack(docs: DataFrame, *, tokenizer: str, end_id: int = END_ID, width: int = WIDTH, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length, padded_length``.

    ``sequence_id`` counts from 0 along the stream.  ``padded_length`` is ``width``, or the length where that is a power of two.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = spread(texts.count(), rows_per_range)
    mixed = F.xxhash64("text")
    dealt = texts.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), mixed)
    sorted_texts = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), mixed).withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, closes, sequences, part = WordCache(tokenizer), sentence_ends(tokenizer), 0, 0
        held_ids: list[np.ndarray] = []
        held_docs: list = []

        def flush() -> pa.RecordBatch:
            nonlocal sequences
            ends = np.cumsum([len(x) for x in held_ids])
            found = pack_stretch(held_docs, np.concatenate(held_ids), ends, closes, width)
            found["local_sequence"] = found["local_sequence"] + sequences
            sequences = int(found["local_sequence"][-1]) + 1
            held_ids.clear()
            held_docs.clear()
            types = [pa.int64()] * (len(SCHEMA.names) - 1)
            return pa.RecordBatch.from_arrays(
                [pa.array([part] * len(found["doc_id"]), pa.int32()), *(pa.array(found[n], t) for n, t in zip(SCHEMA.names[1:], types))], SCHEMA.names
            )

        size = 0
        for batch in batches:
            for some in pieces(batch, "text"):
                part = some.column(some.schema.get_field_index("part"))[0].as_py()
                offsets, ids = words.encode(some.column(some.schema.get_field_index("text")), end_id)
                for doc, a, b in zip(some.column(0).to_pylist(), offsets[:-1], offsets[1:]):
                    held_docs.append(doc)
                    held_ids.append(ids[a:b])
                    size += b - a
                    if size >= STRETCH:
                        yield flush()
                        size = 0
        if held_docs:
            yield flush()

    found = cut(arrow(sorted_texts).mapInArrow(run, SCHEMA))
    totals = found.groupBy("part").agg((F.max("local_sequence") + 1).alias("sequences"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("sequences").over(ahead), F.lit(0)).alias("ahead"))
    length = F.col("sequence_length")
    power = length.bitwiseAND(length - 1) == 0
    return found.join(F.broadcast(offsets), "part").select(  # one row a range, 20,000 at most
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("ahead") + F.col("local_sequence")).alias("sequence_id"),
        "offset", "sequence_length", F.when(power, length).otherwise(F.lit(width)).cast("long").alias("padded_length"),
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids."""
    return pack(table(spark, sf_dir, "documents"), tokenizer=vocabulary_path())
