"""Operator 9: quality rules, and the log-likelihood ratio of hashed n-grams between trusted and raw text.

Words and pairs of neighbouring words are hashed to ``BUCKETS`` buckets.  Two multinomials are estimated over them, one from
all raw documents and one from the trusted documents among them (labelled good and not toxic).  A document's score is the mean
over its n-grams of log p_trusted - log p_raw; dividing by their number makes long and short documents comparable.  Every
document below the threshold is rejected.  The threshold is a set low quantile (the lower one, itself a score) of the scores of all trusted documents that pass
the base rules, those of the fit scored as if left out of it, so documents that resemble them stay; those that fail the base rules are rejected anyway and set no threshold.

The fit alone uses a bounded sample of trusted documents, the ``SAMPLE`` ids with the least hashes; raw counts and the quantile
cover the whole table.  Counts are added up inside tasks and then by bucket, so what reaches the driver is two numbers a bucket.

Nulls and odd input: a null text has no words and fails the base rules; a label without a document or with null values is not
trusted; without trusted documents only the base rules decide; repeated rows are scored alike.  Other columns, also such with the
names used here, pass through ``annotate`` untouched.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcast.functions.ranks import rank_counts
from fieldcast.llm.common import add_columns, arrow, fresh, pieces, table

BUCKETS = 1 << 14
SAMPLE = 20_000
SMOOTHING = 1.0
#: A document stays if it scores at least the quantile ``REJECTED`` of the trusted documents.
REJECTED = 0.001
#: The base rules: words of a document, and the percentage of them that repeated windows hold.
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def ngram_buckets(words: list[bytes], buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the words and of the pairs of neighbours."""
    one = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = np.concatenate((one * np.uint64(0xD6E8FEB86659FD93), two))
    return ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words inside windows of ``size`` words that occur at least twice in the text."""
    if len(words) <= size:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    keys = ids[: len(ids) - size + 1]
    for k in range(1, size):
        # Pairs are numbered anew so that any number of distinct words fits.
        _, keys = np.unique(keys * len(numbers) + ids[k : len(ids) - size + 1 + k], return_inverse=True)
    again = np.flatnonzero(np.bincount(keys)[keys] > 1)
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, again, 1)
    np.add.at(marks, again + size, -1)
    return int(np.count_nonzero(np.cumsum(marks)[:-1]))


def repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def measures(text: bytes, words: list[bytes]) -> tuple[int, ...]:
    inside = b"".join(words)
    chars = len(inside) if inside.isascii() else len(inside.decode("utf-8", "replace"))
    return len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), repeated_lines(text), repeated_words(words)


def binary(texts: pa.Array) -> list[bytes]:
    return texts.cast(pa.binary()).fill_null(b"").to_pylist()


def ngram_counts(docs: DataFrame, trusted: list[int], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all documents and of the trusted ones, by bucket."""
    chosen = docs.sparkSession.sparkContext.broadcast(np.array(sorted(trusted), np.int64))
    schema = "bucket int, raw long, trusted long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, buckets), np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                ids = np.asarray(part.column(0).cast(pa.int64()).fill_null(-1))
                good = np.isin(ids, chosen.value) & np.asarray(part.column(0).is_valid())
                for text, is_good in zip(binary(part.column(1)), good):
                    found = np.bincount(ngram_buckets(text.split(), buckets), minlength=buckets) if text else 0
                    counts[0] += found
                    if is_good:
                        counts[1] += found
        some = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[0, some]), pa.array(counts[1, some])], ["bucket", "raw", "trusted"])

    found = arrow(docs.select("doc_id", "text")).mapInArrow(run, schema).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))
    out = np.zeros((2, buckets), np.int64)
    for bucket, raw, good in found.collect():  # at most one row a bucket
        out[:, bucket] = raw, good
    return out[0], out[1]


def ratios(raw: np.ndarray, trusted: np.ndarray) -> np.ndarray:
    """log p_trusted - log p_raw by bucket, smoothed."""
    def log_share(counts: np.ndarray) -> np.ndarray:
        return np.log((counts + SMOOTHING) / (counts.sum() + SMOOTHING * len(counts)))

    return log_share(trusted) - log_share(raw)


def trusted_labels(labels: DataFrame) -> DataFrame:
    good = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    return good.select("doc_id").distinct()


def trusted_ids(labels: DataFrame, sample: int = SAMPLE) -> list[int]:
    least = trusted_labels(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return [r[0] for r in least.collect()]


def with_measures(docs: DataFrame, name: str, weights: np.ndarray | None) -> DataFrame:
    """``docs`` with a struct column of the measures and, given weights, the score (null for texts without words)."""
    kind = T.StructType([*(T.StructField(f, T.LongType()) for f in FIELDS), T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        table_ = sent.value

        def row(text: bytes) -> tuple:
            words = text.split()
            score = float(table_[ngram_buckets(words, len(table_))].mean()) if table_ is not None and words else None
            return (*measures(text, words), score)

        arrow = [pa.int64()] * len(FIELDS) + [pa.float64()]

        def work(texts: pa.Array) -> list[pa.Array]:
            columns = list(zip(*map(row, binary(texts)))) or [()] * len(arrow)
            return [pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow)], names=kind.names)]

        return work

    return add_columns(docs, "text", [T.StructField(name, kind)], make)


def base_failed(x: Column) -> Column:
    """Whether the measures ``x`` break the base rules."""
    return (x["n_words"] < LEAST_WORDS) | (100 * x["n_repeat_words"] > MOST_REPEATED * x["n_words"])


def left_out(found: np.ndarray, raw: np.ndarray, trusted: np.ndarray) -> float:
    """The score of a text with buckets ``found`` by a fit to the trusted texts but this one."""
    own, counts = np.unique(found, return_counts=True)
    rest = np.log(np.maximum(trusted[own] - counts, 0) + SMOOTHING) - np.log(trusted.sum() - len(found) + SMOOTHING * len(trusted))
    return float((counts * (rest - np.log(raw[own] + SMOOTHING) + np.log(raw.sum() + SMOOTHING * len(raw)))).sum() / len(found))


def least_score(docs: DataFrame, labels: DataFrame, chosen: list[int], raw: np.ndarray, trusted: np.ndarray, rejected: float) -> float | None:
    """The lower quantile ``rejected`` of the scores of all trusted rows that pass the base rules; None without such rows.

    It is one of their scores, so at most this share of them is below it.  Texts of the fit (``chosen``) count with the score that they
    have when left out of it: the fit favours its own texts, and good texts without a label must not be held to that.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((raw, trusted))
    fields = [T.StructField("passed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("outside", T.DoubleType())]

    def make():
        raw, trusted = sent.value
        weights = ratios(raw, trusted)

        def row(text: bytes) -> tuple:
            words = text.split()
            if len(words) < LEAST_WORDS or 100 * repeated_words(words) > MOST_REPEATED * len(words):
                return False, None, None
            found = ngram_buckets(words, len(weights))
            return True, float(weights[found].mean()), left_out(found, raw, trusted)

        def work(texts: pa.Array) -> list[pa.Array]:
            columns = list(zip(*map(row, binary(texts)))) or [()] * len(fields)
            return [pa.array(c, t) for c, t in zip(columns, [pa.bool_(), pa.float64(), pa.float64()])]

        return work

    scored = add_columns(docs.select("doc_id", "text"), "text", fields, make).drop("text").where("passed")
    own = scored.join(trusted_labels(labels), "doc_id", "left_semi")
    fitted = spark.createDataFrame([(i, True) for i in chosen], "doc_id long, fitted boolean")  # at most ``sample`` ids
    own = own.join(F.broadcast(fitted), "doc_id", "left").select(F.when(F.col("fitted"), F.col("outside")).otherwise(F.col("score")).alias("score"))
    upto = rank_counts(own, [], "score").where(F.col("n_upto") > F.floor((F.col("n_total") - 1) * F.lit(rejected)))
    return upto.agg(F.min("score")).first()[0]


def annotate(
    docs: DataFrame, labels: DataFrame, *, buckets: int = BUCKETS, sample: int = SAMPLE, rejected: float = REJECTED
) -> tuple[DataFrame, str]:
    """``docs`` with a struct column (the measures, score, base_failed, kept) and that column's name."""
    measured, name = fresh(docs, "measured", "quality_verdict")
    chosen = trusted_ids(labels, sample)
    raw, trusted = ngram_counts(docs, chosen, buckets)
    weights = ratios(raw, trusted) if trusted.sum() else None
    threshold = None if weights is None else least_score(docs, labels, chosen, raw, trusted, rejected)
    found = with_measures(docs, measured, weights)
    x = F.col(measured)
    failed = base_failed(x)
    passes = F.lit(True) if threshold is None else F.coalesce(x["score"] >= F.lit(threshold), F.lit(False))
    told = F.struct(*(x[f].alias(f) for f in (*FIELDS, "score")), failed.alias("base_failed"), (~failed & passes).alias("kept"))
    return found.withColumn(name, told).drop(measured), name


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document measured, scored and judged."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, name = annotate(docs, table(spark, sf_dir, "labels"))
    return found.select("doc_id", *(F.col(name)[f].alias(f) for f in (*FIELDS, "base_failed", "kept", "score")))
