"""Operator 13: URL filters by gradient-boosted trees on lexical features.

Rules of host and path decide where they fit, the longest first.  The URLs that they decide are the labelled ones: from them the trees learn, and judge
the rest.  The features are lengths, depth, ratios of digits and marks, entropies, counts of parameters and labels, and suffix statistics: the share of
blocked URLs among the labelled ones with the same last one, two and three labels of the host, by hashed suffix.  A labelled URL is left out of its own
statistic, or the trees would read off their own answers.

Statistics cover all labelled rows and are two numbers for each of ``BUCKETS`` buckets.  The trees alone are fitted to a sample of at most ``SAMPLE``
labelled rows, those with the least hashes, so that fit is the same size at any size of table.  Everything else is one pass over the rows without a shuffle.

Nulls and odd input: a null URL and one without ``://`` have an empty host and path, fit no rule and are judged by their features as any other; an empty or
very long URL is read whole; repeated rows are judged alike; if no URL is labelled, the method allows, and if all have one label, it gives that;
an empty table has no rows; other columns, also such with the names used here, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcast.llm.common import add_columns, arrow, cut, table

#: Verdict, host and path of the contract's rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SAMPLE = 20_000
BUCKETS = 1 << 14
#: Prior weight of a suffix statistic, in URLs.
PRIOR = 4.0
TREES, DEPTH, STEP, SEED = 20, 4, 0.3, 42
SUFFIXES = 3
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), CAPITALS, SMALL), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def decided(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, like ``net/``, and its verdict; null where none does."""
    rule = verdict = None
    for judged, of, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == of) | F.endswith(host, F.lit("." + of))) & F.startswith(path, F.lit(start))
        rule = F.when(fits, F.lit(of + start)) if rule is None else F.when(fits, F.lit(of + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(judged)) if verdict is None else F.when(fits, F.lit(judged)).otherwise(verdict)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if rule is None else (rule, verdict)


def entropy(text: str) -> float:
    if not text:
        return 0.0
    _, counts = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), return_counts=True)
    share = counts / len(text)
    return float(-(share * np.log2(share)).sum())


def lexical(url: str) -> list[float]:
    """Features of the letters of a URL."""
    rest = url.partition("://")[2]
    address, _, fragment = rest.partition("#")
    address, mark, query = address.partition("?")
    host, slash, path = address.partition("/")
    labels = host.split(".")
    digits = sum(map(url.count, "0123456789"))
    in_host = sum(map(host.count, "0123456789"))
    steps = [s for s in path.split("/") if s]
    return [
        len(url), len(host), len(path), len(query), len(fragment), len(steps), max(map(len, steps), default=0),
        digits / max(1, len(url)), in_host / max(1, len(host)), entropy(host), entropy(path), entropy(url),
        query.count("&") + bool(query), query.count("="), len(labels), max(map(len, labels)), host.count("-"), path.count("-") + path.count("_"),
        path.count("."), url.count("%"), float(url[:8].lower() == "https://"), float(labels[0] == "www"), float(":" in host), len(set(host)) / max(1, len(host)),
    ]


def suffix_buckets(host: str) -> list[int]:
    """Buckets of the last one, two and three labels of the host; shorter hosts repeat the whole."""
    labels = host.split(".")
    return [zlib.crc32(f"{k}:{'.'.join(labels[-k:])}".encode("utf-8", "surrogatepass")) % BUCKETS for k in range(1, SUFFIXES + 1)]


def with_suffixes(rows: DataFrame) -> DataFrame:
    def make():
        def work(hosts: pa.Array) -> list[pa.Array]:
            return [pa.array([suffix_buckets(h) for h in hosts.fill_null("").to_pylist()], pa.list_(pa.int32()))]

        return work

    return add_columns(rows, "host", [T.StructField("suffixes", T.ArrayType(T.IntegerType()))], make)


def suffix_counts(labelled: DataFrame) -> np.ndarray:
    """Labelled and blocked URLs by bucket of a suffix; two numbers a bucket reach the driver."""
    spots = labelled.select(F.explode("suffixes").alias("bucket"), (F.col("decided") == "block").cast("long").alias("bad"))
    out = np.zeros((2, BUCKETS), np.int64)
    for bucket, n, bad in spots.groupBy("bucket").agg(F.count("*"), F.sum("bad")).collect():
        out[:, bucket] = n, bad
    return out


def with_features(rows: DataFrame, counts: np.ndarray) -> DataFrame:
    """``rows`` (url, suffixes, decided) with the list ``x`` of all features."""
    sent = rows.sparkSession.sparkContext.broadcast(counts)
    base = float(counts[1].sum() / max(1, counts[0].sum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, bad = sent.value
        for batch in batches:
            out = []
            for url, buckets, verdict in zip(*(batch.column(c).to_pylist() for c in ("url", "suffixes", "decided"))):
                here, blocked = n[buckets] - (verdict is not None), bad[buckets] - (verdict == "block")
                share = (blocked + PRIOR * base) / (here + PRIOR)
                out.append([*map(float, lexical(url or "")), *share.tolist(), *np.log1p(here).tolist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], [*batch.schema.names, "x"])

    return arrow(rows).mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("x", T.ArrayType(T.DoubleType()))]))


def fitted(labelled: DataFrame, total: int, sample: int) -> GBTClassificationModel:
    """Trees fitted to the ``sample`` labelled rows with the least hashes, both classes with equal weight."""
    mixed = F.xxhash64("page_id", "url")
    upto = int(min(1.0, 2 * sample / max(1, total)) * (1 << 64)) - (1 << 63)
    least = labelled.where(mixed <= F.lit(min(upto, (1 << 63) - 1))).orderBy(mixed, "page_id").limit(sample)
    rows = cut(least.select("x", (F.col("decided") == "block").cast("double").alias("bad")))
    shares = {r[0]: r[1] for r in rows.groupBy("bad").count().collect()}
    weight = F.when(F.col("bad") == 1, F.lit(0.5 / max(1, shares.get(1.0, 0)))).otherwise(F.lit(0.5 / max(1, shares.get(0.0, 0))))
    ready = rows.select(array_to_vector("x").alias("features"), "bad", (weight * sum(shares.values())).alias("weight")).coalesce(4)
    trees = GBTClassifier(labelCol="bad", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=SEED, minInstancesPerNode=5, cacheNodeIds=False)
    return trees.fit(ready)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, *, sample: int = SAMPLE) -> DataFrame:
    """``page_id, host, path, rule, verdict, blocked_share`` of every row; the share is what the trees say, null where nothing was learnt."""
    host, path = host_and_path(F.coalesce("url", F.lit("")))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = decided(F.col("host"), F.col("path"), rules)
    rows = cut(with_suffixes(rows.select("*", rule.alias("rule"), verdict.alias("decided"))))
    labelled = rows.where(F.col("decided").isNotNull())
    kinds = {r[0]: r[1] for r in labelled.groupBy("decided").count().collect()}
    keep = ["page_id", "host", "path", "rule"]
    if len(kinds) < 2:
        only = next(iter(kinds), "allow")
        return rows.select(*keep, F.coalesce("decided", F.lit(only)).alias("verdict"), F.lit(None).cast("double").alias("blocked_share"))
    measured = with_features(rows, suffix_counts(labelled))
    model = fitted(measured.where(F.col("decided").isNotNull()), sum(kinds.values()), sample)
    told = model.transform(measured.withColumn("features", array_to_vector("x")))
    method = F.when(F.col("prediction") == 1, "block").otherwise("allow")
    return told.select(*keep, F.coalesce("decided", method).alias("verdict"), vector_to_array("probability")[1].alias("blocked_share"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged."""
    return judge(table(spark, sf_dir, "pages"))
