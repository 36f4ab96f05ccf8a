"""Operator 2: benchmark decontamination by Wu-Manber search for word windows.

Texts are lower-cased in A-Z and split into words of digits, a-z and all characters from U+0080.  The patterns are the
13-word windows of every benchmark item; an item with fewer words is one pattern.  Patterns of one length are searched
together: the last two words of the search window (a block) look up how far the window may move without missing an occurrence;
where that is zero the block's bucket, keyed by a hash of the pattern's last words, holds the patterns to test, and comparing
word by word confirms them.

Items are read in blocks of a set number of bytes, checked before anything is sent to the executors; a benchmark over the bound
is searched block by block and each document's hits are merged, so no item is left out.

Nulls and odd input: a null or empty text has no words, no hits and is clean; items without words never occur; a repeated
item_id counts once, a null item_id is named by the empty string; repeated documents are each judged; an empty benchmark leaves
all clean.  Other columns, also such with the names used here, pass through ``annotate`` untouched.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcast.llm.common import add_columns, cut, fresh, table

WINDOW = 13
BLOCK = 2
#: Bytes of benchmark text held by a task at once.
ITEM_BYTES = 8 << 20
LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
HITS = T.StructType([
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("n_words", T.LongType()),
])


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER)) if text and not text.isascii() else WORD.findall((text or "").lower())


class Patterns:
    """Patterns of one length: shift table and suffix buckets over blocks of words."""

    def __init__(self, length: int, patterns: dict[tuple[str, ...], frozenset[str]]):
        self.length, self.owners = length, patterns
        self.block = min(BLOCK, length)
        self.default = length - self.block + 1
        self.shift: dict[tuple[str, ...], int] = {}
        self.buckets: dict[int, list[tuple[str, ...]]] = {}
        for pattern in patterns:
            for end in range(self.block, length + 1):
                key, move = pattern[end - self.block : end], length - end
                if move < self.shift.get(key, self.default):
                    self.shift[key] = move
            self.buckets.setdefault(hash(pattern[-self.block :]), []).append(pattern)

    def search(self, words: list[str]) -> Iterable[tuple[int, tuple[str, ...]]]:
        """(position, pattern) of every occurrence."""
        at, size, block, length = self.length, len(words), self.block, self.length
        shift, default = self.shift.get, self.default
        while at <= size:
            key = tuple(words[at - block : at])
            move = shift(key, default)
            if move:
                at += move
                continue
            begin = at - length
            for pattern in self.buckets.get(hash(key), ()):
                if tuple(words[begin:at]) == pattern:
                    yield begin, pattern
            at += 1


def compile_items(items: Iterable[tuple[str, str | None]], window: int = WINDOW) -> list[Patterns]:
    by_length: dict[int, dict[tuple[str, ...], set[str]]] = {}
    for item, text in items:
        words = words_of(text)
        length = min(window, len(words))
        for i in range(len(words) - length + 1 if length else 0):
            by_length.setdefault(length, {}).setdefault(tuple(words[i : i + length]), set()).add(item)
    return [Patterns(n, {p: frozenset(o) for p, o in found.items()}) for n, found in sorted(by_length.items())]


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans without overlap, ends exclusive."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def occurrences(text: str | None, patterns: list[Patterns]) -> dict:
    """Hit spans in words, the items that occur and the number of words."""
    words = words_of(text)
    spans, items = set(), set()
    for group in patterns:
        for begin, pattern in group.search(words):
            spans.add((begin, begin + group.length))
            items |= group.owners[pattern]
    return {"spans": [{"first": a, "last": b} for a, b in merged(spans)], "items": sorted(items), "n_words": len(words)}


def item_blocks(items: DataFrame, limit: int) -> list[list[tuple[str, str | None]]]:
    """The benchmark in blocks of about ``limit`` bytes; one block is fetched at a time, after its size is known."""
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").where(F.length("text") > 0)
    total = named.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    parts = -(-total // limit) or 1
    mine = F.pmod(F.xxhash64("item", "text"), F.lit(parts))
    return [[tuple(r) for r in named.where(mine == k).collect()] for k in range(parts)]


def find_items(docs: DataFrame, items: DataFrame, hits: str, window: int, limit: int) -> DataFrame:
    """``docs`` with the struct column ``hits``."""
    blocks = item_blocks(items, limit)
    for k, block in enumerate(blocks):
        sent = docs.sparkSession.sparkContext.broadcast(block)
        (found,) = fresh(docs, f"{hits}_{k}")

        def make(sent=sent):
            patterns = compile_items(sent.value, window)
            kind = pa.struct([
                ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
                ("items", pa.list_(pa.string())),
                ("n_words", pa.int64()),
            ])
            return lambda texts: [pa.array([occurrences(t, patterns) for t in texts.to_pylist()], kind)]

        docs = add_columns(docs, "text", [T.StructField(found, HITS)], make)
        if k == 0:
            docs = docs.withColumnRenamed(found, hits)
        else:
            both = F.struct(
                F.array_union(F.col(hits)["spans"], F.col(found)["spans"]).alias("spans"),
                F.array_union(F.col(hits)["items"], F.col(found)["items"]).alias("items"),
                F.col(hits)["n_words"].alias("n_words"),
            )
            docs = cut(docs.withColumn(hits, both).drop(found))
    return docs


def covered(spans):
    """Words inside the union of spans (ends exclusive), which may overlap after blocks were merged."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("to"))

    def step(state, span):
        begin = F.greatest(state["to"], span["first"])
        return F.struct((state["n"] + F.greatest(F.lit(0), span["last"] - begin)).alias("n"), F.greatest(state["to"], span["last"]).alias("to"))

    return F.aggregate(F.array_sort(spans), start, step, lambda state: state["n"]).cast("long")


def annotate(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, limit: int = ITEM_BYTES) -> tuple[DataFrame, str]:
    """``docs`` with a struct column (n_words, n_hit, n_items, items_sha256, contaminated, items) and that column's name."""
    hits, name = fresh(docs, "hits", "contamination")
    found = find_items(docs, items, hits, window, limit)
    n_words, n_hit = F.col(hits)["n_words"], covered(F.col(hits)["spans"])
    owners = F.array_sort(F.col(hits)["items"])
    told = F.struct(
        n_words.alias("n_words"), n_hit.alias("n_hit"), F.size(owners).cast("long").alias("n_items"),
        F.sha2(F.array_join(owners, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= n_words)).alias("contaminated"), owners.alias("items"),
    )
    return found.withColumn(name, told).drop(hits), name


def sha256_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, name = annotate(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", *(F.col(name)[c].alias(c) for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")))


OP2_SQL = """
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS s
  FROM (SELECT item, w, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT m FROM windows),
places AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS s
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc_words, lengths WHERE len(w) >= m)),
found AS (SELECT doc_id, item, p.m, i FROM places p JOIN windows v ON p.s = v.s AND p.m = v.m),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS pos FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
