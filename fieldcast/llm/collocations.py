"""Operator 11: phrases of two to five words by an FM-index per shard over word numbers.

A shard holds some ``SHARD_BYTES`` of the texts of one language, as one sequence of word numbers with a mark of its own between pieces.
Its index is the Burrows-Wheeler transform of that sequence: rows are suffixes in order, so the occurrences of a phrase are an interval
of rows.  A phrase is extended in both directions at once: the rows of its interval name the words before it, the LF mapping leads
from them to the interval of the longer phrase, and that lies inside the interval of the phrase without its last word.  Depth k + 1 is thus
enumerated from the intervals of depth k, and only from phrases whose two parts of k words are both frequent in the whole corpus: a phrase is
never more frequent than its parts, so nothing is lost.

Between depths the counts of all shards are summed.  A longer phrase is named by its two parts, each by the place of its first occurrence
(least shard, row), so sums are exact: no phrase is told by a hash.  No table of phrases or words is broadcast; names go back to their
shards through a shuffle, to a group bounded by the shard's own size.  Sums see one row a shard and phrase, so a word that is a third of all
words is no hot key.  The top of a language is taken in two levels.

Nulls and odd input: a null text is empty, a null language ``und`` (and one with it); texts without words count nothing; a text longer than a
shard is split between two pieces, where no phrase runs (a piece without marks stays whole, however long); repeated rows count each time; equal scores are ordered by count
and phrase; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldcast.llm.common import arrow, cut, spread, table

LONGEST = 5
LEAST = 100
TOP = 2000
#: Bytes of text of one index, and of texts that a task holds before it builds one.
SHARD_BYTES = 12 << 20
HELD_BYTES = 16 << 20
#: A capital never stands in a lower-cased text, so it marks the ends of pieces.
MARK = b"A"
LOWER = bytearray(range(256))
LOWER[65:91] = range(97, 123)
for _byte in b".,;:!?\n\x0b\x0c\r":
    LOWER[_byte] = MARK[0]
LOWER[9] = 32
LOWER = bytes(LOWER)
CANDIDATES_A_WINDOW = 50_000


def suffix_order(numbers: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes, by prefix doubling; only places still tied are sorted again.

    The largest numbers that are equal must be followed by different ones in the end: marks are numbered apart.
    """
    size = len(numbers)
    order = np.argsort(numbers, kind="stable").astype(np.int32)
    rank = np.empty(size, np.int32)
    slots, keys = np.arange(size, dtype=np.int32), numbers[order]
    step = 1
    while True:
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        starts = np.flatnonzero(new)
        lengths = np.diff(np.append(starts, len(keys)))
        rank[order[slots]] = np.repeat(slots[starts], lengths)
        tied = np.repeat(lengths > 1, lengths)
        slots = slots[tied]
        if not len(slots):
            return order
        places = order[slots]
        keys = rank[places].astype(np.int64) * size + rank[places + step]
        again = np.argsort(keys, kind="stable")
        order[slots], keys = places[again], keys[again]
        step *= 2


class FMIndex:
    """The transform of a sequence of word numbers from 1; zeros are marks and match nothing, and the sequence ends with one."""

    def __init__(self, bwt: np.ndarray):
        self.bwt = bwt
        # The k-th row that is preceded by a word is the k-th row that begins with it.
        self.lf = np.empty(len(bwt), np.int32)
        self.lf[np.argsort(bwt, kind="stable")] = np.arange(len(bwt), dtype=np.int32)

    @classmethod
    def of(cls, words: np.ndarray) -> FMIndex:
        marks = words == 0
        apart = np.where(marks, np.cumsum(marks, dtype=np.int32) - np.int32(1), words.astype(np.int32) + np.int32(marks.sum()))
        order = suffix_order(apart)
        return cls(words[order - 1])  # before the first word stands the last mark

    def packed(self) -> bytes:
        planes = self.bwt.astype("<u4").view(np.uint8).reshape(-1, 4).T
        return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())

    @classmethod
    def unpacked(cls, data: bytes) -> FMIndex:
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
        return cls(np.ascontiguousarray(planes.T).reshape(-1).view("<u4"))

    def extended(self, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        """Intervals of the phrases one word longer: their first row and count, and which of the given intervals (``first`` row
        ascending, ``count`` rows) are those of the phrase without its last and without its first word."""
        inside = np.full(len(self.bwt), -1, np.int32)
        rows = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum()))
        inside[rows] = np.repeat(np.arange(len(first), dtype=np.int32), count)
        rows = rows[self.bwt[rows] > 0]
        longer = self.lf[rows]
        both = inside[longer] >= 0
        tail = np.full(len(self.bwt), -1, np.int32)
        tail[longer[both]] = inside[rows[both]]
        rows = np.flatnonzero(tail >= 0)
        if not len(rows):
            return rows, rows, rows, rows
        starts = np.flatnonzero(np.concatenate(([True], (np.diff(inside[rows]) != 0) | (np.diff(tail[rows]) != 0))))
        at = rows[starts]
        return at, np.diff(np.append(starts, len(rows))), inside[at], tail[at]


def word_numbers(text: bytes) -> tuple[list[str], np.ndarray]:
    """The different words of a marked text, most frequent first, and the numbers of its words from 1, zero for marks, with one at the end."""
    data = text.replace(MARK, b" A ") + b" A"
    array = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(data)], np.int64)), pa.py_buffer(data)])
    coded = pc.ascii_split_whitespace(array).flatten().dictionary_encode()
    words, found = coded.dictionary.to_pylist(), np.asarray(coded.indices)
    kept = [int(i) for i in np.argsort(-np.bincount(found), kind="stable") if words[i] not in ("", "A")]
    number = np.full(len(words), -1, np.int32)
    number[kept] = np.arange(1, len(kept) + 1)
    number[words.index("A")] = 0
    numbers = number[found]
    numbers = numbers[numbers >= 0]
    repeated = np.concatenate((numbers[1:] == 0, [False])) & (numbers == 0)
    return [words[i] for i in kept], numbers[~repeated].astype(np.uint32)


def parts(text: bytes, limit: int) -> Iterator[bytes]:
    """A marked text in parts that end at marks, of some ``limit`` bytes."""
    at = 0
    while len(text) - at > limit:
        end = text.find(MARK, at + limit)
        if end < 0:
            break
        yield text[at:end]
        at = end + 1
    yield text[at:]


SHARD = "shard long, lang string, n_words long, words array<string>, first array<int>, count array<int>, bwt binary"


def shards(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row an index: its number, language, words with their intervals, and transform."""
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
    names = ["shard", "lang", "n_words", "words", "first", "count", "bwt"]

    def built(number: int, lang: str, texts: list[bytes]) -> pa.RecordBatch:
        words, numbers = word_numbers(MARK.join(texts))
        counts = np.bincount(numbers, minlength=len(words) + 1)
        firsts = np.cumsum(counts) - counts
        row = [number, lang, int(counts[1:].sum()), words, firsts[1:].astype(np.int32), counts[1:].astype(np.int32), FMIndex.of(numbers).packed()]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 16
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                for part in parts(text.as_py().translate(LOWER), shard_bytes):
                    held.setdefault(lang, []).append(part)
                    sizes[lang] = sizes.get(lang, 0) + len(part) + 1
                    if sizes[lang] >= shard_bytes or sum(sizes.values()) >= max(shard_bytes, HELD_BYTES):
                        largest = max(sizes, key=sizes.get)
                        yield built(number, largest, held.pop(largest))
                        number += 1
                        del sizes[largest]
        for lang in list(held):
            yield built(number, lang, held.pop(lang))
            number += 1

    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return arrow(texts).mapInArrow(run, SHARD)


def summed(found: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows of phrases (``keys``) with ``least`` occurrences at least: adds ``a``, their sum, and ``name``, one for each phrase."""
    own = Window.partitionBy(*keys)
    total = found.select("*", F.sum("n").over(own).alias("a"), F.min("at").over(own).alias("name"))
    return cut(total.where(F.col("a") >= least))


def place(shard: Column, row: Column) -> Column:
    return F.shiftleft(shard, 31).bitwiseOR(row.cast("long"))


def longer(state: DataFrame, found: DataFrame) -> DataFrame:
    """``at, n, head, tail``: the phrases of each shard one word longer than those in ``found``, named by their parts."""
    def run(labels: pa.Table, index: pa.Table) -> pa.Table:
        schema = pa.schema([("at", pa.int64()), ("n", pa.int64()), ("head", pa.int64()), ("tail", pa.int64())])
        if not len(index) or not len(labels):
            return schema.empty_table()
        at, count, name = (np.asarray(labels.column(c).combine_chunks()) for c in ("at", "n", "name"))
        order = np.argsort(at)
        shard, name = int(at[0]) >> 31, name[order]
        rows = at[order] & ((1 << 31) - 1)
        found = FMIndex.unpacked(index.column("bwt")[0].as_py()).extended(rows, count[order])
        columns = [(shard << 31) | found[0].astype(np.int64), found[1].astype(np.int64), name[found[2]], name[found[3]]]
        return pa.Table.from_arrays([pa.array(c) for c in columns], schema=schema)

    labels = found.select(F.shiftright("at", 31).alias("shard"), "at", "n", "name")
    return labels.groupBy("shard").cogroup(state.select("shard", "bwt").groupBy("shard")).applyInArrow(run, "at long, n long, head long, tail long")


def phrases(docs: DataFrame, *, longest: int = LONGEST, least: int = LEAST, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """The phrases of one to ``longest`` words with ``least`` occurrences at least, and the words of each language, ``lang, n``.

    A phrase has ``depth, lang, phrase, a``; its counts ``heads`` and ``tails``, those of its first and last one, two... words; its ``name`` and
    those of its two parts, ``head`` and ``tail`` (null for words); names are unique among phrases of one depth.
    """
    state = cut(shards(docs, shard_bytes))
    totals = state.groupBy("lang").agg(F.sum("n_words").alias("n")).where("n > 0")
    word = F.explode(F.arrays_zip("words", "first", "count")).alias("w")
    local = state.select("shard", "lang", word)
    local = local.select("lang", F.col("w.words").alias("last"), place(F.col("shard"), F.col("w.first")).alias("at"), F.col("w.count").cast("long").alias("n"))
    found = summed(local, ["lang", "last"], least)
    first = found.where("at = name")
    none = F.lit(None).cast("long")
    known = first.select("name", "lang", "last", F.col("last").alias("phrase"), "a", F.array("a").alias("heads"), F.array("a").alias("tails"), none.alias("head"), none.alias("tail"))
    levels = [known]
    for _ in range(1, longest):
        found = summed(longer(state, found), ["head", "tail"], least)
        new = found.where("at = name").select("name", "head", "tail", "a")
        heads = known.select(F.col("name").alias("head"), "lang", F.col("phrase").alias("start"), "heads")
        tails = known.select(F.col("name").alias("tail"), "last", "tails")
        new = new.join(heads, "head").join(tails, "tail")
        known = cut(new.select(
            "name", "lang", "last", F.concat_ws(" ", "start", "last").alias("phrase"), "a",
            F.concat("heads", F.array("a")).alias("heads"), F.concat("tails", F.array("a")).alias("tails"), "head", "tail",
        ))
        levels.append(known)
    out = levels[0].withColumn("depth", F.lit(1))
    for depth, level in enumerate(levels[1:], 2):
        out = out.unionByName(level.withColumn("depth", F.lit(depth)))
    return out, totals


def exact(name: str) -> Column:
    return F.col(name).cast("decimal(19,0)")


def maximal(found: DataFrame) -> DataFrame:
    """Phrases of two words or more that no longer one contains as often.

    A phrase is at most as frequent as its parts, so it is enough to look at phrases one word longer.
    """
    longer_ones = found.select((F.col("depth") - 1).alias("depth"), F.explode(F.array("head", "tail")).alias("name"), F.col("a").alias("by"))
    as_often = longer_ones.groupBy("depth", "name").agg(F.max("by").alias("a"))
    return found.where("depth > 1").join(as_often, ["depth", "name", "a"], "left_anti")


def scored(found: DataFrame, totals: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, n, score``: each phrase by the cut that scores least, the smallest of equal ones."""
    with_n = found.join(totals, "lang")
    score = F.expr("(1000 * cast(a as decimal(16,0)) * cast(n as decimal(18,0))) div (cast(heads[k - 1] as decimal(19,0)) * cast(tails[depth - k - 1] as decimal(19,0)))")
    cuts = with_n.select("lang", "phrase", "a", "n", "depth", "heads", "tails", F.explode(F.sequence(F.lit(1), F.col("depth") - 1)).alias("k"))
    each = F.struct(score.alias("score"), "k", F.expr("heads[k - 1]").alias("l"), F.expr("tails[depth - k - 1]").alias("r"))
    least = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(each).alias("c"))
    return least.select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")


def collocations(docs: DataFrame, *, longest: int = LONGEST, least: int = LEAST, top: int = TOP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language."""
    found, totals = phrases(docs, longest=longest, least=least, shard_bytes=shard_bytes)
    judged = cut(scored(maximal(found), totals))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    bucket = F.pmod(F.xxhash64("phrase"), F.lit(spread(judged.count(), CANDIDATES_A_WINDOW)))
    first = judged.withColumn("bucket", bucket).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order)))
    ranks = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return first.where(F.col("rank") <= top).withColumn("rank", ranks).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language."""
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), worded AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces
), totals AS (
    SELECT lang, sum(len(w)) AS n FROM worded GROUP BY lang
), spots AS (
    SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, range(1, 6) AS t(k) WHERE len(w) >= k
), counted AS (
    SELECT lang, k, w[i:i + k - 1] AS p, count(*) AS f FROM spots GROUP BY ALL HAVING count(*) >= 100
), inner_parts AS (
    SELECT c.lang, c.p[i:j] AS p, max(c.f) AS f
    FROM counted c, range(1, 6) AS a(i), range(1, 6) AS b(j)
    WHERE j > i AND j <= c.k AND j - i + 1 < c.k GROUP BY ALL
), candidates AS (
    SELECT c.* FROM counted c LEFT JOIN inner_parts s ON s.lang = c.lang AND s.p = c.p AND 100 * s.f >= 100 * c.f
    WHERE c.k > 1 AND s.p IS NULL
), cuts AS (
    SELECT c.lang, c.p, c.f AS a, h.f AS l, t.f AS r, h.k AS cut, totals.n,
        (1000::HUGEINT * c.f * totals.n) // (h.f::HUGEINT * t.f) AS score
    FROM candidates c JOIN counted h ON h.lang = c.lang AND h.k < c.k AND h.p = c.p[1:h.k]
    JOIN counted t ON t.lang = c.lang AND t.k = c.k - h.k AND t.p = c.p[h.k + 1:c.k]
    JOIN totals ON totals.lang = c.lang
), best AS (
    SELECT *, array_to_string(p, ' ') AS phrase FROM cuts
    QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1
), ranked AS (
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""
